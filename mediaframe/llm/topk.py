"""Exact top-k search by distributed histogram selection.

Scores are integer inner products of vectors quantised as floor(256 * x). For each block of queries
every candidate is scored; per-query histograms of the scores, summed over all partitions, locate
the bucket of the k-th value, which is refined until its width is 1 or few rows lie at or above its
lower edge. A last pass keeps the rows from that edge up and breaks ties by the smaller vec_id.

What is sent around is bounded: a block holds a fixed number of queries whatever the table's size,
and a partition reports at most k occupied buckets a query (the k-th value of the whole cannot lie
below the k-th value of a part) and at most k rows a query in the last pass, so a value shared by a
third of all rows costs no more than any other.

Inner products are exact: a pair whose norms multiply to less than 2^52 is scored in doubles, which hold all
its sums, others in 64-bit integers or, beyond 2^62, in integers of any size. Scores that a long cannot hold
saturate at its ends (+-(2^63 - 1)) and tie there.

Defined cases: an empty table or no query gives no rows; columns beside the key and the vector are left out,
whatever their names; vectors that are null or hold null, NaN or infinite components take no part, neither
as query as query nor as candidate, nor do those with a component whose scaled value no double holds; shorter vectors count as padded with zeros; a query's own row is every row
with its vec_id; query rows repeated with the same vector are one query, those that share an id and differ in their vectors
are queries of their own, each with its k rows; candidates repeated are returned as often as they stand; rows without vec_id are no queries and come last in ties.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaframe.llm.common import configure, materialize, read

SCHEMA = "query_id long, rank int, vec_id long, score long"
LAST = np.iinfo(np.int64).max
OWN = np.iinfo(np.int64).min  # stands for the score of a query's own row; no score is as low
EXACT, WHOLE = 2.0**52, 2.0**62


def quantised(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """vec_id, v: the rows that take part, components floor(scale * x)."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) == float("inf")))

    def down(x):  # doubles from 2^52 on are whole already, and floor() gives longs
        y = x.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return df.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(key).cast("long").alias("vec_id"), F.transform(F.col(vector), down).alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column as rows of a matrix, cut or padded to dims."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(ends)
    if (lengths == dims).all():
        return flat[ends[0] : ends[-1]].reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    for i, (a, n) in enumerate(zip(ends[:-1], lengths, strict=True)):
        out[i, : min(n, dims)] = flat[a : a + min(n, dims)]
    return out


def _scores(batch, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidate ids, scores as queries x candidates, own rows at OWN)."""
    vec = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
    got = inner(q, _matrix(batch.column(1), q.shape[1]))
    got[ids[:, None] == vec[None, :]] = OWN
    return vec, got


def inner(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, queries x candidates, within +-LAST."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms, mine = np.sqrt((q * q).sum(axis=1)), np.sqrt((m * m).sum(axis=1))
        most = norms.max(initial=0) * mine
    plain = most < EXACT
    if plain.all():
        return (q @ m.T).astype(np.int64)
    got = np.zeros((len(q), len(m)), np.int64)
    got[:, plain] = (q @ m[plain].T).astype(np.int64)
    whole = ~plain & (most < WHOLE)
    if whole.any():
        got[:, whole] = q.astype(np.int64) @ m[whole].astype(np.int64).T
    for j in np.flatnonzero(~plain & ~whole):
        with np.errstate(over="ignore", invalid="ignore"):
            small = norms * mine[j] < EXACT
        got[small, j] = (q[small] @ m[j]).astype(np.int64)
        column = [int(x) for x in m[j]]
        for i in np.flatnonzero(~small):
            got[i, j] = max(-LAST, min(LAST, sum(int(x) * y for x, y in zip(q[i], column, strict=True))))
    return got


def _histogram(vecs: DataFrame, ids: np.ndarray, q: np.ndarray, low: list[int], width: list[int], bins: int, k: int) -> dict:
    """(query index, bucket) -> count over all rows; a score past the last bucket's edge counts there."""
    import pyarrow as pa

    held = vecs.sparkSession.sparkContext.broadcast((ids, q, np.array(low, np.int64), np.array(width, np.uint64)))

    def go(batches):
        ids, q, low, width = held.value
        count = np.zeros((len(ids), bins), np.int64)
        for batch in batches:
            _, got = _scores(batch, ids, q)
            # differences may pass the long's range, but not that of the unsigned
            slot = np.minimum((got.view(np.uint64) - low.view(np.uint64)[:, None]) // width[:, None], np.uint64(bins - 1)).astype(np.int64)
            at = np.flatnonzero((got >= low[:, None]).ravel())
            count += np.bincount((slot + np.arange(len(ids))[:, None] * bins).ravel()[at], minlength=count.size).reshape(count.shape)
        above = count[:, ::-1].cumsum(axis=1)[:, ::-1] - count
        who, slot = np.nonzero((count > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array(slot, pa.int32()), pa.array(count[who, slot])], names=["q", "slot", "n"])

    found = vecs.mapInArrow(go, "q int, slot int, n long").groupBy("q", "slot").agg(F.sum("n").alias("n"))
    # Of the summed buckets of a query only those that reach down to its k-th value come to the driver.
    above = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("slot"))) - F.col("n")
    return {(r.q, r.slot): r.n for r in found.withColumn("above", above).where(F.col("above") < k).collect()}


def _select(vecs: DataFrame, ids: np.ndarray, q: np.ndarray, edge: list[int], k: int) -> DataFrame:
    """Rows with a score from the edge up; of a partition, the k best of each query."""
    import pyarrow as pa

    held = vecs.sparkSession.sparkContext.broadcast((ids, q, np.array(edge, np.int64)))

    def best(who, vec, score):
        order = np.lexsort((vec, -score, who))
        who, vec, score = who[order], vec[order], score[order]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        place = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
        return who[place < k], vec[place < k], score[place < k]

    def go(batches):
        ids, q, edge = held.value
        kept = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            vec, got = _scores(batch, ids, q)
            who, at = np.nonzero((got >= edge[:, None]) & (got > OWN))
            if len(who):
                kept = best(*(np.concatenate(x) for x in zip(kept, (who, vec[at], got[who, at]), strict=True)))
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[0].astype(np.int32)), pa.array(kept[1], mask=kept[1] == LAST), pa.array(kept[2])], names=["query_id", "query", "vec_id", "score"])

    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))  # not by query_id, which two queries may share
    return vecs.mapInArrow(go, "query_id long, query int, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_topk(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = 4096, bins: int = 256, slack: int = 4) -> DataFrame:
    """The k best candidates of every query row, by rank. is_query: a condition on vec_id.

    block: queries that are scored together, and so the bound on what is broadcast. slack: refinement
    ends when at most slack * k rows of a query lie from the current bucket up.
    """
    spark = df.sparkSession
    configure(spark)
    vecs = quantised(df, key, vector)
    asked = vecs.where(is_query).dropDuplicates(["vec_id", "v"])
    size = vecs.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    total = asked.count()
    results = []
    for b in range(max(1, -(-total // block)) if total else 0):
        n = -(-total // block)
        part = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)) == b) if n > 1 else asked
        rows = sorted({(r.vec_id, tuple(r.v)) for r in part.collect()})
        if not rows:
            continue
        ids = np.array([r[0] for r in rows], np.int64)
        q = np.zeros((len(rows), size[0]))
        for i, (_, v) in enumerate(rows):
            q[i, : len(v)] = v
        # Scores lie within the product of the norms.
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.sqrt((q * q).sum(axis=1)) * np.sqrt(size[1])
        reach = [int(x * 1.001) + 2 if x < WHOLE else int(LAST) for x in most]
        low, width = [-x for x in reach], [-(-(2 * x + 1) // bins) for x in reach]
        need = np.full(len(rows), k)
        while True:
            found = _histogram(vecs, ids, q, low, width, bins, k)
            by: dict[int, list] = {}
            for (i, slot), c in found.items():
                by.setdefault(i, []).append((slot, c))
            again = False
            for i in range(len(rows)):
                above = 0
                for slot, c in sorted(by.get(i, ()), reverse=True):
                    if above + c >= need[i]:
                        low[i] += slot * width[i]
                        fine = width[i] == 1 or above + c <= slack * k
                        # what lies above the bucket stays in its last finer bucket
                        width[i] = 1 if fine else max(1, -(-width[i] // (bins - 1)))
                        again |= not fine
                        break
                    above += c
            if not again:
                break
        results.append(_select(vecs, ids, q, low, k))
    if not results:
        return spark.createDataFrame([], SCHEMA)
    out = reduce(DataFrame.unionByName, results)
    return materialize(out, "topk") if len(results) > 16 else out


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op10_exact_topk": op10_exact_topk}
ORACLES = {"op10_exact_topk": SQL}
