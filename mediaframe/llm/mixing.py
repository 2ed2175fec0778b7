"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into hash blocks and permuted. Its target says how many words the mix takes:
whole passes over its blocks, then every block of the permuted order that fits what is left when its
turn comes, and one more that fits the gap best. The numbers of blocks so drawn are exact quotas. A tree splits
them among the output shards: at each node the left half's share of every source is one draw from the
multivariate hypergeometric distribution of what the node holds. Shards then take disjoint runs of
each source's permuted blocks, and shuffle their rows by a hash of their own.

Only sums per source reach the driver. All choices are hashes or seeded draws, so reruns agree.

Defined cases: null text has size 0; null source is a source of its own that sorts last; an empty
source has target 0; repeated rows share a block and are taken alike; the empty table mixes to
itself; columns that the table has already are kept next to those asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.llm.common import aside, let_go, materialize, read

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCKS = 4096
SHARDS = 16
MAX_SOURCES = 200_000  # beyond this many sources the plan would no longer fit the driver: an error, nothing is dropped
BROADCAST_ROWS = 200_000  # rows of the block plan, of about 100 bytes, that are broadcast; more are joined by a shuffle


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take per source, given in order: shares by weight, cut at most * size, the excess shared again."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    full = [most * s for s in sizes]
    free = set(range(len(sizes)))
    left = min(share * sum(sizes), sum(full))
    while free:
        unit = left / sum(w[i] for i in free)
        over = [i for i in free if w[i] * unit >= full[i]]
        if not over:
            return [w[i] * unit if i in free else full[i] for i in range(len(sizes))]
        free.difference_update(over)
        left -= sum(full[i] for i in over)
    return full


def split(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source (columns) for each shard (rows); columns sum to the quota."""
    out = np.zeros((shards, len(quota)), np.int64)

    def node(held: np.ndarray, a: int, b: int) -> None:
        if b - a == 1 or not len(held):
            out[a] = held
            return
        mid = (a + b) // 2
        total = int(held.sum())
        take = total * (mid - a) // (b - a)
        left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(held, take, method="marginals")
        node(left, a, mid)
        node(held - left, mid, b)

    node(np.asarray(quota, np.int64), 0, shards)
    return out


def _coded(source: Column) -> Column:
    """Null last, else by code point."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def fitted(rows: DataFrame) -> DataFrame:
    """rows with whole: whether a block (words) still fits into its source's rest when the order comes to it.

    What is left shrinks only, so a block that was passed over would not fit at the end either.
    """
    import pyarrow as pa

    def go(batches):
        let_go()
        source, taken = None, 0
        for batch in batches:
            whole = []
            for k, words, rest in zip(*(batch.column(c).to_pylist() for c in ("k", "words", "rest")), strict=True):
                if k != source:
                    source, taken = k, 0
                fits = taken + words <= rest
                taken += words if fits else 0
                whole.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.bool_())], names=[*batch.schema.names, "whole"])

    return rows.repartition("k").sortWithinPartitions("k", "order", "block").mapInArrow(go, T.StructType([*rows.schema.fields, T.StructField("whole", T.BooleanType())]))


def plan(docs: DataFrame, shards: int = SHARDS, seed: int = 0, blocks: int = BLOCKS, weights: tuple = WEIGHTS) -> tuple[DataFrame, bool]:
    """(k, block) -> source_size, target and the draws of the block; whether it is small enough to broadcast."""
    spark = docs.sparkSession
    keyed = docs.select(*_keys(seed, blocks), _words().alias("size"))
    table = materialize(keyed.groupBy("k", "block").agg(F.sum("size").alias("words")), "mix-table")
    sources = sorted(((r.k, r.s, r.n) for r in table.groupBy("k").agg(F.sum("words").alias("s"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()))
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goals = targets([s for _, s, _ in sources], weights)
    passes = [min(int(t // s), 2) if s else 0 for (_, s, _), t in zip(sources, goals, strict=True)]
    rest = [t - p * s for (_, s, _), t, p in zip(sources, goals, passes, strict=True)]
    facts = spark.createDataFrame([(k, s, float(t), p, float(r), n) for (k, s, n), t, p, r in zip(sources, goals, passes, rest, strict=True)] or [("", 0, 0.0, 0, 0.0, 0)], "k string, source_size long, target double, passes int, rest double, n_blocks long")

    # The partial pass: blocks in permuted order wherever they fit, then the one that fits the gap best.
    placed = fitted(table.join(facts, "k").withColumn("order", F.xxhash64(F.lit(seed), F.col("passes"), "k", "block")))
    gap = F.col("rest") - F.sum(F.when(F.col("whole"), F.col("words")).otherwise(0)).over(W.partitionBy("k"))
    miss = F.when(~F.col("whole") & (F.col("words") > 0) & (F.abs(F.col("gap") - F.col("words")) < F.col("gap")), F.abs(F.col("gap") - F.col("words")))
    closing = (F.row_number().over(W.partitionBy("k").orderBy(F.asc_nulls_last("miss"), "block")) == 1) & F.col("miss").isNotNull()
    placed = placed.withColumn("gap", gap).withColumn("miss", miss).withColumn("partial", (F.col("whole") & (F.col("words") > 0)) | closing)
    placed = materialize(placed.select("k", "block", "source_size", "target", "passes", "partial"), "mix-blocks")

    draws = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((F.col("pass") < F.col("passes")) | (F.col("pass") == F.col("passes")) & F.col("partial"))
    order = W.partitionBy("k").orderBy("pass", F.xxhash64(F.lit(seed), F.col("pass"), "k", "block"), "block")
    draws = materialize(draws.select("k", "block", "pass", (F.row_number().over(order) - 1).alias("place")), "mix-draws")
    quota = {r.k: r.n for r in draws.groupBy("k").agg(F.count("*").alias("n")).collect()}
    dealt = split(np.array([quota.get(k, 0) for k, _, _ in sources], np.int64), shards, seed)
    ends = dealt.cumsum(axis=0)
    runs = [(k, s, int(ends[s, i] - dealt[s, i]), int(ends[s, i])) for i, (k, _, _) in enumerate(sources) for s in range(shards) if dealt[s, i]]
    shard = spark.createDataFrame(runs or [("", 0, 0, 0)], "k string, shard int, first long, last long")
    owned = draws.join(shard, "k").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("last")))
    per_block = owned.groupBy("k", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    done = materialize(placed.select("k", "block", "source_size", "target").join(per_block, ["k", "block"], "left"), "mix-plan")
    return done, sum(n for _, _, n in sources) <= BROADCAST_ROWS


def _words() -> Column:
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _keys(seed: int, blocks: int) -> list[Column]:
    k = _coded(F.col("source"))
    return [k.alias("k"), F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), k), F.lit(blocks)).cast("int").alias("block")]


def _drawn(docs: DataFrame, shards: int, seed: int, blocks: int, weights: tuple) -> DataFrame:
    """docs with __mix: source_size, target and the draws of the row's block."""
    made, small = plan(docs, shards, seed, blocks, weights)
    held = made.select(F.col("k").alias("__k"), F.col("block").alias("__block"), F.struct("source_size", "target", "draws").alias("__plan"))
    k, block = _keys(seed, blocks)
    rows = docs.withColumns({"__k": k, "__block": block}).join(F.broadcast(held) if small else held, ["__k", "__block"])
    draws = F.coalesce(F.col("__plan.draws"), F.array())
    return rows.withColumn("__mix", F.struct(F.col("__plan.source_size").alias("source_size"), F.col("__plan.target").alias("target"), draws.alias("draws"))).drop("__k", "__block", "__plan")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 0, blocks: int = BLOCKS, weights: tuple = WEIGHTS) -> DataFrame:
    """The mixed rows: docs' columns, once per draw, with __shard and __place, the shuffled order in a shard."""
    rows = _drawn(docs, shards, seed, blocks, weights).withColumn("__draw", F.explode("__mix.draws"))
    place = F.xxhash64(F.lit(seed), F.col("__draw.shard"), F.col("__draw.pass"), F.col("doc_id"))
    return rows.withColumns({"__shard": F.col("__draw.shard"), "__place": place}).drop("__mix", "__draw")


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs' columns of the mix, dealt out by shard and shuffled within each."""
    docs, renamed = aside(docs, "doc_id", "text", "source")
    shards = max(SHARDS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = mix(docs, shards, seed)
    return renamed(rows.repartitionById(shards, F.col("__shard").cast("int")).sortWithinPartitions("__shard", "__place"))


def report(docs: DataFrame, shards: int = SHARDS, seed: int = 0, blocks: int = BLOCKS, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards: what the mix takes of every row, and the output shards that draw it.

    A row that two draws take counts twice, in the shards that the splitting tree gives those draws.
    """
    docs = docs.select("doc_id", "text", "source")
    rows = _drawn(docs, shards, seed, blocks, weights)
    return rows.select("doc_id", _words().alias("size"), "__mix").select("doc_id", "size", "__mix.source_size", "__mix.target", (F.col("size") * F.size("__mix.draws")).alias("taken"), F.array_join(F.transform("__mix.draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))


def op3_mixing_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))


QUERIES = {"op3_mixing_splitting_tree": op3_mixing_splitting_tree}
ORACLES: dict[str, str] = {}
