"""The two farthest of each group's 64-bit hashes, without comparing all pairs of a group.

Three sweeps (the farthest from the smallest hash, the farthest from that, and once more) give a distance that is reached,
and pivots. Groups in which no more bits vary than that distance are done. The others are cut into blocks by their distances to
two pivots; two blocks are compared only if they could hold a pair that is farther apart:

- by the triangle inequality, d(x, y) <= d(x, p) + d(p, y), and for the pivot's complement 128 - d(x, p) - d(p, y);
- by the bits on which all of both blocks agree.

A block holds a bounded number of hashes and pairs of blocks are dealt over the tasks, so neither a task nor a row grows with
the group. Where hashes are spread so evenly that no bound helps, all blocks are compared, in NumPy, a nanosecond or so a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.hashing import hamming
from mediaframe.plans.storage import materialize, release

BLOCK = 1024
SWEEPS = 3


def _sweeps(rows: DataFrame) -> DataFrame:
    """label, n, every, some (bits that all and that any member has), p0, p1, low: two pivots and the largest distance met."""
    found = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("p0"), F.bit_and("h").alias("every"), F.bit_or("h").alias("some"))
    found = found.select("*", F.col("p0").alias("p"), F.lit(0).alias("low"))
    for i in range(SWEEPS):
        far = rows.join(found.select("label", "p"), "label").groupBy("label").agg(F.max(F.struct(hamming(F.col("h"), F.col("p")).alias("d"), "h")).alias("far"))
        last, held = found, [] if i == 0 else ["p1"]
        found = last.join(far, "label").select("label", "n", "every", "some", "p0", *held, *([F.col("far.h").alias("p1")] if i == 0 else []), F.col("far.h").alias("p"), F.greatest("low", "far.d").alias("low"))
        found = materialize(found, "sweeps")
        if i:
            release(last)
    return found.drop("p")


def _bound() -> Column:
    """No member of block x is farther than this from one of block y."""
    reach = [b for i in (0, 1) for b in (F.col(f"x.hi{i}") + F.col(f"y.hi{i}"), 128 - F.col(f"x.lo{i}") - F.col(f"y.lo{i}"))]
    both = F.col("x.every").bitwiseAND(F.col("y.every")).bitwiseOR(F.bitwise_not(F.col("x.some").bitwiseOR(F.col("y.some"))))
    return F.least(*reach, 64 - F.bit_count(both))


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The farthest pair of each pair of blocks; those that cannot beat what the task has met in their group are passed over."""
    label, best = None, 0
    for pdf in batches:
        found = []
        for row in pdf.itertuples(index=False):
            if row.label != label:
                label, best = row.label, row.low
            if row.bound > best:
                x, y = np.asarray(row.x, np.int64).view(np.uint64), np.asarray(row.y, np.int64).view(np.uint64)
                best = max(best, max(int(np.bitwise_count(x[i : i + 256, None] ^ y).max()) for i in range(0, len(x), 256)))
                found.append((label, best))
        yield pd.DataFrame({"label": [f[0] for f in found], "far": np.array([f[1] for f in found], np.int32)})


def farthest(rows: DataFrame, label: str = "label", h: str = "h", block: int = BLOCK) -> DataFrame:
    """label, far: the largest Hamming distance of any two hashes with a label, 0 where there is one hash only.

    Null hashes and null labels take no part; repeated rows count once. block: hashes that are compared at a time.
    """
    rows = materialize(rows.select(F.col(label).alias("label"), F.col(h).alias("h")).dropna().distinct(), "hashes")
    swept = _sweeps(rows)
    varying = F.bit_count(F.col("every").bitwiseXOR(F.col("some")))
    left = swept.where((F.col("n") > 2) & (varying > F.col("low")))  # two hashes are compared by the first sweep

    d = rows.join(left.select("label", "n", "low", "p0", "p1"), "label").withColumns({f"d{i}": hamming(F.col("h"), F.col(f"p{i}")) for i in (0, 1)})
    cell = F.when(F.col("n") <= block, 0).otherwise(F.col("d0") * 16 + F.shiftright("d1", 3))
    d = d.withColumn("cell", cell.cast("long"))
    counts = d.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).alias("pieces"))
    d = d.join(counts, ["label", "cell"]).withColumn("block", F.call_function("shiftleft", F.col("cell"), F.lit(32)) + F.pmod(F.xxhash64("h"), "pieces"))
    spans = [f(f"d{i}").alias(f"{name}{i}") for i in (0, 1) for name, f in (("lo", F.min), ("hi", F.max))]
    blocks = materialize(d.groupBy("label", "block").agg(F.first("low").alias("low"), F.collect_list("h").alias("hs"), F.bit_and("h").alias("every"), F.bit_or("h").alias("some"), *spans), "blocks")

    x, y = blocks.drop("hs").alias("x"), blocks.drop("hs").alias("y")
    pairs = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.block") <= F.col("y.block")))
    pairs = pairs.select(F.col("x.label").alias("label"), F.col("x.block").alias("bx"), F.col("y.block").alias("by"), F.col("x.low").alias("low"), _bound().alias("bound")).where("bound > low")
    pairs = pairs.join(blocks.select("label", F.col("block").alias("bx"), F.col("hs").alias("x")), ["label", "bx"]).join(blocks.select("label", F.col("block").alias("by"), F.col("hs").alias("y")), ["label", "by"])
    kind, session = dict(rows.dtypes)["label"], rows.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.repartition(tasks, "label", "bx", "by")  # few bytes, much work: not to be put together again
    met = dealt.select("label", "low", "bound", "x", "y").sortWithinPartitions("label", F.desc("bound")).mapInPandas(_compare, f"label {kind}, far int")
    met = materialize(met.groupBy("label").agg(F.max("far").alias("far")), "farthest")
    out = materialize(swept.select("label", "low").join(met, "label", "left").select("label", F.greatest("low", "far").alias("far")), "diameters")
    release(rows, swept, blocks, met)
    return out
