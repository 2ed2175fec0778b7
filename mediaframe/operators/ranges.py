"""Runs of neighbouring rows in a whole sort order, without a window over a value or over the table.

Rows are dealt to ranges of the order, so a value that a third of all rows share lies in as many ranges as any third.
Each range is passed once, in order, which numbers its runs and the rows in them; then the ranges' edges, two runs
a range, are put together: a range goes on with the run of the one before where the break between them is none. What
is put together in one place has a row or two a range, and is broadcast: its size is bound by the number of ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.plans.storage import materialize

#: Columns that runs() adds beside the rows' own.
MADE = ["__part", "__run", "__place", "__head"]


def runs(df: DataFrame, by: list[str], order: list[str], step: str | None = None, most: int | None = None, partitions: int | None = None) -> DataFrame:
    """df with __part and __run, its range and the run within it; __place, the row's place in the whole run, from 0; and
    __head, the range and number under which the whole run begins.

    order: columns, with a "-" in front for downwards. A run ends where a ``by`` column changes, nulls being equal, or where the long column ``step`` grows by more than ``most``.
    The result is written down, since its ranges must not be drawn again.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    names, n = df.columns, len(df.columns)
    whole = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = df.withColumn("__by", whole)
    keys = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_first(c) for c in (*by, *order)]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    ordered = dealt.sortWithinPartitions(*keys)
    at = names.index(step) if step else None

    def go(batches: Iterator) -> Iterator:
        part, run, place, last_by, last = TaskContext.get().partitionId(), -1, 0, None, None
        for batch in batches:
            m = len(batch)
            if not m:
                continue
            group = batch.column(n).to_numpy(zero_copy_only=False)
            new = np.r_[group[0] != last_by, group[1:] != group[:-1]]
            if at is not None:
                x = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
                new |= np.r_[last is None or x[0] - last > most, x[1:] - x[:-1] > most]
                last = int(x[-1])
            number = run + np.cumsum(new)
            begins = np.flatnonzero(new)
            since = np.arange(m) - np.r_[0, begins][np.cumsum(new)]
            since[: begins[0] if len(begins) else m] += place
            run, place, last_by = int(number[-1]), int(since[-1]) + 1, group[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.full(m, part, np.int32)), pa.array(number.astype(np.int64)), pa.array(since.astype(np.int64)), batch.column(n)], names=[*names, *MADE[:3], "__by"])

    fields = T.StructType([*df.schema.fields, *T.StructType.fromDDL("__part int, __run long, __place long, __by string").fields])
    passed = materialize(ordered.mapInArrow(go, fields), "runs")
    edges = _edges(passed, step, most)
    joined = passed.join(F.broadcast(edges), ["__part", "__run"], "left")
    return joined.withColumn("__place", F.col("__place") + F.coalesce("__before", F.lit(0))).withColumn("__head", F.coalesce("__head", F.struct("__part", "__run"))).drop("__before", "__by")


def _edges(passed: DataFrame, step: str | None, most: int | None) -> DataFrame:
    """__part, __run, __head, __before of the runs that go on with one of an earlier range: where that one begins, and its rows before this range."""
    far = F.struct("__run", "__place")
    x = F.col(step) if step else F.lit(0).cast("long")
    ends = passed.groupBy("__part").agg(
        F.min_by(F.struct("__by", x.alias("x")), far).alias("first"), F.max_by(F.struct("__by", x.alias("x"), "__run", "__place"), far).alias("last"), F.count_if(F.col("__run") == 0).alias("head_rows")
    )
    chain = W.orderBy("__part")  # one row a range
    before = F.lag("last").over(chain)
    goes_on = before.isNotNull() & (before["__by"] == F.col("first")["__by"])
    if step:
        goes_on = goes_on & (F.col("first")["x"] - before["x"] <= most)
    marked = ends.withColumn("on", goes_on)
    # A run that spans ranges: it begins as the last run of a range, and covers whole ranges that are one run each.
    opens = F.when(~F.col("on") | (F.col("last")["__run"] > 0), F.col("__part"))
    head = F.last(opens, ignorenulls=True).over(chain.rowsBetween(W.unboundedPreceding, -1))
    spans = marked.withColumn("head_part", F.when(F.col("on"), head))
    heads = marked.select(F.col("__part").alias("head_part"), F.struct(F.col("__part"), F.col("last")["__run"].alias("__run")).alias("__head"), (F.col("last")["__place"] + 1).alias("open_rows"))
    inside = W.partitionBy("head_part").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    led = spans.where("on").withColumn("ahead", F.coalesce(F.sum("head_rows").over(inside), F.lit(0)))
    return led.join(heads, "head_part").select("__part", F.lit(0).cast("long").alias("__run"), "__head", (F.col("ahead") + F.col("open_rows")).alias("__before"))


def sizes(found: DataFrame, key: str) -> DataFrame:
    """found, the result of runs(), with run_size and run_first, the key of the run's first row.

    Rows learn them by their range and run, so however long a run is, a join key has no more rows than a range. Runs that
    span ranges are few, two a range at most.
    """
    local = found.groupBy("__head", "__part", "__run").agg(F.count("*").alias("n"), F.min_by(key, "__place").alias("k"), F.min("__place").alias("p"))
    crossing = local.where((F.col("__head")["__part"] != F.col("__part")) | (F.col("__head")["__run"] != F.col("__run"))).select("__head").distinct()
    among = local.join(F.broadcast(crossing), "__head", "left_semi")
    whole = among.groupBy("__head").agg(F.sum("n").alias("run_size"), F.min_by("k", "p").alias("run_first"))
    spanning = among.join(F.broadcast(whole), "__head").select("__part", "__run", "run_size", "run_first")
    alone = local.join(F.broadcast(crossing), "__head", "left_anti").select("__part", "__run", F.col("n").alias("run_size"), F.col("k").alias("run_first"))
    return found.join(alone.unionByName(spanning), ["__part", "__run"])


def pages(df: DataFrame, group: str, order: list[str], size: int, page: int | None = None, partitions: int | None = None) -> DataFrame:
    """df with place, from 0 in its group's order, and page, from 0; of one page only if asked.

    A page of a group of any length is found without the group in one place: places are counts per range and the place within.
    """
    found = runs(df, [group], order, partitions=partitions)
    paged = found.withColumn("place", F.col("__place")).withColumn("page", F.floor(F.col("__place") / size)).drop(*MADE)
    return paged if page is None else paged.where(F.col("page") == page)
