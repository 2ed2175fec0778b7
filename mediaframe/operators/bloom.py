"""Bloom filters as tables: bitmaps that partial aggregation builds and a broadcast join asks.

A filter is a table of at most ``MOST`` bits in bitmaps of 4 KB by number, so what is broadcast has a bound whatever is
in it. It is made with Spark's own bitmap aggregates, which merge bits before and after the shuffle, and asked by
column expressions; no row leaves the JVM. A key that was put in always passes. Of others a share passes that depends on
how many keys there are: about 2 in a hundred up to ``MOST`` / 10 keys, more beyond, so an exact test has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 18, 1 << 30  # bits
BITMAP = 1 << 15  # bits of a row
HASHES = 3


def _place(i: int, bits: int, keys: tuple[str, ...]) -> Column:
    """The i-th bit of a row's keys, null keys being as good as others."""
    return F.pmod(F.xxhash64(F.lit(i), *(F.col(k) for k in keys)), F.lit(bits))


def build(rows: DataFrame, *keys: str, bits: int | None = None) -> DataFrame:
    """bitmap_no, bits, total of a filter of all keys; about ten bits a key, between LEAST and MOST."""
    if bits is None:
        bits = min(MOST, max(LEAST, 1 << max(0, 10 * rows.count() - 1).bit_length()))
    at = rows.select(F.explode(F.array(*(_place(i, bits, keys) for i in range(HASHES)))).alias("at"))
    maps = at.groupBy(F.floor(F.col("at") / BITMAP).alias("bitmap_no")).agg(F.call_function("bitmap_construct_agg", F.pmod("at", F.lit(BITMAP))).alias("bits"))
    return maps.withColumn("total", F.lit(bits).cast("long"))


def passing(rows: DataFrame, bloom: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys the filter may hold."""
    bits = bloom.select(F.max("total")).first()[0]
    if bits is None:  # nothing was put in
        return rows.where(F.lit(False))
    maps = bloom.select("bitmap_no", F.col("bits").alias("__bits"))
    for i in range(HASHES):
        at = _place(i, bits, keys)
        named = maps.withColumnRenamed("bitmap_no", "__no").withColumnRenamed("__bits", "__map")
        byte = F.conv(F.hex(F.substring("__map", (F.pmod(at, F.lit(BITMAP)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
        joined = rows.join(F.broadcast(named), F.floor(at / BITMAP) == F.col("__no"))  # MOST / BITMAP rows of 4 KB at most
        rows = joined.where(held).drop("__no", "__map")
    return rows
