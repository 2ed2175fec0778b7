"""Content hashes and 64-bit perceptual hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUICK_BYTES = 4096
BUFFER = 65536


def quick_hash(content: Column) -> Column:
    """Of the first 4096 bytes; for grouping."""
    return F.sha2(F.substring(content.cast("binary"), 1, QUICK_BYTES), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


@F.pandas_udf(T.StringType())
def stored_quick_hash(content: pd.Series) -> pd.Series:
    """XXH64, seed 0, of the first 4096 bytes as 16 hexadecimal digits: equal to values stored elsewhere."""
    import xxhash

    return content.map(lambda b: None if b is None else xxhash.xxh64_hexdigest(bytes(b)[:QUICK_BYTES]))


@F.pandas_udf(T.StringType())
def stored_full_hash(content: pd.Series) -> pd.Series:
    """XXH64 chained over 64 KB reads: each read's digest seeds the next, the first seed is 0."""
    import xxhash

    def chain(b) -> str | None:
        if b is None:
            return None
        digest = 0
        for a in range(0, len(b), BUFFER):
            digest = xxhash.xxh64_intdigest(bytes(b[a : a + BUFFER]), seed=digest)
        return f"{digest:016x}"

    return content.map(chain)


def average_hash(cells: Column) -> Column:
    """64 bits of 64 cells, the first cell in the highest bit: set where a cell is above the mean.

    n * 64 > total is the same as n > mean, in whole numbers.
    """
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x)
    bits = F.transform(cells, lambda x, i: F.when(x * 64 > total, F.call_function("shiftleft", F.lit(1).cast("long"), 63 - i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(h: Column, n: int = 8) -> Column:
    """The hash's bytes, highest first, as an array of (band, value)."""
    width = 64 // n
    return F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(h, 64 - width * (i + 1)).bitwiseAND((1 << width) - 1).cast("int").alias("value")) for i in range(n)))
