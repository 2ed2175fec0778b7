"""Bloom filters: nothing that was put in is lost, few others pass, and the funnel hashes survivors only."""

import hashlib

import pytest
from pyspark.sql import functions as F

from mediaframe.operators import bloom, duplicates


@pytest.mark.parametrize("n", [1, 100, 50_000])
def test_no_key_is_lost_and_few_pass(spark, n):
    rows = spark.range(n).select((F.col("id") * 3).alias("a"), F.concat(F.lit("k"), "id").alias("b"))
    held = bloom.build(rows, "a", "b")
    assert bloom.passing(rows, held, "a", "b").count() == n
    others = spark.range(20_000).select((F.col("id") * 3 + 1).alias("a"), F.lit("k").alias("b"))
    assert bloom.passing(others, held, "a", "b").count() < 600
    assert held.count() <= bloom.LEAST * 4 / bloom.BITMAP


def test_edges(spark):
    rows = spark.createDataFrame([(1, None), (None, "x"), (None, None)], "a long, b string")
    held = bloom.build(rows, "a", "b")
    assert bloom.passing(rows, held, "a", "b").count() == 3
    assert bloom.passing(rows, bloom.build(rows.limit(0), "a", "b"), "a", "b").count() == 0
    assert bloom.passing(rows, bloom.build(rows, "a", bits=64), "a").count() == 3  # a full filter loses nothing


def test_funnel_reads_survivors_only(spark, monkeypatch):
    quick, full = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(total, hashed):
        @F.udf("string")
        def f(b):
            total.add(1)
            return hashlib.sha256(hashed(bytes(b))).hexdigest()

        return f.asNondeterministic()

    first, whole = counting(quick, lambda b: b[:4096]), counting(full, lambda b: b)
    monkeypatch.setattr(duplicates.hashing, "quick_hash", lambda c: first(c.cast("binary")))
    monkeypatch.setattr(duplicates.hashing, "full_hash", lambda c: whole(c.cast("binary")))
    # 3000 sizes, most of them of one file; 40 pairs of equal size, 10 of them equal
    lone = [(i, "x" * (10_000 + i)) for i in range(3000)]
    pairs = [(5000 + 2 * i + j, ("y" if i < 10 or j else "z") * (20_000 + i)) for i in range(40) for j in (0, 1)]
    files = spark.createDataFrame([(k, len(c), c) for k, c in lone + pairs], "id long, file_size long, content string")
    out = {(r.group_id, r.id) for r in duplicates.exact_groups(files, floor=0).collect()}
    assert out == {(5000 + 2 * i, 5000 + 2 * i + j) for i in range(10) for j in (0, 1)}
    # The quick hash is made twice, for the filter and for the rows; a few lone sizes pass the filter by chance.
    assert 2 * 80 <= quick.value < 2 * 80 + 100 and 20 <= full.value < 30
