import numpy as np
import pandas as pd
import pytest
from oracle import both

from mediaframe import queries
from mediaframe.operators import diameter, duplicates


def brute(h: np.ndarray) -> int:
    u = np.unique(np.asarray(h, np.int64)).view(np.uint64)
    return max(int(np.bitwise_count(u[i : i + 512, None] ^ u).max()) for i in range(0, len(u), 512))


def chain(rng, n, flips):
    """A walk that changes some bits a step."""
    out, x = [], 0
    for _ in range(n):
        for b in rng.integers(0, 64, flips):
            x ^= 1 << int(b)
        out.append(x)
    return np.array(out, np.uint64).view(np.int64)


def near(rng, n, bits):
    """Hashes that differ from one in some bits."""
    masks = np.zeros(n, np.uint64)
    for _ in range(bits):
        masks |= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return (masks ^ np.uint64(0xDEADBEEF12345678)).view(np.int64)


def frame(spark, groups):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"label": g, "h": h}) for g, h in groups.items()]))


@pytest.mark.parametrize("block", [3, 64, 1024])
def test_farthest_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    n = 300 if block == 3 else 2500
    groups = {1: chain(rng, n, 1), 2: chain(rng, n, 3), 3: near(rng, n, 4), 4: rng.integers(-(2**63), 2**63, n), 5: np.array([7]), 6: np.array([0, -1]), 7: np.array([3, 3, 5, 9]), 8: np.arange(40)}
    got = {r.label: r.far for r in diameter.farthest(frame(spark, groups), block=block).collect()}
    assert got == {g: brute(h) for g, h in groups.items()}


def test_one_cluster_of_100000(spark):
    rng = np.random.default_rng(6)
    h = near(rng, 120_000, 9)
    assert len(np.unique(h)) > 100_000
    assert [(r.label, r.far) for r in diameter.farthest(frame(spark, {1: h})).collect()] == [(1, brute(h))]


def test_bounds_leave_blocks_out(spark, monkeypatch):
    """In a tight cloud with one far member only blocks that reach as far are compared."""
    rng = np.random.default_rng(7)
    h = np.concatenate([near(rng, 3000, 3), np.array([0xDEADBEEF12345678 ^ (2**30 - 1)], np.uint64).view(np.int64)])
    seen = spark.sparkContext.accumulator(0)
    compare = diameter._compare

    def counted(batches):
        def tee():
            for pdf in batches:
                seen.add(int((pdf["x"].str.len() * pdf["y"].str.len()).sum()))
                yield pdf

        yield from compare(tee())

    monkeypatch.setattr(diameter, "_compare", counted)
    assert diameter.farthest(frame(spark, {1: h}), block=128).first().far == brute(h)
    assert seen.value < len(np.unique(h)) ** 2 / 10


def test_text_labels_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 12), (None, 3), ("b", None), ("c", 4)], "label string, h long")
    assert {r.label: r.far for r in diameter.farthest(df).collect()} == {"a": 3, "c": 0}
    assert diameter.farthest(df.limit(0)).count() == 0
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "node long, label long")
    hashes = spark.createDataFrame([(1, 0), (2, 1), (3, None), (9, None)], "id long, phash long")
    assert [(r.cluster, r.n, r.score) for r in duplicates.cluster_scores(clusters, hashes).collect()] == [(1, 3, 1 - 1 / 64)]


def test_scores_equal_sql(spark):
    ours, theirs = both(spark, queries.QUERIES, queries.ORACLES, "similar_scores")
    assert ours == theirs
