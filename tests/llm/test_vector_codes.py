"""Product quantisation codes against plain rounds over integers of any size."""

import hashlib
import random

import numpy as np
import pytest
from oracle import both

from mediaframe.llm import queries, vector_codes
from mediaframe.llm.vector_codes import _down, _up, assign, encode, with_labels


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector) of equal lengths; codes and errors by row, and the entries."""
    import math

    ints = [(i, [math.floor(x * scale) for x in v]) for i, v in rows]
    width = len(ints[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in ints]
    order = sorted(range(len(ints)), key=lambda r: (ints[r][0] is None, ints[r]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))

    for turn in range(rounds + 1):
        found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [x[p] for x, f in zip(cut, found, strict=True) if f[p][1] == e]
                    if mine:
                        books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    text = ",".join(str(x) for b in books for c in b for x in c)
    return ["".join(f"{i:02x}" for _, i in f) for f in found], [sum(d for d, _ in f) for f in found], hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")  # code clashes with a column of the result


@pytest.mark.parametrize("kind", ["clustered", "grid", "wide", "huge"])
def test_equals_plain_rounds(spark, kind):
    rng = random.Random(kind)
    n, width = (90, 8) if kind == "huge" else (300, 8)
    size = {"clustered": 1, "grid": 0.01, "wide": 3e6, "huge": 1e25}[kind]
    centre = [[rng.uniform(-size, size) for _ in range(width)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, size / 30) for x in rng.choice(centre)]
        if kind == "grid":  # many equal distances
            v = [rng.randrange(-2, 3) / 1024 for _ in range(width)]
        rows.append((i * 3, v))
    rows += [(5, rows[5][1]), (7, rows[9][1])]
    entries = 24
    codes, books = encode(frame(spark, [(i, v, i % 3, "x") for i, v in rows]), entries=entries)
    got = sorted((r.vec_id, r.code, r.error) for r in codes.collect())
    code, error, sha = plain(rows, entries=entries)
    assert got == sorted((r[0], c, min(e, 2**63 - 1)) for r, c, e in zip(rows, code, error, strict=True))
    assert vector_codes.digest(books) == sha


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centre = rng.integers(-4000, 4000, (64, 16)).astype(float)
    x = centre[rng.integers(0, 64, 2000)] + rng.integers(-60, 60, (2000, 16))
    true = lambda c: ((x[:, None] - c[None]) ** 2).sum(2)
    half = lambda c: _down(((c[:, None] - c[None]) ** 2).sum(2)) / 2 * (1 - 1e-9)
    c = x[:64].copy()
    own, upper, lower = np.zeros(2000, np.int64), np.full(2000, np.inf), np.zeros((2000, 64))
    compared = []
    for _ in range(5):
        own, _, upper, lower, n = assign(x, c, own, upper, lower, half(c))
        d = true(c)
        assert (own == d.argmin(1)).all()
        packed, unit = vector_codes._pack(lower)
        lower = packed * unit[:, None]
        at = np.arange(2000)
        assert (lower**2 <= d * (1 + 1e-9)).all() and (upper**2 >= d[at, own] * (1 - 1e-12)).all()
        compared.append(n)
        new = np.array([np.floor(x[own == e].mean(0)) if (own == e).any() else c[e] for e in range(64)])
        moved, c = _up(((new - c) ** 2).sum(1)), new
        upper, lower = upper + moved[own], np.maximum(lower - moved, 0)
    assert 0.9 * 2000 * 63 < compared[0] < 2000 * 63 and compared[-1] < 0.05 * compared[0]  # most pairs are never compared


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), 1.0, -2.5, 0.1 * i], i % 2 if i % 3 else None, "x") for i in range(40)]
    bad = [(100, None, 1, "x"), (101, [1.0, None, 2.0, 3.0], 1, "x"), (102, [nan, 0.0, 0.0, 0.0], 1, "x"), (103, [inf, 0.0, 0.0, 0.0], 1, "x"), (104, [1e308, 0.0, 0.0, 0.0], 1, "x")]
    odd = [(105, [1.0, 2.0], 1, "x"), (None, [9.0, 9.0, 9.0, 9.0], None, "x")]
    rows = {r.vec_id: r for r in with_labels(encode(frame(spark, good + bad + odd))[0]).collect()}
    assert set(rows) == {*range(40), 105, None} and rows[105].code is None and rows[105].error is None
    code, error, _ = plain([(i, v) for i, v, *_ in good] + [(None, odd[1][1])])
    assert [rows[i].code for i in range(40)] == code[:40] and rows[None].code == code[40]
    by = {k: sum(e for (_, _, k2, _), e in zip(good, error, strict=False) if k2 == k) for k in (0, 1, None)}
    by[None] += error[40]
    assert all(rows[i].label_error == by[good[i][2]] for i in range(40))
    assert encode(frame(spark, good[:0]))[0].count() == 0 and encode(frame(spark, bad))[0].count() == 0
    assert {r.code for r in encode(frame(spark, [(1, [1.0, 2.0, 3.0], 0, "x")]))[0].collect()} == {None}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    ours, theirs = both(spark, queries.QUERIES, queries.ORACLES, "op13_elkan_vector_codes", f"/root/testdata/{sf}")
    assert ours == theirs
