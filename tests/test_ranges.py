"""Runs, sessions and pages over range partitions against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mediaframe.operators import bursts, duplicates, ranges

T0 = dt.datetime(2024, 1, 1)


def plain_sessions(rows, gap, least):
    """rows: (by, time, key); key -> (first, size)."""
    out, run = {}, []

    def close():
        if len(run) >= least:
            out.update({k: (run[0][2], len(run)) for _, _, k in run})

    for r in sorted(rows, key=lambda r: ((r[0] is not None, r[0]), r[1], r[2])):
        if run and (r[0] != run[-1][0] or int((r[1] - run[-1][1]).total_seconds()) > gap):
            close()
            run = []
        run.append(r)
    close()
    return out


@pytest.mark.parametrize("partitions", [1, 3, 8, 40])
@pytest.mark.parametrize("kind", ["mixed", "one session", "ties", "apart"])
def test_sessions(spark, kind, partitions):
    rng = random.Random(kind)
    at, rows = 0, []
    for i in range(150):
        at += {"mixed": rng.choice([0, 900, 5_000, 5_999, 6_000, 20_000]), "one session": 1000, "ties": 0, "apart": 60_000}[kind]
        rows.append((rng.choice([None, "a", "b"]), T0 + dt.timedelta(milliseconds=at), i * 7 % 150, "x"))
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, ("a", None, 999, "x")], "who string, t timestamp_ntz, id long, run_size string")
    df = df.withColumnRenamed("run_size", "note")
    for by in ([], ["who"]):
        got = {r.id: (r.first_id, r.session_size) for r in bursts.sessions(df, "t", "id", 5, 2, by, partitions).collect()}
        assert got == plain_sessions([(w if by else None, t, k) for w, t, k, _ in rows], 5, 2)
    assert bursts.sessions(df.limit(0), "t", "id").count() == 0


def test_one_hour_of_all_rows_is_spread(spark):
    rows = spark.range(20_000).select("id", (F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id % 100 * 36.0)")).alias("t"))
    out = bursts.sessions(rows, "t", "id", 60, partitions=8)
    assert out.count() == 20_000 and out.agg(F.min("session_size"), F.min("first_id"), F.max("first_id")).first() == (20_000, 0, 0)
    found = ranges.runs(rows.withColumn("us", F.unix_micros(F.col("t").cast("timestamp"))), [], ["us", "id"], "us", 60_999_999, partitions=8)
    each = [r["count"] for r in found.groupBy("__part").count().collect()]
    assert len(each) == 8 and max(each) < 2 * min(each)


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_pages_of_groups(spark, partitions):
    rng = random.Random(3)
    rows = [("big" if i % 2 else rng.choice(["a", "b", None]), rng.randrange(40), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = {r.id: (r.place, r.page) for r in ranges.pages(df, "g", ["v", "id"], 30, partitions=partitions).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r[2]] = (place, place // 30)
    assert got == want
    some = ranges.pages(df, "g", ["v", "id"], 30, page=2, partitions=partitions)
    assert {r.id for r in some.collect()} == {k for k, (_, p) in want.items() if p == 2}


def test_group_pages(spark):
    members = spark.createDataFrame([(i % 3 % 2, i, i == 0) for i in range(50)], "group_id long, media_id long, is_preferred boolean")
    media = spark.range(50).select("id", F.concat(F.lit("/"), "id").alias("file_path"), (F.col("id") * 2).alias("file_size"))
    out = {(r.group_id, r.page): r for r in duplicates.group_pages(members, media, 10).collect()}
    ids = [i for i in range(50) if i % 3 % 2 == 0]
    assert [m.media_id for m in out[(0, 1)].members] == ids[10:20] and out[(0, 3)].n == len(ids) == 33 and len(out[(0, 3)].members) == 3
    assert [r.page for r in duplicates.group_pages(members, media, 10, page=1).collect()] == [1, 1]
