"""Quiet-gap batches with state and timers, and the bounded log."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from mediaframe.plans.versions import Store
from mediaframe.streaming import watch

T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(milliseconds=ms), k, p) for i, ms, k, p in rows], watch.EVENT)


def test_joined_is_the_same_for_every_split():
    rng = np.random.default_rng(1)
    for _ in range(50):
        us = rng.integers(0, 5000, 60)
        flags = rng.random(60) < 0.2
        parts = np.array_split(rng.permutation(60), rng.integers(1, 9))
        some = [watch.joined(us[p], us[p], np.ones(len(p), int), flags[p], 40) for p in parts]
        got = watch.joined(*(np.concatenate(x) for x in zip(*some, strict=True)), 40)
        want = watch.joined(us, us, np.ones(60, int), flags, 40)
        assert all((a == b).all() for a, b in zip(got, want, strict=True)) and got[2].sum() == 60
    assert len(watch.joined(*(np.zeros(0, int),) * 4, 40)[0]) == 0


def test_quiet_stream_closes_the_last_batch(spark, tmp_path):
    rng = random.Random(2)
    at, rows = 0, []
    for i in range(300):
        at += rng.choice([10, 50, 400, 500, 501, 900])
        rows.append((i, at, rng.choice(["create", "modify", "remove", "remove", "other"]), [f"/{i}", "/x"][: 1 + i % 2]))
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    frame(spark, rows[:1]).limit(0).write.parquet(src)

    def run(part):
        query = watch.start(watch.quiet_stream(watch.events(spark, src), late="2 seconds", idle="1 seconds"), out, check, once=False)
        try:
            frame(spark, part).repartition(4).write.mode("append").parquet(src)
            watch.settle(query, "1 seconds")
        finally:
            query.stop()

    got = lambda: sorted((r.started, r.ended, r.n, r.rescan) for r in spark.read.parquet(out).collect())
    want = lambda part: sorted((r.started, r.ended, r.n, r.rescan) for r in watch.quiet_batches(frame(spark, part)).collect())
    # A cut at a gap over the limit: what is open is closed by the timer before the next part comes, after a restart.
    cut = next(i for i in range(150, 300) if rows[i][1] - rows[i - 1][1] > 500 and rows[i][2] != "other" and rows[i - 1][2] != "other")
    run(rows[:cut])
    assert got() == want(rows[:cut])
    run(rows[cut:])
    assert got() == want(rows)


def test_quiet_stream_by_folder(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    frame(spark, [(i, i * 300, "create", [f"/{'ab'[i % 2]}/x"]) for i in range(8)]).write.parquet(src)
    batches = watch.quiet_stream(watch.events(spark, src), idle="1 seconds", folder=F.substring(F.col("paths")[0], 1, 2))
    query = watch.start(batches, out, check, once=False)
    try:
        watch.settle(query, "1 seconds")
    finally:
        query.stop()
    # 600 ms within a folder: each event is a batch of its own; over both folders they would be one
    assert sorted((r.folder, r.n) for r in spark.read.parquet(out).collect()) == [("/a", 1)] * 4 + [("/b", 1)] * 4


def test_ring(spark, tmp_path):
    store, src = Store(spark, f"file://{tmp_path}/store"), str(tmp_path / "src")
    ids = lambda: sorted(r.event_id for r in store.table("recent").collect())
    run = lambda check: watch.record(store, watch.events(spark, src, 1), f"{tmp_path}/{check}", n=5).awaitTermination(120)
    for a, b in ((0, 3), (3, 12), (12, 14)):
        frame(spark, [(i, i, "create", ["/x"]) for i in range(a, b)]).coalesce(1).write.mode("append").parquet(src)
        run("check")
        assert ids() == list(range(max(0, b - 5), b))
    version = store.manifest()["version"]
    run("check")  # nothing new after a restart
    run("again")  # the same three batches with their numbers, from an empty checkpoint
    assert store.manifest()["version"] == version and [r.event_id for r in watch.latest(store.table("recent"), 2).collect()] == [12, 13]
