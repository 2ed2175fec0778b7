"""Change streams: quiet-gap batches of file events, rescan signals, snapshot polls, run logs."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from mediaframe.operators.sync import snapshot_changes
from mediaframe.plans.versions import Store

EVENT = "event_id long, ts timestamp, kind string, paths array<string>"
KINDS = ("create", "modify", "remove")
QUIET = "500 milliseconds"


def events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of change records from files that appear below path."""
    reader = spark.readStream.schema(EVENT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def flat(changes: DataFrame, *more: str) -> DataFrame:
    """event_id, ts, kind, path: one row per path of the kinds that matter."""
    return changes.where(F.col("kind").isin(*KINDS)).select("event_id", "ts", "kind", F.explode("paths").alias("path"), *more)


def quiet_batches(changes: DataFrame, quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """started, ended, n, rescan: batches that a quiet gap ends; rescan if a file came or changed.

    The whole stream is one sequence of batches, as the gap is between any two events. Partial
    aggregation merges sessions before the shuffle, so what meets in one place is sessions, not events.
    """
    window = F.session_window("ts", quiet)
    one = F.pmod(F.coalesce("event_id", F.lit(0)), F.lit(1))  # sessions need a key that is not a constant
    rows = flat(changes).withWatermark("ts", late).groupBy(window.alias("w"), one.alias("stream")).agg(F.count("*").alias("n"), F.max(F.col("kind").isin("create", "modify")).alias("rescan"))
    return rows.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "rescan")


def _span(text: str) -> int:
    """Microseconds of an interval such as "500 milliseconds"."""
    return int(pd.Timedelta(text).total_seconds() * 1e6)


def joined(start: np.ndarray, end: np.ndarray, n: np.ndarray, rescan: np.ndarray, quiet: int) -> tuple[np.ndarray, ...]:
    """Stretches of events joined where the gap between them is at most quiet, in order of time.

    Any split of the events into stretches comes to the same: stretches of parts of a stream can be joined to those of all.
    """
    order = np.argsort(start, kind="stable")
    start, end, n, rescan = start[order], end[order], n[order], rescan[order]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, start[1:] - reach[:-1] > quiet]) if len(start) else np.zeros(0, int)
    if not len(first):
        return start, end, n, rescan
    return start[first], np.maximum.reduceat(end, first), np.add.reduceat(n, first), np.logical_or.reduceat(rescan, first)


PART = "folder string, start long, end long, n long, rescan boolean"
CLOSED = "folder string, started timestamp, ended timestamp, n long, rescan boolean"


def stretches(rows: DataFrame, quiet: int) -> DataFrame:
    """rows: folder, us, rescan. Each task joins what it reads to stretches, batch by batch, and no event leaves it."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, part in pdf.groupby("folder", sort=False):
                us = part["us"].to_numpy()
                start, end, n, rescan = joined(us, us, np.ones(len(us), np.int64), part["rescan"].to_numpy(bool), quiet)
                yield pd.DataFrame({"folder": folder, "start": start, "end": end, "n": n, "rescan": rescan})

    return rows.mapInPandas(go, PART)


class QuietGap(StatefulProcessor):
    """A folder's open stretches, and a timer that closes them when no event comes for a while."""

    def __init__(self, quiet: int, late: int, idle: int):
        self.quiet, self.late, self.idle = quiet, late, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, end long, n long, rescan boolean")
        self.seen = handle.getValueState("seen", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, seen = list(self.open.get()), self.seen.get()[0] if self.seen.exists() else None
        new = pd.concat([pdf[["start", "end", "n", "rescan"]] for pdf in rows])
        if seen is not None:
            new = new[new["end"] + self.quiet >= seen - self.late]
        every = pd.concat([pd.DataFrame(held, columns=["start", "end", "n", "rescan"]).astype(new.dtypes), new])
        start, end, n, rescan = joined(*(every[c].to_numpy() for c in ("start", "end", "n", "rescan")), self.quiet)
        if len(end):
            seen = max(int(end.max()), seen if seen is not None else int(end.max()))
            self.seen.update((seen,))
            done = end + self.quiet < seen - self.late
            self._keep(start[~done], end[~done], n[~done], rescan[~done])
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle // 1000)
            yield self._rows(key, start[done], end[done], n[done], rescan[done])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.open.get())
        if held:
            self.open.clear()
            yield self._rows(key, *(np.array(x) for x in zip(*held, strict=True)))

    def close(self) -> None:
        pass

    def _keep(self, *columns: np.ndarray) -> None:
        self.open.clear()
        if len(columns[0]):
            self.open.put([tuple(x.item() for x in row) for row in zip(*columns, strict=True)])

    def _rows(self, key, start, end, n, rescan) -> pd.DataFrame:
        at = lambda us: pd.to_datetime(us, unit="us", utc=True)
        return pd.DataFrame({"folder": key[0], "started": at(start), "ended": at(end + self.quiet), "n": n, "rescan": rescan})


def quiet_stream(changes: DataFrame, quiet: str = QUIET, late: str = "10 seconds", idle: str | None = None, folder: Column | None = None) -> DataFrame:
    """folder, started, ended, n, rescan: batches as quiet_batches() has them, of each watched folder, and none stays open.

    A batch is closed by an event that is ``late`` and a quiet gap after it, or, where no event follows at all, by a
    timer ``idle`` (quiet and late together unless given) after the last one came. Events that come more than ``late``
    behind the newest are left out. Tasks join their events to stretches first, so a folder's state meets stretches, however many events come.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q, d = _span(quiet), _span(late)
    rows = flat(changes.withColumn("__folder", F.lit("") if folder is None else folder), "__folder")
    rows = rows.where("ts is not null").select(F.coalesce(F.col("__folder"), F.lit("")).alias("folder"), F.unix_micros("ts").alias("us"), F.col("kind").isin("create", "modify").alias("rescan"))
    processor = QuietGap(q, d, _span(idle) if idle else q + d)
    return stretches(rows, q).groupBy("folder").transformWithStateInPandas(processor, CLOSED, "Append", "ProcessingTime")


def settle(query: StreamingQuery, idle: str, most: float = 300) -> None:
    """Wait until all there is has been read and every batch that was open then has been closed by its timer."""
    # With timers there is always another batch, so processAllAvailable() would not return. The first batch after a restart
    # may repeat one that was planned before, without a look at the source; the second of two empty ones has had it.
    asked, span, known = time.time(), _span(idle) / 1e6, {}
    while time.time() < asked + span + most:
        if query.exception() or not query.isActive:
            raise RuntimeError(str(query.exception() or "the stream has stopped"))
        known |= {p["batchId"]: (pd.Timestamp(p["timestamp"]).timestamp(), p["numInputRows"]) for p in query.recentProgress}
        empty: list[float] = []
        for _, (began, n) in sorted(known.items()):
            empty = [] if n else [*empty, began] if began >= asked else empty
        if len(empty) > 1 and empty[-1] >= empty[1] + span:
            return
        time.sleep(0.1)
    raise TimeoutError("the stream did not settle")


def start(batches: DataFrame, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write finished batches as Parquet, exactly once by the checkpoint. A stream with timers runs on (once=False)."""
    writer = batches.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


RING = 10_000


def ring(store: Store, batch: DataFrame, number: int, source: str = "watch", n: int = RING, at: str = "ts", key: str = "event_id") -> int:
    """The log of the n newest events after a batch, as the store's table ``recent``: older ones leave it, a repeated batch changes nothing.

    Each task keeps at most n rows of the batch, so what comes together is bounded whatever comes in.
    """
    store.create("recent", key, EVENT, buckets=1)
    news = batch.orderBy(F.desc(at), F.desc(key)).limit(n)
    return store.commit(source, number, {"recent": ([0], latest(store.table("recent").unionByName(news.select(*store.table("recent").columns)), n, at, key))})


def record(store: Store, changes: DataFrame, checkpoint: str, n: int = RING) -> StreamingQuery:
    return changes.writeStream.foreachBatch(lambda batch, number: ring(store, batch, number, n=n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(log: DataFrame, n: int = 100, at: str = "ts", key: str = "event_id") -> DataFrame:
    """The newest n events, newest last."""
    return log.orderBy(F.desc(at), F.desc(key)).limit(n).orderBy(at, key)


def poll(snapshots: DataFrame, key: str, store: str, checkpoint: str) -> StreamingQuery:
    """Turn a stream of whole snapshots into mount and unmount rows below store/changes."""

    def step(batch: DataFrame, number: int) -> None:
        spark, seen = batch.sparkSession, f"{store}/seen"
        try:
            before = spark.read.parquet(f"{seen}/{number - 1}") if number else batch.limit(0).select(key)
        except Exception as e:  # the first batch after the store was emptied
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = batch.limit(0).select(key)
        snapshot_changes(before, batch, key).write.mode("overwrite").parquet(f"{store}/changes/batch={number}")
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{seen}/{number}")

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_log(runs: DataFrame, schedule_id, n: int = 100) -> DataFrame:
    """The newest runs of a schedule."""
    return runs.where(F.col("schedule_id") == schedule_id).orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def stop(spark: SparkSession, name: str) -> int:
    """Stop the running queries of a name; how many there were."""
    found = [q for q in spark.streams.active if q.name == name]
    for q in found:
        q.stop()
    return len(found)
