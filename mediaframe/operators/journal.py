"""The undo journal: appended batches, recent history, reverse replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def append(journal: DataFrame, operations: DataFrame, batch_id, order: list[str]) -> DataFrame:
    """Operations of one batch with sequences from 0; done ones only, as status says."""
    w = W.partitionBy("batch_id").orderBy(*order)
    rows = operations.withColumn("batch_id", F.lit(batch_id)).withColumn("sequence", F.row_number().over(w) - 1)
    return journal.unionByName(rows, allowMissingColumns=True)


def history(journal: DataFrame, batches: int = 50) -> DataFrame:
    """batch_id, executed_at, n of the latest executed batches, newest first."""
    rows = journal.where("status = 'executed'").groupBy("batch_id").agg(F.max("executed_at").alias("executed_at"), F.count("*").alias("n"))
    recent = rows.orderBy(F.desc("executed_at"), F.desc("batch_id")).limit(batches)
    return recent


def history_entries(journal: DataFrame, batches: int = 50) -> DataFrame:
    """The entries of the latest batches, as an ordered array per batch."""
    recent = history(journal, batches)
    entries = journal.join(F.broadcast(recent.select("batch_id")), "batch_id", "left_semi")  # at most ``batches`` rows
    return entries.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "operation", "source_path", "target_path"))).alias("entries"), F.max("executed_at").alias("executed_at"))


def undo_plan(journal: DataFrame, batch_id) -> DataFrame:
    """step, source_path, target_path: the batch's executed entries backwards, each the other way round."""
    rows = journal.where((F.col("batch_id") == batch_id) & (F.col("status") == "executed"))
    w = W.partitionBy("batch_id").orderBy(F.desc("sequence"))
    return rows.select(F.row_number().over(w).alias("step"), "sequence", F.col("target_path").alias("source_path"), F.col("source_path").alias("target_path"))


def mark_undone(journal: DataFrame, results: DataFrame) -> DataFrame:
    """results: batch_id, sequence, ok. Entries that were undone become so; failed ones stay executed."""
    done = results.where("ok").select("batch_id", "sequence", F.lit(True).alias("__undone"))
    return journal.join(done, ["batch_id", "sequence"], "left").withColumn("status", F.when(F.col("__undone"), "undone").otherwise(F.col("status"))).select(*journal.columns)
