"""Moving, copying and renaming whole folders: what each request comes to, its files, carrying it out, the journal.

A folder's files are those that have it among their ancestors, so requests meet files by an equal key, one row a file
and ancestor, and no request is compared with all files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import paths
from mediaframe.operators import organize
from mediaframe.plans import fileops
from mediaframe.plans.storage import materialize, shared_dir


def _with_self(path: str):
    return F.concat(paths.ancestors(F.col(path)), F.array(F.col(path)))


def plan(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """request, source, target_dir, status, destination: what each request comes to before anything is done.

    requests: request, source, target_dir and, for a rename, new_name (null otherwise), of which target_dir is the
    source's own folder. entries: path and folder (a boolean) of all that is there. status is the first of: ``missing`` (no such source),
    ``bad name``, ``no target`` (not a folder), ``nested`` (the target is the source or lies in it), ``covered`` (the source lies in
    another request's source, or is the same and that request has a smaller number), ``taken`` (a rename to a name that is there),
    ``ready``. A ready one's destination is the name in target_dir, with `` (n)`` if it is taken, also by another request.
    """
    there = entries.groupBy("path").agg(F.max("folder").alias("folder"))
    rows = requests.select("request", "source", "target_dir", "new_name")
    rows = rows.join(there.select(F.col("path").alias("source"), F.lit(True).alias("__found")), "source", "left")
    rows = rows.join(there.where("folder").select(F.col("path").alias("target_dir"), F.lit(True).alias("__target")), "target_dir", "left")
    # Sources above a source, and the first request of several for one: by equal keys.
    firsts = rows.groupBy("source").agg(F.min("request").alias("__first"))
    above = rows.select("source", F.explode(paths.ancestors(F.col("source"))).alias("__above")).distinct()
    inside = above.join(firsts.select(F.col("source").alias("__above")), "__above", "left_semi").select("source").distinct().withColumn("__inside", F.lit(True))
    rows = rows.join(firsts, "source").join(inside, "source", "left")
    trimmed = F.trim("new_name")
    bad = F.col("new_name").isNotNull() & ((trimmed == "") | trimmed.isin(".", "..") | F.contains(trimmed, F.lit("/")) | F.contains(trimmed, F.lit("\0")))
    name = F.coalesce(trimmed, paths.file_name(F.col("source")))
    rows = rows.withColumn("target", F.concat_ws("/", "target_dir", name))
    rows = rows.join(there.select(F.col("path").alias("target"), F.lit(True).alias("__taken")), "target", "left")
    nested = F.col("new_name").isNull() & F.startswith(F.concat("target_dir", F.lit("/")), F.concat("source", F.lit("/")))
    status = (
        F.when(F.col("__found").isNull(), "missing").when(bad, "bad name").when(F.col("__target").isNull(), "no target").when(nested, "nested")
        .when(F.col("__inside").isNotNull() | (F.col("request") > F.col("__first")), "covered").when(F.col("new_name").isNotNull() & F.col("__taken").isNotNull(), "taken").otherwise("ready")
    )
    rows = rows.select("request", "source", "target_dir", "target", status.alias("status"))
    ready = organize.resolve_collisions(rows.where("status = 'ready'"), entries.select("path"))
    return ready.withColumnRenamed("final_target", "destination").unionByName(rows.where("status <> 'ready'"), allowMissingColumns=True).select("request", "source", "target_dir", "status", "destination")


def expand(planned: DataFrame, entries: DataFrame) -> DataFrame:
    """request, folder, source, target: every file and folder that ready requests take along, themselves included."""
    ready = planned.where("status = 'ready' and destination is not null").select("request", F.col("source").alias("__top"), "destination")
    rows = entries.select("path", "folder", F.explode(_with_self("path")).alias("__top")).join(ready, "__top")
    return rows.select("request", "folder", F.col("path").alias("source"), F.concat("destination", F.substr("path", F.length("__top") + 1)).alias("target"))


def carry_out(planned: DataFrame, entries: DataFrame, operation: str = "move", claims: str | None = None, whole: bool = True) -> DataFrame:
    """request, source, destination, status of each ready request, written down.

    A move within a device is one rename. Copies, and moves to another device, go by files, as many tasks as Spark deals
    them to; a move's folders go after all their files have. status is ``done``, or what the first item said that was not.
    whole: try a rename of the folder first; without it moves go by files in any case.
    """
    held = claims or shared_dir(planned.sparkSession, "claims")
    ready = materialize(planned.where("status = 'ready' and destination is not null").select("request", "source", "destination"), "requests")
    if operation == "move":
        if whole:
            renamed = fileops.execute(ready, "move", source="source", target="destination", claims=held).withColumnRenamed("target", "destination")
            tried = ready.join(renamed, ["source", "destination"])
        else:
            tried = ready.withColumn("status", F.lit(fileops.OTHER_DEVICE))
        by_files = tried.where(F.col("status") == fileops.OTHER_DEVICE)
    else:
        tried, by_files = None, ready
    of = by_files.select("request", "source", "destination", F.lit("ready").alias("status"))
    items = materialize(expand(of, entries), "items")
    done = _folders(items.where("folder"), "make").unionByName(fileops.execute(items.where("not folder"), operation, claims=held))
    bad = done.join(items.select("request", "source", "target"), ["source", "target"]).groupBy("request").agg(F.min(F.when(F.col("status") != "done", F.col("status"))).alias("bad"))
    results = materialize(of.drop("status").join(bad, "request", "left").select("request", "source", "destination", F.coalesce("bad", F.lit("done")).alias("status")), "carried-out")
    if operation == "move":
        emptied = items.where("folder").join(results.where("status = 'done'").select("request"), "request", "left_semi")
        _folders(emptied, "remove")
        results = tried.where(F.col("status") != fileops.OTHER_DEVICE).select("request", "source", "destination", "status").unionByName(results)
    return results


def _folders(items: DataFrame, what: str) -> DataFrame:
    """Makes the target folders, or removes the source folders, deepest first, where nothing is left in them."""

    def go(batches):
        for pdf in batches:
            for source, target in zip(pdf["source"], pdf["target"], strict=True):
                if what == "make":
                    os.makedirs(target, exist_ok=True)
                else:
                    try:
                        os.rmdir(source)
                    except OSError:  # something has come in, or it is gone already
                        pass
            yield pdf.assign(status="done")

    rows = items.select("source", "target", "request")
    rows = rows if what == "make" else rows.repartition("request").sortWithinPartitions(F.length("source").desc())
    return materialize(rows.select("source", "target").mapInPandas(go, "source string, target string, status string"), "folders")


def journalled(done: DataFrame, batch_id: str) -> DataFrame:
    """Journal rows of the requests that are done, in their order; an undo is the same rows the other way round."""
    rows = done.where("status = 'done'")
    return rows.select(F.lit(batch_id).alias("batch_id"), F.col("request").alias("sequence"), F.lit("move_dir").alias("operation"), F.col("source").alias("source_path"), F.col("destination").alias("target_path"), F.lit("executed").alias("status"))
