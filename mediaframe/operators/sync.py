"""Directory sync: the difference of two listings as a plan, and what resolutions make of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import paths


def sync_plan(source: DataFrame, target: DataFrame, exclusions: list[str] | None = None, orphans: bool = True, checksum: bool = False) -> DataFrame:
    """rel_path, action, source_size, target_size, source_mtime, target_mtime, content_identical.

    Listings have rel_path, size, mtime and, for checksum, hash. Actions: new, conflict (the target is
    newer; tested before sizes), size_changed, modified, same, orphan.
    """
    keep = ~paths.excluded(F.col("rel_path"), exclusions or [])
    hashed = ["hash"] if checksum else []
    s = source.where(keep).select("rel_path", F.col("size").alias("source_size"), F.col("mtime").alias("source_mtime"), *(F.col(c).alias("source_hash") for c in hashed), F.lit(True).alias("__s"))
    t = target.where(keep).select("rel_path", F.col("size").alias("target_size"), F.col("mtime").alias("target_mtime"), *(F.col(c).alias("target_hash") for c in hashed), F.lit(True).alias("__t"))
    rows = s.join(t, "rel_path", "full_outer" if orphans else "left")
    action = (
        F.when(F.col("__t").isNull(), "new")
        .when(F.col("__s").isNull(), "orphan")
        .when(F.col("target_mtime") > F.col("source_mtime"), "conflict")
        .when(F.col("source_size") != F.col("target_size"), "size_changed")
        .when(F.col("source_mtime") > F.col("target_mtime"), "modified")
        .otherwise("same")
    )
    equal = F.coalesce(F.col("source_hash") == F.col("target_hash"), F.lit(False)) if checksum else F.col("source_size") == F.col("target_size")
    return rows.withColumn("action", action).select("rel_path", "action", "source_size", "target_size", "source_mtime", "target_mtime", F.when(F.col("action") == "conflict", equal).alias("content_identical"))


def sync_totals(plan: DataFrame) -> DataFrame:
    """Files to copy or update, their bytes, conflicts, orphans."""
    moved = F.col("action").isin("new", "size_changed", "modified")
    return plan.agg(F.count_if(moved).alias("total_files"), F.coalesce(F.sum(F.when(moved, F.col("source_size"))), F.lit(0)).alias("total_bytes"), F.count_if(F.col("action") == "conflict").alias("conflicts"), F.count_if(F.col("action") == "orphan").alias("orphans"))


def sync_orphans(source: DataFrame, target: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    keep = ~paths.excluded(F.col("rel_path"), exclusions or [])
    return target.where(keep).join(source.where(keep).select("rel_path"), "rel_path", "left_anti")


def sync_worklist(plan: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """rel_path, operation, destination: copies, updates and resolved conflicts.

    resolutions: rel_path, resolution of conflicts. force_copy overwrites, rename_copy copies beside the
    target as ``name_conflict.ext``, skip and pending do nothing.
    """
    copies = plan.where(F.col("action") == "new").select("rel_path", F.lit("copy").alias("operation"), F.col("rel_path").alias("destination"))
    updates = plan.where(F.col("action").isin("size_changed", "modified")).select("rel_path", F.lit("update").alias("operation"), F.col("rel_path").alias("destination"))
    out = copies.unionByName(updates)
    if resolutions is not None:
        solved = plan.where(F.col("action") == "conflict").join(resolutions, "rel_path")
        beside = F.regexp_replace("rel_path", "^(.*?)(\\.[^./]*)?$", "$1_conflict$2")
        how = F.when(F.col("resolution") == "force_copy", "copy").when(F.col("resolution") == "rename_copy", "copy")
        out = out.unionByName(solved.select("rel_path", how.alias("operation"), F.when(F.col("resolution") == "rename_copy", beside).otherwise(F.col("rel_path")).alias("destination")).where("operation is not null"))
    return out


def apply_sync(target: DataFrame, source: DataFrame, work: DataFrame) -> DataFrame:
    """The target listing after the work is done."""
    done = work.join(source, "rel_path").select(F.col("destination").alias("rel_path"), "size", "mtime")
    return target.join(done.select("rel_path"), "rel_path", "left_anti").select("rel_path", "size", "mtime").unionByName(done)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change: what came and what went between two snapshots."""
    came = after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("mounted"))
    return came.unionByName(before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("unmounted")))
