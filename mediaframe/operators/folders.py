"""Folder analytics: roll-ups to every ancestor, type statistics, largest files, tree filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaframe.functions import paths
from mediaframe.plans.storage import materialize

LARGE = 10_000_000


def rollup(files: DataFrame, path: str = "file_path", size: str = "file_size", max_depth: int | None = None) -> DataFrame:
    """folder, depth, total_size, file_count, folder_count for every folder above a file.

    Sizes and files count at any depth; folder_count counts the folders below, down to the depth limit,
    and folders beyond it have no row.
    """
    rows = files.select(F.col(path).alias("path"), F.col(size).cast("long").alias("size"))
    leaf = rows.groupBy(paths.parent_of(F.col("path")).alias("home")).agg(F.sum("size").alias("size"), F.count("*").alias("files"))
    # one row per folder with files, exploded, instead of one per file
    up = leaf.select(F.explode(paths.ancestors(F.concat("home", F.lit("/x")))).alias("folder"), "size", "files")
    sums = up.groupBy("folder").agg(F.sum("size").alias("total_size"), F.sum("files").alias("file_count")).withColumn("depth", paths.depth(F.col("folder")))
    limited = sums if max_depth is None else sums.where(F.col("depth") <= max_depth)
    below = limited.select(F.explode(paths.ancestors(F.col("folder"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("folder_count"))
    return limited.join(below, "folder", "left").select("folder", "depth", F.coalesce("total_size", F.lit(0)).alias("total_size"), "file_count", F.coalesce("folder_count", F.lit(0)).alias("folder_count"))


def type_stats(files: DataFrame, name: str = "file_name", size: str = "file_size") -> DataFrame:
    ext = F.coalesce(paths.extension(F.col(name)), F.lit("other"))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("n"), F.sum(size).alias("total_size")).orderBy(F.desc("total_size"), "extension")


def largest_files(files: DataFrame, least: int = LARGE, n: int = 20, size: str = "file_size", key: str = "file_path") -> DataFrame:
    return files.where(F.col(size) > least).orderBy(F.desc(size), key).limit(n)


def largest_per_folder(files: DataFrame, n: int = 20, path: str = "file_path", size: str = "file_size") -> DataFrame:
    """Of each folder, its n largest direct files."""
    w = W.partitionBy("folder").orderBy(F.desc(size), path)
    return files.withColumn("folder", paths.parent_of(F.col(path))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def listing(entries: DataFrame, folder: str, path: str = "path", is_dir: str = "is_dir") -> DataFrame:
    """One level of a folder: hidden entries left out, folders first, then by name without case."""
    name = paths.file_name(F.col(path))
    rows = entries.where((paths.parent_of(F.col(path)) == folder.rstrip("/")) & ~name.startswith("."))
    return rows.withColumn("name", name).orderBy(F.desc(is_dir), F.lower("name"), "name")


def tree_filter(entries: DataFrame, search: str = "", kind: str = "all", path: str = "path", is_dir: str = "is_dir") -> DataFrame:
    """Entries that stay visible: files that match name and type, folders that match by name or hold a match."""
    name = F.lower(paths.file_name(F.col(path)))
    by_name = F.contains(name, F.lit(search.lower()))
    typed = F.lit(True) if kind == "all" else paths.file_type(F.col(path)) == kind
    files = entries.where(~F.col(is_dir) & by_name & typed)
    own = entries.where(F.col(is_dir) & by_name) if search else entries.where(F.col(is_dir) & F.lit(kind == "all"))
    held = files.unionByName(own).select(F.explode(paths.ancestors(F.col(path))).alias(path)).distinct()
    folders = entries.where(is_dir).join(held.unionByName(own.select(path)).distinct(), path, "left_semi")
    return files.unionByName(folders)


def tree_stats(entries: DataFrame, visible: DataFrame, path: str = "path", is_dir: str = "is_dir", size: str = "size") -> DataFrame:
    """folders (all of them), and files, size, images, videos among the visible ones."""
    kind = paths.file_type(F.col(path))
    file = ~F.col(is_dir)
    shown = visible.agg(F.count_if(file).alias("files"), F.coalesce(F.sum(F.when(file, F.col(size))), F.lit(0)).alias("size"), F.count_if(file & (kind == "image")).alias("images"), F.count_if(file & (kind == "video")).alias("videos"))
    return entries.agg(F.count_if(is_dir).alias("folders")).crossJoin(shown)  # one row each


def group_tree(groups: DataFrame, folder: str = "folder", n: str = "n") -> DataFrame:
    """folder, label, total, children: folder groups as a tree, counts carried up, single-child chains joined.

    A folder with one child that has children itself is joined with it: the child takes over the
    parent's place and its label, and its own count stays in its total. Joined folders point to their
    only child; the pointers are followed by doubling.
    """
    counted = groups.select(F.col(folder).alias("folder"), F.col(n).cast("long").alias("n"))
    up = counted.select(F.explode(paths.ancestors(F.concat("folder", F.lit("/x")))).alias("folder"), "n")
    nodes = up.groupBy("folder").agg(F.sum("n").alias("total")).withColumn("parent", paths.parent_of(F.col("folder")))
    kids = nodes.groupBy("parent").agg(F.count("*").alias("children"), F.min("folder").alias("only"))
    nodes = materialize(nodes.join(kids.withColumnRenamed("parent", "folder"), "folder", "left").withColumn("children", F.coalesce("children", F.lit(0))), "tree")
    inner = nodes.select(F.col("folder").alias("only"), F.col("children").alias("below"))
    chained = nodes.where("children = 1").join(inner, "only").where("below > 0")
    hops = materialize(chained.select("folder", F.col("only").alias("end")), "hops")
    while True:
        ahead = hops.select(F.col("folder").alias("end"), F.col("end").alias("far"))
        further = materialize(hops.join(ahead, "end", "left").select("folder", F.coalesce("far", "end").alias("end"), F.col("far").isNotNull().alias("moved")), "hops")
        if not further.where("moved").limit(1).count():
            break
        hops = further.select("folder", "end")
    starts = hops.groupBy(F.col("end").alias("folder")).agg(F.min("folder").alias("top"))
    kept = nodes.join(hops.select("folder"), "folder", "left_anti").join(starts, "folder", "left").withColumn("top", F.coalesce("top", "folder"))
    cut = F.length(paths.parent_of(F.col("top")))
    label = F.regexp_replace(F.substr("folder", F.lit(1) + cut), "^/", "")
    return kept.select("folder", label.alias("label"), "total", F.col("children").cast("long").alias("children"))


