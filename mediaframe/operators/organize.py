"""Move plans: where files go, which moves are needed, name collisions, and rule-based classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaframe.functions import dates, paths

NO_EXTENSION = "기타"  # fixed value: the folder of files without an extension


def organize_plan(media: DataFrame, exif: DataFrame, target: str, strategy: str = "date") -> DataFrame:
    """id, source, target, subfolder, file_name, file_size, reason: the moves that change something."""
    rows = media.join(exif.select(F.col("media_id").alias("id"), "date_taken"), "id", "left")
    if strategy == "date":
        sub = dates.day_folder(dates.effective_date(F.col("date_taken"), F.col("modified_at")))
    elif strategy == "type":
        sub = F.upper(F.coalesce(paths.extension(F.col("file_name")), F.lit(NO_EXTENSION)))
    else:
        sub = F.lit(dates.UNCATEGORIZED)
    rows = rows.withColumn("subfolder", sub).withColumn("target", F.concat_ws("/", F.lit(target), "subfolder", "file_name"))
    return rows.where("file_path <> target").select("id", F.col("file_path").alias("source"), "target", "subfolder", "file_name", "file_size", F.lit(f"Classified by {strategy}").alias("reason"))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), F.count_distinct("subfolder").alias("new_folders"))


def resolve_collisions(plan: DataFrame, existing: DataFrame, most: int | None = None) -> DataFrame:
    """plan with final_target: taken names get `` (n)`` before the extension; null from n = most on, if that is given.

    existing: path, the files that are there. Of several moves to one target the first by source keeps
    the name if it is free; free numbers are handed out in order, passing over those that exist.
    """
    taken = existing.select(F.col("path").alias("target"), F.lit(True).alias("__taken")).distinct()
    rows = plan.join(taken, "target", "left").withColumn("__k", F.row_number().over(W.partitionBy("target").orderBy("source")) - F.when(F.col("__taken"), 0).otherwise(1))
    name = "(?s)^(.*?)(\\.[^./]*)?\\z"
    wanted = rows.withColumns({"__stem": F.regexp_extract("target", name, 1), "__ext": F.regexp_extract("target", name, 2), "__at": F.col("__k").cast("long"), "__held": F.lit(0)})
    # Numbers in use stand among the moves: the j-th of them, u, lies before the k-th free number if fewer than k are free below it, u - j < k.
    numbered = "(?s)^(.*) \\(([1-9][0-9]*)\\)(\\.[^./]*)?\\z"
    used = existing.select(F.regexp_extract("path", numbered, 1).alias("__stem"), F.regexp_extract("path", numbered, 3).alias("__ext"), F.regexp_extract("path", numbered, 2).try_cast("long").alias("__u")).where("__u is not null").distinct()
    used = used.select("__stem", "__ext", (F.col("__u") - F.row_number().over(W.partitionBy("__stem", "__ext").orderBy("__u")) + 1).alias("__at"), F.lit(1).alias("__held"))
    before = W.partitionBy("__stem", "__ext").orderBy("__at", F.desc("__held")).rowsBetween(W.unboundedPreceding, 0)
    placed = wanted.unionByName(used, allowMissingColumns=True).withColumn("__n", F.col("__k") + F.sum("__held").over(before)).where("__held = 0")
    fits = F.lit(True) if most is None else F.col("__n") < most
    final = F.when(F.col("__k") == 0, F.col("target")).when(fits, F.concat("__stem", F.lit(" ("), F.col("__n").cast("string"), F.lit(")"), "__ext"))
    return placed.withColumn("final_target", final).select(*plan.columns, "final_target")


def date_folder_plan(folders: DataFrame, path: str = "path") -> DataFrame:
    """path, target, merges: folders named YYYYMMDD<suffix> and their YYYY-MM-DD<suffix> names; merges if that one exists."""
    name = paths.file_name(F.col(path))
    rows = folders.select(F.col(path).alias("path"), F.concat(paths.parent_of(F.col(path)), F.lit("/"), dates.dated_name(name)).alias("target")).where("target is not null")
    there = folders.select(F.col(path).alias("target"), F.lit(True).alias("there")).distinct()
    return rows.join(there, "target", "left").select("path", "target", F.coalesce("there", F.lit(False)).alias("merges"))


def date_folder_scan(folders: DataFrame, entries: DataFrame) -> DataFrame:
    """date_folder_plan() of folders with conflict_count: the entries that the target holds already.

    entries: path, the files and folders that lie in them.
    """
    held = entries.groupBy(paths.parent_of(F.col("path")).alias("target")).agg(F.count("*").alias("conflict_count"))
    return date_folder_plan(folders).join(held, "target", "left").select("path", "target", "merges", F.coalesce("conflict_count", F.lit(0)).alias("conflict_count"))


def date_folder_moves(folders: DataFrame, entries: DataFrame, merge: bool = True) -> DataFrame:
    """source, target: renames of date folders; where the target is there, its entries move in under free names.

    entries as in date_folder_scan(). Without merge, folders whose target is there stay where they are.
    """
    plan = date_folder_plan(folders)
    renamed = plan.where("not merges").select(F.col("path").alias("source"), "target")
    if not merge:
        return renamed
    placed = entries.select("path", paths.parent_of(F.col("path")).alias("parent"))
    into = plan.where("merges").select(F.col("path").alias("parent"), F.col("target").alias("folder"))
    moves = placed.join(into, "parent").select(F.col("path").alias("source"), F.concat("folder", F.lit("/"), paths.file_name(F.col("path"))).alias("target"))
    there = placed.join(into.select(F.col("folder").alias("parent")).distinct(), "parent", "left_semi").select("path")
    return renamed.unionByName(resolve_collisions(moves, there).where("final_target is not null").select("source", F.col("final_target").alias("target")))


def classify_by_name(name: Column, size: Column) -> Column:
    """(folder, confidence) by the name alone, or null."""
    low = F.lower(name)
    shot = F.contains(low, F.lit("screenshot")) | F.contains(low, F.lit("screen shot")) | low.startswith("scr_")
    web = (size < 100_000) & (F.contains(low, F.lit("download")) | F.contains(low, F.lit("image")))
    made = lambda folder, p: F.struct(F.lit(folder).alias("folder"), F.lit(p).alias("confidence"))
    return F.when(shot, made("Screenshots", 0.95)).when(web, made("Downloads", 0.7))


def rule_matches(conditions: Column, file_name: Column, camera: Column) -> Column:
    """Whether all conditions of a JSON array hold; no conditions hold, anything but an array does not."""
    parsed = F.from_json(conditions, "array<struct<field: string, operator: string, value: string>>")
    is_array = F.ltrim(conditions).startswith("[") & parsed.isNotNull()
    low, model = F.lower(file_name), F.lower(camera)

    def holds(c: Column) -> Column:
        value = F.lower(F.coalesce(c["value"], F.lit("")))
        name = c["field"] == "file_name"
        test = F.when(name & (c["operator"] == "contains"), F.contains(low, value)).when(name & (c["operator"] == "starts_with"), low.startswith(value))
        return F.coalesce(test.when((c["field"] == "camera_model") & (c["operator"] == "equals"), F.coalesce(model == value, F.lit(False))), F.lit(False))

    return F.coalesce(is_array & F.forall(parsed, holds), F.lit(False))


def apply_rules(media: DataFrame, rules: DataFrame) -> DataFrame:
    """id, rule_id, action_type, action_value: of the enabled rules that match, that of the highest priority.

    rules is a hand-written table, so the match is a broadcast nested loop over it, then one aggregate.
    """
    live = rules.where("enabled").select(F.col("id").alias("rule_id"), "priority", "conditions_json", "action_type", "action_value")
    hit = media.join(live, rule_matches(F.col("conditions_json"), F.col("file_name"), F.col("camera_model")))
    return hit.groupBy("id").agg(F.max_by(F.struct("rule_id", "action_type", "action_value"), F.struct("priority", "rule_id")).alias("r")).select("id", "r.*")
