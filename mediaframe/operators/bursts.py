"""Burst sessions and the best photo of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import quality
from mediaframe.operators import ranges

GAP = 5


def sessions(df: DataFrame, at: str, key: str, gap: int = GAP, least: int = 2, by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """df's rows in sessions of at least ``least``, with first_id (the session's first key) and session_size.

    at: a zoneless timestamp; rows in its order, ties by key. A session ends where the distance to the
    next row, cut to whole seconds, is over the gap. With ``by`` columns each of their values has its own
    sessions. Rows lie in ranges of that order (see ranges.runs), so neither one value nor one hour of all rows
    is a task's. Rows without a timestamp are in no session.
    """
    by = list(by or [])
    rows = df.where(F.col(at).isNotNull()).withColumn("__us", F.unix_micros(F.col(at).cast("timestamp")))
    # Distances are cut to seconds, so those of up to a microsecond less than gap + 1 seconds are within it.
    found = ranges.runs(rows, by, ["__us", key], step="__us", most=(gap + 1) * 1_000_000 - 1, partitions=partitions)
    sized = ranges.sizes(found, key)
    return sized.where(F.col("run_size") >= least).withColumnsRenamed({"run_size": "session_size", "run_first": "first_id"}).drop("__us", *ranges.MADE)


def score(members: DataFrame, group: str, sharp: Column, exposed: Column, width: str = "width", height: str = "height", size: str = "file_size") -> DataFrame:
    """members with sharpness_score, exposure_score and quality_score, normalised by the group's largest."""
    area = F.coalesce(F.col(width).cast("double"), F.lit(0.0)) * F.coalesce(F.col(height).cast("double"), F.lit(0.0))
    most = members.groupBy(group).agg(F.max(area).alias("__area"), F.coalesce(F.max(size), F.lit(1)).alias("__size"))
    rows = members.join(most, group).withColumn("sharpness_score", quality.sharpness_score(sharp)).withColumn("exposure_score", quality.exposure_score(exposed))
    total = quality.total_score(F.col("sharpness_score"), F.col("exposure_score"), quality.resolution_score(F.col(width), F.col(height), F.col("__area")), quality.size_score(F.col(size), F.col("__size")))
    return rows.withColumn("quality_score", total).drop("__area", "__size")


def best(members: DataFrame, group: str, value: str, order: list[str], flag: str = "is_best") -> DataFrame:
    """Flags the member with the largest value, the last in order among equals."""
    top = members.groupBy(group).agg(F.max(F.struct(value, *order)).alias("__top"))
    return members.join(top, group).withColumn(flag, F.struct(value, *order).eqNullSafe(F.col("__top"))).drop("__top")


def analyze(media: DataFrame, exif: DataFrame, sharp: Column, exposed: Column, gap: int = GAP) -> DataFrame:
    """The whole burst job: images with a capture date, their sessions, scores, and the best of each session.

    media's and exif's columns with first_id (the session), session_size, the three scores and is_best.
    """
    taken = F.concat(F.replace(F.substring("date_taken", 1, 10), F.lit(":"), F.lit("-")), F.substring("date_taken", 11, 9)).try_cast("timestamp_ntz")
    rows = media.where("media_type = 'image'").join(exif.withColumnRenamed("media_id", "id"), "id").withColumn("taken", taken)
    scored = score(sessions(rows, "taken", "id", gap), "first_id", sharp, exposed)
    return best(scored, "first_id", "quality_score", ["taken", "id"])


def review_marks(media: DataFrame, bursts: DataFrame, scores: DataFrame, floor: float = 40.0) -> DataFrame:
    """id, mark: a burst's best is kept and its others discarded; else a score below the floor discards."""
    rows = media.select("id").join(bursts.select(F.col("media_id").alias("id"), "is_best"), "id", "left").join(scores.select(F.col("media_id").alias("id"), "score"), "id", "left")
    mark = F.when(F.col("is_best"), "keep").when(F.col("is_best") == F.lit(False), "discard").when(F.col("score") < floor, "discard")
    return rows.select("id", mark.alias("mark"))


def review_progress(marks: DataFrame, media: DataFrame) -> DataFrame:
    rows = media.join(marks, "id", "left")
    discard = F.col("mark") == "discard"
    return rows.agg(F.count_if(F.col("mark") == "keep").alias("keep"), F.count_if(discard).alias("discard"), F.coalesce(F.sum(F.when(discard, F.col("file_size"))), F.lit(0)).alias("discard_bytes"))
