"""Faceted listing, searching, counting and grouping of the media catalog.

``predicate`` is the one place where facets become conditions, so pages and counts cannot drift apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaframe.functions import dates, paths, text
from mediaframe.operators import ranges
from mediaframe.plans.storage import materialize

MEDIA_COLUMNS = ["id", "file_path", "original_path", "file_name", "file_size", "mime_type", "sha256_hash", "quick_hash", "phash", "width", "height", "media_type", "created_at", "modified_at", "scanned_at", "source_type", "scan_phase"]


@dataclass(frozen=True)
class Facets:
    """Each absent facet, and media_type "all", sets no condition."""

    folder: str | None = None
    media_type: str | None = None
    search: str | None = None
    tag_id: object = None
    album_id: object = None


def with_exif(media: DataFrame, exif: DataFrame, how: str = "left") -> DataFrame:
    """Media next to their 1:0..1 EXIF row."""
    return media.join(exif.withColumnRenamed("media_id", "id"), "id", how)


# The columns of a media row as clients see it, beside date_taken.
MEDIA_COLUMNS = ["id", "file_path", "original_path", "file_name", "file_size", "mime_type", "sha256_hash", "quick_hash", "width", "height", "media_type", "created_at", "modified_at", "scanned_at", "source_type", "thumbnail", "scan_phase"]


def media_rows(media: DataFrame, exif: DataFrame) -> DataFrame:
    """The 18 columns of a media row; media without EXIF have no date_taken."""
    return with_exif(media.select(MEDIA_COLUMNS), exif.select("media_id", "date_taken")).select(*MEDIA_COLUMNS, "date_taken")


def predicate(facets: Facets) -> Column:
    tests: list[Column] = []
    if facets.folder:
        tests.append(text.fold(F.col("file_path")).startswith(text.fold_str(facets.folder.rstrip("/")) + "/"))
    if facets.media_type and facets.media_type != "all":
        tests.append(F.col("media_type") == facets.media_type)
    if facets.search and facets.search.strip():
        needle = facets.search.strip()
        tests.append(text.contains(F.col("file_name"), needle) | text.contains(F.col("file_path"), needle))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def select_media(media: DataFrame, facets: Facets, media_tags: DataFrame | None = None, album_media: DataFrame | None = None) -> DataFrame:
    """Media that meet all facets; membership by semi-joins, so no row is multiplied."""
    out = media.where(predicate(facets))
    if facets.tag_id is not None:
        out = in_tag(out, media_tags, facets.tag_id)
    if facets.album_id is not None:
        out = in_album(out, album_media, facets.album_id)
    return out


def in_tag(media: DataFrame, media_tags: DataFrame, tag_id) -> DataFrame:
    return media.join(media_tags.where(F.col("tag_id") == tag_id).select(F.col("media_id").alias("id")), "id", "left_semi")


def in_album(media: DataFrame, album_media: DataFrame, album_id) -> DataFrame:
    return media.join(album_media.where(F.col("album_id") == album_id).select(F.col("media_id").alias("id")), "id", "left_semi")


def media_page(media: DataFrame, exif: DataFrame, facets: Facets = Facets(), limit: int = 500, offset: int = 0, **membership) -> DataFrame:
    """One page, newest effective date first, ties by id."""
    rows = with_exif(select_media(media, facets, **membership), exif.select("media_id", "date_taken"))
    return rows.orderBy(dates.effective_date(F.col("date_taken"), F.col("modified_at")).desc_nulls_last(), F.col("id")).offset(offset).limit(limit)


def recent_page(media: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page by modification alone, newest first, ties by id."""
    return media.orderBy(F.col("modified_at").desc_nulls_last(), "id").offset(offset).limit(limit)


def media_count(media: DataFrame, facets: Facets = Facets(), **membership) -> DataFrame:
    return select_media(media, facets, **membership).agg(F.count("*").alias("total"))


def search_wide(media: DataFrame, exif: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Name, path, camera model, camera make or comment like %query%, its own wildcards in force; newest modified first."""
    rows = with_exif(media, exif.select("media_id", "camera_model", "camera_make"))
    hit = reduce(lambda a, b: a | b, (F.coalesce(text.like_raw(F.col(c), f"%{query}%"), F.lit(False)) for c in ("file_name", "file_path", "camera_model", "camera_make", "comment")))
    return rows.where(hit).orderBy(F.col("modified_at").desc_nulls_last(), F.col("id")).limit(limit)


def sorted_media(media: DataFrame, exif: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """The whole catalog by name, path, date, modified, size, pixels or extension; ties by id."""
    rows = with_exif(media, exif.select("media_id", "date_taken").hint("merge"))  # a small file, but as many rows as there are media
    keys = {
        "name": F.lower("file_name"),
        "path": F.col("file_path"),
        "date": dates.effective_date(F.col("date_taken"), F.col("modified_at")),
        "modified": F.col("modified_at"),
        "size": F.col("file_size"),
        "pixels": pixels(),
        "extension": F.coalesce(paths.extension(F.col("file_name")), F.lit("")),
    }
    return rows.orderBy(keys[key].desc_nulls_last() if descending else keys[key].asc_nulls_first(), F.col("id"))


def places(ordered: DataFrame) -> DataFrame:
    """A sorted DataFrame with place, each row's number from 1: counts per sorted partition and the place within it.

    Its rows are written down, so select what is needed of them before.
    """
    held = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    counts = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__n")).alias("__before"))  # one row a partition
    return held.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__before")


def badges(media: DataFrame, uploads: DataFrame) -> DataFrame:
    """media with is_uploaded and has_comment."""
    up = uploads.where("media_id is not null").select(F.col("media_id").alias("id")).distinct().withColumn("__up", F.lit(True))
    rows = media.join(up, "id", "left").withColumn("is_uploaded", F.col("__up").isNotNull())
    return rows.withColumn("has_comment", F.coalesce(F.col("comment") != "", F.lit(False))).drop("__up")


def pixels() -> Column:
    return F.coalesce(F.col("width").cast("long"), F.lit(0)) * F.coalesce(F.col("height").cast("long"), F.lit(0))


def stats(media: DataFrame) -> DataFrame:
    """total_count, total_size, image_count, video_count."""
    return media.agg(F.count("*").alias("total_count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), F.count_if(F.col("media_type") == "image").alias("image_count"), F.count_if(F.col("media_type") == "video").alias("video_count"))


def by_day(media: DataFrame, exif: DataFrame) -> DataFrame:
    rows = with_exif(media.select("id", "modified_at"), exif.select("media_id", "date_taken"))
    return rows.groupBy(dates.day_label(F.col("date_taken"), F.col("modified_at")).alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day"))


def by_folder(media: DataFrame) -> DataFrame:
    return media.groupBy(paths.parent(F.col("file_path"), F.col("file_name")).alias("folder")).agg(F.count("*").alias("n")).orderBy("folder")


def grouped(media: DataFrame, exif: DataFrame, by: str = "day") -> DataFrame:
    """Groups with their members' ids in list order."""
    rows = with_exif(media, exif.select("media_id", "date_taken"))
    when = dates.effective_date(F.col("date_taken"), F.col("modified_at"))
    label = dates.day_label(F.col("date_taken"), F.col("modified_at")) if by == "day" else paths.parent(F.col("file_path"), F.col("file_name"))
    members = F.collect_list(F.struct(when.alias("at"), F.col("id").alias("id")))
    ordered = F.array_sort(members, lambda a, b: F.when(a["at"] > b["at"], -1).when(a["at"] < b["at"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.transform(ordered, lambda m: m["id"]).alias("ids"))


def grouped_pages(media: DataFrame, exif: DataFrame, by: str = "day", size: int = 1000, page: int | None = None) -> DataFrame:
    """label, page, ids: every group's members in list order, a page of ``size`` a row; one page of each if asked.

    Groups of any length: what is in one place is a page.
    """
    rows = with_exif(media, exif.select("media_id", "date_taken"))
    when = dates.effective_date(F.col("date_taken"), F.col("modified_at"))
    label = dates.day_label(F.col("date_taken"), F.col("modified_at")) if by == "day" else paths.parent(F.col("file_path"), F.col("file_name"))
    paged = ranges.pages(rows.select(label.alias("label"), when.alias("at"), "id"), "label", ["-at", "id"], size, page)
    members = F.array_sort(F.collect_list(F.struct("place", "id")))
    return paged.groupBy("label", "page").agg(F.transform(members, lambda m: m["id"]).alias("ids"))


def gps_media(media: DataFrame, exif: DataFrame, limit: int = 1000) -> DataFrame:
    """Media with a position, newest first."""
    rows = with_exif(media, exif.where("gps_latitude is not null and gps_longitude is not null"), "inner")
    return rows.orderBy(dates.effective_date(F.col("date_taken"), F.col("modified_at")).desc_nulls_last(), F.col("id")).limit(limit)


def comments(media: DataFrame) -> DataFrame:
    return media.where((F.col("comment").isNotNull()) & (F.col("comment") != "")).select("id", "comment")


def backlog(media: DataFrame, limit: int) -> DataFrame:
    """Files not enriched yet, newest first."""
    return media.where("scan_phase = 0").orderBy(F.col("modified_at").desc_nulls_last(), F.col("id")).limit(limit)


def dashboard(media: DataFrame, uploads: DataFrame, dup_members: DataFrame, dup_groups: DataFrame, burst_members: DataFrame, burst_groups: DataFrame, scope: str | None = None) -> DataFrame:
    """Seven figures of the files below a folder, or of all: one row.

    The four counts over files come from one pass; the group counts from joins with the pending groups.
    """
    rows = media.where(predicate(Facets(folder=scope))) if scope else media
    up = uploads.select(F.col("media_id").alias("id")).where("id is not null").distinct().withColumn("up", F.lit(True))
    folder = paths.parent(F.col("file_path"), F.col("file_name"))
    files = rows.join(up, "id", "left").agg(
        F.count("*").alias("total_count"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"),
        F.count_if(F.col("up").isNull()).alias("unuploaded_count"),
        F.count_if(~F.col("file_path").rlike("/[12][0-9]{3}-[0-9]{2}-[0-9]{2}/")).alias("undated_files"),
        F.count_distinct(F.when(folder.rlike("/[12][0-9]{3}[01][0-9][0-3][0-9]$"), folder)).alias("date_format_folders"),
    )

    def pending(members: DataFrame, groups: DataFrame, name: str) -> DataFrame:
        live = groups.where("status = 'pending'").select(F.col("id").alias("group_id"))
        return members.join(live, "group_id", "left_semi").join(rows.select(F.col("id").alias("media_id")), "media_id", "left_semi").agg(F.count_distinct("group_id").alias(name))

    # one row each
    return files.crossJoin(pending(dup_members, dup_groups, "dup_groups")).crossJoin(pending(burst_members, burst_groups, "burst_groups"))
