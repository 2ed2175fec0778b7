"""Tags, albums, comments, settings, the upload ledger, and copy-on-write changes to tables.

Tables are immutable: every change returns the whole new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaframe.functions import dates, paths


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is new are added, one of each; the others are dropped. Null keys count as equal to none."""
    fresh = rows.dropDuplicates(key).join(table.select(*key), key, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those with the same key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows.dropDuplicates(key), allowMissingColumns=True)


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def enrich(table: DataFrame, facts: DataFrame, key: str = "id") -> DataFrame:
    """width, height, thumbnail where facts have them; every row that facts name gets scan_phase 1."""
    new = facts.select(key, *(F.col(c).alias(f"__{c}") for c in ("width", "height", "thumbnail")), F.lit(1).alias("__seen"))
    rows = table.join(new, key, "left")
    rows = rows.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in ("width", "height", "thumbnail")}).withColumn("scan_phase", F.coalesce("__seen", "scan_phase"))
    return rows.select(*table.columns)


def set_exclusive(members: DataFrame, group, media, flag: str) -> DataFrame:
    """In the group, the flag holds for this member alone; other groups stay."""
    return members.withColumn(flag, F.when(F.col("group_id") == group, F.col("media_id") == media).otherwise(F.col(flag)))


def dismiss(groups: DataFrame, group) -> DataFrame:
    return update_where(groups, F.col("id") == group, status=F.lit("dismissed"))


def set_comment(media: DataFrame, media_id, comment: str | None) -> DataFrame:
    """Trimmed; an empty comment clears it."""
    return update_where(media, F.col("id") == media_id, comment=F.nullif(F.trim(F.lit(comment)), F.lit("")))


def rewrite_prefix(table: DataFrame, old: str, new: str, columns: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Paths below a moved folder, and the folder itself; /a/bc stays when /a/b moves."""
    return table.withColumns({c: paths.move_prefix(F.col(c), old, new) for c in columns})


def purge_folder(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Removes media below a folder with all that depends on them, then groups that lost every member.

    tables: media_files and any of media_exif, media_tags, album_media, duplicate_members, bcut_members,
    nas_uploads (kept, with media_id cleared), duplicate_groups, bcut_groups.
    """
    out = dict(tables)
    gone = tables["media_files"].where(paths.under(F.col("file_path"), folder)).select(F.col("id").alias("media_id"))
    return remove_media(out, gone)


def remove_media(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Removes the media of ``gone`` (media_id) with their dependants and the groups left empty."""
    out = dict(tables)
    out["media_files"] = tables["media_files"].join(gone.withColumnRenamed("media_id", "id"), "id", "left_anti")
    for name in ("media_exif", "media_tags", "album_media", "duplicate_members", "bcut_members"):
        if name in out:
            out[name] = out[name].join(gone, "media_id", "left_anti")
    if "nas_uploads" in out:
        marked = out["nas_uploads"].join(gone.distinct().withColumn("__gone", F.lit(True)), "media_id", "left")
        out["nas_uploads"] = marked.withColumn("media_id", F.when(F.col("__gone").isNull(), F.col("media_id"))).select(*out["nas_uploads"].columns)
    for groups, members in (("duplicate_groups", "duplicate_members"), ("bcut_groups", "bcut_members")):
        if groups in out and members in out:
            out[groups] = out[groups].join(out[members].select(F.col("group_id").alias("id")), "id", "left_semi")
    return out


def groups_to_resolve(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Pending groups with at most one member, also those with none."""
    counts = members.groupBy("group_id").agg(F.count("media_id").alias("n"))
    rows = groups.where("status = 'pending'").join(counts.withColumnRenamed("group_id", "id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.where("n <= 1").select("id", "n")


def resolve_after_trash(tables: dict[str, DataFrame], trashed: DataFrame) -> dict[str, DataFrame]:
    """trashed: media_id, ok. Media that really went are removed; groups with one member left or none are resolved."""
    gone = trashed.where("ok").select("media_id")
    out = dict(tables)
    out["media_files"] = tables["media_files"].join(gone.withColumnRenamed("media_id", "id"), "id", "left_anti")
    for groups, members in (("duplicate_groups", "duplicate_members"), ("bcut_groups", "bcut_members")):
        if groups in out and members in out:
            out[members] = out[members].join(gone, "media_id", "left_anti")
            done = groups_to_resolve(out[groups], out[members]).select("id", F.lit(True).alias("__done"))
            out[groups] = out[groups].join(done, "id", "left").withColumn("status", F.when(F.col("__done"), "resolved").otherwise(F.col("status"))).drop("__done")
    return out


# ---- tags and albums --------------------------------------------------------------------------


def create_tag(tags: DataFrame, tag: DataFrame) -> DataFrame:
    """tag: one row or more; a name that is taken stays with its tag."""
    return insert_or_ignore(tags, tag, ["name"])


def delete_rows(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not among those of gone: untag, remove from an album."""
    return table.join(gone.select(*key), key, "left_anti")


def delete_with_members(table: DataFrame, members: DataFrame, gone, reference: str) -> tuple[DataFrame, DataFrame]:
    """A tag or an album without the row ``gone``, and its memberships without those that refer to it."""
    return table.where(F.col("id") != gone), members.where(F.col(reference) != gone)


def write_hashes(media: DataFrame, hashes: DataFrame, columns: tuple[str, ...] = ("sha256_hash", "phash")) -> DataFrame:
    """media with newly computed hashes written over the cached ones; null leaves what is there."""
    new = hashes.select("id", *(F.col(c).alias(f"__{c}") for c in columns))
    return media.join(new, "id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*media.columns)


def tags_of(media_tags: DataFrame, tags: DataFrame, media_id) -> DataFrame:
    return media_tags.where(F.col("media_id") == media_id).join(tags.withColumnRenamed("id", "tag_id"), "tag_id").orderBy("name")


def albums_of(album_media: DataFrame, albums: DataFrame, media_id) -> DataFrame:
    return album_media.where(F.col("media_id") == media_id).join(albums.withColumnRenamed("id", "album_id"), "album_id").orderBy(F.desc("created_at"), "album_id")


def media_of_album(album_media: DataFrame, media: DataFrame, album_id) -> DataFrame:
    return album_media.where(F.col("album_id") == album_id).join(media.withColumnRenamed("id", "media_id"), "media_id").orderBy("sort_order", "media_id")


def album_counts(albums: DataFrame, album_media: DataFrame) -> DataFrame:
    """Every album with its number of members, empty ones too."""
    counts = album_media.groupBy("album_id").agg(F.count("*").alias("n"))
    return albums.join(counts.withColumnRenamed("album_id", "id"), "id", "left").withColumn("media_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def add_to_album(album_media: DataFrame, album_id, media_ids: DataFrame) -> DataFrame:
    """media_ids: media_id, position. New members get ordinals from 0 in that order; present ones stay."""
    order = F.row_number().over(W.partitionBy(F.lit(album_id)).orderBy("position", "media_id")) - 1
    rows = media_ids.select(F.lit(album_id).alias("album_id"), "media_id", order.alias("sort_order"))
    return insert_or_ignore(album_media, rows, ["album_id", "media_id"])


def fill_covers(albums: DataFrame, album_media: DataFrame) -> DataFrame:
    """Albums without a cover take their first member."""
    first = album_media.groupBy("album_id").agg(F.min_by("media_id", F.struct("sort_order", "media_id")).alias("first"))
    return albums.join(first.withColumnRenamed("album_id", "id"), "id", "left").withColumn("cover_media_id", F.coalesce("cover_media_id", "first")).drop("first")


# ---- upload ledger ----------------------------------------------------------------------------


def uploaded_ids(uploads: DataFrame, media: DataFrame) -> DataFrame:
    """Ids in the ledger, and ids of media whose content was uploaded under another one."""
    by_id = uploads.where("media_id is not null").select("media_id")
    hashes = uploads.where("sha256 is not null").select(F.col("sha256").alias("sha256_hash")).distinct()
    return by_id.union(media.join(hashes, "sha256_hash", "left_semi").select(F.col("id").alias("media_id"))).distinct()


def uploaded_hashes(uploads: DataFrame) -> DataFrame:
    return uploads.where("sha256 is not null").select("sha256").distinct()


def not_uploaded(media: DataFrame, uploads: DataFrame) -> DataFrame:
    return media.join(uploads.select(F.col("media_id").alias("id")), "id", "left_anti")


def upload_worklist(media: DataFrame, exif: DataFrame, uploads: DataFrame, bursts: DataFrame | None = None, burst_groups: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """id, file_path, best_date, sha256_hash and skip: what an upload run does with each item, oldest first.

    Pending bursts give up all but their best. skip is null, ``uploaded`` for ids or hashes in the ledger,
    or ``same_content`` for a later item with the content of an earlier one of the same run.
    """
    rows = media if ids is None else media.join(ids, "id", "left_semi")
    if bursts is not None:
        live = burst_groups.where("status = 'pending'").select(F.col("id").alias("group_id"))
        worse = bursts.where("not is_best").join(live, "group_id", "left_semi").select(F.col("media_id").alias("id"))
        rows = rows.join(worse, "id", "left_anti")
    rows = rows.join(exif.select(F.col("media_id").alias("id"), "date_taken"), "id", "left").withColumn("best_date", F.coalesce("date_taken", "modified_at"))
    seen_ids = uploads.where("media_id is not null").select(F.col("media_id").alias("id")).distinct().withColumn("__id", F.lit(True))
    seen = uploaded_hashes(uploads).withColumnRenamed("sha256", "sha256_hash").withColumn("__hash", F.lit(True))
    rows = rows.join(seen_ids, "id", "left").join(seen, "sha256_hash", "left").withColumn("known", F.coalesce("__id", "__hash", F.lit(False)))
    # The first of equal contents that is not known yet; partial aggregation instead of a window, as one content may be most of the rows.
    first = rows.where("not known and sha256_hash is not null").groupBy("sha256_hash").agg(F.min(F.struct("best_date", "id")).alias("first"))
    rows = rows.join(first, "sha256_hash", "left")
    skip = F.when(F.col("known"), "uploaded").when(F.col("sha256_hash").isNotNull() & (F.col("first.id") != F.col("id")), "same_content")
    return rows.select("id", "file_path", "best_date", "sha256_hash", skip.alias("skip"))


def upload_run(worklist: DataFrame, attempts: DataFrame, root: str, organize_by_date: bool = True, skip_uploaded: bool = True) -> DataFrame:
    """id, status, reason, remote_path: how a run over the worklist ends, given what the server answers to each item.

    worklist: id, file_name, best_date, sha256_hash, known (its id or content is in the ledger); taken oldest first. attempts: id,
    code: 0 is done, 1805 a name that is taken (skipped), 105 and 119 an ended session (this item fails, those after it are not
    tried), null or no row a file that is not there, any other code a failure. Once a content is up, later items with it are skipped;
    an item that failed keeps none of them back. What an item does depends on the first success of its content and
    the first end of a session only: two aggregates, no loop over the order.
    """
    at = F.struct("best_date", "id")
    rows = worklist.join(attempts.select("id", "code"), "id", "left").withColumn("__skip", F.lit(skip_uploaded) & F.col("known"))
    able = F.col("code").isNotNull() & ~F.col("__skip")
    done = rows.where(able & (F.col("code") == 0) & F.col("sha256_hash").isNotNull()).groupBy("sha256_hash").agg(F.min(at).alias("__done"))
    rows = rows.join(done, "sha256_hash", "left").withColumn("__later", F.lit(skip_uploaded) & F.col("__done").isNotNull() & (at > F.col("__done")))
    tried = able & ~F.col("__later")
    ended = F.col("code").isin(105, 119)
    end = rows.where(tried & ended).agg(F.min(at).alias("__end"))
    rows = rows.withColumn("__end", end.scalar())
    status = (
        F.when(at > F.col("__end"), "not_tried").when(F.col("code").isNull(), "failed").when(F.col("__skip") | F.col("__later"), "skipped")
        .when(F.col("code") == 0, "uploaded").when(F.col("code") == 1805, "skipped").otherwise("failed")
    )
    reason = (
        F.when(at > F.col("__end"), "ended").when(F.col("code").isNull(), "missing").when(F.col("__skip"), "ledger").when(F.col("__later"), "same_content")
        .when(F.col("code") == 1805, "name_taken").when(ended, "session").when(F.col("code") != 0, "code")
    )
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), dates.day_folder(F.col("best_date"))) if organize_by_date else F.lit(root.rstrip("/"))
    return rows.select("id", "sha256_hash", status.alias("status"), reason.alias("reason"), F.when(status == "uploaded", F.concat_ws("/", folder, "file_name")).alias("remote_path"))


def upload_ledger(ledger: DataFrame, run: DataFrame, media: DataFrame) -> DataFrame:
    """The ledger (media_id, sha256, source_path, remote_path) with what a run uploaded; a pair that is there stays as it is."""
    rows = run.where("status = 'uploaded'").join(media.select("id", "file_path"), "id")
    rows = rows.select(F.col("id").alias("media_id"), F.col("sha256_hash").alias("sha256"), F.col("file_path").alias("source_path"), "remote_path")
    return insert_or_ignore(ledger, rows, ["media_id", "remote_path"])


# ---- lists ------------------------------------------------------------------------------------


def source_folder_list(source_folders: DataFrame) -> DataFrame:
    """In the order in which they were added."""
    return source_folders.orderBy("added_at", "id")


def pending_groups(groups: DataFrame, *order: str) -> DataFrame:
    """Pending groups by their order (match_type for duplicates), then by id."""
    return groups.where("status = 'pending'").orderBy(*order, "id")


def group_member_list(members: DataFrame, media: DataFrame, exif: DataFrame) -> DataFrame:
    """Members of burst groups next to their media and date taken, group by group, the best quality first."""
    rows = members.join(media.withColumnRenamed("id", "media_id"), "media_id").join(exif.select("media_id", "date_taken"), "media_id", "left")
    return rows.orderBy("group_id", F.desc("quality_score"), "media_id")
