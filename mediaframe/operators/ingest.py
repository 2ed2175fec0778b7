"""Incremental catalog ingest: what a scan brings, and what becomes of the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediaframe.plans.storage import materialize, release
from mediaframe.plans.versions import BUCKETS, Store
from mediaframe.sources import media


def delta(catalog: DataFrame, scan: DataFrame, key: str = "file_path", facts: tuple[str, ...] = ("file_size", "modified_at")) -> DataFrame:
    """key, state: new, changed or same for every scanned file; gone for those of the catalog the scan lacks."""
    old = catalog.select(key, *(F.col(c).alias(f"__{c}") for c in facts), F.lit(True).alias("__old"))
    new = scan.select(key, *facts, F.lit(True).alias("__new"))
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "gone").when(same, "same").otherwise("changed")
    return new.join(old, key, "full_outer").select(key, state.alias("state"))


def changed(catalog: DataFrame, scan: DataFrame, key: str = "file_path", facts: tuple[str, ...] = ("file_size", "modified_at")) -> DataFrame:
    """Scanned files that the catalog does not hold in the same state."""
    return scan.join(catalog.select(key, *facts), [key, *facts], "left_anti")


def ingest(catalog: DataFrame, scan: DataFrame, on_change: str = "ignore", prune: bool = False, key: str = "file_path", facts: tuple[str, ...] = ("file_size", "modified_at")) -> DataFrame:
    """The catalog after a scan. New files come in with scan_phase 0.

    on_change: ``ignore`` leaves changed files as they are; ``refresh`` takes their new facts and sends
    them through enrichment again. prune: files that the scan lacks go.
    """
    scan = scan.dropDuplicates([key])
    base = catalog.join(scan.select(key), key, "left_semi") if prune else catalog
    if on_change == "refresh":
        news = scan.select(key, *(F.col(c).alias(f"__{c}") for c in facts), F.lit(True).alias("__seen"))
        rows = base.join(news, key, "left")
        moved = F.col("__seen").isNotNull() & ~F.struct(*facts).eqNullSafe(F.struct(*(F.col(f"__{c}").alias(c) for c in facts)))
        rows = rows.withColumn("__moved", moved)
        rows = rows.withColumns({c: F.when(F.col("__moved"), F.col(f"__{c}")).otherwise(F.col(c)) for c in facts} | {"scan_phase": F.when(F.col("__moved"), 0).otherwise(F.col("scan_phase"))})
        base = rows.select(*catalog.columns)
    fresh = scan.join(catalog.select(key), key, "left_anti").withColumn("scan_phase", F.lit(0))
    return base.unionByName(fresh, allowMissingColumns=True)


# ---- the job ----------------------------------------------------------------------------------

MEDIA = "id string, file_path string, file_name string, file_size long, mime_type string, media_type string, modified_at string, width int, height int, scan_phase int"
EXIF = "media_id string, " + media.EXIF.removesuffix(", width int, height int")


def facts_of_files(todo: DataFrame) -> DataFrame:
    """id and what the files of these rows say of themselves; no file, no facts."""
    return media.read_exif_files(todo.where("media_type = 'image'"), "id")


def open_catalog(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Store:
    """The store of media_files by path and media_exif by file, made where there is none."""
    store = Store(spark, root)
    store.create("media_files", "file_path", MEDIA, buckets)
    store.create("media_exif", "media_id", EXIF, buckets)
    return store


def ingest_batch(store: Store, scan: DataFrame, number: int, source: str = "scan", on_change: str = "ignore", facts: Callable[[DataFrame], DataFrame] = facts_of_files) -> int:
    """From a scan to the enriched catalog in one commit; the version after it.

    New files come in, changed ones are left or refreshed, and what is in phase 0 then is enriched, which takes
    it to phase 1, whether its file could be read or not. An id is the hash of the path, so a batch that is run
    again makes the same rows; one that was committed is not run again. Of rows with equal paths one is taken; null paths are left out.
    """
    if number <= store.last(source):
        return store.manifest()["version"]
    seen = scan.where("file_path is not null").withColumn("id", F.sha1("file_path"))
    names = [c for c in store.table("media_files").columns if c in seen.columns]
    seen = materialize(seen.groupBy("file_path").agg(F.max(F.struct(*(c for c in names if c != "file_path"))).alias("__r")).select("file_path", "__r.*"), "scan")
    touched = store.touched("media_files", seen)
    before = store.table("media_files", buckets=touched)
    after = materialize(ingest(before, seen, on_change), "catalog")
    todo = after.where("scan_phase = 0")
    found = materialize(facts(todo), "facts")
    size = found.select("id", F.col("width").alias("__w"), F.col("height").alias("__h"))
    rows = after.join(size, "id", "left").withColumns({"width": F.coalesce("__w", "width"), "height": F.coalesce("__h", "height"), "scan_phase": F.lit(1)})
    own = [f.name for f in store.table("media_exif").schema]
    exif = found.withColumnRenamed("id", "media_id").select(*own)
    of_exif = store.touched("media_exif", exif)
    kept = store.table("media_exif", buckets=of_exif).join(exif.select("media_id"), "media_id", "left_anti")
    version = store.commit(source, number, {"media_files": (touched, rows), "media_exif": (of_exif, kept.unionByName(exif))})
    release(seen, after, found)
    return version


def ingest_stream(store: Store, scans: DataFrame, checkpoint: str, **how) -> StreamingQuery:
    """Every batch of scanned rows as one commit, numbered as the stream numbers it."""
    return scans.writeStream.foreachBatch(lambda batch, number: ingest_batch(store, batch, number, **how) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
