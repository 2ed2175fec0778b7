"""More of the query catalogue: work on files, and jobs that run as streams or in several commits."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.fixtures import Roles
from mediaframe.functions import paths
from mediaframe.operators import catalog, duplicates, ingest, membership
from mediaframe.plans import folders
from mediaframe.plans.storage import materialize, shared_dir
from mediaframe.queries import EXACT, FOLDER, query
from mediaframe.sources import media

# ---- folder trees -----------------------------------------------------------------------------

FOLDERS = ("_trip", ".hid", "node_modules", "A.app", "_DCIM/100", "b c", "plain")
NAMES = ("_DSC{}.JPG", "IMG_{}.mov", ".x{}.jpg", "n{}.txt", "c{}.png")
TREE_SQL = f"""SELECT p_partkey AS k, {list(FOLDERS)}[p_partkey % 7 + 1] AS folder, replace({list(NAMES)}[p_partkey % 5 + 1], '{{}}', CAST(p_partkey AS VARCHAR)) AS name,
  {list(FOLDERS)}[p_partkey % 7 + 1] || '/' || (p_partkey % 10) || '/' || replace({list(NAMES)}[p_partkey % 5 + 1], '{{}}', CAST(p_partkey AS VARCHAR)) AS rel_path, p_partkey % 50 AS size FROM part"""


def tree_files(r: Roles) -> DataFrame:
    """rel_path, size: a file per part, in folders and under names that scans treat differently."""
    k = F.col("p_partkey")
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), (k % len(of) + 1).cast("int"))
    name = F.replace(pick(NAMES), F.lit("{}"), k.cast("string"))
    return r.table("part").select(F.concat_ws("/", pick(FOLDERS), (k % 10).cast("string"), name).alias("rel_path"), (k % 50).alias("size"))


def write_tree(files: DataFrame, root: str) -> None:
    """Files of the given sizes below a folder that all executors share; writing one again changes nothing."""
    top = root.removeprefix("file://")

    def go(batches):
        for pdf in batches:
            for rel, size in zip(pdf["rel_path"], pdf["size"], strict=True):
                path = f"{top}/{rel}"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(b"x" * size)
            yield pdf[["size"]]

    os.makedirs(top, exist_ok=True)
    files.mapInPandas(go, "size long").agg(F.sum("size")).collect()


def _below(root: str, path: Column) -> Column:
    return F.substr(path, F.lit(len(root.removeprefix("file://")) + 2))


@query(
    f"""SELECT rel_path, name AS file_name, size AS file_size, CASE WHEN k % 5 = 1 THEN 'video' ELSE 'image' END AS media_type FROM ({TREE_SQL})
    WHERE folder NOT IN ('.hid', 'node_modules', 'A.app') AND k % 5 NOT IN (2, 3)"""
)
def scan_tree(r: Roles) -> DataFrame:
    """Files on disk, walked: underscores stay, hidden and excluded ones go."""
    root = shared_dir(r.spark, "tree")
    write_tree(tree_files(r), root)
    found = materialize(media.scan(r.spark, root), "scan")
    return found.select(_below(root, F.col("file_path")).alias("rel_path"), "file_name", "file_size", "media_type")


@query(f"SELECT rel_path, size FROM ({TREE_SQL})")
def listing_tree(r: Roles) -> DataFrame:
    """What a sync compares: every file, whatever its name."""
    root = shared_dir(r.spark, "tree")
    write_tree(tree_files(r), root)
    return materialize(media.listing(r.spark, root).select("rel_path", "size"), "listing")


# ---- ingest -----------------------------------------------------------------------------------


@query(
    """SELECT file_path, media_type, CAST(CASE WHEN id % 3 = 0 AND id % 10 = 0 THEN file_size + 1 ELSE file_size END AS BIGINT) AS file_size, 1 AS scan_phase, media_type = 'image' AND media_id IS NOT NULL AS has_exif, CASE WHEN media_type = 'image' THEN date_taken END AS date_taken
    FROM media LEFT JOIN exif ON id = media_id""",
    "media", "exif",
)
def ingest_job(r: Roles) -> DataFrame:
    """Three scans in a stream, each of more files than the last and the third with changed sizes, then all of it once more."""
    files = r.media().select("id", "file_path", "file_name", "file_size", "media_type", "modified_at")
    known = r.exif().select("media_id", "date_taken", "camera_make", "camera_model")

    def facts(todo: DataFrame) -> DataFrame:
        """The labels' facts instead of those in files."""
        made = todo.where("media_type = 'image'").withColumn("media_id", F.regexp_extract("file_name", "IMG_([0-9]+)", 1).cast("long")).join(known, "media_id")
        none = [f for f in media.EXIF.split(", ") if f.split()[0] not in ("date_taken", "camera_make", "camera_model")]
        return made.select("id", "date_taken", "camera_make", "camera_model", *(F.lit(None).cast(t).alias(c) for c, t in map(str.split, none)))

    store = ingest.open_catalog(r.spark, shared_dir(r.spark, "catalog"), buckets=8)
    source, check = shared_dir(r.spark, "scans"), shared_dir(r.spark, "ingest")
    changed = F.when((F.col("id") % 10 == 0) & (F.col("id") % 3 == 0), 1).otherwise(0)
    for scan in (files.where("id % 3 = 0"), files.where("id % 3 <> 2"), files.withColumn("file_size", F.col("file_size") + changed)):
        scan.drop("id").write.mode("append").parquet(source)
        stream = r.spark.readStream.schema(scan.drop("id").schema).parquet(source)
        ingest.ingest_stream(store, stream, check, on_change="refresh", facts=facts).awaitTermination()
    ingest.ingest_stream(store, stream, shared_dir(r.spark, "ingest"), on_change="refresh", facts=facts).awaitTermination()  # repeats number 0
    exif = store.table("media_exif").select(F.col("media_id").alias("id"), "date_taken", F.lit(True).alias("has_exif"))
    rows = store.table("media_files").join(exif, "id", "left")
    return rows.select("file_path", "media_type", "file_size", "scan_phase", F.coalesce("has_exif", F.lit(False)).alias("has_exif"), "date_taken")


# ---- pages of groups --------------------------------------------------------------------------


@query(
    f"""SELECT label, page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS ids FROM (
    SELECT *, place // 20 AS page FROM (SELECT {FOLDER} AS label, id, row_number() OVER (PARTITION BY {FOLDER} ORDER BY coalesce(date_taken, modified_at) DESC, id) - 1 AS place FROM media LEFT JOIN exif ON id = media_id)) GROUP BY label, page""",
    "media", "exif",
)
def media_grouped_pages(r: Roles) -> DataFrame:
    return catalog.grouped_pages(r.media(), r.exif(), "folder", 20).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query(
    f"""SELECT group_id, n, page, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (
    SELECT g.group_id, g.n, d.doc_id, (row_number() OVER (PARTITION BY g.group_id ORDER BY d.doc_id) - 1) // 3 AS page FROM documents d JOIN {EXACT} g ON md5(d.text) = g.k) GROUP BY group_id, n, page"""
)
def exact_dup_pages(r: Roles) -> DataFrame:
    exact = duplicates.exact_groups(r.table("documents"), floor=0, size="n_chars", content="text", key="doc_id")
    out = duplicates.group_pages(exact.select("group_id", F.col("id").alias("media_id"), "is_preferred"), r.media(), 3)
    return out.select("group_id", "n", "page", F.array_join(F.transform("members", lambda m: m["media_id"].cast("string")), ",").alias("ids"))


# ---- folders ----------------------------------------------------------------------------------

FOLDER_REQUESTS = f"""d AS (SELECT {FOLDER} AS f, min(id) AS k FROM media GROUP BY 1),
q AS (SELECT k AS request, f AS source, CASE k % 6 WHEN 0 THEN f WHEN 1 THEN f || '/x' WHEN 2 THEN '/lib/src1' WHEN 5 THEN regexp_replace(f, '/[^/]*$', '') ELSE '/lib/src2' END AS target_dir, CASE WHEN k % 6 = 5 THEN CASE WHEN k % 4 = 1 THEN 'en' WHEN k % 4 = 3 THEN 'new' || k ELSE 'a/b' END END AS new_name FROM d
  UNION ALL SELECT 1000000000, '/lib/src0', '/lib/src1', NULL UNION ALL SELECT 1000000001, '/lib/none', '/lib/src1', NULL),
e AS (SELECT file_path AS path, FALSE AS folder FROM media UNION ALL SELECT f, TRUE FROM d UNION SELECT regexp_replace(f, '/[^/]*$', ''), TRUE FROM d UNION SELECT '/lib', TRUE),
"""


@query(
    "+ " + FOLDER_REQUESTS + """s AS (SELECT *, target_dir || '/' || coalesce(new_name, regexp_extract(source, '[^/]*$')) AS target, CASE
      WHEN source NOT IN (SELECT path FROM e) THEN 'missing' WHEN contains(new_name, '/') THEN 'bad name' WHEN target_dir NOT IN (SELECT path FROM e WHERE folder) THEN 'no target'
      WHEN new_name IS NULL AND starts_with(target_dir || '/', source || '/') THEN 'nested' WHEN EXISTS (SELECT 1 FROM q o WHERE starts_with(q.source, o.source || '/')) THEN 'covered'
      WHEN new_name IS NOT NULL AND target_dir || '/' || new_name IN (SELECT path FROM e) THEN 'taken' ELSE 'ready' END AS status FROM q),
    n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source) - CASE WHEN target IN (SELECT path FROM e) THEN 0 ELSE 1 END AS k FROM s WHERE status = 'ready'),
    r AS (SELECT request, target || CASE WHEN k = 0 THEN '' ELSE ' (' || k || ')' END AS destination FROM n)
    SELECT s.request, s.source, status, destination, CASE WHEN status = 'ready' THEN (SELECT count(*) FROM e WHERE path = s.source OR starts_with(path, s.source || '/')) END AS n FROM s LEFT JOIN r ON s.request = r.request""",
    "media",
)
def folder_plan(r: Roles) -> DataFrame:
    """Requests to move and rename folders, what they come to, and how many entries each takes along."""
    media_rows = r.media()
    folder = paths.parent(F.col("file_path"), F.col("file_name"))
    d = media_rows.groupBy(folder.alias("f")).agg(F.min("id").alias("k"))
    k, up = F.col("k"), paths.parent_of(F.col("f"))
    where = F.when(k % 6 == 0, F.col("f")).when(k % 6 == 1, F.concat("f", F.lit("/x"))).when(k % 6 == 2, "/lib/src1").when(k % 6 == 5, up).otherwise("/lib/src2")
    name = F.when(k % 6 == 5, F.when(k % 4 == 1, "en").when(k % 4 == 3, F.concat(F.lit("new"), k)).otherwise("a/b"))
    asked = d.select(k.alias("request"), F.col("f").alias("source"), where.alias("target_dir"), name.alias("new_name"))
    more = r.spark.createDataFrame([(1_000_000_000, "/lib/src0", "/lib/src1", None), (1_000_000_001, "/lib/none", "/lib/src1", None)], asked.schema)
    tops = d.select(F.explode(F.array("f", up, F.lit("/lib"))).alias("path")).distinct().withColumn("folder", F.lit(True))
    entries = media_rows.select(F.col("file_path").alias("path"), F.lit(False).alias("folder")).unionByName(tops)
    planned = materialize(folders.plan(asked.unionByName(more), entries), "plan")
    counts = folders.expand(planned, entries).groupBy("request").agg(F.count("*").alias("n"))
    return planned.join(counts, "request", "left").select("request", "source", "status", "destination", "n")


@query(
    f"""+ gone AS (SELECT id FROM media WHERE file_path LIKE '/lib/src1/%'), m AS (SELECT g.group_id, d.doc_id AS media_id FROM documents d JOIN {EXACT} g ON md5(d.text) = g.k)
    SELECT group_id AS id, count(*) AS n, min(media_id) AS first_left FROM m WHERE media_id NOT IN (SELECT id FROM gone) GROUP BY group_id""",
    "media",
)
def purge_folder_groups(r: Roles) -> DataFrame:
    """Groups that outlive the purge of a folder, with the members they keep; those that lost all go."""
    exact = duplicates.exact_groups(r.table("documents"), floor=0, size="n_chars", content="text", key="doc_id")
    members = materialize(exact.select("group_id", F.col("id").alias("media_id")), "members")
    groups = members.select(F.col("group_id").alias("id")).distinct()
    left = membership.purge_folder({"media_files": r.media(), "duplicate_members": members, "duplicate_groups": groups}, "/lib/src1")
    counts = left["duplicate_members"].groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("n"), F.min("media_id").alias("first_left"))
    return left["duplicate_groups"].join(counts, "id", "left")
