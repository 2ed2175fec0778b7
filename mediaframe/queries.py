"""The query catalogue: each operator over the role views, and the same thing in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.fixtures import Roles, sql
from mediaframe.functions import dates, hashing, paths, quality, text
from mediaframe.operators import bursts, catalog, duplicates, folders, geo, ingest, journal, membership, organize, sync
from mediaframe.plans.storage import shared_dir
from mediaframe.plans.versions import Store
from mediaframe.sources import media as media_source
from mediaframe.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None, *views: str):
    """Register a function of role views as a query, with its SQL."""

    def add(f: Callable[[Roles], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *views) if views else oracle
        return f

    return add


PAGE = ["id", "file_path", "file_name", "file_size", "media_type", "modified_at", "date_taken"]
FOLDER = "substr(file_path, 1, length(file_path) - length(file_name) - 1)"

# ---- catalog ----------------------------------------------------------------------------------


@query(
    """SELECT id, file_path, file_name, file_size, media_type, modified_at, date_taken FROM media LEFT JOIN exif ON id = media_id
    WHERE file_path LIKE '/lib/src1/%' AND (lower(file_name) LIKE '%img\\_%' ESCAPE '\\' OR lower(file_path) LIKE '%img\\_%' ESCAPE '\\') ORDER BY coalesce(date_taken, modified_at) DESC, id LIMIT 20 OFFSET 10""",
    "media", "exif",
)
def media_list_page(r: Roles) -> DataFrame:
    return catalog.media_page(r.media(), r.exif(), catalog.Facets(folder="/lib/src1/", media_type="all", search=" Img_ "), 20, 10).select(PAGE)


@query("SELECT count(*) AS total FROM media WHERE file_path LIKE '/lib/src1/%' AND media_type = 'image' AND (lower(file_name) LIKE '%img\\_1%' ESCAPE '\\' OR lower(file_path) LIKE '%img\\_1%' ESCAPE '\\')", "media")
def media_list_count(r: Roles) -> DataFrame:
    return catalog.media_count(r.media(), catalog.Facets(folder="/lib/src1", media_type="image", search="IMG_1"))


@query(
    """SELECT id, file_name, comment, camera_model FROM media LEFT JOIN exif ON id = media_id
    WHERE lower(file_name) LIKE '%1_e%' OR lower(file_path) LIKE '%1_e%' OR lower(camera_model) LIKE '%1_e%' OR lower(camera_make) LIKE '%1_e%' OR lower(comment) LIKE '%1_e%' ORDER BY modified_at DESC, id LIMIT 100""",
    "media", "exif",
)
def media_search_wide(r: Roles) -> DataFrame:
    return catalog.search_wide(r.media(), r.exif(), "1_E").select("id", "file_name", "comment", "camera_model")


@query("SELECT count(*) AS total_count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size, count(*) FILTER (media_type = 'image') AS image_count, count(*) FILTER (media_type = 'video') AS video_count FROM media", "media")
def media_stats(r: Roles) -> DataFrame:
    return catalog.stats(r.media())


@query("SELECT coalesce(replace(substr(date_taken, 1, 10), ':', '-'), substr(modified_at, 1, 10)) AS day, count(*) AS n FROM media LEFT JOIN exif ON id = media_id GROUP BY 1", "media", "exif")
def media_by_day(r: Roles) -> DataFrame:
    return catalog.by_day(r.media(), r.exif())


@query(f"SELECT {FOLDER} AS folder, count(*) AS n FROM media GROUP BY 1", "media")
def media_by_folder(r: Roles) -> DataFrame:
    return catalog.by_folder(r.media())


@query(
    f"""SELECT label, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY d DESC, id) AS ids FROM (
    SELECT {FOLDER} AS label, id, coalesce(date_taken, modified_at) AS d FROM media LEFT JOIN exif ON id = media_id) GROUP BY label""",
    "media", "exif",
)
def media_grouped(r: Roles) -> DataFrame:
    return catalog.grouped(r.media(), r.exif(), "folder").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("SELECT id, row_number() OVER (ORDER BY coalesce(width, 0)::BIGINT * coalesce(height, 0) DESC, id) AS place FROM media", "media")
def media_sorted_by_pixels(r: Roles) -> DataFrame:
    return catalog.places(catalog.sorted_media(r.media(), r.exif(), "pixels", descending=True)).select("id", "place")


DASHBOARD = f"""
+ m AS (SELECT * FROM media WHERE file_path LIKE '/lib/src1/%'),
g AS (SELECT md5(text) AS k FROM documents GROUP BY 1 HAVING count(*) > 1),
dm AS (SELECT sha256_hash AS group_id, id AS media_id FROM media WHERE sha256_hash IN (SELECT k FROM g)),
bm AS (SELECT album_id AS group_id, media_id FROM album_media)
SELECT (SELECT count(*) FROM m) AS total_count, (SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) FROM m) AS total_size,
 (SELECT count(*) FROM m WHERE NOT EXISTS (SELECT 1 FROM uploads u WHERE u.media_id = m.id)) AS unuploaded_count,
 (SELECT count(*) FROM m WHERE NOT regexp_matches(file_path, '/[12][0-9]{{3}}-[0-9]{{2}}-[0-9]{{2}}/')) AS undated_files,
 (SELECT count(DISTINCT {FOLDER}) FROM m WHERE regexp_matches({FOLDER}, '/[12][0-9]{{3}}[01][0-9][0-3][0-9]$')) AS date_format_folders,
 (SELECT count(DISTINCT group_id) FROM dm WHERE media_id IN (SELECT id FROM m)) AS dup_groups,
 (SELECT count(DISTINCT group_id) FROM bm WHERE group_id % 2 = 0 AND media_id IN (SELECT id FROM m)) AS burst_groups
"""


@query(DASHBOARD, "media", "uploads", "album_media")
def dashboard_scoped(r: Roles) -> DataFrame:
    media = r.media()
    repeated = media.groupBy("sha256_hash").count().where("count > 1").select(F.col("sha256_hash").alias("id"), F.lit("pending").alias("status"))
    members = media.select(F.col("sha256_hash").alias("group_id"), F.col("id").alias("media_id"))
    groups = r.albums().select("id", F.when(F.col("id") % 2 == 0, "pending").otherwise("resolved").alias("status"))
    return catalog.dashboard(media, r.uploads(), members, repeated, r.album_media().select(F.col("album_id").alias("group_id"), "media_id"), groups, scope="/lib/src1/")


@query("SELECT id, file_name FROM media WHERE EXISTS (SELECT 1 FROM media_tags t WHERE t.media_id = id AND t.tag_id = 1)", "media", "media_tags")
def in_tag(r: Roles) -> DataFrame:
    return catalog.in_tag(r.media(), r.media_tags(), 1).select("id", "file_name")


@query("SELECT id, file_name FROM media WHERE EXISTS (SELECT 1 FROM album_media a WHERE a.media_id = id AND a.album_id = 3)", "media", "album_media")
def in_album(r: Roles) -> DataFrame:
    return catalog.in_album(r.media(), r.album_media(), 3).select("id", "file_name")


@query("SELECT a.media_id, a.sort_order, m.file_name FROM album_media a JOIN media m ON m.id = a.media_id WHERE a.album_id = 3", "media", "album_media")
def album_members(r: Roles) -> DataFrame:
    return membership.media_of_album(r.album_media(), r.media(), 3).select("media_id", "sort_order", "file_name")


@query("SELECT id, comment FROM media WHERE comment IS NOT NULL AND comment <> ''", "media")
def media_comments(r: Roles) -> DataFrame:
    return catalog.comments(r.media())


@query("SELECT id FROM media ORDER BY modified_at DESC, id LIMIT 50", "media")
def phase0_backlog(r: Roles) -> DataFrame:
    return catalog.backlog(r.media(), 50).select("id")


# ---- membership and uploads -------------------------------------------------------------------


@query("SELECT id FROM media WHERE NOT EXISTS (SELECT 1 FROM uploads u WHERE u.media_id = id)", "media", "uploads")
def not_uploaded(r: Roles) -> DataFrame:
    return membership.not_uploaded(r.media(), r.uploads()).select("id")


@query("SELECT media_id FROM uploads WHERE media_id IS NOT NULL UNION SELECT id FROM media WHERE sha256_hash IN (SELECT sha256 FROM uploads WHERE sha256 IS NOT NULL)", "media", "uploads")
def uploaded_ids(r: Roles) -> DataFrame:
    return membership.uploaded_ids(r.uploads(), r.media())


@query("SELECT DISTINCT sha256 FROM uploads WHERE sha256 IS NOT NULL", "uploads")
def uploaded_hashes(r: Roles) -> DataFrame:
    return membership.uploaded_hashes(r.uploads())


@query("SELECT a.id, (SELECT count(*) FROM album_media m WHERE m.album_id = a.id) AS media_count FROM albums a", "albums", "album_media")
def album_counts(r: Roles) -> DataFrame:
    return membership.album_counts(r.albums(), r.album_media())


WORKLIST = """
+ w AS (SELECT m.id, m.file_path, coalesce(e.date_taken, m.modified_at) AS best_date, m.sha256_hash,
    m.id IN (SELECT media_id FROM uploads) OR m.sha256_hash IN (SELECT sha256 FROM uploads WHERE sha256 IS NOT NULL) AS known
  FROM media m LEFT JOIN exif e ON m.id = e.media_id WHERE m.id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
f AS (SELECT *, row_number() OVER (PARTITION BY sha256_hash, known ORDER BY best_date, id) AS k FROM w)
SELECT id, file_path, best_date, sha256_hash, CASE WHEN known THEN 'uploaded' WHEN k > 1 THEN 'same_content' END AS skip FROM f
"""


@query(WORKLIST, "media", "exif", "uploads")
def upload_worklist(r: Roles) -> DataFrame:
    worse = r.table("labels").select(F.lit(1).alias("group_id"), F.col("doc_id").alias("media_id"), (F.col("quality") == 1).alias("is_best"))
    live = r.spark.range(1, 2).select("id", F.lit("pending").alias("status"))
    return membership.upload_worklist(r.media(), r.exif(), r.uploads(), worse, live)


@query("SELECT id, CASE WHEN file_path LIKE '/lib/src1/%' THEN '/moved/one' || substr(file_path, 10) ELSE file_path END AS file_path FROM media", "media")
def prefix_rewrite(r: Roles) -> DataFrame:
    return membership.rewrite_prefix(r.media().select("id", "file_path"), "/lib/src1", "/moved/one/")


@query("SELECT conv_id, turn, role, CAST(n AS BIGINT) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE k = 1")
def conversation_latest(r: Roles) -> DataFrame:
    rows = r.table("conversations").groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("last"), F.count("*").alias("turns"))
    return rows.select("conv_id", "last.turn", "last.role", "turns")


# ---- duplicates -------------------------------------------------------------------------------

EXACT = "(SELECT md5(text) AS k, n_chars AS size, count(*) AS n, min(doc_id) AS group_id FROM documents WHERE n_chars > 0 GROUP BY 1, 2 HAVING count(*) > 1)"


def _exact(r: Roles) -> DataFrame:
    return duplicates.exact_groups(r.table("documents"), floor=0, size="n_chars", content="text", key="doc_id")


@query(f"SELECT g.group_id, d.doc_id AS id, d.n_chars AS size FROM documents d JOIN {EXACT} g ON md5(d.text) = g.k")
def exact_dup_groups(r: Roles) -> DataFrame:
    return _exact(r).select("group_id", "id", "size")


@query(f"SELECT group_id, n, size, CAST(size * (n - 1) AS BIGINT) AS saved FROM {EXACT} g")
def exact_dup_savings(r: Roles) -> DataFrame:
    return duplicates.group_summary(_exact(r))


@query(f"SELECT d.doc_id AS id, d.doc_id = g.group_id AS is_preferred FROM documents d JOIN {EXACT} g ON md5(d.text) = g.k")
def exact_dup_preferred(r: Roles) -> DataFrame:
    return _exact(r).select("id", "is_preferred")


@query(f"SELECT g.group_id, g.n, string_agg(CAST(d.doc_id AS VARCHAR), ',' ORDER BY d.doc_id) AS ids FROM documents d JOIN {EXACT} g ON md5(d.text) = g.k GROUP BY g.group_id, g.n")
def exact_dup_details(r: Roles) -> DataFrame:
    members = _exact(r).select("group_id", F.col("id").alias("media_id"), "is_preferred")
    out = duplicates.group_details(members, r.media())
    return out.select("group_id", "n", F.array_join(F.transform("members", lambda m: m["media_id"].cast("string")), ",").alias("ids"))


@query(f"SELECT d.doc_id AS id FROM documents d JOIN {EXACT} g ON md5(d.text) = g.k WHERE d.doc_id <> g.group_id AND g.group_id % 2 = 0")
def trash_preview(r: Roles) -> DataFrame:
    members = _exact(r).select("group_id", F.col("id").alias("media_id"), "is_preferred")
    groups = members.select(F.col("group_id").alias("id")).distinct().withColumn("status", F.when(F.col("id") % 2 == 0, "pending").otherwise("dismissed"))
    return duplicates.trash_preview(members, groups, r.media(), "is_preferred").select(F.col("media_id").alias("id"))


@query(f"SELECT g.group_id AS id, count(d.doc_id) AS n FROM {EXACT} g LEFT JOIN (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) d ON md5(d.text) = g.k GROUP BY 1 HAVING count(d.doc_id) <= 1")
def groups_to_resolve(r: Roles) -> DataFrame:
    """Groups with one member left or none, once the labelled documents are gone."""
    found = _exact(r)
    members = found.select("group_id", F.col("id").alias("media_id")).join(r.table("labels").select(F.col("doc_id").alias("media_id")), "media_id", "left_anti")
    return membership.groups_to_resolve(found.select(F.col("group_id").alias("id")).distinct().withColumn("status", F.lit("pending")), members)


PAIRS = """
+ b AS (SELECT id, phash, i AS band, (phash >> (56 - 8 * i)) & 255 AS v FROM hashes, (SELECT unnest(range(8)) AS i)),
s AS (SELECT band, v FROM b GROUP BY band, v HAVING count(*) BETWEEN 2 AND 500),
h AS (SELECT b.* FROM b JOIN s ON b.band = s.band AND b.v = s.v),
p AS (SELECT DISTINCT x.id AS a, y.id AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INTEGER) AS distance FROM h x JOIN h y ON x.band = y.band AND x.v = y.v AND x.id < y.id WHERE bit_count(xor(x.phash, y.phash)) <= 5)
"""
CLUSTERS = (
    PAIRS
    + """, u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n),
c AS (SELECT n AS id, min(m) AS cluster FROM r GROUP BY n)
"""
)


@query(PAIRS + "SELECT a, b, distance FROM p", "hashes")
def similar_pairs(r: Roles) -> DataFrame:
    return duplicates.similar_pairs(r.hashes())


@query(CLUSTERS + "SELECT id, cluster FROM c", "hashes")
def similar_clusters(r: Roles) -> DataFrame:
    return duplicates.similar_clusters(duplicates.similar_pairs(r.hashes())).select(F.col("node").alias("id"), F.col("label").alias("cluster"))


@query(
    CLUSTERS + """SELECT c.cluster, count(DISTINCT c.id) AS n, 1.0 - max(bit_count(xor(hx.phash, hy.phash)))::DOUBLE / 64.0::DOUBLE AS score
    FROM c JOIN c d ON c.cluster = d.cluster JOIN hashes hx ON hx.id = c.id JOIN hashes hy ON hy.id = d.id GROUP BY c.cluster""",
    "hashes",
)
def similar_scores(r: Roles) -> DataFrame:
    hashes = r.hashes()
    return duplicates.cluster_scores(duplicates.similar_clusters(duplicates.similar_pairs(hashes)), hashes)


@query(CLUSTERS + "SELECT cluster, id AS preferred FROM c JOIN documents ON doc_id = id QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n_chars DESC, id DESC) = 1", "hashes")
def similar_preferred(r: Roles) -> DataFrame:
    clusters = duplicates.similar_clusters(duplicates.similar_pairs(r.hashes()))
    rows = clusters.join(r.table("documents").select(F.col("doc_id").alias("node"), "n_chars"), "node")
    return duplicates.preferred(rows, "label", ["n_chars", "node"]).where("is_preferred").select(F.col("label").alias("cluster"), F.col("node").alias("preferred"))


# ---- bursts -----------------------------------------------------------------------------------


def _sessions(by: str, gap: int) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""
o AS (SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) // 1000000 AS d FROM events WINDOW w AS ({part}ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN d <= {gap} THEN 0 ELSE 1 END) OVER ({part}ORDER BY ts, event_id) AS g FROM o),
b AS (SELECT *, count(*) OVER (PARTITION BY {by + ',' if by else ''} g) AS n, first_value(event_id) OVER (PARTITION BY {by + ',' if by else ''} g ORDER BY ts, event_id) AS first_id FROM s)
"""


@query("WITH " + _sessions("", 5) + "SELECT DISTINCT first_id, CAST(n AS BIGINT) AS n FROM b WHERE n >= 2")
def burst_sessions(r: Roles) -> DataFrame:
    rows = bursts.sessions(r.table("events"), "ts", "event_id")
    return rows.groupBy("first_id").agg(F.count("*").alias("n"))


@query(
    "WITH " + _sessions("", 5) + """, m AS (SELECT *, least(value / 20.0, 100.0) * 0.45 + 50.0 * 0.30 + 50.0 * 0.15 + CASE WHEN max(size) OVER (PARTITION BY g) > 0 THEN least(size::DOUBLE / max(size) OVER (PARTITION BY g) * 100.0, 100.0) ELSE 50.0 END * 0.10 AS q
      FROM (SELECT *, event_id % 1000 AS size FROM b WHERE n >= 2))
    SELECT first_id, event_id AS best_id, round(q, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY g ORDER BY q DESC, ts DESC, event_id DESC) = 1"""
)
def burst_best(r: Roles) -> DataFrame:
    none = F.lit(None).cast("int")
    rows = bursts.sessions(r.table("events"), "ts", "event_id").withColumns({"width": none, "height": none, "file_size": F.col("event_id") % 1000})
    scored = bursts.score(rows, "first_id", F.col("value"), F.lit(None).cast("double"))
    return bursts.best(scored, "first_id", "quality_score", ["ts", "event_id"]).where("is_best").select("first_id", F.col("event_id").alias("best_id"), F.round("quality_score", 6).alias("score"))


@query("WITH " + _sessions("user_id", 300) + "SELECT DISTINCT user_id, first_id, CAST(n AS BIGINT) AS n FROM b WHERE n >= 2")
def burst_sessions_by_user(r: Roles) -> DataFrame:
    rows = bursts.sessions(r.table("events"), "ts", "event_id", gap=300, by=["user_id"])
    return rows.groupBy("user_id", "first_id").agg(F.count("*").alias("n"))


SCORES = """
+ p AS (SELECT id, substr(file_path, 1, length(file_path) - length(file_name) - 1) AS g, file_size, width, height, CAST(file_size AS DOUBLE) AS sharp FROM media),
m AS (SELECT g, max(coalesce(width, 0)::DOUBLE * coalesce(height, 0)::DOUBLE) AS area, max(file_size) AS size FROM p GROUP BY g)
SELECT id, round(least(sharp / 20.0, 100.0) * 0.45 + 50.0 * 0.30 + CASE WHEN width IS NULL OR height IS NULL OR area <= 0 THEN 50.0 ELSE least(width::DOUBLE * height / area * 100.0, 100.0) END * 0.15
  + CASE WHEN size > 0 THEN least(file_size::DOUBLE / size * 100.0, 100.0) ELSE 50.0 END * 0.10, 6) AS quality_score FROM p JOIN m ON p.g = m.g
"""


@query(SCORES, "media")
def burst_scores(r: Roles) -> DataFrame:
    rows = r.media().withColumn("g", paths.parent(F.col("file_path"), F.col("file_name")))
    return bursts.score(rows, "g", F.col("file_size").cast("double"), F.lit(None).cast("double")).select("id", F.round("quality_score", 6).alias("quality_score"))


MARKS = "(SELECT m.id, m.file_size, CASE WHEN a.best THEN 'keep' WHEN NOT a.best THEN 'discard' WHEN l.quality = 0 THEN 'discard' END AS mark FROM media m LEFT JOIN (SELECT media_id, min(sort_order) = 0 AS best FROM album_media GROUP BY 1) a ON a.media_id = m.id LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = m.id)"


def _marks(r: Roles) -> DataFrame:
    held = r.album_media().groupBy("media_id").agg((F.min("sort_order") == 0).alias("is_best"))
    scores = r.table("labels").groupBy(F.col("doc_id").alias("media_id")).agg((F.min("quality") * 100.0).alias("score"))
    return bursts.review_marks(r.media(), held, scores)


@query(f"SELECT id, mark FROM {MARKS}", "media", "album_media")
def review_marks(r: Roles) -> DataFrame:
    return _marks(r)


@query(f"SELECT count(*) FILTER (mark = 'keep') AS keep, count(*) FILTER (mark = 'discard') AS discard, CAST(coalesce(sum(file_size) FILTER (mark = 'discard'), 0) AS BIGINT) AS discard_bytes FROM {MARKS}", "media", "album_media")
def review_progress(r: Roles) -> DataFrame:
    return bursts.review_progress(_marks(r), r.media())


# ---- organize and sync ------------------------------------------------------------------------

BY_DAY = "(SELECT id, file_path AS source, file_name, file_size, replace(substr(coalesce(date_taken, modified_at), 1, 10), ':', '-') AS subfolder FROM media LEFT JOIN exif ON id = media_id)"


@query(f"SELECT id, source, '/out/' || subfolder || '/' || file_name AS target FROM {BY_DAY} WHERE source <> '/out/' || subfolder || '/' || file_name", "media", "exif")
def organize_by_day(r: Roles) -> DataFrame:
    return organize.organize_plan(r.media(), r.exif(), "/out").select("id", "source", "target")


@query("SELECT id, file_path AS source, '/out/' || upper(ext) || '/' || file_name AS target FROM media", "media")
def organize_by_type(r: Roles) -> DataFrame:
    return organize.organize_plan(r.media(), r.exif(), "/out", "type").select("id", "source", "target")


@query(f"SELECT count(*) AS total_files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size, count(DISTINCT subfolder) AS new_folders FROM {BY_DAY}", "media", "exif")
def organize_totals(r: Roles) -> DataFrame:
    return organize.plan_totals(organize.organize_plan(r.media(), r.exif(), "/out"))


@query("SELECT id, CASE WHEN k = 1 THEN '/flat/' || source || '.jpg' ELSE '/flat/' || source || ' (' || (k - 1) || ').jpg' END AS final_target FROM (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS k FROM documents)")
def move_collisions(r: Roles) -> DataFrame:
    plan = r.table("documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("source"), F.concat(F.lit("/flat/"), "source", F.lit(".jpg")).alias("target"))
    return organize.resolve_collisions(plan, r.spark.createDataFrame([], "path string")).select(F.col("doc_id").alias("id"), "final_target")


@query(f"SELECT path, dir || '/' || substr(name, 1, 4) || '-' || substr(name, 5, 2) || '-' || substr(name, 7) AS target FROM (SELECT DISTINCT {FOLDER} AS path, regexp_extract({FOLDER}, '^(.*)/[^/]*$', 1) AS dir, regexp_extract({FOLDER}, '[^/]*$') AS name FROM media) WHERE regexp_matches(name, '^[0-9]{{8}}')", "media")
def date_folders(r: Roles) -> DataFrame:
    found = r.media().select(paths.parent(F.col("file_path"), F.col("file_name")).alias("path")).distinct()
    return organize.date_folder_plan(found).select("path", "target")


@query("SELECT p_partkey AS id, (contains(lower(p_name), 'a') AND lower(p_brand) = lower('Brand#11')) OR FALSE AS brand, starts_with(lower(p_name), lower(substr(p_name, 1, 3))) AS prefix, FALSE AS unknown, TRUE AS nothing FROM part")
def rule_match(r: Roles) -> DataFrame:
    p = r.table("part")
    brand = F.lit('[{"field":"file_name","operator":"contains","value":"A"},{"field":"camera_model","operator":"equals","value":"brand#11"}]')
    prefix = F.concat(F.lit('[{"field":"file_name","operator":"starts_with","value":"'), F.substring("p_name", 1, 3), F.lit('"}]'))
    test = lambda c: organize.rule_matches(c, F.col("p_name"), F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("id"), test(brand).alias("brand"), test(prefix).alias("prefix"), test(F.lit('[{"field":"iso","operator":"equals","value":"1"}]')).alias("unknown"), test(F.lit("[]")).alias("nothing"))


SYNC = """
+ d AS (SELECT coalesce(s.rel_path, t.rel_path) AS rel_path, s.size AS source_size, t.size AS target_size,
  CASE WHEN t.rel_path IS NULL THEN 'new' WHEN s.rel_path IS NULL THEN 'orphan' WHEN t.mtime > s.mtime THEN 'conflict' WHEN s.size <> t.size THEN 'size_changed' WHEN s.mtime > t.mtime THEN 'modified' ELSE 'same' END AS action
  FROM sync_source s FULL JOIN sync_target t ON s.rel_path = t.rel_path)
"""


@query(SYNC + "SELECT rel_path, action, source_size, target_size, CASE WHEN action = 'conflict' THEN source_size = target_size END AS content_identical FROM d", "sync_source", "sync_target")
def sync_plan(r: Roles) -> DataFrame:
    return sync.sync_plan(r.sync_source(), r.sync_target()).select("rel_path", "action", "source_size", "target_size", "content_identical")


@query(SYNC + "SELECT count(*) FILTER (action IN ('new', 'size_changed', 'modified')) AS total_files, CAST(sum(source_size) FILTER (action IN ('new', 'size_changed', 'modified')) AS BIGINT) AS total_bytes, count(*) FILTER (action = 'conflict') AS conflicts, count(*) FILTER (action = 'orphan') AS orphans FROM d WHERE rel_path NOT LIKE 'd3/%'", "sync_source", "sync_target")
def sync_totals(r: Roles) -> DataFrame:
    return sync.sync_totals(sync.sync_plan(r.sync_source(), r.sync_target(), ["d3/**"]))


@query("SELECT rel_path, size FROM sync_target WHERE rel_path NOT IN (SELECT rel_path FROM sync_source) AND rel_path NOT LIKE '%5.jpg'", "sync_source", "sync_target")
def sync_orphans(r: Roles) -> DataFrame:
    return sync.sync_orphans(r.sync_source(), r.sync_target(), ["*5.jpg"]).select("rel_path", "size")


@query(SYNC + "SELECT rel_path, CASE WHEN action IN ('size_changed', 'modified') THEN 'update' ELSE 'copy' END AS operation, CASE WHEN action = 'conflict' AND source_size % 3 = 1 THEN replace(rel_path, '.jpg', '_conflict.jpg') ELSE rel_path END AS destination FROM d WHERE action IN ('new', 'size_changed', 'modified') OR (action = 'conflict' AND source_size % 3 < 2)", "sync_source", "sync_target")
def sync_worklist(r: Roles) -> DataFrame:
    plan = sync.sync_plan(r.sync_source(), r.sync_target())
    how = F.when(F.col("source_size") % 3 == 0, "force_copy").when(F.col("source_size") % 3 == 1, "rename_copy").otherwise("skip")
    return sync.sync_worklist(plan, plan.where("action = 'conflict'").select("rel_path", how.alias("resolution")))


@query("SELECT event_id AS id, CASE WHEN d IS NULL THEN 'unmounted' ELSE 'mounted' END AS change FROM (SELECT a.event_id, b.event_id AS x, 1 AS d FROM (SELECT * FROM events WHERE event_id % 3 <> 0) a LEFT JOIN (SELECT * FROM events WHERE event_id % 4 <> 0) b ON a.event_id = b.event_id WHERE b.event_id IS NULL UNION ALL SELECT b.event_id, NULL, NULL FROM (SELECT * FROM events WHERE event_id % 4 <> 0) b WHERE b.event_id % 3 = 0)")
def snapshot_changes(r: Roles) -> DataFrame:
    e = r.table("events").select(F.col("event_id").alias("id"))
    return sync.snapshot_changes(e.where("id % 4 <> 0"), e.where("id % 3 <> 0"), "id")


# ---- folders, files, positions ----------------------------------------------------------------

ROLLUP = """
+ f AS (SELECT regexp_replace(path, '(^|/)[^/]*$', '') AS home, size FROM paths),
a AS (SELECT array_to_string(string_split(home, '/')[1:i], '/') AS folder, size FROM f, (SELECT unnest(range(1, 40)) AS i) WHERE home <> '' AND i <= len(string_split(home, '/'))),
s AS (SELECT folder, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS file_count FROM a GROUP BY folder)
SELECT folder, CAST(len(string_split(folder, '/')) AS INTEGER) AS depth, total_size, file_count, (SELECT count(*) FROM s x WHERE starts_with(x.folder, s.folder || '/')) AS folder_count FROM s
"""


@query(ROLLUP, "paths")
def folder_rollup(r: Roles) -> DataFrame:
    return folders.rollup(r.pages(), "path", "size")


@query("SELECT lower(ext) AS extension, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS total_size FROM media GROUP BY 1", "media")
def folder_type_stats(r: Roles) -> DataFrame:
    return folders.type_stats(r.media())


@query("SELECT id, file_size FROM media WHERE file_size > 1000 ORDER BY file_size DESC, file_path LIMIT 20", "media")
def largest_files(r: Roles) -> DataFrame:
    return folders.largest_files(r.media(), 1000).select("id", "file_size")


@query(f"SELECT id, folder, CAST(k AS INTEGER) AS rank FROM (SELECT id, {FOLDER} AS folder, row_number() OVER (PARTITION BY {FOLDER} ORDER BY file_size DESC, file_path) AS k FROM media) WHERE k <= 3", "media")
def largest_per_folder(r: Roles) -> DataFrame:
    return folders.largest_per_folder(r.media(), 3).select("id", "folder", "rank")


@query(
    """SELECT file_name, CASE lower(ext) WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'heic' THEN 'image/heif' WHEN 'gif' THEN 'image/gif' WHEN 'mp4' THEN 'video/mp4' WHEN 'mov' THEN 'video/quicktime' ELSE 'application/' || lower(ext) END AS mime_type,
    media_type, CASE WHEN lower(ext) IN ('mp4', 'mov') THEN 'video' ELSE 'image' END AS file_type, lower(ext) AS extension FROM media""",
    "media",
)
def file_type_classes(r: Roles) -> DataFrame:
    n = F.col("file_name")
    return r.media().select("file_name", paths.mime_type(n).alias("mime_type"), paths.media_type(n).alias("media_type"), paths.file_type(n).alias("file_type"), paths.extension(n).alias("extension"))


@query("SELECT floor(lat * 100 + 0.5) / 100 AS cell_lat, floor(lng * 100 + 0.5) / 100 AS cell_lng, count(*) AS n, min(id) AS first_at, max(id) AS last_at FROM positions GROUP BY 1, 2", "positions")
def geo_cells(r: Roles) -> DataFrame:
    return geo.clusters(r.positions(), at="id")


@query("SELECT m.id, p.lat FROM media m JOIN positions p ON p.id = m.id WHERE p.lat IS NOT NULL AND p.lng IS NOT NULL ORDER BY m.modified_at DESC, m.id LIMIT 1000", "media", "positions")
def gps_latest(r: Roles) -> DataFrame:
    exif = r.positions().select(F.col("id").alias("media_id"), F.col("lat").alias("gps_latitude"), F.col("lng").alias("gps_longitude"), F.lit(None).cast("string").alias("date_taken"))
    return catalog.gps_media(r.media(), exif).select("id", F.col("gps_latitude").alias("lat"))


# ---- journal and ingest -----------------------------------------------------------------------


@query("SELECT batch_id, max(executed_at) AS executed_at, count(*) AS n FROM journal GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 50", "journal")
def journal_history(r: Roles) -> DataFrame:
    return journal.history(r.journal())


@query("SELECT CAST(row_number() OVER (ORDER BY sequence DESC) AS INTEGER) AS step, sequence, target_path AS source_path, source_path AS target_path FROM journal WHERE batch_id = 7", "journal")
def journal_undo_plan(r: Roles) -> DataFrame:
    return journal.undo_plan(r.journal(), 7)


DELTA = """
SELECT coalesce(n.event_id, o.event_id) AS file_path, CASE WHEN o.event_id IS NULL THEN 'new' WHEN n.event_id IS NULL THEN 'gone' WHEN n.size = o.size THEN 'same' ELSE 'changed' END AS state
FROM (SELECT event_id, floor(value) + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM events WHERE event_id % 4 <> 0) n
FULL JOIN (SELECT event_id, floor(value) AS size FROM events WHERE event_id % 3 <> 0) o ON n.event_id = o.event_id
"""


@query(DELTA)
def ingest_delta(r: Roles) -> DataFrame:
    e = r.table("events").select(F.col("event_id").alias("file_path"), F.floor("value").alias("file_size"))
    scan = e.where("file_path % 4 <> 0").withColumn("file_size", F.col("file_size") + F.when(F.col("file_path") % 5 == 0, 1).otherwise(0))
    return ingest.delta(e.where("file_path % 3 <> 0"), scan, facts=("file_size",))


@query("SELECT event_id AS file_path, CAST(floor(value) + CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 0 THEN 0 WHEN event_id % 5 = 0 AND event_id % 4 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS file_size FROM events WHERE event_id % 3 <> 0 OR event_id % 4 <> 0")
def ingest_refresh(r: Roles) -> DataFrame:
    e = r.table("events").select(F.col("event_id").alias("file_path"), F.floor("value").alias("file_size"), F.lit(1).alias("scan_phase"))
    bumped = F.when((F.col("file_path") % 5 == 0) & (F.col("file_path") % 3 != 0), 1).otherwise(0)
    scan = e.where("file_path % 4 <> 0").withColumn("file_size", F.col("file_size") + bumped).drop("scan_phase")
    return ingest.ingest(e.where("file_path % 3 <> 0"), scan, on_change="refresh", facts=("file_size",)).select("file_path", "file_size")


# ---- functions --------------------------------------------------------------------------------


@query(
    """SELECT id, strftime(t, '%Y-%m-%d') AS day_folder, strftime(t, '%Y/%m-%b') AS month_folder, t AS parsed
    FROM (SELECT media_id AS id, CAST(replace(substr(date_taken, 1, 10), ':', '-') || substr(date_taken, 11) AS TIMESTAMP) AS t FROM exif WHERE date_taken IS NOT NULL)""",
    "exif",
)
def date_functions(r: Roles) -> DataFrame:
    d = F.col("date_taken")
    return r.exif().where("date_taken is not null").select(F.col("media_id").alias("id"), dates.day_folder(d).alias("day_folder"), dates.month_folder(d).alias("month_folder"), dates.parse(d).alias("parsed"))


@query("SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INTEGER) AS distance FROM hashes x JOIN hashes y ON y.id = x.id + 1", "hashes")
def hamming_neighbours(r: Roles) -> DataFrame:
    h = r.hashes()
    other = h.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("phash").alias("hb"))
    return h.join(other, h.id == other.a).select("a", "b", hashing.hamming(F.col("phash"), F.col("hb")).cast("int").alias("distance"))


@query(
    """SELECT page_id, 'http://' || path AS url, CASE WHEN size >= 1048576 THEN format('{:.1f} MB', size / 1048576.0) WHEN size >= 1024 THEN format('{:.1f} KB', size / 1024.0) ELSE size || ' B' END AS shown FROM paths""",
    "paths",
)
def text_functions(r: Roles) -> DataFrame:
    return r.pages().select("page_id", text.base_url(F.col("path")).alias("url"), text.human_size(F.col("size")).alias("shown"))


# ---- changes of state -------------------------------------------------------------------------


@query("SELECT media_id, camera_model FROM exif WHERE media_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 'Replaced' FROM labels WHERE toxic = 1", "exif")
def exif_upsert(r: Roles) -> DataFrame:
    new = r.table("labels").where("toxic = 1").select(F.col("doc_id").alias("media_id"), F.lit("Replaced").alias("camera_model"))
    return membership.upsert(r.exif().select("media_id", "camera_model"), new, ["media_id"])


@query("SELECT o_orderkey AS media_id, 'old' AS state FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderstatus <> 'F'")
def ledger_insert_or_ignore(r: Roles) -> DataFrame:
    o = r.table("orders").select(F.col("o_orderkey").alias("media_id"), "o_orderstatus")
    old = o.where("o_orderstatus = 'F'").select("media_id", F.lit("old").alias("state"))
    return membership.insert_or_ignore(old, o.select("media_id", F.lit("new").alias("state")), ["media_id"])


@query("SELECT id, CASE WHEN quality IS NULL THEN width ELSE 1000 + quality END AS width, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS scan_phase FROM media LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) ON doc_id = id", "media")
def enrich_files(r: Roles) -> DataFrame:
    facts = r.table("labels").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") + 1000).alias("width")).select("id", "width", F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("thumbnail"))
    return membership.enrich(r.media().withColumn("thumbnail", F.lit(None).cast("string")), facts).select("id", "width", "scan_phase")


@query("SELECT album_id AS group_id, media_id, CASE WHEN album_id = 3 THEN media_id = 20 ELSE sort_order = 0 END AS is_best FROM album_media", "album_media")
def set_best_member(r: Roles) -> DataFrame:
    members = r.album_media().select(F.col("album_id").alias("group_id"), "media_id", (F.col("sort_order") == 0).alias("is_best"))
    return membership.set_exclusive(members, 3, 20, "is_best")


PURGE = """
+ m AS (SELECT id FROM media WHERE file_path NOT LIKE '/lib/src1/%')
SELECT 'media_files' AS name, count(*) AS n FROM m UNION ALL SELECT 'album_media', count(*) FROM album_media WHERE media_id NOT IN (SELECT id FROM media WHERE file_path LIKE '/lib/src1/%')
UNION ALL SELECT 'nas_uploads', count(*) FROM uploads WHERE media_id NOT IN (SELECT id FROM media WHERE file_path LIKE '/lib/src1/%')
"""


@query(PURGE, "media", "album_media", "uploads")
def purge_folder(r: Roles) -> DataFrame:
    """Rows left in each table, and ledger rows that still name their file."""
    left = membership.purge_folder({"media_files": r.media(), "album_media": r.album_media(), "nas_uploads": r.uploads()}, "/lib/src1")
    left["nas_uploads"] = left["nas_uploads"].where("media_id is not null")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"SELECT g.group_id AS id, CASE WHEN count(d.doc_id) <= 1 THEN 'resolved' ELSE 'pending' END AS status FROM {EXACT} g LEFT JOIN (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) d ON md5(d.text) = g.k GROUP BY 1")
def resolve_after_trash(r: Roles) -> DataFrame:
    found = _exact(r)
    tables = {"media_files": r.media(), "duplicate_members": found.select("group_id", F.col("id").alias("media_id")), "duplicate_groups": found.select(F.col("group_id").alias("id")).distinct().withColumn("status", F.lit("pending"))}
    trashed = r.table("labels").select(F.col("doc_id").alias("media_id"), (F.col("quality") == 1).alias("ok"))
    return membership.resolve_after_trash(tables, trashed)["duplicate_groups"]


@query("SELECT album_id, min_by(media_id, sort_order * 1000000 + media_id) AS cover FROM album_media GROUP BY 1", "album_media")
def album_covers(r: Roles) -> DataFrame:
    filled = membership.fill_covers(r.albums().withColumn("cover_media_id", F.lit(None).cast("long")), r.album_media())
    return filled.where("cover_media_id is not null").select(F.col("id").alias("album_id"), F.col("cover_media_id").alias("cover"))


@query("SELECT DISTINCT album_id FROM album_media WHERE media_id = 12", "album_media")
def albums_of_media(r: Roles) -> DataFrame:
    albums = r.albums().withColumn("created_at", F.lit("2024"))
    return membership.albums_of(r.album_media(), albums, 12).select("album_id").distinct()


@query("SELECT batch_id, executed_at, string_agg(source_path, ',' ORDER BY sequence) AS paths FROM (SELECT *, max(executed_at) OVER (PARTITION BY batch_id) AS latest FROM journal) WHERE batch_id IN (SELECT batch_id FROM journal GROUP BY 1 ORDER BY max(executed_at) DESC, 1 DESC LIMIT 50) GROUP BY batch_id, latest".replace("SELECT batch_id, executed_at,", "SELECT batch_id, latest AS executed_at,"), "journal")
def journal_entries(r: Roles) -> DataFrame:
    return journal.history_entries(r.journal()).select("batch_id", "executed_at", F.array_join(F.transform("entries", lambda e: e["source_path"]), ",").alias("paths"))


# ---- trees and scans --------------------------------------------------------------------------


def _entries(r: Roles) -> DataFrame:
    """Files of the media role and all their folders."""
    files = r.media().select(F.col("file_path").alias("path"), F.lit(False).alias("is_dir"), F.col("file_size").alias("size"))
    up = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return files.unionByName(up.select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size")))


ENTRIES = """
+ d AS (SELECT DISTINCT array_to_string(string_split(file_path, '/')[1:i], '/') AS path FROM media, (SELECT unnest([2, 3, 4]) AS i)),
v AS (SELECT file_path AS path FROM media WHERE contains(lower(file_name), '_1') AND lower(ext) IN ('mp4', 'mov'))
"""


@query(ENTRIES + "SELECT path FROM v UNION ALL SELECT path FROM d WHERE EXISTS (SELECT 1 FROM v WHERE starts_with(v.path, d.path || '/')) OR contains(lower(regexp_extract(path, '[^/]*$')), '_1')", "media")
def tree_filter(r: Roles) -> DataFrame:
    return folders.tree_filter(_entries(r), "_1", "video").select("path")


@query(ENTRIES + "SELECT (SELECT count(*) FROM d) AS folders, count(*) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS size, CAST(0 AS BIGINT) AS images, count(*) AS videos FROM media WHERE file_path IN (SELECT path FROM v)", "media")
def tree_stats(r: Roles) -> DataFrame:
    e = _entries(r)
    return folders.tree_stats(e, folders.tree_filter(e, "_1", "video"))


@query("SELECT regexp_extract(path, '[^/]*$') AS name FROM (SELECT DISTINCT array_to_string(string_split(file_path, '/')[1:4], '/') AS path FROM media) WHERE starts_with(path, '/lib/src1/')", "media")
def list_directory(r: Roles) -> DataFrame:
    return folders.listing(_entries(r), "/lib/src1/").select("name")


@query(f"SELECT regexp_extract({FOLDER}, '[^/]*$') AS label, {FOLDER} AS folder, count(*) AS total FROM media GROUP BY {FOLDER}", "media")
def folder_group_tree(r: Roles) -> DataFrame:
    """The leaves of the tree: their labels and totals."""
    return folders.group_tree(catalog.by_folder(r.media())).where("children = 0").select("label", "folder", "total")


@query("SELECT id, regexp_matches(file_path, '(^|/)2024-01-0[0-9]/') OR lower(ext) = 'gif' OR starts_with(file_name, 'IMG_7') AS excluded FROM (SELECT *, lower(ext) AS low FROM media WHERE ext <> 'GIF')", "media")
def sync_exclusions(r: Roles) -> DataFrame:
    return r.media().select("id", paths.excluded(F.col("file_path"), ["**/2024-01-0?/**", "*.gif", "IMG_7*"]).alias("excluded"))


@query("SELECT id, NOT (regexp_matches(file_path, '/(private|[0-9]{8})/') OR regexp_matches(file_path, '/[^/]*-(01|02)/')) AS kept FROM media", "media")
def scan_filter(r: Roles) -> DataFrame:
    """A scan whose excluded folders are those named YYYYMMDD and those ending in -01 or -02."""
    names = tuple(f"202401{d:02d}" for d in range(1, 29))
    return r.media().select("id", media_source.scannable(F.col("file_path"), "", (*media_source.EXCLUDED_NAMES, *names), ("-01", "-02")).alias("kept"))


# ---- streams and pixels -----------------------------------------------------------------------


def _changes(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "create").when(F.col("event_type") == "click", "modify").when(F.col("event_type") == "error", "remove").otherwise("view")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.array(F.col("user_id").cast("string")).alias("paths"))


QUIET = """
WITH e AS (SELECT * FROM events WHERE event_type <> 'view'),
o AS (SELECT *, date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS d FROM e),
s AS (SELECT *, sum(CASE WHEN d <= 60000000 THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS g FROM o)
SELECT min(ts) AS started, count(*) AS n, bool_or(event_type IN ('signup', 'purchase', 'click')) AS rescan FROM s GROUP BY g
"""


@query(QUIET)
def quiet_batches(r: Roles) -> DataFrame:
    return watch.quiet_batches(_changes(r.table("events")), "60 seconds").select(F.col("started").cast("timestamp_ntz").alias("started"), "n", "rescan")


@query(QUIET)
def stream_quiet_gap(r: Roles) -> DataFrame:
    """The same batches from a file stream that is stopped twice on the way, each time at a gap; a timer closes the last one."""
    source, out, check = (shared_dir(r.spark, f"quiet-{x}") for x in ("changes", "batches", "checkpoint"))
    changes, idle = _changes(r.table("events")), "1 seconds"
    starts = watch.quiet_batches(changes, "60 seconds").agg(F.percentile_approx(F.unix_micros("started"), [0.3, 0.7])).first()[0] or [0, 0]
    low, high = (F.coalesce(F.unix_micros("ts") >= x, F.lit(False)) for x in starts)
    for part in (~low, low & ~high, high):
        changes.where(part).write.mode("append").parquet(source)
        query = watch.start(watch.quiet_stream(watch.events(r.spark, source), "60 seconds", idle=idle), out, check, once=False)
        try:
            watch.settle(query, idle)
        finally:
            query.stop()
    return r.spark.read.schema(watch.CLOSED).parquet(out).select(F.col("started").cast("timestamp_ntz").alias("started"), "n", "rescan")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def recent_events(r: Roles) -> DataFrame:
    """The log of the newest events after a stream in two runs; LIMIT is the log's size."""
    source, check = (shared_dir(r.spark, f"recent-{x}") for x in ("changes", "checkpoint"))
    store = Store(r.spark, shared_dir(r.spark, "recent-log"))
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        _changes(r.table("events")).where(part).write.mode("append").parquet(source)
        watch.record(store, watch.events(r.spark, source), check, n=1000).awaitTermination()
    return store.table("recent").select("event_id")


QUALITY = """
WITH g AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(least(greatest(floor(CAST(x AS DOUBLE) * 255 + 128), 0), 255) AS INTEGER)) AS p FROM embeddings),
l AS (SELECT id, p, list_transform(range(36), lambda k: p[k // 6 * 8 + k % 6 + 2] + p[k // 6 * 8 + k % 6 + 18] + p[k // 6 * 8 + k % 6 + 9] + p[k // 6 * 8 + k % 6 + 11] - 4 * p[k // 6 * 8 + k % 6 + 10]) AS lap FROM g),
s AS (SELECT id, list_var_pop(lap) AS sharp, (0.6::DOUBLE * (1 - abs(list_avg(p) - 128) / 128) + 0.4::DOUBLE * greatest(0, 1 - 5 * len(list_filter(p, lambda x: x < 5 OR x > 250)) / 64::DOUBLE)) * 100 AS exposed FROM l)
SELECT id, round(sharp, 6) AS sharp, round(exposed, 6) AS exposed, round(least(sharp / 20, 100) * 0.5::DOUBLE + exposed * 0.5::DOUBLE, 6) AS score FROM s
"""


@query(QUALITY)
def quality_scores(r: Roles) -> DataFrame:
    """Sharpness, exposure and quick score of 8 x 8 pixels made of the embeddings."""
    gray = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 255 + 128), F.lit(0)), F.lit(255)).cast("int"))
    rows = r.table("embeddings").select(F.col("vec_id").alias("id"), gray.alias("pixels"), F.lit(8).alias("width"))
    rows = rows.select("id", quality.sharpness("pixels", "width").alias("sharp"), quality.exposure("pixels", "width").alias("exposed"))
    score = quality.quick_score(quality.sharpness_score(F.col("sharp")), quality.exposure_score(F.col("exposed")))
    return rows.select("id", F.round("sharp", 6).alias("sharp"), F.round("exposed", 6).alias("exposed"), F.round(score, 6).alias("score"))


# Registers more queries of the same kind.
from mediaframe import job_queries as _job_queries, state_queries as _state_queries  # noqa: E402, F401
