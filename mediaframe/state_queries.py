"""More of the query catalogue: whole jobs, changes to tables, sort orders and functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.fixtures import Roles
from mediaframe.functions import hashing, paths, text
from mediaframe.operators import bursts, catalog, duplicates, journal, membership, organize
from mediaframe.plans.storage import materialize
from mediaframe.queries import EXACT, FOLDER, query
from mediaframe.sources import volumes

# ---- lists ------------------------------------------------------------------------------------

ORDERS = {"name": "lower(file_name)", "path": "file_path", "date": "coalesce(date_taken, modified_at)", "modified": "modified_at", "size": "file_size", "extension": "lower(ext)"}


@query(
    " UNION ALL ".join(f"SELECT id, '{k}{way}' AS sorted_by, row_number() OVER (ORDER BY {x} {way}, id) AS place FROM media LEFT JOIN exif ON id = media_id" for k, x in ORDERS.items() for way in ("ASC", "DESC")),
    "media", "exif",
)
def media_sort_keys(r: Roles) -> DataFrame:
    one = lambda k, way: catalog.places(catalog.sorted_media(r.media(), r.exif(), k, way == "DESC").select("id")).select("id", F.lit(k + way).alias("sorted_by"), "place")
    return reduce(DataFrame.unionByName, [one(k, way) for k in ORDERS for way in ("ASC", "DESC")])


@query("SELECT id, id IN (SELECT media_id FROM uploads) AS is_uploaded, coalesce(comment <> '', FALSE) AS has_comment FROM media", "media", "uploads")
def media_badges(r: Roles) -> DataFrame:
    return catalog.badges(r.media(), r.uploads()).select("id", "is_uploaded", "has_comment")


@query("SELECT id, comment FROM media WHERE comment LIKE '%50\\% e%' ESCAPE '\\'", "media")
def escaped_search(r: Roles) -> DataFrame:
    """The needle's own wildcards are letters."""
    return r.media().where(F.col("comment").like(f"%{text.escape_like('50% e')}%")).select("id", "comment")


# ---- duplicates and bursts --------------------------------------------------------------------


@query("SELECT d.doc_id AS id, g.group_id FROM documents d JOIN (SELECT md5(text) AS k, min(doc_id) AS group_id FROM documents WHERE n_chars > 1500 GROUP BY 1 HAVING count(*) > 1) g ON md5(d.text) = g.k")
def exact_dup_above_floor(r: Roles) -> DataFrame:
    return duplicates.exact_groups(r.table("documents"), floor=1500, size="n_chars", content="text", key="doc_id").select("id", "group_id")


CANDIDATES = f"+ c AS (SELECT id, file_size FROM media WHERE media_type = 'image' AND id NOT IN (SELECT d.doc_id FROM documents d JOIN {EXACT} g ON md5(d.text) = g.k WHERE d.doc_id <> g.group_id))"


def _candidates(r: Roles) -> DataFrame:
    exact = duplicates.exact_groups(r.table("documents"), floor=0, size="n_chars", content="text", key="doc_id")
    return duplicates.similar_candidates(r.media(), exact.select(F.col("id").alias("media_id"), "is_preferred"))


@query(CANDIDATES + " SELECT id, file_size FROM c", "media")
def similar_candidates(r: Roles) -> DataFrame:
    return _candidates(r).select("id", "file_size")


EXACT_PAIRS = """,
h AS (SELECT phash, min(id) AS id FROM hashes {among} GROUP BY phash),
p AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INTEGER) AS distance FROM h x JOIN h y ON x.id < y.id WHERE bit_count(xor(x.phash, y.phash)) <= 5
  UNION ALL SELECT h.id, s.id, 0 FROM h JOIN hashes s ON s.phash = h.phash AND s.id <> h.id {also})
"""


@query("+" + EXACT_PAIRS.format(among="", also="").lstrip(",") + "SELECT a, b, distance FROM p", "hashes")
def similar_pairs_exact(r: Roles) -> DataFrame:
    return duplicates.similar_pairs_exact(r.hashes())


SIMILAR_JOB = CANDIDATES + EXACT_PAIRS.format(among="WHERE id IN (SELECT id FROM c)", also="WHERE s.id IN (SELECT id FROM c)") + """, u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    q(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, q.m FROM q JOIN u ON u.a = q.n), k AS (SELECT n AS id, min(m) AS cluster FROM q GROUP BY n)
    SELECT cluster, count(*) AS n, CAST(sum(file_size) - max(file_size) AS BIGINT) AS saved FROM k JOIN c ON c.id = k.id GROUP BY cluster"""


@query(SIMILAR_JOB, "media", "hashes")
def similar_job(r: Roles) -> DataFrame:
    """Candidates, their hashes, exact pairs, clusters, and what each cluster could save."""
    media = _candidates(r)
    clusters = duplicates.similar_clusters(duplicates.similar_pairs_exact(r.hashes().join(media.select("id"), "id", "left_semi")))
    return duplicates.similar_savings(clusters, media)


@query(SIMILAR_JOB, "media", "hashes")
def similar_job_missing(r: Roles) -> DataFrame:
    """The same where every other file has no hash yet, and one in six of those a thumbnail: it is computed in the job."""
    stored = r.media().join(r.hashes(), "id", "left").withColumn("phash", F.when(F.col("id") % 2 == 0, F.col("phash")))
    exact = duplicates.exact_groups(r.table("documents"), floor=0, size="n_chars", content="text", key="doc_id")
    members, cells = exact.select(F.col("id").alias("media_id"), "is_preferred"), r.cells()
    _, clusters = duplicates.similar_job(stored, members, cells.where("id % 3 = 0"), cells)
    return duplicates.similar_savings(clusters, duplicates.similar_candidates(r.media(), members))



@query(
    """+ t AS (SELECT m.*, e.date_taken, strptime(replace(substr(date_taken, 1, 10), ':', '-') || substr(date_taken, 11, 9), '%Y-%m-%d %H:%M:%S') AS taken FROM media m JOIN exif e ON e.media_id = m.id WHERE media_type = 'image' AND date_taken IS NOT NULL),
    o AS (SELECT *, date_diff('second', lag(taken) OVER (ORDER BY taken, id), taken) AS d FROM t),
    s AS (SELECT *, sum(CASE WHEN d <= 3000 THEN 0 ELSE 1 END) OVER (ORDER BY taken, id) AS g FROM o),
    b AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, first_value(id) OVER (PARTITION BY g ORDER BY taken, id) AS first_id, max(file_size) OVER (PARTITION BY g) AS most, max(coalesce(width, 0)::DOUBLE * height) OVER (PARTITION BY g) AS area FROM s),
    q AS (SELECT *, least(file_size / 20.0, 100.0) * 0.45 + (id % 100)::DOUBLE * 0.30 + CASE WHEN width IS NULL OR area <= 0 THEN 50.0 ELSE least(width::DOUBLE * height / area * 100.0, 100.0) END * 0.15 + CASE WHEN most > 0 THEN least(file_size::DOUBLE / most * 100.0, 100.0) ELSE 50.0 END * 0.10 AS score FROM b WHERE n >= 2)
    SELECT id, first_id, n AS session_size, round(score, 6) AS score, row_number() OVER (PARTITION BY g ORDER BY score DESC, taken DESC, id DESC) = 1 AS is_best FROM q""",
    "media", "exif",
)
def burst_job(r: Roles) -> DataFrame:
    """Media with capture dates to sessions, scores and the best of each, as one job."""
    rows = bursts.analyze(r.media(), r.exif(), F.col("file_size").cast("double"), (F.col("id") % 100).cast("double"), gap=3000)
    return rows.select("id", "first_id", "session_size", F.round("quality_score", 6).alias("score"), "is_best")


@query(f"SELECT group_id AS id, n, CASE WHEN group_id = (SELECT min(group_id) FROM {EXACT}) THEN 'dismissed' ELSE 'pending' END AS status FROM {EXACT} g")
def dismiss_group(r: Roles) -> DataFrame:
    """Groups of equal documents, one of which a user waves away: its members stay, its status changes."""
    exact = duplicates.exact_groups(r.table("documents"), floor=0, size="n_chars", content="text", key="doc_id")
    groups = exact.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("n")).withColumn("status", F.lit("pending"))
    return membership.dismiss(groups, groups.agg(F.min("id")).first()[0])


# ---- tags, albums, settings, hashes -----------------------------------------------------------


@query("SELECT media_id, tag_id FROM (SELECT DISTINCT media_id, tag_id FROM media_tags UNION SELECT id, 7 FROM media WHERE id % 10 = 0) WHERE NOT (media_id % 4 = 0 AND tag_id = 7) AND tag_id <> 0", "media", "media_tags")
def tag_lifecycle(r: Roles) -> DataFrame:
    """Tag 7 is created and attached, detached from some, and tag 0 deleted with its attachments."""
    tags = membership.create_tag(r.spark.createDataFrame([(0, "low"), (1, "high")], "id long, name string"), r.spark.createDataFrame([(7, "tens"), (8, "low")], "id long, name string"))
    seven = tags.where("name = 'tens'").select(F.col("id").alias("tag_id"))
    new = r.media().where("id % 10 = 0").select(F.col("id").alias("media_id")).join(F.broadcast(seven))  # one tag
    attached = membership.insert_or_ignore(r.media_tags().distinct().withColumn("tag_id", F.col("tag_id").cast("long")), new, ["media_id", "tag_id"])
    detached = membership.delete_rows(attached, new.where("media_id % 4 = 0"), ["media_id", "tag_id"])
    return membership.delete_with_members(tags, detached, 0, "tag_id")[1].select("media_id", "tag_id")


@query(
    """SELECT album_id, media_id, sort_order FROM (SELECT album_id, media_id, min(sort_order) AS sort_order FROM album_media WHERE album_id <> 3 GROUP BY 1, 2) WHERE NOT (album_id = 4 AND media_id % 2 = 0)
    UNION ALL SELECT 20, id, CAST(row_number() OVER (ORDER BY id DESC) - 1 AS INTEGER) FROM media WHERE id % 50 = 0""",
    "media", "album_media",
)
def album_lifecycle(r: Roles) -> DataFrame:
    """Album 3 is deleted, album 4 loses members, album 20 is created and filled in order."""
    albums, members = r.albums(), r.album_media().groupBy("album_id", "media_id").agg(F.min("sort_order").alias("sort_order"))
    albums, members = membership.delete_with_members(albums, members, 3, "album_id")
    members = membership.delete_rows(members, members.where("album_id = 4 and media_id % 2 = 0"), ["album_id", "media_id"])
    chosen = r.media().where("id % 50 = 0").select(F.col("id").alias("media_id"), (-F.col("id")).alias("position"))
    return membership.add_to_album(members, 20, chosen).select("album_id", "media_id", "sort_order")


@query("SELECT id, CASE WHEN id = 22 THEN 'seen' WHEN id = 33 THEN NULL ELSE comment END AS comment FROM media", "media")
def edit_comments(r: Roles) -> DataFrame:
    return membership.set_comment(membership.set_comment(r.media(), 22, "  seen "), 33, "  ").select("id", "comment")


@query("SELECT n_name AS key, CASE WHEN n_regionkey = 2 THEN 'new' ELSE 'old' END AS value FROM nation UNION ALL SELECT 'theme', 'dark'")
def settings_upsert(r: Roles) -> DataFrame:
    n = r.table("nation")
    fresh = n.where("n_regionkey = 2").select(F.col("n_name").alias("key"), F.lit("new").alias("value")).union(r.spark.createDataFrame([("theme", "dark")], "key string, value string"))
    return membership.upsert(n.select(F.col("n_name").alias("key"), F.lit("old").alias("value")), fresh, ["key"])


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'x' || id ELSE sha256_hash END AS sha256_hash, CASE WHEN id % 3 = 0 THEN id END AS phash FROM media", "media")
def hash_write_back(r: Roles) -> DataFrame:
    found = r.media().where("id % 3 = 0").select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("sha256_hash"), F.col("id").alias("phash"))
    return membership.write_hashes(r.media().withColumn("phash", F.lit(None).cast("long")), found).select("id", "sha256_hash", "phash")


@query("SELECT batch_id, source_path, CAST(sequence AS INTEGER) AS sequence FROM journal UNION ALL SELECT -1, file_path, CAST(row_number() OVER (ORDER BY file_path) - 1 AS INTEGER) FROM media WHERE id % 7 = 0", "journal", "media")
def journal_append(r: Roles) -> DataFrame:
    moved = r.media().where("id % 7 = 0").select(F.col("file_path").alias("source_path"), F.lit("executed").alias("status"))
    return journal.append(r.journal(), moved, -1, ["source_path"]).select("batch_id", "source_path", F.col("sequence").cast("int").alias("sequence"))


@query(
    """+ w AS (SELECT m.id, coalesce(e.date_taken, m.modified_at) AS best_date, m.sha256_hash, m.id IN (SELECT media_id FROM uploads) OR m.sha256_hash IN (SELECT sha256 FROM uploads WHERE sha256 IS NOT NULL) AS known
      FROM media m LEFT JOIN exif e ON m.id = e.media_id WHERE m.id IN (SELECT media_id FROM album_media)),
    f AS (SELECT *, row_number() OVER (PARTITION BY sha256_hash, known ORDER BY best_date, id) AS k FROM w)
    SELECT id, CASE WHEN known THEN 'uploaded' WHEN k > 1 THEN 'same_content' END AS skip FROM f""",
    "media", "exif", "uploads", "album_media",
)
def upload_chosen(r: Roles) -> DataFrame:
    """The upload run of chosen ids alone."""
    return membership.upload_worklist(r.media(), r.exif(), r.uploads(), ids=r.album_media().select(F.col("media_id").alias("id"))).select("id", "skip")


@query(
    """SELECT doc_id AS id, CASE WHEN n < 1000 THEN '/flat/' || source || CASE WHEN n = 0 THEN '' ELSE ' (' || n || ')' END || '.jpg' END AS final_target
    FROM (SELECT *, CASE WHEN source <> 'src1' THEN k - 1 WHEN k >= 2 THEN k + 1 ELSE k END AS n FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents))"""
)
def move_collisions_with_existing(r: Roles) -> DataFrame:
    """src1.jpg and src1 (2).jpg are there already; the original numbers no further than 999."""
    plan = r.table("documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("source"), F.concat(F.lit("/flat/"), "source", F.lit(".jpg")).alias("target"))
    there = r.spark.createDataFrame([("/flat/src1.jpg",), ("/flat/src1 (2).jpg",)], "path string")
    return organize.resolve_collisions(plan, there, most=1000).select(F.col("doc_id").alias("id"), "final_target")


DATED = f"""+ f AS (SELECT id, file_name, path, dir || '/' || substr(name, 1, 4) || '-' || substr(name, 5, 2) || '-' || substr(name, 7) AS target FROM (
  SELECT id, file_name, {FOLDER} AS path, regexp_extract({FOLDER}, '^(.*)/[^/]*$', 1) AS dir, regexp_extract({FOLDER}, '[^/]*$') AS name FROM media) WHERE regexp_matches(name, '^[0-9]{{8}}')),
p AS (SELECT path, target, count(*) FILTER (id % 3 = 0 AND path LIKE '/lib/src1/%') AS n FROM f GROUP BY path, target)
"""


def _dated(r: Roles) -> tuple[DataFrame, DataFrame]:
    """Folders and their entries; below src1 a third of the files lie in the folder with the new name too."""
    old = r.media().select("id", "file_name", "file_path", paths.parent(F.col("file_path"), F.col("file_name")).alias("path"))
    # written, or the new names are worked out inside the expressions that rename them again, too long to compile
    named = materialize(organize.date_folder_plan(old.select("path").distinct()).where("path like '/lib/src1/%'").select("path", "target"), "named")
    new = old.where("id % 3 = 0").join(named, "path").select("file_name", F.col("target").alias("path"))
    entries = old.select(F.col("file_path").alias("path")).unionByName(new.select(F.concat("path", F.lit("/"), "file_name").alias("path")))
    return old.select("path").unionByName(new.select("path")).distinct(), entries


@query(DATED + "SELECT path, target, n > 0 AS merges, n AS conflict_count FROM p", "media")
def date_folder_conflicts(r: Roles) -> DataFrame:
    return organize.date_folder_scan(*_dated(r))


@query(
    DATED + """SELECT f.path || '/' || file_name AS source, f.target || '/' || CASE WHEN id % 3 = 0 THEN regexp_replace(file_name, '([.][^.]*)$', ' (1)\\1') ELSE file_name END AS target
    FROM f JOIN p ON f.path = p.path WHERE n > 0 UNION ALL SELECT path, target FROM p WHERE n = 0""",
    "media",
)
def date_folder_merges(r: Roles) -> DataFrame:
    return organize.date_folder_moves(*_dated(r))


@query("SELECT id, file_path, file_name, file_size, media_type FROM media ORDER BY modified_at DESC, id LIMIT 20 OFFSET 20", "media")
def recent_page(r: Roles) -> DataFrame:
    return catalog.recent_page(r.media(), offset=20).select("id", "file_path", "file_name", "file_size", "media_type")


# ---- functions --------------------------------------------------------------------------------


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Screenshots' WHEN p_partkey % 3 = 1 AND p_size < 30 THEN 'Downloads' END AS folder, CASE WHEN p_partkey % 3 = 0 THEN 0.95::DOUBLE WHEN p_partkey % 3 = 1 AND p_size < 30 THEN 0.7::DOUBLE END AS confidence FROM part"""
)
def name_classes(r: Roles) -> DataFrame:
    name = F.concat(F.element_at(F.array(F.lit("My ScreenShot "), F.lit("Image-"), F.lit("DSC_")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_partkey").cast("string"))
    found = organize.classify_by_name(name, F.when(F.col("p_size") < 30, 1000).otherwise(200_000))
    return r.table("part").select(F.col("p_partkey").alias("id"), found["folder"].alias("folder"), found["confidence"].cast("double").alias("confidence"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS INTEGER) END AS code, s_suppkey % 5 = 1 AS newer FROM supplier")
def error_codes_and_versions(r: Roles) -> DataFrame:
    key = F.col("s_suppkey")
    message = F.when(key % 4 == 0, F.format_string("[%d] no such share", key)).when(key % 4 == 1, F.format_string("failed [%d] ", key)).when(key % 4 == 2, F.lit("[x] no"))
    version = F.when(key % 5 == 1, "v1.10.0").when(key % 5 == 2, "1.9").when(key % 5 == 3, "1.8.9").otherwise("0.99")
    return r.table("supplier").select(key.alias("id"), text.error_code(message).alias("code"), text.is_newer(version, F.lit("1.9")).alias("newer"))


@query(
    """SELECT vec_id AS id, format('{:016x}', list_sum(list_transform(range(1, 65), lambda i: CASE WHEN g[i] * 64 > list_sum(g) THEN CAST(1 AS UBIGINT) << (64 - i) ELSE CAST(0 AS UBIGINT) END))::UBIGINT) AS ahash
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor(CAST(x AS DOUBLE) * 255 + 128), 0), 255) AS BIGINT)) AS g FROM embeddings WHERE len(embedding) = 64)"""
)
def average_hashes(r: Roles) -> DataFrame:
    gray = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 255 + 128), F.lit(0)), F.lit(255)))
    rows = r.table("embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").alias("id"), gray.alias("cells"))
    return rows.select("id", F.lower(F.lpad(F.hex(hashing.average_hash(F.col("cells"))), 16, "0")).alias("ahash"))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey * 1000 ELSE c_custkey END AS bytes, c_nationkey % 3 = 0 OR c_nationkey % 5 = 0 AS removable FROM customer")
def mounted_volumes(r: Roles) -> DataFrame:
    """Listings of key: value lines to facts, bytes and whether a volume can be removed."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    size = F.when(nation % 2 == 0, F.format_string("   Disk Size: %.1f KB (%d Bytes) (exactly 1 unit)", key.cast("double"), key * 1000)).otherwise(F.format_string("Disk Size:  %d B", key))
    lines = F.array(size, F.when(nation % 3 == 0, "  Protocol: USB").otherwise("  Protocol: PCI"), F.when(nation % 5 == 0, "Removable Media: Removable").otherwise("Removable Media: Fixed"), F.lit("no colon here"), F.lit("Mount Point: /Volumes/a:b"))
    facts = volumes.volume_facts(r.table("customer").select(key.alias("volume"), F.explode(lines).alias("value")))
    return facts.select(F.col("volume").alias("id"), volumes.byte_value(F.try_element_at("facts", F.lit("Disk Size"))).alias("bytes"), volumes.is_removable(F.col("facts")).alias("removable"))


# ---- upload runs, lists, exact clusters -------------------------------------------------------

CODES = "CASE WHEN id % 19 = 7 THEN NULL WHEN id % 3001 = 3000 THEN 119 WHEN id % 17 = 5 THEN 1805 WHEN id % 23 = 9 THEN 407 ELSE 0 END"
UPLOAD_RUN = f"""+ w AS (SELECT m.id, file_name, file_path, coalesce(date_taken, modified_at) AS best_date, sha256_hash, m.id IN (SELECT media_id FROM uploads WHERE media_id % 3 = 0) AS known, {CODES} AS code FROM media m LEFT JOIN exif ON m.id = media_id),
    o AS (SELECT *, row_number() OVER (ORDER BY best_date, id) AS pos FROM w),
    d AS (SELECT *, min(CASE WHEN code = 0 AND NOT known THEN pos END) OVER (PARTITION BY sha256_hash) AS done FROM o),
    l AS (SELECT *, sha256_hash IS NOT NULL AND coalesce(pos > done, FALSE) AS later FROM d),
    e AS (SELECT *, coalesce(pos > (SELECT min(pos) FROM l WHERE code = 119 AND NOT known AND NOT later), FALSE) AS ended FROM l),
    u AS (SELECT *, CASE WHEN ended THEN 'not_tried' WHEN code IS NULL THEN 'failed' WHEN known OR later OR code = 1805 THEN 'skipped' WHEN code = 0 THEN 'uploaded' ELSE 'failed' END AS status,
      CASE WHEN ended THEN 'ended' WHEN code IS NULL THEN 'missing' WHEN known THEN 'ledger' WHEN later THEN 'same_content' WHEN code = 1805 THEN 'name_taken' WHEN code = 119 THEN 'session' WHEN code <> 0 THEN 'code' END AS reason,
      '/nas/' || replace(substr(best_date, 1, 10), ':', '-') || '/' || file_name AS remote FROM e)
"""


def _upload_run(r: Roles) -> DataFrame:
    known = r.uploads().where("media_id % 3 = 0").select(F.col("media_id").alias("id")).distinct().withColumn("known", F.lit(True))
    rows = r.media().join(r.exif().select(F.col("media_id").alias("id"), "date_taken"), "id", "left").join(known, "id", "left")
    work = rows.select("id", "file_name", F.coalesce("date_taken", "modified_at").alias("best_date"), "sha256_hash", F.coalesce("known", F.lit(False)).alias("known"))
    return membership.upload_run(work, r.media().select("id", F.expr(CODES).alias("code")), "/nas/")


@query(UPLOAD_RUN + "SELECT id, status, reason, CASE WHEN status = 'uploaded' THEN remote END AS remote_path FROM u", "media", "exif", "uploads")
def upload_run(r: Roles) -> DataFrame:
    """An upload run over all media, one of which meets the end of the session; what the server answers is derived from ids."""
    return _upload_run(r).select("id", "status", "reason", "remote_path")


@query(UPLOAD_RUN + "SELECT media_id, sha256, NULL AS remote_path FROM uploads WHERE media_id % 3 = 0 UNION ALL SELECT id, sha256_hash, remote FROM u WHERE status = 'uploaded'", "media", "exif", "uploads")
def upload_ledger(r: Roles) -> DataFrame:
    """The ledger after that run."""
    none = F.lit(None).cast("string")
    ledger = r.uploads().where("media_id % 3 = 0").withColumns({"source_path": none, "remote_path": none})
    return membership.upload_ledger(ledger, _upload_run(r), r.media()).select("media_id", "sha256", "remote_path")


@query(
    """SELECT id, file_path, '/old' || file_path AS original_path, file_name, file_size, 'application/x' AS mime_type, sha256_hash, substr(sha256_hash, 1, 16) AS quick_hash, width, height, media_type,
    modified_at AS created_at, modified_at, modified_at AS scanned_at, 'local' AS source_type, comment AS thumbnail, 0 AS scan_phase, date_taken FROM media LEFT JOIN exif ON id = media_id""",
    "media", "exif",
)
def media_rows(r: Roles) -> DataFrame:
    at = F.col("modified_at")
    more = {"original_path": F.concat(F.lit("/old"), "file_path"), "mime_type": F.lit("application/x"), "quick_hash": F.substring("sha256_hash", 1, 16), "created_at": at, "scanned_at": at, "source_type": F.lit("local"), "thumbnail": F.col("comment")}
    return catalog.media_rows(r.media().withColumns(more), r.exif())


@query("SELECT tag_id AS group_id, id AS media_id, file_name, CAST(file_size % 101 AS DOUBLE) AS quality_score, date_taken FROM media_tags t JOIN media ON t.media_id = id LEFT JOIN exif x ON x.media_id = id ORDER BY group_id, quality_score DESC, id LIMIT 300", "media", "exif", "media_tags")
def group_member_list(r: Roles) -> DataFrame:
    """The first members of the list: what the cut keeps shows the order."""
    members = r.media_tags().join(r.media().select(F.col("id").alias("media_id"), (F.col("file_size") % 101).cast("double").alias("quality_score")), "media_id").withColumnRenamed("tag_id", "group_id")
    return membership.group_member_list(members, r.media(), r.exif()).limit(300).select("group_id", "media_id", "file_name", "quality_score", "date_taken")


@query(
    "+" + EXACT_PAIRS.format(among="", also="").lstrip(",") + """, u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    q(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, q.m FROM q JOIN u ON u.a = q.n), k AS (SELECT n AS id, min(m) AS cluster FROM q GROUP BY n),
    c AS (SELECT k.id, cluster, phash FROM k JOIN hashes ON hashes.id = k.id)
    SELECT c.cluster, count(DISTINCT c.id) AS n, 1.0 - max(bit_count(xor(c.phash, d.phash)))::DOUBLE / 64.0::DOUBLE AS score FROM c JOIN c d ON c.cluster = d.cluster GROUP BY c.cluster""",
    "hashes",
)
def similar_scores_exact(r: Roles) -> DataFrame:
    """Scores of the clusters of all pairs within the threshold, no bucket left out."""
    hashes = materialize(r.hashes(), "hashes")
    return duplicates.cluster_scores(duplicates.similar_clusters(duplicates.similar_pairs_exact(hashes)), hashes)
