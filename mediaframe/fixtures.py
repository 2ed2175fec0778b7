"""Role views: the driver's tables in the roles of a media catalog, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.functions import paths

EXTENSIONS = ("jpg", "png", "heic", "cr2", "mp4", "mov", "JPG", "gif")


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def media(self) -> DataFrame:
        d = self.table("documents")
        name = F.concat(F.lit("IMG_"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int")))
        dd = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
        folder = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("2024-01-"), dd)).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("202401"), dd)).otherwise(F.col("lang"))
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).cast("timestamp_ntz")
        rows = d.select(
            F.col("doc_id").alias("id"), name.alias("file_name"), F.concat_ws("/", F.lit("/lib"), "source", folder, name).alias("file_path"), F.col("n_chars").alias("file_size"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("modified_at"),
            F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") % 400 + 640).cast("int")).alias("width"), F.lit(480).alias("height"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("note 50% "), "lang")).alias("comment"), F.md5(F.col("text").cast("binary")).alias("sha256_hash"), F.col("text"), F.lit(0).alias("scan_phase"),
        )
        return rows.withColumn("media_type", F.coalesce(paths.media_type(F.col("file_name")), F.lit("image")))

    def exif(self) -> DataFrame:
        at = F.timestamp_seconds(F.lit(1706745600) + F.col("doc_id") * 420).cast("timestamp_ntz")
        taken = F.when(F.col("doc_id") % 2 == 0, F.date_format(at, "yyyy:MM:dd HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        return self.table("labels").select(F.col("doc_id").alias("media_id"), F.when(F.col("toxic") != 1, taken).alias("date_taken"), F.concat(F.lit("Model_"), F.col("quality").cast("string")).alias("camera_model"), F.concat(F.lit("Maker_"), (F.col("doc_id") % 3).cast("string")).alias("camera_make"))

    def media_tags(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("media_id"), F.col("quality").alias("tag_id"))

    def albums(self) -> DataFrame:
        return self.spark.range(12).select("id")

    def album_media(self) -> DataFrame:
        return self.table("conversations").select((F.col("conv_id") % 10).alias("album_id"), (F.col("conv_id") + F.col("turn")).alias("media_id"), F.col("turn").cast("int").alias("sort_order"))

    def uploads(self) -> DataFrame:
        hashed = self.table("documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("sha256"))
        return self.table("labels").select("doc_id", "quality").join(hashed, "doc_id").select(F.col("doc_id").alias("media_id"), F.when(F.col("quality") == 1, F.col("sha256")).alias("sha256"))

    def hashes(self) -> DataFrame:
        """id, phash of 64 word cells."""
        words = self.table("documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("w"))
        cells = words.groupBy("doc_id", (F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 2), 16, 10).cast("int") % 64).alias("cell")).agg(F.count("*").alias("n"))
        totals = cells.groupBy("doc_id").agg(F.sum("n").alias("total"), F.collect_list(F.struct("cell", "n")).alias("cells"))
        bits = F.transform(F.filter("cells", lambda c: c["n"] * 64 > F.col("total")), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), 63 - c["cell"]))
        return totals.select(F.col("doc_id").alias("id"), F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("phash"))

    def cells(self) -> DataFrame:
        """id, cells: the counts of the 64 word cells that hashes() is made of, as a gray picture of 8 by 8."""
        words = self.table("documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("w"))
        counts = words.groupBy("doc_id", (F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 2), 16, 10).cast("int") % 64).alias("cell")).agg(F.count("*").alias("n"))
        held = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("held"))
        return held.select(F.col("doc_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))).alias("cells"))

    def journal(self) -> DataFrame:
        from pyspark.sql import Window as W

        order = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
        return self.table("orders").select(F.col("o_custkey").alias("batch_id"), order.alias("sequence"), F.lit("move").alias("operation"), F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string")).alias("source_path"), F.concat(F.lit("/out/"), F.col("o_orderkey").cast("string")).alias("target_path"), F.col("o_orderdate").alias("executed_at"), F.lit("executed").alias("status"))

    def sync_source(self) -> DataFrame:
        o = self.table("orders").where("o_orderkey % 5 <> 0")
        return o.select(self._rel(), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").alias("mtime"))

    def sync_target(self) -> DataFrame:
        o = self.table("orders").where("o_orderkey % 7 <> 0")
        shift = F.expr("make_dt_interval(cast(o_orderkey % 3 - 1 as int))")
        return o.select(self._rel(), (F.floor("o_totalprice") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)).alias("size"), (F.col("o_orderdate") + shift).alias("mtime"))

    @staticmethod
    def _rel():
        return F.concat(F.lit("d"), (F.col("o_orderkey") % 10).cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("rel_path")

    def pages(self) -> DataFrame:
        """page_id, path, size: urls as paths."""
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/+$", "")
        return self.table("pages").select("page_id", bare.alias("path"), F.length("html").cast("long").alias("size"))

    def positions(self) -> DataFrame:
        at = lambda i: F.element_at("embedding", i).cast("double")
        return self.table("embeddings").select(F.col("vec_id").alias("id"), (at(1) * 90).alias("lat"), (at(2) * 180).alias("lng"))


MEDIA_SQL = f"""
SELECT *, CASE WHEN lower(ext) IN ('mp4', 'mov') THEN 'video' ELSE 'image' END AS media_type FROM (
  SELECT doc_id AS id, 'IMG_' || doc_id || '.' || ext AS file_name,
    '/lib/' || source || '/' || CASE WHEN doc_id % 5 = 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') WHEN doc_id % 7 = 0 THEN '202401' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') ELSE lang END || '/IMG_' || doc_id || '.' || ext AS file_path,
    n_chars AS file_size, strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S') AS modified_at,
    CASE WHEN doc_id % 9 <> 0 THEN CAST(doc_id % 400 + 640 AS INTEGER) END AS width, 480 AS height,
    CASE WHEN doc_id % 11 = 0 THEN 'note 50% ' || lang END AS comment, md5(text) AS sha256_hash, text, ext
  FROM (SELECT *, {list(EXTENSIONS)}[doc_id % 8 + 1] AS ext FROM documents))
"""
EXIF_SQL = """
SELECT doc_id AS media_id, CASE WHEN toxic <> 1 THEN CASE WHEN doc_id % 2 = 0 THEN strftime(TIMESTAMP '2024-02-01' + to_minutes(doc_id * 7), '%Y:%m:%d %H:%M:%S') ELSE strftime(TIMESTAMP '2024-02-01' + to_minutes(doc_id * 7), '%Y-%m-%d %H:%M:%S') END END AS date_taken,
  'Model_' || quality AS camera_model, 'Maker_' || (doc_id % 3) AS camera_make FROM labels
"""
HASH_SQL = """
SELECT doc_id AS id, bit_or(CASE WHEN n * 64 > total THEN CAST(1 AS UBIGINT) << (63 - cell) ELSE CAST(0 AS UBIGINT) END) AS phash FROM (
  SELECT doc_id, cell, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM (
    SELECT doc_id, CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) % 64 AS cell FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents)) GROUP BY doc_id, cell)
GROUP BY doc_id
"""
REL_SQL = "'d' || (o_orderkey % 10) || '/o' || o_orderkey || '.jpg' AS rel_path"
#: SQL of the views, to be put in front of a query.
SQL = {
    "media": MEDIA_SQL,
    "exif": EXIF_SQL,
    "media_tags": "SELECT doc_id AS media_id, quality AS tag_id FROM labels",
    "albums": "SELECT range AS id FROM range(12)",
    "album_media": "SELECT conv_id % 10 AS album_id, conv_id + turn AS media_id, CAST(turn AS INTEGER) AS sort_order FROM conversations",
    "uploads": "SELECT l.doc_id AS media_id, CASE WHEN quality = 1 THEN md5(text) END AS sha256 FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "hashes": HASH_SQL,
    "journal": "SELECT o_custkey AS batch_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS sequence, '/in/' || o_orderkey AS source_path, '/out/' || o_orderkey AS target_path, o_orderdate AS executed_at FROM orders",
    "sync_source": f"SELECT {REL_SQL}, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS mtime FROM orders WHERE o_orderkey % 5 <> 0",
    "sync_target": f"SELECT {REL_SQL}, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS size, o_orderdate + to_days(CAST(o_orderkey % 3 - 1 AS INTEGER)) AS mtime FROM orders WHERE o_orderkey % 7 <> 0",
    "paths": "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path, CAST(length(html) AS BIGINT) AS size FROM pages",
    "positions": "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 90 AS lat, CAST(embedding[2] AS DOUBLE) * 180 AS lng FROM embeddings",
}


def sql(body: str, *views: str) -> str:
    """A query over role views."""
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")
