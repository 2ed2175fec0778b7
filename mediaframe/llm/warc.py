"""WARC archives written by Spark and read back as a chunked record table.

Writing stays in the JVM: a payload is cut into segments of bounded size and each segment is a WARC
record of its own (segment 1 keeps the record's type, the others are ``continuation`` records with
``WARC-Segment-Number``). Payloads are cut as they are scanned: what is shuffled, sorted and written are segments. Spark's text writer
puts the record separator ``\\r\\n\\r\\n`` behind each one and commits the files, so lost executors and
speculative copies leave no half-written archive; the archives are gzipped.

Reading streams each archive: a record comes back as rows (record id, chunk number, bytes) in order,
each with the number of payload bytes and the SHA-1 up to and including that chunk. The digest of the
last chunk is that of the payload; nothing longer than a chunk is held.

Defined cases: a null payload is empty; of equal payloads of at least min_bytes the record with the
smallest key is the response and the others revisit it; a null key is larger than any other; rows that
repeat key and payload are records of their own, numbered from 1, the first one the response; an
archive that ends inside a record gives the chunks before the cut and no last chunk; an empty table
gives no records; columns beside key, payload and url are not archived, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm.common import configure, materialize, read, shared_dir

CRLF = "\r\n"
URN = "urn:x-page:"
SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CHUNKS = "archive string, record_id string, record_type string, target_uri string, refers_to string, declared_digest string, declared_bytes long, chunk_no int, chunk binary, bytes_so_far long, sha1_so_far string, is_last boolean"
FIELDS = [x.split()[0] for x in CHUNKS.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hexadecimal digits make 4 characters."""
    hexed = F.sha1(payload)
    chars = []
    for i in range(8):
        group = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(ALPHABET), F.shiftright(group, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*chars)


def plan_records(df: DataFrame, key: str, payload: str, url: str, min_bytes: int = 0) -> DataFrame:
    """key, n, digest, bytes, url, refers_to, revisit: a narrow row per record, without its payload."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    narrow = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    # Written once: payloads are read and hashed for it, and it is asked for responses, revisits and first keys.
    same = materialize(narrow.groupBy("key", "digest", "bytes").agg(F.min("url").alias("url"), F.count("*").alias("copies")), "warc-plan")
    # min() passes over null keys, which is the order asked for; a class of null keys alone refers to null
    first = same.groupBy("digest").agg(F.min("key").alias("response"))
    each = same.join(first, "digest").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.withColumn("revisit", (F.col("bytes") >= min_bytes) & ~(F.col("key").eqNullSafe(F.col("response")) & (F.col("n") == 1))).drop("copies")


def _head(kind: Column, rid: Column, *more: Column) -> Column:
    fixed = [F.lit("WARC/1.1" + CRLF), F.concat(F.lit("WARC-Type: "), kind, F.lit(CRLF)), F.concat(F.lit("WARC-Record-ID: <"), rid, F.lit(">" + CRLF)), F.lit("WARC-Date: 2024-01-01T00:00:00Z" + CRLF)]
    return F.concat(*fixed, *(F.coalesce(x, F.lit("")) for x in more))


def _line(name: str, value: Column) -> Column:
    """A header line, or null for a null value."""
    return F.concat(F.lit(name + ": "), value, F.lit(CRLF))


def write_archives(df: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """A WARC record per row below path; longer blocks are cut into segments."""
    records(df, key, payload, url, min_bytes, segment_bytes).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def records(df: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """value: the WARC records, a row each."""
    plan = plan_records(df, key, payload, url, min_bytes)
    rid = F.concat(F.lit(URN), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit(":"), F.col("n").cast("string"))
    origin = F.concat(F.lit(URN), F.coalesce(F.col("response").cast("string"), F.lit("null")), F.lit(":1"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    target = _line("WARC-Target-URI", F.regexp_replace(F.col("url"), "[\\r\\n]", "%0A"))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    content = F.lit(f"Content-Type: application/http; msgtype=response{CRLF}")

    revisits = plan.where("revisit").select(
        F.concat(
            _head(F.lit("revisit"), rid, target, digest, _line("WARC-Refers-To", F.concat(F.lit("<"), origin, F.lit(">"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF), content),
            _line("Content-Length", F.octet_length(http).cast("string")), F.lit(CRLF), http,
        ).alias("value")
    )

    # The payload is cut where it is scanned, so that no row larger than a segment is shuffled, sorted or
    # kept. A segment takes its bytes from the header and the body directly: the two are never put together.
    # Segments join their row of the plan by key and digest: nearly unique, so no partition is hot.
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    full = df.select(text(F.col(key)).alias("k"), body.alias("body"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    full = full.withColumn("total", F.octet_length(http) + F.col("bytes")).withColumn("seg", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("total") / segment_bytes).cast("int")))))
    before, head = ((F.col("seg") - 1) * segment_bytes).cast("int"), F.octet_length(http)
    begin, end = F.greatest(before - head, F.lit(0)), F.greatest(before + segment_bytes - head, F.lit(0))
    piece = F.concat(F.substring(http.cast("binary"), before + 1, F.lit(segment_bytes)), F.substring(F.col("body"), begin + 1, end - begin))
    pieces = full.select("k", "digest", "total", "seg", piece.alias("piece"))
    wanted = plan.where("not revisit").withColumn("k", text(F.col("key")))
    cut = pieces.join(wanted, ["k", "digest"]).dropDuplicates(["k", "digest", "n", "seg"])
    size = F.least(F.lit(segment_bytes).cast("long"), F.col("total") - before)
    several, last = F.col("total") > segment_bytes, F.col("seg") * segment_bytes >= F.col("total")
    numbered = F.when(several, _line("WARC-Segment-Number", F.col("seg").cast("string")))
    summed = F.when(several & last, _line("WARC-Segment-Total-Length", F.col("total").cast("string")))
    first = _head(F.lit("response"), rid, target, digest, numbered, summed, content)
    later = _head(F.lit("continuation"), F.concat(rid, F.lit(":"), F.col("seg").cast("string")), _line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), rid, F.lit(">"))), numbered, summed)
    sized = _line("Content-Length", size.cast("string"))
    responses = cut.select(F.concat(F.when(F.col("seg") == 1, first).otherwise(later).cast("binary"), sized.cast("binary"), F.lit(CRLF).cast("binary"), F.col("piece")).cast("string").alias("value"))
    return responses.unionByName(revisits)


# ---- reading ----------------------------------------------------------------------------------


def _headers(source: io.BufferedIOBase) -> dict[str, str] | None:
    """The next record's header fields in lower case; None at the end of the archive."""
    line = source.readline(1 << 16)
    while line in (b"\r\n", b"\n"):
        line = source.readline(1 << 16)
    if not line.startswith(b"WARC/"):
        return None
    out: dict[str, str] = {}
    while (line := source.readline(1 << 16)) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class _Record:
    """What is carried from chunk to chunk, and over the segments of one record."""

    def __init__(self, head: dict[str, str]):
        self.head, self.sha, self.bytes, self.chunk_no, self.declared = head, hashlib.sha1(), 0, 0, None

    def row(self, archive: str, chunk: bytes, last: bool) -> tuple:
        self.sha.update(chunk)
        self.bytes += len(chunk)
        self.chunk_no += 1
        h, bare = self.head, lambda k: self.head.get(k, "").strip("<>") or None
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        return archive, bare("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), bare("warc-refers-to"), digest, self.declared, self.chunk_no - 1, chunk, self.bytes, base64.b32encode(self.sha.digest()).decode(), last


def chunks(source: io.BufferedIOBase, archive: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of CHUNKS from an open archive, plain or gzipped, holding one chunk at a time."""
    if source.peek(2)[:2] == b"\x1f\x8b":
        import gzip

        source = io.BufferedReader(gzip.GzipFile(fileobj=source))
    pending: dict[str, _Record] = {}
    while (head := _headers(source)) is not None:
        left, kind = int(head.get("content-length", 0)), head.get("warc-type")
        origin = head.get("warc-segment-origin-id")
        record = pending.get(origin) if origin else _Record(head)
        if record is None:  # a continuation whose first segment is not in this archive
            record = _Record(head)
        if not origin and head.get("content-type", "").startswith("application/http") and kind in ("response", "revisit", "request"):
            while left > 0:
                line = source.readline(min(left, 1 << 16))
                left -= len(line)
                if line.lower().startswith(b"content-length:"):
                    record.declared = int(line.split(b":")[1])
                if line in (b"\r\n", b"\n", b""):
                    break
        number, whole = head.get("warc-segment-number"), head.get("warc-segment-total-length")
        ends = number is None or whole is not None
        first = True
        while left > 0 or first:
            chunk = source.read(min(left, chunk_bytes)) if left else b""
            if left and not chunk:
                return
            left -= len(chunk)
            if chunk or ends:
                yield record.row(archive, chunk, ends and left == 0)
            first = False
        if number == "1" and not ends:
            pending[head["warc-record-id"]] = record
        elif origin and ends:
            pending.pop(origin, None)


class _Joined(io.RawIOBase):
    """The bytes of an archive from the pieces between its record separators, one piece at a time."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.left:
            if (piece := next(self.pieces, None)) is None:
                return 0
            self.left = memoryview(piece + (CRLF * 2).encode())
        n = min(len(buffer), len(self.left))
        buffer[:n], self.left = self.left[:n], self.left[n:]
        return n


def read_archives(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives below path, streamed from any store.

    Shared file systems are opened where the task runs. From other stores Spark's text reader streams
    gzipped archives, which it does not split, in pieces between record separators: with archives written
    here at most a segment each. Only archives that are not gzipped come whole from there (at most 2 GB).
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(CHUNKS))
    configure(spark)

    def files(batches) -> Iterator[tuple[str, io.BufferedIOBase]]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open("/" + name.removeprefix("file:").lstrip("/"), "rb") as f:
                    yield name, f

    def contents(batches) -> Iterator[tuple[str, io.BufferedIOBase]]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield name.as_py(), io.BufferedReader(io.BytesIO(content.as_py()))

    def lines(batches) -> Iterator[tuple[str, io.BufferedIOBase]]:
        rows = ((name.as_py(), piece) for batch in batches for name, piece in zip(batch.column(0), batch.column(1), strict=True))
        for name, held in itertools.groupby(rows, key=lambda r: r[0]):
            yield name, io.BufferedReader(_Joined(piece.as_py() for _, piece in held))

    def table(df: DataFrame, opened) -> DataFrame:
        def go(batches):
            rows, held = [], 0
            for name, source in opened(batches):
                for row in chunks(source, name, chunk_bytes):
                    rows.append(row)
                    held += len(row[8]) + 400
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        return df.mapInArrow(go, CHUNKS)

    if path.startswith(("/", "file:")):
        return table(spark.read.format("binaryFile").load(path).select("path"), files)
    gzipped = spark.read.option("lineSep", CRLF * 2).option("pathGlobFilter", "*.gz").text(path)
    others = spark.read.format("binaryFile").option("pathGlobFilter", "{*[!z],*[!g]z,*[!.]gz,z,gz}").load(path)
    return table(gzipped.select(F.input_file_name().alias("path"), F.col("value").cast("binary").alias("piece")), lines).unionByName(table(others.select("path", "content"), contents))


def page_records(table: DataFrame) -> DataFrame:
    """A row per record from its last chunk: key, payload size and digest, type, what it refers to."""
    key = lambda c: F.split(F.substring(c, len(URN) + 1, 1 << 20), ":")[0].try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return table.where("is_last").select(
        key(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
        "record_type",
        key(F.col("refers_to")).alias("refers_to"),
    )


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(read(spark, sf_dir, "pages", ["page_id", "url", "html"]), path)
    return page_records(read_archives(spark, path))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
g AS (
  SELECT page_id, payload_bytes, x, min(page_id) OVER (PARTITION BY x) AS response,
         list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS n
  FROM d
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(n, lambda v:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1) ||
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM g
"""

QUERIES = {"op2_warc_chunks": op2_warc_chunks}
ORACLES = {"op2_warc_chunks": SQL}
