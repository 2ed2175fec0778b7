"""Matroska, WARC and suffix dedup against round trips and brute force."""

import base64
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from oracle import both

from mediaframe.llm import matroska, queries, suffix_dedup, warc
from mediaframe.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


# ---- Matroska ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 8192, 9000, 32768, 123_456])
def test_mux_round_trip(n):
    samples, size = matroska.payload("a" * n)
    packets, facts = matroska.demux(matroska.mux(samples))
    buf = matroska.mux(samples)
    assert size == n and len(samples) % 64 == 0 and len(samples) >= 64
    assert b"".join(buf[p[5] : p[5] + p[6]] for p in packets) == samples and facts["intact"]
    assert all(p[8] for p in packets) and [p[4] for p in packets] == sorted(p[4] for p in packets)


def test_demux_foreign_layouts():
    e, u, s = matroska._element, matroska._uint, matroska._size
    xiph = b"\x81" + struct.pack(">hB", 5, 2 | 0x80) + bytes([2, 255, 1, 3]) + b"x" * 256 + b"y" * 3 + b"z" * 7
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x40\x02" + struct.pack(">hB", -1, 0) + b"data"))
    cluster = u(matroska.TIMESTAMP, 10) + e(matroska.SIMPLE_BLOCK, xiph) + group
    unknown = matroska._id(matroska.CLUSTER) + b"\x01" + b"\xff" * 7 + cluster
    body = unknown + e(matroska.CLUSTER, u(matroska.TIMESTAMP, 99) + e(matroska.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 0, 0x80) + b"end"))
    buf = matroska._HEAD + matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + body
    packets, facts = matroska.demux(buf)
    assert [(p[0], p[3], p[4], buf[p[5] : p[5] + p[6]]) for p in packets] == [(1, "xiph", 15, b"x" * 256), (1, "xiph", 15, b"yyy"), (1, "xiph", 15, b"z" * 7), (2, "none", 9, b"data"), (1, "none", 99, b"end")]
    assert facts["clusters"] == 2 and s(127) == b"\x40\x7f"
    for cut in (1, 30, len(buf) - 2):
        assert matroska.demux(buf[:cut])[1]["intact"] is False or cut > 40


def test_media_columns(spark):
    df = spark.createDataFrame([(1, "héllo", "x"), (None, None, "y"), (2, "", "z"), (3, "héllo", "w")], "doc_id long, text string, media string")
    rows = {(r.doc_id, r.n_bytes): r for r in matroska.digest(matroska.store(df)).collect()}
    raw = "héllo".encode().ljust(64, b"\0")
    r = rows[(1, 6)]
    assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (64, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw))
    assert rows[(None, 0)].media_sha256 == rows[(2, 0)].media_sha256 and rows[(3, 6)].feature == r.feature
    assert matroska.digest(matroska.store(df.limit(0))).count() == 0
    assert matroska.packets(matroska.store(df), "doc_id").count() == 4


# ---- WARC -------------------------------------------------------------------------------------


def test_warc_segments_and_revisits(spark):
    bodies = ["é" * 300, "é" * 300, None, "", "", "x" * 64, "x" * 64, "\r\n\r\nWARC/1.1\r\n" * 20]
    ids = [2, 1, 3, 4, 4, None, None, 9]
    df = spark.createDataFrame([(i, "a\r\nb" if i else None, b, "kept") for i, b in zip(ids, bodies, strict=True)], "page_id long, url string, html string, digest string")
    path = shared_dir(spark, "warc-test")
    warc.write_archives(df, path, segment_bytes=100)
    table = warc.read_archives(spark, path, chunk_bytes=64)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(table).collect())
    sha = lambda b: base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode()
    kinds = {(1, 0): ("response", None), (2, 0): ("revisit", 1), (3, 0): ("response", None), (4, 0): ("revisit", 3), (4, 1): ("revisit", 3), (0, 0): ("response", None), (0, 1): ("revisit", None), (9, 0): ("response", None)}
    seen: dict = {}
    expected = []
    for i, b in sorted(zip([x or 0 for x in ids], bodies, strict=True), key=lambda p: p[0]):
        n = seen[i] = seen.get(i, -1) + 1
        expected.append((i, len((b or "").encode()), sha(b), *kinds[(i, n)]))
    key = lambda r: (r[0], r[3], str(r[4]))
    assert sorted(got, key=key) == sorted(expected, key=key)
    chunks = table.where("record_id = 'urn:x-page:1:1'").orderBy("chunk_no").collect()
    assert b"".join(bytes(c.chunk) for c in chunks) == ("é" * 300).encode() and max(len(c.chunk) for c in chunks) <= 64
    assert [c.is_last for c in chunks] == [False] * (len(chunks) - 1) + [True]
    # the same through a path that only Spark's readers can open, gzipped and not
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./a", path if path.startswith("file:") else f"file://{path}")
    key = lambda r: str(r)
    near = sorted((tuple(r) for r in table.drop("archive").collect()), key=key)
    assert sorted((tuple(r) for r in warc.read_archives(spark, "viewfs://far/a", 64).drop("archive").collect()), key=key) == near
    plain = shared_dir(spark, "warc-plain")
    warc.records(df, segment_bytes=100).write.option("lineSep", warc.CRLF * 2).text(plain)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.bare.link./a", plain if plain.startswith("file:") else f"file://{plain}")
    assert sorted((tuple(r) for r in warc.read_archives(spark, "viewfs://bare/a", 64).drop("archive").collect()), key=key) == near


def test_warc_names_that_end_in_z(spark, tmp_path):
    """A store that only Spark reads: archives are told apart by whether their names end in .gz, and none is read twice or not at all."""
    import gzip

    folder = tmp_path / "z"
    folder.mkdir()
    record = lambda i: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n".encode()
    names = ["a.warc", "b.z", "z", "gz", "c.xz", "dgz", "e.7z", "f.gz", "ggzz", "h.gzz"]
    for i, name in enumerate(names):
        (folder / name).write_bytes(gzip.compress(record(i)) if name.endswith(".gz") else record(i))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.zz.link./a", f"file://{folder}")
    got = warc.read_archives(spark, "viewfs://zz/a", 64).select("record_id").distinct().collect()
    assert len(got) == len(names)


def test_warc_segments_are_cut_from_the_body(spark):
    """No expression puts header and whole body together; the segments do so bit by bit."""
    body = "".join(chr(97 + i % 26) for i in range(1000))
    df = spark.createDataFrame([(1, "u", body)], "page_id long, url string, html string")
    for size in (50, 333, 1 << 20):
        made = warc.records(df, segment_bytes=size)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "substring(concat(" not in plan and "substring(body" in plan
        rows = [r.value.split("\r\n\r\n", 1) for r in made.collect()]
        number = lambda head: int(re.search(r"WARC-Segment-Number: (\d+)|$", head)[1] or 1)
        parts = [(number(h), re.search(r"Content-Length: (\d+)$", h)[1], b) for h, b in rows]
        assert all(int(n) == len(b) <= size for _, n, b in parts)
        block = "".join(b for _, _, b in sorted(parts))
        assert block == f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 1000\r\n\r\n{body}"


def test_warc_empty_table(spark):
    path = shared_dir(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_records(warc.read_archives(spark, path)).count() == 0


def test_warc_equals_sql(spark):
    ours, theirs = both(spark, queries.QUERIES, queries.ORACLES, "op2_warc_chunks")
    assert ours == theirs


# ---- suffix dedup -----------------------------------------------------------------------------


def brute(texts, n):
    seen: dict = {}
    for i, b in enumerate(texts):
        for j in range(len(b) - n + 1):
            seen.setdefault(b[j : j + n], []).append((i, j))
    covered = [np.zeros(len(b), bool) for b in texts]
    for places in seen.values():
        for i, j in places if len(places) > 1 else ():
            covered[i][j : j + n] = True
    out = []
    for b, c in zip(texts, covered, strict=True):
        edges = np.diff(np.r_[0, c.astype(int), 0])
        out.append((len(b), int(c.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~c])).hexdigest()))
    return out


def hard_texts():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(900)) for _ in range(6)]
    out = [None, "", "x" * 199, "x" * 200, "x" * 450, "ab" * 300, base[0], base[0], base[1] + base[2][:200], base[2], base[3][:350] + "Q" + base[3][351:], base[3], base[4][:210] + base[4][100:320] + base[5], "z" + base[4][120:330]]
    for k in range(30):
        a, b = rng.sample(base, 2)
        i, j = rng.randint(0, 600), rng.randint(0, 600)
        out.append(a[i : i + rng.randint(150, 300)] + str(k) + b[j : j + rng.randint(190, 230)])
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_suffix_dedup_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", -1)
        monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", -1)
    texts = hard_texts()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(3)
    got = [tuple(r)[1:] for r in suffix_dedup.report(df).orderBy("doc_id").collect()]
    assert got == brute([(t or "").encode() for t in texts], 200)


def test_suffix_dedup_survives_colliding_hashes(spark, monkeypatch):
    """Names of 4 bits: the prefilter lets nearly everything through, the bytes decide."""
    of = suffix_dedup.Names.of
    monkeypatch.setattr(suffix_dedup.Names, "of", lambda self, start, end: of(self, start, end) & np.uint64(0xF << 60))
    texts = hard_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [tuple(r)[1:] for r in suffix_dedup.report(df).orderBy("doc_id").collect()]
    assert got == brute([(t or "").encode() for t in texts], 200)


@pytest.mark.parametrize("length", [35, 100, 300])
def test_suffix_dedup_other_lengths(spark, length):
    rng = random.Random(length)
    base = ["".join(rng.choice("abcd ") for _ in range(4 * length)) for _ in range(4)]
    texts = ["ab" * length, "y" * (length - 1), "y" * length, None]
    for k in range(60):
        a, b = rng.sample(base, 2)
        i, j = rng.randint(0, 3 * length), rng.randint(0, 3 * length)
        texts.append(a[i : i + rng.randint(length // 2, 3 * length)] + str(k) + b[j : j + rng.randint(length // 2, 2 * length)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffix_dedup.report(df, length).orderBy("doc_id").collect()]
    assert got == brute([(t or "").encode() for t in texts], length)


def test_suffix_dedup_empty_and_wrong_length(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.report(df).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.report(df, 201)


def test_suffix_dedup_stretches(monkeypatch):
    raw = ("".join(random.Random(5).choice("ab") for _ in range(3000)) * 2).encode()
    whole = suffix_dedup.runs(suffix_dedup.Names(raw))
    monkeypatch.setattr(suffix_dedup, "STRETCH", 512)
    cut = suffix_dedup.runs(suffix_dedup.Names(raw))
    assert whole[2][0] == cut[2][0] == 0 and whole[3][-1] == cut[3][-1] == len(raw) - 199
    assert dict(zip(whole[1].tolist(), whole[0].tolist(), strict=True)) == dict(zip(cut[1].tolist(), cut[0].tolist(), strict=True))


def test_suffix_dedup_rewrite_keeps_columns(spark):
    text = "é" * 150
    df = spark.createDataFrame([(1, text + "tail", 154, "s"), (2, text, 150, None), (3, None, 0, "t")], "doc_id long, text string, n_chars long, __cuts_note string")
    out = {r.doc_id: r for r in suffix_dedup.rewrite(df).collect()}
    assert out[1].text == "tail" and out[1].n_chars == 4 and out[2].text == "" and out[3].text is None and out[3]["__cuts_note"] == "t"
    nothing = suffix_dedup.rewrite(df.limit(0))
    assert nothing.columns == df.columns and nothing.count() == 0
