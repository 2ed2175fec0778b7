import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import dates, hashing, paths, quality, text
from mediaframe.sources import media as sources
from mediaframe.sources import volumes


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(expr(F.col("x"))).collect()]


def test_escape_like():
    assert [text.escape_like(x) for x in ("2024_01", "100%", "a\\b", "plain")] == ["2024\\_01", "100\\%", "a\\\\b", "plain"]


def test_hamming(spark):
    pairs = [(0, 0), (0, 0x0700000000000080), (0, -1)]
    df = spark.createDataFrame(pairs, "a long, b long").select(hashing.hamming(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in df.collect()] == [0, 4, 64]


def test_day_folder(spark):
    given = ["2024:07:15 14:32:00", "2024-07-15T14:32:00", "2024:7:5 09:00:00", "", "not a date", "0000:00"]
    u = dates.UNCATEGORIZED
    assert values(spark, given, dates.day_folder) == ["2024-07-15", "2024-07-15", "2024-07-05", u, u, u]


def test_month_folder_and_dated_name(spark):
    assert values(spark, ["2024:07:15 01:02:03", "2024-13-01", "x", None], dates.month_folder) == ["2024/07-Jul", "2024/13", None, None]
    assert values(spark, ["20240715 trip", "20241301", "18990101", "2024-07-15", "2024071"], dates.dated_name) == ["2024-07-15 trip", None, None, None, None]


def test_parse(spark):
    got = values(spark, ["2024-01-02 03:04:05", "2024:01:02 03:04:05", "2024-01-02T03:04:05", "nonsense", None], dates.parse)
    assert [str(x) if x else None for x in got] == ["2024-01-02 03:04:05"] * 3 + [None, None]


@pytest.mark.parametrize(
    ("patterns", "given", "expected"),
    [
        (["*.tmp", "thumbs.db"], ["foo.tmp", "sub/dir/foo.tmp", "thumbs.db", "photo.jpg"], [True, True, True, False]),
        ([".git/**"], [".git/config", ".git/objects/abc", "src/main.rs"], [True, True, False]),
        ([], ["anything"], [False]),
        (["a[", "b***c"], ["a[", "bxc"], [False, False]),
        (["**/x.jpg", "[!a]?.png"], ["x.jpg", "d/e/x.jpg", "bc.png", "ac.png"], [True, True, True, False]),
    ],
)
def test_excluded(spark, patterns, given, expected):
    assert values(spark, given, lambda x: paths.excluded(x, patterns)) == expected


def test_volume_bytes_and_removable(spark):
    assert values(spark, ["31.9 GB (31914983424 Bytes)", "500107862016", "500 B", ""], volumes.byte_value) == [31914983424, 500107862016, 500, None]
    lines = [("a", "Protocol: USB"), ("b", "Location: External"), ("b", "Virtual: No"), ("c", "Location: Internal"), ("c", "Name: a:b"), ("d", "Location: External"), ("d", "Virtual: Yes"), ("d", "nothing")]
    facts = volumes.volume_facts(spark.createDataFrame(lines, "volume string, value string"))
    got = {r.volume: (r.r, r.n) for r in facts.select("volume", volumes.is_removable(F.col("facts")).alias("r"), F.try_element_at("facts", F.lit("Name")).alias("n")).collect()}
    assert got == {"a": (True, None), "b": (True, None), "c": (False, "a:b"), "d": (False, None)}


def test_urls_and_codes(spark):
    assert values(spark, ["192.168.0.10:5000", " https://nas.local:5001/ "], text.base_url) == ["http://192.168.0.10:5000", "https://nas.local:5001"]
    assert values(spark, ["[1805] there", "[403] no", "plain"], text.error_code) == [1805, 403, None]


def test_versions(spark):
    df = spark.createDataFrame([("v1.10.0", "1.9.9"), ("1.2", "1.2.0"), ("2.0-beta", "2.0"), ("1.2.0", "1.2")], "a string, b string")
    assert [r[0] for r in df.select(text.is_newer(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_paths(spark):
    assert values(spark, ["/a/b/c.jpg", "x", "/y"], paths.ancestors) == [["/a", "/a/b"], [], []]
    assert values(spark, ["a.JPG", ".hidden", "none", "x.tar.gz", "v.CR3"], paths.extension) == ["jpg", None, None, "gz", "cr3"]
    assert values(spark, ["/a/b/c", "/a/bc", "/a/b"], lambda x: paths.move_prefix(x, "/a/b/", "/z")) == ["/z/c", "/a/bc", "/z"]
    assert values(spark, [1, 2048, 5 * 1024**3], text.human_size, "x long") == ["1 B", "2.0 KB", "5.0 GB"]
    assert values(spark, [-12.5, 12.5], text.js_round, "x double") == [-12, 13]


def test_sizes_between_two_decimals(spark):
    sizes = [1280, 1279, 1281, 1792, 1310720, 7936, 1023, 1331, 0, None]
    assert values(spark, sizes, text.human_size, "x long") == ["1.2 KB", "1.2 KB", "1.3 KB", "1.8 KB", "1.2 MB", "7.8 KB", "1023 B", "1.3 KB", "0 B", None]


def test_scannable(spark):
    given = ["/r/a.jpg", "/r/.x/a.jpg", "/r/node_modules/a.jpg", "/r/P.app/a.jpg", "/r/.a.jpg", "/r/a.txt", "/r/Thumbs.db", "/r/sub/v.MOV"]
    assert values(spark, given, lambda x: sources.scannable(x, "/r")) == [True, False, False, False, False, False, False, True]


def test_hashes(spark):
    import xxhash

    body = bytes(range(256)) * 600
    df = spark.createDataFrame([(body,), (b"",)], "c binary").select(hashing.stored_quick_hash("c").alias("q"), hashing.stored_full_hash("c").alias("f"))
    a, b = df.collect()
    seed = 0
    for i in range(0, len(body), 65536):
        seed = xxhash.xxh64_intdigest(body[i : i + 65536], seed=seed)
    assert (a.q, a.f) == (xxhash.xxh64_hexdigest(body[:4096]), f"{seed:016x}") and b.f == "0" * 16


def test_average_hash(spark):
    cells = [9] + [0] * 62 + [9]
    df = spark.createDataFrame([(cells,)], "c array<int>").select(hashing.average_hash(F.col("c")).alias("h"))
    h = df.first().h & (1 << 64) - 1
    assert h == (1 << 63) | 1
    assert [tuple(x) for x in df.select(F.inline(hashing.bands(F.col("h")))).collect()] == [(0, 128), *((i, 0) for i in range(1, 7)), (7, 1)]


def test_quality(spark):
    rng = np.random.default_rng(0)
    gray = rng.integers(0, 256, (12, 10)).astype(np.uint8)
    lap = [int(gray[i - 1, j]) + int(gray[i + 1, j]) + int(gray[i, j - 1]) + int(gray[i, j + 1]) - 4 * int(gray[i, j]) for i in range(1, 11) for j in range(1, 9)]
    flat = gray.ravel()
    clip = ((flat <= 4) | (flat >= 251)).mean()
    df = spark.createDataFrame([(flat.tolist(), 10), ([1, 2], 2), (None, 3)], "p array<int>, w int")
    rows = df.select(quality.sharpness("p", "w").alias("s"), quality.exposure("p", "w").alias("e")).collect()
    assert rows[0].s == pytest.approx(np.var(lap)) and rows[1].s is None and rows[2].e is None
    assert rows[0].e == pytest.approx((0.6 * (1 - abs(flat.mean() - 128) / 128) + 0.4 * max(0, 1 - 5 * clip)) * 100)
    assert quality.shrink(np.zeros((1600, 800), np.uint8), 800).shape == (800, 400)


def test_exif(spark):
    import struct

    def entry(tag, kind, count, value):
        return struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")

    data = b"Maker\0" + struct.pack("<6I", 37, 1, 30, 1, 0, 1)
    ifd = 2 + 3 * 12 + 4
    gps_at = 8 + ifd
    data_at = gps_at + 2 + 2 * 12 + 4
    main = struct.pack("<H", 3) + entry(0x010F, 2, 6, struct.pack("<I", data_at)) + entry(0x0112, 3, 1, struct.pack("<H", 6)) + entry(0x8825, 4, 1, struct.pack("<I", gps_at)) + b"\0" * 4
    gps = struct.pack("<H", 2) + entry(1, 2, 2, b"S\0") + entry(2, 5, 3, struct.pack("<I", data_at + 6)) + b"\0" * 4
    tiff = b"II*\0" + struct.pack("<I", 8) + main + gps + data
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 40, 30)
    df = spark.createDataFrame([("t", tiff), ("p", png), ("x", b"junk"), ("n", None)], "path string, content binary")
    got = {r.path: r for r in sources.read_exif(df).collect()}
    assert got["t"].camera_make == "Maker" and got["t"].orientation == 6 and got["t"].gps_latitude == -37.5
    assert (got["p"].width, got["p"].height) == (40, 30) and got["x"].width is None and got["n"].iso is None
