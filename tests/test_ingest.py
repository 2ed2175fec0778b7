"""EXIF by ranged reads, versioned tables, and the scan-to-catalog job."""

import io
import os

import images
import pytest
from pyspark.sql import functions as F

from mediaframe.operators import ingest
from mediaframe.plans.versions import Store
from mediaframe.sources import media


@pytest.mark.parametrize("content", [images.tiff(), images.tiff(far=5_000_000), images.jpeg(images.tiff()), images.jpeg(images.tiff(), before=20, picture=9_000_000)])
def test_exif_reads_little(content):
    image = media.Ranged(io.BytesIO(content))
    got = media.exif_in(image)
    assert (got["camera_make"], got["orientation"], got["date_taken"], got["gps_latitude"]) == ("Maker", 6, "2024-05-06 07:08:09", -37.5)
    blocks = 30 if len(content) > 9_000_000 else 4  # a block or two a segment header
    assert image.fetched <= blocks * media.BLOCK
    assert content[:2] == b"II" or (got["width"], got["height"]) == (640, 480)


def test_broken_images_have_no_facts():
    whole = images.jpeg(images.tiff())
    for cut in range(0, len(whole), 7):
        media.exif_of(whole[:cut])
    for bad in (b"", b"\xff\xd8\xff", b"\xff\xd8\xff\xe1\0\0", b"II*\0\xff\xff\xff\xff", b"\xff\xd8" + b"\xff\xe0\0\0" * 9):
        assert set(media.exif_of(bad).values()) == {None}
    media.exif_of(images.tiff()[:40] + b"\xff" * 400)  # whatever it says, it is read
    assert media.exif_of(images.tiff(make=b"x" * 70_000))["camera_make"] is None  # no make is as long


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create("t", "k", "k long, v string", buckets=4)
    store.create("t", "k", "k long, v string", buckets=9)  # there already
    rows = lambda *xs: spark.createDataFrame(list(xs), "k long, v string")
    assert store.table("t").count() == 0 and store.last("s") == -1

    def put(number, new):
        touched = store.touched("t", new)
        kept = store.table("t", buckets=touched).join(new.select("k"), "k", "left_anti")
        return store.commit("s", number, {"t": (touched, kept.unionByName(new))})

    got = lambda v=None: {r.k: r.v for r in store.table("t", v).collect()}
    first = put(0, rows(*[(i, "a") for i in range(20)]))
    second = put(1, rows((3, "b"), (40, "c")))
    assert got() == {i: "a" for i in range(20)} | {3: "b", 40: "c"} and got(first) == {i: "a" for i in range(20)}
    before, after = (store.manifest(v)["tables"]["t"]["folders"] for v in (first, second))
    assert sum(before[b] == after[b] for b in before) >= 2  # buckets without a change are not written again
    assert put(1, rows((3, "z"))) == second and put(0, rows((4, "z"))) == second and got()[3] == "b"
    empty = store.commit("s", 2, {"t": (range(4), rows())})
    assert got() == {} and got(second)[40] == "c"
    with pytest.raises(Exception, match="exist"):
        store._publish(store.manifest(second))  # that version is there
    store._names("data", "t")
    assert store.vacuum(1) > 0 and store.versions() == [empty] and store.table("t").count() == 0


def test_failed_commit_is_invisible_and_runs_again(spark, tmp_path, monkeypatch):
    store = ingest.open_catalog(spark, f"file://{tmp_path}/store", buckets=3)
    scan = spark.createDataFrame([("/a.jpg", 1, "x", "image"), ("/a.jpg", 1, "x", "image"), (None, 1, "x", "image")], "file_path string, file_size long, modified_at string, media_type string")
    monkeypatch.setattr(Store, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.ingest_batch(store, scan, 0)
    assert store.table("media_files").count() == 0
    monkeypatch.undo()
    ingest.ingest_batch(store, scan, 0)
    assert [(r.file_path, r.scan_phase) for r in store.table("media_files").collect()] == [("/a.jpg", 1)]
    assert store.vacuum(1) > 0 and store.table("media_files").count() == 1


def test_scan_to_catalog(spark, tmp_path):
    lib = tmp_path / "lib"
    for name, content in (("_a.jpg", images.jpeg(images.tiff())), ("d/b.png", images.png(40, 30)), ("c.mov", b"v"), ("t.txt", b"t")):
        (lib / name).parent.mkdir(parents=True, exist_ok=True)
        (lib / name).write_bytes(content)
    store = ingest.open_catalog(spark, f"file://{tmp_path}/store", buckets=3)
    source, n = f"{tmp_path}/scans", [0]

    def run(checkpoint, **how):
        media.scan(spark, str(lib)).write.mode("append").parquet(source)
        n[0] += 1
        ingest.ingest_stream(store, spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), f"{tmp_path}/{checkpoint}", **how).awaitTermination(120)

    facts = lambda: {r.file_name: (r.width, r.height, r.scan_phase) for r in store.table("media_files").collect()}
    run("one")
    assert facts() == {"_a.jpg": (640, 480, 1), "b.png": (40, 30, 1), "c.mov": (None, None, 1)}
    exif = store.table("media_exif").join(store.table("media_files").select(F.col("id").alias("media_id"), "file_name"), "media_id")
    assert {r.file_name: (r.camera_make, r.date_taken) for r in exif.collect()} == {"_a.jpg": ("Maker", "2024-05-06 07:08:09"), "b.png": (None, None)}
    one = store.manifest()["version"]
    run("other")  # another run over all of it, numbered from 0 again
    assert store.manifest()["version"] == one
    (lib / "d/b.png").write_bytes(images.png(50, 60) + b"more")
    (lib / "e.jpg").write_bytes(images.jpeg(width=9, height=8))
    run("one")  # ignores the changed file
    assert facts() == {"_a.jpg": (640, 480, 1), "b.png": (40, 30, 1), "c.mov": (None, None, 1), "e.jpg": (9, 8, 1)}
    run("one", on_change="refresh")
    assert facts()["b.png"] == (50, 60, 1) and store.table("media_exif").count() == 3
    assert os.path.exists(tmp_path / "store") and n[0] == 4
