import datetime as dt

from pyspark.sql import functions as F

from mediaframe.sources import config, media, volumes
from mediaframe.streaming import watch


def test_scan_and_listing(spark, tmp_path):
    for p in ("a.jpg", "sub/b.MOV", "node_modules/c.jpg", "d.txt", "X.app/e.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12345")
    got = {(r.file_name, r.media_type, r.mime_type, r.file_size) for r in media.scan(spark, str(tmp_path)).collect()}
    assert got == {("a.jpg", "image", "image/jpeg", 5), ("b.MOV", "video", "video/quicktime", 5)}
    assert {r.rel_path for r in media.listing(spark, str(tmp_path)).collect()} == {"a.jpg", "sub/b.MOV", "node_modules/c.jpg", "d.txt", "X.app/e.png"}


def test_config(tmp_path):
    p = str(tmp_path / "c" / "config.yaml")
    assert config.load(p) == config.Config()
    c = config.save_preset(config.merge(config.Config(), {"debounce_ms": 9, "auto_scan_on_change": None}), {"id": "x", "n": 1})
    config.save(c, p)
    assert config.load(p) == c and config.delete_preset(c, "x").sync_presets == []
    (tmp_path / "c" / "config.yaml").write_text("debounce_ms: {broken")
    assert config.load(p) == config.Config()


def test_shares_and_updates(spark):
    body = '{"data":{"shares":[{"isdir":true,"name":"p","path":"/p"},{"isdir":false,"name":"f","path":"/f"}]}}'
    assert [tuple(r) for r in volumes.share_folders(spark.createDataFrame([(body,)], "body string")).collect()] == [("p", "/p")]
    assert volumes.updates(spark.createDataFrame([("v1.2.0",), ("1.10",)], "version string"), "1.9").count() == 1


def test_quiet_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0, "create", ["/a", "/b"]), (2, 400, "remove", ["/c"]), (3, 2000, "remove", ["/d"]), (4, 2100, "other", ["/e"])]
    frame = lambda xs: spark.createDataFrame([(i, t + dt.timedelta(milliseconds=ms), k, p) for i, ms, k, p in xs], watch.EVENT)
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    frame(rows).coalesce(1).write.parquet(src)
    run = lambda: watch.start(watch.quiet_batches(watch.events(spark, src, 1)), out, check).awaitTermination(120)
    run()
    # a later event moves the watermark past the last batch; a restart from the checkpoint repeats nothing
    frame([(9, 60_000, "modify", ["/z"])]).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    got = sorted((r.n, r.rescan) for r in spark.read.parquet(out).where(F.col("started") < "2024-01-01 00:00:30").collect())
    assert got == [(1, False), (3, True)]


def test_poll(spark, tmp_path):
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    for i, names in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(n,) for n in names], "uuid string").coalesce(1).write.mode("append").parquet(src)
        watch.poll(spark.readStream.schema("uuid string").parquet(src), "uuid", store, str(tmp_path / "check")).awaitTermination(120)
    got = {(r.batch, r.uuid, r.change) for r in spark.read.parquet(f"{store}/changes").collect()}
    assert got == {(0, "a", "mounted"), (0, "b", "mounted"), (1, "c", "mounted"), (1, "a", "unmounted")}


def test_latest(spark):
    log = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, i)) for i in range(5)], "event_id long, ts timestamp")
    assert [r.event_id for r in watch.latest(log, 2).collect()] == [3, 4]
