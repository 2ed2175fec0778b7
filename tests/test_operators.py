import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from mediaframe import schema
from mediaframe.operators import bursts, catalog, components, diameter, duplicates, folders, ingest, journal, membership, organize, sync
from mediaframe.plans import fileops


def test_components(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (1, 0), (5, 5), (7, None)], "a long, b long")
    assert {r.node: r.label for r in components.connected_components(df).collect()} == {0: 0, 1: 0, 2: 0, 5: 5}
    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = components.connected_components(chain)
    assert out.count() == 3001 and out.agg(F.max("label")).first()[0] == 0
    assert components.connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize(("seconds", "together"), [(5.0, True), (5.999, True), (6.0, False)])
def test_burst_boundary(spark, seconds, together):
    start = dt.datetime(2024, 1, 1, 23, 59, 58)
    df = spark.createDataFrame([(1, start), (2, start + dt.timedelta(seconds=seconds)), (3, None)], "id long, ts timestamp_ntz")
    assert bursts.sessions(df, "ts", "id").count() == (2 if together else 0)


def test_burst_sessions_do_not_depend_on_buckets(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=(i * i * 7919) % 500)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    results = [sorted((r.id, r.first_id, r.session_size) for r in bursts.sessions(df, "ts", "id", gap=1, partitions=b).collect()) for b in (1, 4, 9)]
    assert results[0] == results[1] == results[2] and results[0]


def test_best_last_wins(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 7.0), ("g", 3, 7.0), ("h", 4, 1.0)], "g string, pos long, v double")
    assert {r.pos for r in bursts.best(df, "g", "v", ["pos"]).where("is_best").collect()} == {3, 4}


def test_exact_floor(spark):
    rows = [(1, 102_400, b"x"), (2, 102_400, b"x"), (3, 102_401, b"y"), (4, 102_401, b"y"), (5, 102_401, b"z"), (6, 102_401, None)]
    df = spark.createDataFrame(rows, "id long, file_size long, content binary")
    got = duplicates.exact_groups(df).collect()
    assert sorted((r.group_id, r.id, r.is_preferred) for r in got) == [(3, 3, True), (3, 4, False)]


def test_exact_files(spark, tmp_path):
    bodies = {"a": b"x" * 5000 + b"1", "b": b"x" * 5000 + b"1", "c": b"x" * 5000 + b"2", "d": b"y" * 5001, "e": b"z"}
    for n, b in bodies.items():
        (tmp_path / n).write_bytes(b)
    rows = [(str(tmp_path / n), len(b)) for n, b in bodies.items()] + [(str(tmp_path / "gone"), 5001)]
    got = duplicates.exact_groups_of_files(spark.createDataFrame(rows, "file_path string, file_size long"), floor=1).collect()
    assert sorted((os.path.basename(r.id), r.is_preferred) for r in got) == [("a", True), ("b", False)]


@pytest.mark.parametrize(("n", "found"), [(500, True), (501, False)])
def test_bucket_cap(spark, n, found):
    df = spark.range(n).select("id", F.lit(0).cast("long").alias("phash"))
    assert (duplicates.similar_pairs(df).limit(1).count() == 1) == found


def test_smaller_threshold_refines(spark):
    df = spark.range(300).select("id", (F.xxhash64(F.col("id") % 60).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 7).cast("int")))).alias("phash"))
    wide, narrow = ({(r.a, r.b) for r in duplicates.similar_pairs(df, t).collect()} for t in (5, 1))
    assert narrow <= wide and wide


def test_list_and_count_agree(spark):
    from mediaframe.fixtures import Roles

    r = Roles(spark, "/root/testdata/sf0.001")
    for f in (catalog.Facets(), catalog.Facets(folder="/lib/src2"), catalog.Facets(media_type="video", search="img"), catalog.Facets(tag_id=1, album_id=3)):
        kw = {"media_tags": r.media_tags(), "album_media": r.album_media()}
        n = catalog.media_count(r.media(), f, **kw).first().total
        assert catalog.media_page(r.media(), r.exif(), f, limit=10_000, **kw).count() == n


def test_ingest_is_idempotent(spark):
    empty = spark.createDataFrame([], "file_path string, file_size long, modified_at string, scan_phase int")
    scan = spark.createDataFrame([("/a", 1, "x"), ("/b", 2, "y"), ("/b", 2, "y")], "file_path string, file_size long, modified_at string")
    once = ingest.ingest(empty, scan)
    assert once.count() == 2 and ingest.ingest(once, scan).count() == 2 and ingest.changed(once, scan).count() == 0
    later = scan.where("file_path = '/a'").withColumn("file_size", F.lit(9).cast("long"))
    done = once.withColumn("scan_phase", F.lit(1))
    assert {tuple(r) for r in ingest.ingest(done, later).collect()} == {("/a", 1, "x", 1), ("/b", 2, "y", 1)}
    assert {tuple(r) for r in ingest.ingest(done, later, "refresh", prune=True).collect()} == {("/a", 9, "x", 0)}


def test_upserts(spark):
    t = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    new = spark.createDataFrame([("b", "9"), ("c", "3")], "key string, value string")
    assert {tuple(r) for r in membership.upsert(t, new, ["key"]).collect()} == {("a", "1"), ("b", "9"), ("c", "3")}
    assert {tuple(r) for r in membership.insert_or_ignore(t, new, ["key"]).collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    m = spark.createDataFrame([(1, None)], "id long, comment string")
    assert [membership.set_comment(m, 1, c).first().comment for c in ("  hi ", "   ", None)] == ["hi", None, None]
    g = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, False)], "group_id long, media_id long, is_best boolean")
    assert [r.is_best for r in membership.set_exclusive(g, 1, 2, "is_best").orderBy("media_id").collect()] == [False, True, False]


def test_albums(spark):
    am = spark.createDataFrame([(1, 10, 0)], "album_id int, media_id long, sort_order int")
    ids = spark.createDataFrame([(20, 0), (10, 1), (30, 2)], "media_id long, position int")
    out = membership.add_to_album(am, 1, ids)
    assert {(r.media_id, r.sort_order) for r in out.collect()} == {(10, 0), (20, 0), (30, 2)}
    albums = spark.createDataFrame([(1, None), (2, None)], "id int, cover_media_id long")
    assert {r.id: r.cover_media_id for r in membership.fill_covers(albums, out).collect()} == {1: 10, 2: None}


def test_purge_and_trash(spark):
    media = spark.createDataFrame([(1, "/a/b/x"), (2, "/a/bc/y"), (3, "/a/b/z")], "id long, file_path string")
    members = spark.createDataFrame([(7, 1), (7, 3), (8, 2), (8, 3)], "group_id long, media_id long")
    groups = spark.createDataFrame([(7, "pending"), (8, "pending"), (9, "pending")], "id long, status string")
    ups = spark.createDataFrame([(1, "h"), (2, "i")], "media_id long, sha256 string")
    t = {"media_files": media, "duplicate_members": members, "duplicate_groups": groups, "nas_uploads": ups}
    out = membership.purge_folder(t, "/a/b")
    assert [r.id for r in out["media_files"].collect()] == [2] and [r.id for r in out["duplicate_groups"].collect()] == [8]
    assert {tuple(r) for r in out["nas_uploads"].select("media_id", "sha256").collect()} == {(None, "h"), (2, "i")}
    out = membership.resolve_after_trash(t, spark.createDataFrame([(1, True), (3, False)], "media_id long, ok boolean"))
    assert {r.id: r.status for r in out["duplicate_groups"].collect()} == {7: "resolved", 8: "pending", 9: "resolved"}


def test_sync_replan_is_empty(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    s = spark.createDataFrame([("a", 1, t0), ("b", 2, t1), ("c", 3, t0), ("x.tmp", 1, t0), ("d", 5, t0)], "rel_path string, size long, mtime timestamp_ntz")
    t = spark.createDataFrame([("b", 2, t0), ("c", 4, t0), ("d", 6, t1), ("e", 1, t0)], "rel_path string, size long, mtime timestamp_ntz")
    plan = sync.sync_plan(s, t, ["*.tmp"])
    assert {r.rel_path: r.action for r in plan.collect()} == {"a": "new", "b": "modified", "c": "size_changed", "d": "conflict", "e": "orphan"}
    work = sync.sync_worklist(plan, spark.createDataFrame([("d", "force_copy")], "rel_path string, resolution string"))
    again = sync.sync_plan(s, sync.apply_sync(t, s, work), ["*.tmp"], orphans=False)
    assert {r.action for r in again.collect()} == {"same"}


def test_similar_pairs_exact_at_any_size(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    held = base + [b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (0, 1, 3, 5, 5, 6, 7)]
    signed = {i: h - (1 << 64) if h >> 63 else h for i, h in enumerate(held)}
    df = spark.createDataFrame([*signed.items(), (500, None)], "id long, phash long")
    got = duplicates.similar_pairs_exact(df)
    first = {h: min(i for i in signed if signed[i] == h) for h in signed.values()}
    near = [(a, b, ((signed[a] ^ signed[b]) & (1 << 64) - 1).bit_count()) for a in first.values() for b in first.values() if a < b]
    copies = [(first[h], i, 0) for i, h in signed.items() if i != first[h]]
    assert sorted(map(tuple, got.collect())) == sorted([p for p in near if p[2] <= 5] + copies)
    assert not _broadcasts(got)  # nothing that grows goes through the driver


def _broadcasts(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_similar_job_spreads_clusters(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, 3), (5, 3)], "node long, label long").write.parquet(f"{tmp_path}/c")
    media = spark.createDataFrame([(i, 10 * i) for i in range(7)], "id long, file_size long")
    got = duplicates.similar_savings(spark.read.parquet(f"{tmp_path}/c"), media)
    assert sorted(map(tuple, got.collect())) == [(0, 2, 10), (3, 3, 70)]
    assert not _broadcasts(got)  # a cluster's members are as many rows as media


def test_fill_hashes_spreads_what_is_lacking(spark):
    media = spark.createDataFrame([(1, 7), (2, None), (3, None), (4, None)], "id long, phash long")
    dark, bright = [0] * 63 + [9], [9] + [0] * 63
    thumbs = spark.createDataFrame([(1, dark), (2, dark)], "id long, cells array<long>")
    full = spark.createDataFrame([(2, bright), (3, bright)], "id long, cells array<long>")
    got = duplicates.fill_hashes(media, thumbs, full)
    assert sorted(map(tuple, got.collect())) == [(1, 7, False), (2, 1, True), (3, -(1 << 63), True), (4, None, False)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" not in plan and "SortMergeJoin" in plan


def test_cluster_scores_spreads_hashes(spark, monkeypatch):
    seen, farthest = [], diameter.farthest
    monkeypatch.setattr(diameter, "farthest", lambda rows: seen.append(rows) or farthest(rows))
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)], "node long, label long")
    hashes = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (8, 5), (9, 5)], "id long, phash long")
    got = duplicates.cluster_scores(clusters, hashes)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 1 - 2 / 64), (8, 2, 1.0)]
    assert not _broadcasts(got) and not _broadcasts(seen[0])


def test_sort_keys_write_ids_alone(spark, monkeypatch):
    from mediaframe import queries, state_queries  # noqa: F401

    written, materialize = [], catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, name: written.append((df, name)) or materialize(df, name))
    queries.QUERIES["media_sort_keys"](spark, "/root/testdata/sf0.001")
    assert len(written) == 12 and all(df.columns == ["id", "__at"] for df, _ in written)
    assert not any(_broadcasts(df) for df, _ in written)


def test_collisions(spark):
    plan = spark.createDataFrame([("/1/a.jpg", "/o/a.jpg"), ("/2/a.jpg", "/o/a.jpg"), ("/3/a.jpg", "/o/a.jpg"), ("/1/b", "/o/b")], "source string, target string")
    there = spark.createDataFrame([("/o/a.jpg",), ("/o/a (2).jpg",)], "path string")
    got = {r.source: r.final_target for r in organize.resolve_collisions(plan, there).collect()}
    assert got == {"/1/a.jpg": "/o/a (1).jpg", "/2/a.jpg": "/o/a (3).jpg", "/3/a.jpg": "/o/a (4).jpg", "/1/b": "/o/b"}


def test_collisions_number_every_move(spark):
    moves = [(f"/{i:04}/a.jpg", "/o/a.jpg") for i in range(1_500)] + [(f"/{i}/c", "/o/c") for i in range(4)] + [("/0/x\ny.jpg", "/o/x\ny.jpg"), ("/1/x\ny.jpg", "/o/x\ny.jpg")]
    there = {"/o/c", "/o/c (1)", "/o/c (2)", "/o/c (4)", "/o/c (007)", "/o/c (99999999999999999999)", *(f"/o/a ({n}).jpg" for n in (1, 2, 5, 1_003, 1_004, 1_400, 5_000))}
    plan = spark.createDataFrame(moves, "source string, target string")
    there_df = spark.createDataFrame([(p,) for p in there], "path string")
    want, names = {}, set(there)
    for source, target in sorted(moves):
        stem, dot, ext = target.partition(".")
        want[source] = next(x for x in (target, *(f"{stem} ({n}){dot}{ext}" for n in range(1, 2_000))) if x not in names)
        names.add(want[source])
    assert {r.source: r.final_target for r in organize.resolve_collisions(plan, there_df).collect()} == want
    cut = {r.source: r.final_target for r in organize.resolve_collisions(plan, there_df, 1_000).collect()}
    assert cut["/0993/a.jpg"] == want["/0993/a.jpg"] == "/o/a (996).jpg" and cut["/0996/a.jpg"] == "/o/a (999).jpg" and cut["/0997/a.jpg"] is None


def test_rules(spark):
    media = spark.createDataFrame([(1, "Trip.jpg", "X100"), (2, "b.jpg", None)], "id long, file_name string, camera_model string")
    rules = spark.createDataFrame(
        [(1, 1, "[]", "f", "all", True), (2, 9, '[{"field":"camera_model","operator":"equals","value":"x100"}]', "f", "cam", True), (3, 99, '{"a":1}', "f", "no", True), (4, 99, "[]", "f", "off", False), (5, 99, "broken", "f", "no", True)],
        "id int, priority int, conditions_json string, action_type string, action_value string, enabled boolean",
    )
    assert {r.id: r.action_value for r in organize.apply_rules(media, rules).collect()} == {1: "cam", 2: "all"}
    shots = media.select(organize.classify_by_name(F.lit("My ScreenShot.png"), F.lit(5)).alias("c"), organize.classify_by_name(F.lit("image1"), F.lit(100_000)).alias("d")).first()
    assert tuple(shots.c) == ("Screenshots", 0.95) and shots.d is None


def test_folder_tree(spark):
    df = spark.createDataFrame([("/a/b/c", 1), ("/a/b/d", 2), ("/a/b", 4), ("/z", 1)], "folder string, n long")
    got = {(r.folder, r.label, r.total) for r in folders.group_tree(df).collect()}
    assert got == {("/a/b", "a/b", 7), ("/a/b/c", "c", 1), ("/a/b/d", "d", 2), ("/z", "z", 1)}


def test_tree_filter(spark):
    e = spark.createDataFrame([("/r", True, 0), ("/r/s", True, 0), ("/r/s/cat.jpg", False, 5), ("/r/dog.mp4", False, 7), ("/r/catalog", True, 0)], "path string, is_dir boolean, size long")
    assert {r.path for r in folders.tree_filter(e, "cat").collect()} == {"/r", "/r/s", "/r/s/cat.jpg", "/r/catalog"}
    vis = folders.tree_filter(e, "", "image")
    assert {r.path for r in vis.collect()} == {"/r", "/r/s", "/r/s/cat.jpg"}
    s = folders.tree_stats(e, vis).first()
    assert (s.folders, s.files, s["size"], s.images, s.videos) == (3, 1, 5, 1, 0)
    assert [r.name for r in folders.listing(e, "/r").collect()] == ["catalog", "s", "dog.mp4"]


def test_rollup_depth(spark):
    df = spark.createDataFrame([("/a/b/c/f", 1), ("/a/g", 2)], "file_path string, file_size long")
    got = {r.folder: (r.total_size, r.file_count, r.folder_count) for r in folders.rollup(df, max_depth=2).collect()}
    assert got == {"/a": (3, 2, 1), "/a/b": (1, 1, 0)}


def test_execute_and_undo(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in ("a", "b"):
        (src / n).write_text(n)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b").write_text("there")
    plan = spark.createDataFrame([(str(src / n), str(tmp_path / "out" / n)) for n in ("a", "b", "gone")], "source string, target string")
    done = fileops.execute(plan)
    assert {os.path.basename(r.source): r.status for r in done.collect()} == {"a": "done", "b": "exists", "gone": "missing"}
    j = fileops.journalled(done, "batch").withColumn("sequence", F.lit(0)).withColumn("executed_at", F.lit("2024"))
    back = journal.undo_plan(j, "batch")
    assert [r.status for r in fileops.execute(back, source="source_path", target="target_path").collect()] == ["done"] and (src / "a").read_text() == "a"
    after = journal.mark_undone(j, j.select("batch_id", "sequence", F.lit(True).alias("ok")))
    assert [r.status for r in after.collect()] == ["undone"] and journal.history(after).count() == 0


def test_schema_checks(spark):
    tables = schema.reset(spark)
    assert len(tables) == 21 and schema.violations({k: tables[k] for k in ("tags", "media_tags", "media_files")}).count() == 0
    tags = spark.createDataFrame([("1", "x", None, None), ("2", "x", None, None)], schema.struct("tags"))
    links = spark.createDataFrame([("9", "1", 1.0, "user")], schema.struct("media_tags"))
    got = {(r.table, r.rule) for r in schema.violations({"tags": tags, "media_tags": links, "media_files": tables["media_files"]}).collect()}
    assert got == {("tags", "unique name"), ("media_tags", "media_id in media_files")}


def test_missing_hashes_are_computed(spark):
    cells = lambda *on: [100 if i in on else 0 for i in range(64)]
    media = spark.createDataFrame([(1, 5), (2, None), (3, None), (4, None), (5, None)], "id long, phash long")
    thumbs = spark.createDataFrame([(1, cells(0)), (2, cells(63)), (4, [1, 2])], "id long, cells array<long>")
    images = spark.createDataFrame([(2, cells(1)), (3, cells(62, 63)), (3, cells(62, 63)), (9, cells(3))], "id long, cells array<long>")
    got = {r.id: (r.phash, r.computed) for r in duplicates.fill_hashes(media, thumbs, images).collect()}
    assert got == {1: (5, False), 2: (1, True), 3: (3, True), 4: (None, False), 5: (None, False)}
    assert {r.id: r.phash for r in duplicates.fill_hashes(media).collect()} == {1: 5, 2: None, 3: None, 4: None, 5: None}


@pytest.mark.parametrize("skip", [True, False])
def test_upload_run_equals_a_loop(spark, skip):
    rng = random.Random(4)
    items = [(i, f"f{i}.jpg", f"2024-0{rng.randint(1, 4)}-01T00:00:00", rng.choice(["a", "b", "c", "d", None]), rng.random() < 0.1) for i in range(120)]
    for seed in range(3):
        codes = {i: rng.choice([0, 0, 0, 1805, 407, None] + ([119] if rng.random() < 0.02 else [])) for i, *_ in items if i % 13}
        ups, up, over = {}, set(), False
        for i, _, date, sha, known in sorted(items, key=lambda x: (x[2], x[0])):
            code = codes.get(i)
            if over:
                ups[i] = "not_tried"
            elif code is None:
                ups[i] = "failed"
            elif skip and (known or (sha is not None and sha in up)):
                ups[i] = "skipped"
            else:
                ups[i] = {0: "uploaded", 1805: "skipped"}.get(code, "failed")
                over = code in (105, 119)
                if code == 0:
                    up.add(sha)
        work = spark.createDataFrame(items, "id long, file_name string, best_date string, sha256_hash string, known boolean")
        run = membership.upload_run(work, spark.createDataFrame(list(codes.items()), "id long, code int"), "/nas", organize_by_date=False, skip_uploaded=skip)
        assert {r.id: r.status for r in run.collect()} == ups
        assert all(r.remote_path == f"/nas/f{r.id}.jpg" for r in run.where("status = 'uploaded'").collect())
    assert membership.upload_run(work.limit(0), spark.createDataFrame([], "id long, code int"), "/nas").count() == 0


def test_list_orders(spark):
    folders = spark.createDataFrame([("b", "2024-02"), ("a", "2024-02"), ("c", "2023-01")], "id string, added_at string")
    assert [r.id for r in membership.source_folder_list(folders).collect()] == ["c", "a", "b"]
    groups = spark.createDataFrame([("2", "similar", "pending"), ("3", "exact", "pending"), ("1", "exact", "resolved"), ("0", "similar", "pending")], "id string, match_type string, status string")
    assert [r.id for r in membership.pending_groups(groups, "match_type").collect()] == ["3", "0", "2"]
    assert [r.id for r in membership.pending_groups(groups).collect()] == ["0", "2", "3"]
    members = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 7.0), ("g", 3, None), ("a", 4, 1.0)], "group_id string, media_id long, quality_score double")
    media = spark.createDataFrame([(i, f"{i}.jpg") for i in range(5)], "id long, file_name string")
    exif = spark.createDataFrame([(2, "2024")], "media_id long, date_taken string")
    assert [(r.media_id, r.date_taken) for r in membership.group_member_list(members, media, exif).collect()] == [(4, None), (2, "2024"), (1, None), (3, None)]
