"""The folder tree source against os.walk."""

import os

import pytest
from pyspark.sql import functions as F

from mediaframe.sources import media, tree


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "lib"
    names = ["a.jpg", "_DSC0001.JPG", "_trip/b.MOV", "_trip/_deep/_x.png", ".h.jpg", ".hid/c.jpg", "node_modules/d.jpg", "node_modules/in/e.jpg", "Y.app/f.png", "Y.app/Contents/g.png", "t.txt", "é/ü.jpg", "s p/#?.gif", "Thumbs.db", "__MACOSX/k.jpg"]
    names += [f"many/{i % 7}/{i % 3}/{i}.jpg" for i in range(200)]
    for i, n in enumerate(names):
        (top / n).parent.mkdir(parents=True, exist_ok=True)
        (top / n).write_bytes(b"x" * (i % 50))
    os.symlink(top, top / "_trip" / "loop")  # its own ancestor
    os.symlink(top / "many" / "1", top / "again")  # not an ancestor: seen twice
    os.symlink(tmp_path / "nowhere", top / "dangling.jpg")
    os.symlink(top / "a.jpg", top / "alias.jpg")
    (top / "empty").mkdir()
    os.mkdir(os.fsencode(str(top)) + b"/\xff")
    open(os.fsencode(str(top)) + b"/\xff\xfe.jpg", "w").close()
    return str(top)


def walked(root, enters=lambda n: True, gives=lambda n: True):
    out = []

    def go(folder, above):
        for name in os.listdir(folder):
            p = os.path.join(folder, name)
            if os.path.isdir(p):
                real = os.path.realpath(p)
                if enters(name) and real not in above:
                    go(p, [*above, real])
            elif gives(name) and os.path.exists(p) and tree.utf8(p):
                out.append((p, os.stat(p).st_size))

    go(root, [os.path.realpath(root)])
    return sorted(out)


@pytest.mark.parametrize("tasks", [1, 2, 9, 256])
def test_walk_equals_os_walk(spark, root, tasks):
    rows = tree.files(spark, root, tasks=tasks)
    assert sorted((r.path, r["size"]) for r in rows.collect()) == walked(root)
    assert rows.rdd.getNumPartitions() >= min(tasks, 5)
    bad = lambda n: n.startswith(".") or n in media.EXCLUDED_NAMES or n.endswith(media.EXCLUDED_SUFFIXES)
    rows = tree.files(spark, root, media.EXCLUDED_NAMES, media.EXCLUDED_SUFFIXES, hidden=False, tasks=tasks)
    assert sorted((r.path, r["size"]) for r in rows.collect()) == walked(root, lambda n: not bad(n), lambda n: not n.startswith("."))


def test_excluded_folders_are_not_listed(root, monkeypatch):
    seen, real = [], tree.entries
    monkeypatch.setattr(tree, "entries", lambda folder: (seen.append(folder), real(folder))[1])
    reader = tree.TreeReader(root, tree.Rules(list(media.EXCLUDED_NAMES), list(media.EXCLUDED_SUFFIXES), False), 3)
    for part in reader.partitions():
        list(reader.read(part))
    assert seen and not [s for s in seen if any(x in s[len(root) :] for x in ("node_modules", ".app", "/.", "__MACOSX"))]


def test_scan_and_listing_keep_underscores(spark, root):
    found = {r.file_path[len(root) + 1 :]: r for r in media.scan(spark, root).collect()}
    assert {"_DSC0001.JPG", "_trip/b.MOV", "_trip/_deep/_x.png", "a.jpg", "alias.jpg", "é/ü.jpg", "s p/#?.gif"} <= set(found)
    assert not {".h.jpg", "t.txt", "Thumbs.db", "node_modules/d.jpg", "Y.app/f.png", "__MACOSX/k.jpg", "dangling.jpg"} & set(found)
    assert sum(n.startswith("again/") for n in found) == sum(n.startswith("many/1/") for n in found) > 0
    os.utime(f"{root}/a.jpg", (86_399.5, 86_399.5))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
    try:
        assert media.scan(spark, root).where(F.col("file_name") == "a.jpg").first().modified_at == "1970-01-01T23:59:59"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    rel = {r.rel_path for r in media.listing(spark, root).collect()}
    assert {".h.jpg", ".hid/c.jpg", "_trip/_deep/_x.png", "t.txt", "node_modules/in/e.jpg"} <= rel
    with pytest.raises(Exception, match="not a folder"):
        tree.files(spark, f"{root}/nothing").count()


def test_batches(root, spark, monkeypatch):
    monkeypatch.setattr(tree, "BATCH", 3)
    reader = tree.TreeReader(root, tree.Rules([], [], True), 1)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert max(map(len, batches)) == 3 and sum(map(len, batches)) == len(walked(root))
