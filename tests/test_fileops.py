"""Moves and copies carried out once, whatever becomes of the tasks; whole folders and their way back."""

import errno
import os

import pytest
from pyspark.sql import functions as F

from mediaframe.operators import journal
from mediaframe.plans import fileops, folders


def files(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, ns in os.walk(root) for n in ns if ".claims" not in d}


class Stop(BaseException):
    """The task is gone."""


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "a").write_text("content")
    return tmp_path


@pytest.mark.parametrize("other_device", [False, True])
@pytest.mark.parametrize("operation", ["move", "copy"])
def test_killed_anywhere_and_run_again(place, monkeypatch, operation, other_device):
    real = {n: getattr(os, n) for n in ("link", "unlink", "replace", "fsync")}
    claims = str(place / "claims")

    def cross(a, b):
        if other_device and "/in/" in a:
            raise OSError(errno.EXDEV, "other device")
        return real["link"](a, b)

    step, finished = 0, False
    while not finished:
        (place / "in" / "a").write_text("content")
        for name in os.listdir(place / "out"):
            real["unlink"](place / "out" / name)
        calls = [0]

        def dying(name):
            def call(*args):
                calls[0] += 1
                if calls[0] == step + 1:
                    raise Stop
                return (cross if name == "link" else real[name])(*args)

            return call

        for n in real:
            monkeypatch.setattr(fileops.os, n, dying(n))
        args = (str(place / "in" / "a"), str(place / "out" / "b"), operation, False, f"{claims}{step}")
        try:
            assert fileops.act(*args) == "done"
            finished = True
        except Stop:
            pass
        for n in real:
            monkeypatch.setattr(fileops.os, n, cross if n == "link" else real[n])
        assert fileops.act(*args) == "done" and fileops.act(*args) == "done"
        left = {n: t for n, t in files(place).items() if not n.startswith("claims") and ".part-" not in n}
        assert left == ({"out/b": "content"} if operation == "move" else {"in/a": "content", "out/b": "content"})
        step += 1
    assert step > 5


def test_strangers_are_left_alone(place):
    source, target = str(place / "in" / "a"), str(place / "out" / "b")
    (place / "out" / "b").write_text("stranger")
    assert fileops.act(source, target, "move") == "exists" and fileops.act(str(place / "in" / "gone"), target, "move") == "missing"
    assert files(place) == {"in/a": "content", "out/b": "stranger"}
    os.unlink(source)
    assert fileops.act(source, target, "move") == "missing"  # the source is gone and the target is no work of ours
    (place / "in" / "a").write_text("content")
    assert fileops.act(source, target, "move", overwrite=True) == "done" and files(place) == {"out/b": "content"}
    assert fileops.act(target, target, "move") == "same" and fileops.act(str(place / "out"), str(place / "out" / "x"), "move") == "nested"


def test_without_hard_links(place, monkeypatch):
    real = os.link

    def link(a, b):
        if ".claims" not in str(b):
            raise OSError(errno.EPERM, "none here")
        return real(a, b)

    monkeypatch.setattr(fileops.os, "link", link)
    assert fileops.act(str(place / "in" / "a"), str(place / "out" / "b"), "move") == "done" and files(place) == {"out/b": "content"}


def test_side_by_side(place):
    from concurrent.futures import ThreadPoolExecutor

    for i in range(40):
        (place / "in" / f"f{i}").write_text(str(i))
    jobs = [(str(place / "in" / f"f{i}"), str(place / "out" / f"f{i}")) for i in range(40) for _ in range(4)]
    with ThreadPoolExecutor(16) as pool:
        got = list(pool.map(lambda j: fileops.act(*j, "move", False, str(place / "claims")), jobs))
    assert set(got) == {"done"} and {k: v for k, v in files(place / "out").items()} == {f"f{i}": str(i) for i in range(40)} and os.listdir(place / "in") == ["a"]


def test_a_plan_run_again_has_the_same_statuses(spark, place):
    plan = spark.createDataFrame([(str(place / "in" / n), str(place / "out" / n)) for n in ("a", "gone")], "source string, target string")
    once, again = ({r.source[-1]: r.status for r in fileops.execute(plan, claims=str(place / "claims")).collect()} for _ in range(2))
    assert once == again == {"a": "done", "e": "missing"}
    assert {r.status for r in fileops.execute(plan).collect()} == {"missing"}


def tree(root):
    names = ["lib/a/x/1.jpg", "lib/a/x/deep/2.jpg", "lib/a/y/3.jpg", "lib/b/x/4.jpg", "lib/ab/5.jpg"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(n)
    (root / "lib/a/x/empty").mkdir()


def entries(spark, root):
    rows = [(os.path.join(d, n), False) for d, _, ns in os.walk(root) for n in ns] + [(d, True) for d, _, _ in os.walk(root)]
    return spark.createDataFrame(rows, "path string, folder boolean")


REQUEST = "request long, source string, target_dir string, new_name string"


@pytest.mark.parametrize("whole", [True, False])
def test_folders_move_and_come_back(spark, tmp_path, whole):
    tree(tmp_path)
    at = f"{tmp_path}/lib"
    rows = [(0, f"{at}/a/x", f"{at}/b", None), (1, f"{at}/a/x/deep", f"{at}/b", None), (2, f"{at}/a/y", f"{at}/a", " z "), (3, f"{at}/b", f"{at}/b/x", None), (4, f"{at}/none", at, None), (5, f"{at}/ab", f"{at}/ab", "a/b"), (6, f"{at}/ab", f"{at}/no", None), (7, f"{at}/a/y", at, None), (8, f"{at}/b/x", f"{at}/b", "x")]
    there = entries(spark, at)
    planned = folders.plan(spark.createDataFrame(rows, REQUEST), there)
    got = {r.request: (r.status, r.destination and r.destination[len(at) :]) for r in planned.collect()}
    assert got == {0: ("ready", "/b/x (1)"), 1: ("covered", None), 2: ("ready", "/a/z"), 3: ("nested", None), 4: ("missing", None), 5: ("bad name", None), 6: ("no target", None), 7: ("covered", None), 8: ("covered", None)}
    before = files(at)
    done = folders.carry_out(planned, there, whole=whole)
    assert {r.request: r.status for r in done.collect()} == {0: "done", 2: "done"}
    assert files(at) == {"b/x (1)/1.jpg": "lib/a/x/1.jpg", "b/x (1)/deep/2.jpg": "lib/a/x/deep/2.jpg", "a/z/3.jpg": "lib/a/y/3.jpg", "b/x/4.jpg": "lib/b/x/4.jpg", "ab/5.jpg": "lib/ab/5.jpg"}
    assert os.path.isdir(f"{at}/b/x (1)/empty") and not os.path.exists(f"{at}/a/x") and not os.path.exists(f"{at}/a/y")
    j = folders.journalled(done, "batch").withColumn("executed_at", F.lit("2024"))
    back = journal.undo_plan(j, "batch")
    undone = fileops.execute(back, source="source_path", target="target_path")
    assert [r.status for r in undone.collect()] == ["done"] * 2 and files(at) == before


def test_folders_copy(spark, tmp_path):
    tree(tmp_path)
    at = f"{tmp_path}/lib"
    there = entries(spark, at)
    planned = folders.plan(spark.createDataFrame([(0, f"{at}/a", f"{at}/b", None), (1, f"{at}/ab/5.jpg", f"{at}/b", None)], REQUEST), there)
    before = files(at)
    (tmp_path / "lib/a/x/deep/2.jpg").unlink()  # gone since the plan was made
    done = {r.request: r.status for r in folders.carry_out(planned, there, "copy").collect()}
    assert done == {0: "missing", 1: "done"}
    after = files(at)
    assert after["b/a/x/1.jpg"] == "lib/a/x/1.jpg" and after["b/5.jpg"] == "lib/ab/5.jpg" and set(before) - {"a/x/deep/2.jpg"} <= set(after)
    assert os.path.isdir(f"{at}/b/a/x/empty") and folders.carry_out(planned.limit(0), there).count() == 0
