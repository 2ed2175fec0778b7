"""Cancelling running jobs."""

import os
import time

from mediaframe.operators import ingest
from mediaframe.plans.jobs import Job

SCAN = "file_path string, file_size long, modified_at string, media_type string"


def slow(spark, folder, seconds):
    """A scan of eight files, each of which takes its time; a mark tells that a task has begun."""

    def go(batches):
        for pdf in batches:
            for p in pdf["file_path"]:
                open(f"{folder}/{os.path.basename(p)}", "w").close()
                time.sleep(seconds)
            yield pdf

    return spark.createDataFrame([(f"/{i}.jpg", i, "t", "image") for i in range(8)], SCAN).repartition(4).mapInPandas(go, SCAN)


def test_a_cancelled_batch_leaves_nothing_and_runs_again(spark, tmp_path):
    store = ingest.open_catalog(spark, f"file://{tmp_path}/store", buckets=2)
    version, marks = store.manifest()["version"], tmp_path / "marks"
    marks.mkdir()
    began = time.time()
    job = Job(spark, "ingest", lambda job: ingest.ingest_batch(store, slow(spark, str(marks), 20), 0))
    while not os.listdir(marks):
        time.sleep(0.1)
    job.cancel()
    assert job.wait() == "cancelled" and time.time() - began < 30 and store.manifest()["version"] == version
    assert spark.range(5).count() == 5  # other work is not touched
    again = Job(spark, "ingest", lambda job: ingest.ingest_batch(store, slow(spark, str(marks), 0), 0))
    assert again.wait(120) == "done" and again.result == version + 1 and store.table("media_files").count() == 8
    again.cancel()
    assert again.status == "done"


def test_steps_and_failures(spark):
    steps = []

    def work(job):
        for i in range(1000):
            job.step()
            steps.append(i)
            time.sleep(0.05)

    job = Job(spark, "steps", work)
    time.sleep(0.3)
    job.cancel()
    assert job.status == "cancelled" and 0 < len(steps) < 1000
    failed = Job(spark, "fails", lambda job: 1 / 0)
    assert failed.wait(10) == "failed" and isinstance(failed.error, ZeroDivisionError)


def test_one_of_two(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    one = Job(spark, "one", lambda job: slow(spark, str(a), 20).count())
    two = Job(spark, "two", lambda job: slow(spark, str(b), 0.5).count())
    while not os.listdir(a):
        time.sleep(0.1)
    one.cancel()
    assert one.status == "cancelled" and two.wait(120) == "done" and two.result == 8
