"""Fill-in-the-middle forms against tokens cut by a regular expression."""

import hashlib
import random
import re

import pytest
from oracle import both
from pyspark.sql import functions as F

from mediaframe.llm import infill, queries

TOKENS = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    t = TOKENS.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, text
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = ("".join(x) for x in (t[:a], t[a:b], t[b:]))
    if h4 % 100 < 20:
        return len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    parts = ["abc", "Z", " ", "  ", "\n", "é", "ß", "中", "文字", "😀", "123", "<", "P>", "<S", ">", "\0", " ", "x" * 50]
    out = ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(300)]
    return [None, "", "a", "é", "<P>", "a<S>b", "<M", *out]


def test_places_are_where_tokens_begin(monkeypatch):
    for size in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(infill, "SLICE", size)
        for text in filter(None, texts()[:90]):
            t, raw = TOKENS.findall(text), text.encode()
            runs = infill.class_runs(raw)
            assert runs.total == (len(raw), len(text), len(t))
            for u in range(len(t) + 1):
                head = "".join(t[:u])
                assert infill.place(runs, u) == (len(head.encode()), len(head))
    assert infill.class_runs(b"").total == (0, 0, 0) and infill.place(infill.class_runs(b""), 0) == (0, 0)


def test_runs_are_maximal():
    runs = infill.class_runs("ab12é中中x".encode())
    assert runs.kind.tolist() == [0, 1, 2, 3, 0] and runs.char.tolist() == [0, 2, 4, 5, 7]
    assert runs.unit.tolist() == [0, 1, 3, 4, 6] and runs.byte.tolist() == [0, 2, 4, 6, 12]


def test_forms_against_brute_force(spark):
    rows = [(i, t, "n") for i, t in enumerate(texts())] + [(None, "one two", "n"), (-7, "three four five", "n"), (5, "same", "n"), (5, "same", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")  # n clashes with a column of the result
    out = infill.infill(df).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out), key=lambda r: str(r))
    want = sorted(((i, *brute(i, t), t or "") for i, t, _ in rows), key=lambda r: str(r))
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.infill(df.limit(0)).count() == 0


def test_long_text(spark):
    text = ("word, " * 400_000) + "中" * 100_000 + "é" * 100_000
    row = infill.infill(spark.createDataFrame([(2, text)], "doc_id long, text string")).first()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == brute(2, text)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    ours, theirs = both(spark, queries.QUERIES, queries.ORACLES, "op11_infill_run_lengths", f"/root/testdata/{sf}")
    assert ours == theirs
