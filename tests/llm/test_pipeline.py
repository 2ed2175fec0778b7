"""The pipeline's stages in order, each written and read again, against what each stage promises."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from test_ops_bytes import brute
from test_ops_text import expected_classes

from mediaframe.llm import common, mixing, near_dup, packing
from mediaframe.llm.common import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("__node", "node", "label", "k", "draws", "__take0", "class_id", "__lang_pred", "x1", "a.b")


def through(spark, docs):
    import corpus_pipeline

    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(materialize(stage(spark, seen[-1], SF), "stage"))
        assert i == 4 or seen[-1].columns == docs.columns
    return seen


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known, unique, cut, mixed, packed = through(spark, docs)[1:]
    assert known.count() == docs.where("text rlike '\\\\p{L}'").count()
    classes = near_dup.classes(known).collect()
    assert {r.doc_id for r in unique.collect()} == {r.class_id for r in classes}
    assert cut.count() == unique.count() and {r.doc_id for r in mixed.select("doc_id").collect()} <= {r.doc_id for r in cut.collect()}
    assert packed.count() == packing.pieces(mixed).count()
    check_packed(mixed, packed)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def check_packed(mixed, packed):
    """Pieces are the tokenizer's ids cut at 2,048; sequences have no gaps and end at 2,048."""
    encode, expected, by = packing.encoder(packing.default_tokenizer()).plain, Counter(), defaultdict(list)
    for r in mixed.collect():
        ids = encode(r.text or "") + packing.END
        expected.update((r.doc_id, i, 2048 * i, len(ids[a : a + 8192]) // 4, zlib.crc32(ids[a : a + 8192])) for i, a in enumerate(range(0, len(ids), 8192)))
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def hard_documents():
    """Nulls in every column, empty, very short and very long texts, ties, repeated rows, equal ids with other texts."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("the", "le", "der", "sol", "mer", "wind") for b in ("", "a", "es", "n", "o", "ing")]

    def text(n):
        return " ".join(rng.choice(words) + rng.choice("abcdefghij") for _ in range(n))

    passage = text(60)
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 !?", None, None, 5), (None, "a letter", None, None, None), (None, "a letter", None, None, None), (None, None, None, None, None)]
    rows += [(4, "x", "en", None, 1), (5, text(20000), "fr", "long", None)]
    same = text(80)
    rows += [(i, same, "en", "s", 9) for i in (10, 11, 12, 12)]
    near = same.split()
    rows += [(13, " ".join([*near[:-1], "other"]), "de", "t", 9), (10, " ".join([*near[:-2], "two", "more"]), "de", "t", 9)]
    rows += [(10, "quite another text that has the same id as others", "en", "s", 9)] * 2
    rows += [(20 + i, text(40) + " " + passage + " " + text(40), rng.choice(["en", None]), rng.choice(["s", "t", None, "\U0001f600", "￿"]), 1) for i in range(12)]
    rows += [(40 + i, "é" * 120 + text(30) + "é" * 120, "fr", "u", 1) for i in range(4)]
    return rows


@pytest.mark.parametrize("extra", [(), CLASHING])
def test_hard_documents(spark, extra):
    rows = hard_documents()
    schema = ", ".join([COLUMNS, *(f"`{c}` string" for c in extra)])
    docs = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in extra)) for r in rows], schema).repartition(3)
    given, known, unique, cut, mixed, packed = through(spark, docs)

    def pairs(df):
        return Counter((r["doc_id"], r["text"]) for r in df.collect())

    # language: rows with a letter stay
    held = [(r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert pairs(known) == Counter(held)
    for df in (known, unique, cut, mixed):
        assert all(r[c] == f"{c}{r['doc_id']}" for r in df.collect() for c in extra)

    # near duplicates: one row of each class, with its smallest doc_id
    root = expected_classes(list(range(len(held))), [t for _, t in held])
    members = defaultdict(list)
    for i, k in root.items():
        members[k].append(held[i])
    left = pairs(unique)
    assert sum(left.values()) == len(members)
    for rows_of in members.values():
        ids = [i for i, _ in rows_of if i is not None]
        assert sum((i, t) in left and i == (min(ids) if ids else None) for i, t in set(rows_of)) == 1

    # repeated passages: as brute force cuts them, sizes with them
    texts = [(r.doc_id, r.text) for r in unique.collect()]
    removed = [b[1] for b in brute([t.encode() for _, t in texts], 200)]
    assert any(removed) and not all(removed)
    after = Counter((r.doc_id, r.n_chars) for r in cut.collect())
    assert after == Counter((r.doc_id, len(r.text)) for r in cut.collect())
    sizes = sorted((i is None, i or 0, len(t.encode()) - n) for (i, t), n in zip(texts, removed, strict=True))
    whole = [(i is None, i or 0, len(t.encode())) for i, t in cut.select("doc_id", "text").collect()]
    assert all(0 <= a[2] - b[2] <= 6 for a, b in zip(sizes, sorted(whole), strict=True))  # broken characters go

    # mix: rows as often as their draws, at most twice
    drawn = Counter()
    for r, n in zip(*(df.orderBy("doc_id").collect() for df in (cut.select("doc_id", "text"), mixing.report(cut, max(mixing.SHARDS, 4)))), strict=True):
        drawn[r.doc_id] += len([x for x in n.shards.split(",") if x])
    assert Counter(r.doc_id for r in mixed.collect()) == +drawn and set(pairs(mixed)) <= set(pairs(cut))
    assert max(pairs(mixed).values()) <= 2
    check_packed(mixed, packed)


def test_empty_and_all_rejected(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert [df.count() for df in through(spark, empty)] == [0] * 6
    unknown = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, 0), (2, "--", "fr", "s", 2)], COLUMNS)
    assert [df.count() for df in through(spark, unknown)] == [3, 0, 0, 0, 0, 0]


def test_idle_workers_give_memory_back(monkeypatch):
    """A worker that turns to a task gives back what Arrow and the C library kept of the last one, whether it held caches or not."""
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append(1))
    common.let_go()
    assert called == [1]
