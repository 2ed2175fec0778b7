"""Classifiers, near duplicates, licenses, packing, mixing and search against brute force and invariants."""

import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from oracle import both
from pyspark.sql import functions as F

from mediaframe.llm import language, licenses, mixing, near_dup, packing, queries, topk, toxicity

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


# ---- toxicity and language --------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rows = toxicity.op1_toxicity_nb_ngrams(spark, SF2).join(spark.read.parquet(f"{SF2}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    hit = Counter((r.toxic, r.predicted) for r in rows)
    assert hit[(1, 1)] >= 0.75 * (hit[(1, 0)] + hit[(1, 1)]) and hit[(0, 1)] <= 0.015 * (hit[(0, 0)] + hit[(0, 1)]), hit


def slots(text):
    """The n-grams' slots, character by character in integers of any size."""
    code, out = [2, *(ord(c) for c in text.lower()), 3], []
    for n in range(3, 7):
        for i in range(len(code) - n + 1):
            x = code[i]
            for c in code[i + 1 : i + n]:
                x = x * 0x9E3779B97F4A7C15 + c
            x = (x + n) * 0xD6E8FEB86659FD93 % 2**64
            x ^= x >> 32
            out.append((x * 0xD6E8FEB86659FD93 % 2**64) >> 46)
    return set(out)


def test_toxicity_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts, toxic = toxicity.sample(docs, labels, 1500, 16384)
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    rows = docs.collect()
    assert sorted(texts) == sorted(r.text for r in rows if r.doc_id in known and len(r.text) <= 16384)
    place, weights, bias = toxicity.fit(texts, toxic)
    sets, n = [slots(t) for t in texts], [toxic.count(0), toxic.count(1)]
    count = [Counter(x for s, y in zip(sets, toxic, strict=True) if y == k for x in s) for k in (0, 1)]
    ratio = {x: np.log((count[1][x] + 1) / (n[1] + 2)) - np.log((count[0][x] + 1) / (n[0] + 2)) for x in set(count[0]) | set(count[1])}
    power = {x: abs(r) * np.sqrt(count[0][x] + count[1][x]) for x, r in ratio.items()}
    kept = set(np.flatnonzero(place >= 0).tolist())
    assert len(kept) == 2000 and min(power[x] for x in kept) >= max(p for x, p in power.items() if x not in kept) - 1e-9
    for r in toxicity.score(docs, labels).collect():
        text = next(d.text for d in rows if d.doc_id == r.doc_id)
        z = bias + sum(weights[place[x]] for x in slots(text) if place[x] >= 0)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.7)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([None, "", "x" * 50_000, "bad word", "bad word"])], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (1, 0), (0, 0), (99, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 5 and toxicity.score(docs.limit(0), labels).count() == 0


def test_automaton_accepts_substrings_only():
    rng = random.Random(1)
    text = [rng.randint(0, 2) for _ in range(60)]
    trans = language.automaton(text)

    def accepts(word):
        state = 0
        for c in word:
            if c not in trans[state]:
                return False
            state = trans[state][c]
        return True

    subs = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 7) + 1)}
    assert all(accepts(w) for w in subs)
    for _ in range(300):
        w = tuple(rng.randint(0, 2) for _ in range(rng.randint(1, 6)))
        assert accepts(w) == (w in subs)


def test_phrases_are_longest_matches():
    model = language.Model({"a": "abracadabra", "b": "banana bandana"})
    text = "banabrazanana?"
    for lang, train in (("a", "abracadabra"), ("b", "banana bandana")):
        n, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at : end + 1] in train:
                end += 1
            n, at = n + 1, end
        k = model.langs.index(lang)
        unknown_first = text[0] not in train
        got = model.costs([text], 2048)[0, k] * len(text) / model.bits[k]
        assert abs(got - n) <= 1 + unknown_first + sum(c not in train for c in text)


def test_more_letters_than_the_dense_table():
    """Languages of hundreds of letters each: exact phrases, and their own texts are told apart."""
    rng, samples, texts = random.Random(7), {}, []
    letters = [chr(0x4E00 + i) for i in range(600)] + [chr(0xAC00 + i) for i in range(400)]
    for k, lang in enumerate("abc"):
        words = ["".join(rng.choices(letters[200 * k : 200 * k + 600], k=rng.randint(1, 4))) for _ in range(400)]
        samples[lang] = " ".join(rng.choices(words, k=1500))[:3500]
        texts += [" ".join(rng.choices(words, k=100)) + "?" for _ in range(10)]
    model = language.Model(samples)
    assert len(set("".join(samples.values()))) > 500
    cost = model.costs(texts, 2048)
    assert cost.argmin(axis=1).tolist() == [0] * 10 + [1] * 10 + [2] * 10
    for text, row in zip(texts, cost, strict=True):
        for k, lang in enumerate(model.langs):
            n, at = 0, 0
            while at < len(text):
                end = at + 1
                while end < len(text) and text[at : end + 1] in samples[lang]:
                    end += 1
                n, at = n + 1, end
            assert round(row[k] * len(text) / model.bits[k]) == n


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang")
    rows = language.op9_language_cross_parsing(spark, SF2).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_brute_force(spark):
    """Samples from learnable rows only; every prediction and score recomputed by longest matches in the samples."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(10_001, "\u4f60\u597d, hello \U0001f600 welt", None, None, 9), (10_002, "Le Chat " * 600, "xx", None, 9), (None, "nobody", "yy", None, 9)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = {r.doc_id: r for r in docs.collect()}
    known = language.samples(docs)
    teach = defaultdict(list)
    for i, r in rows.items():
        if i is not None and r.lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            teach[r.lang].append(r.text.lower())
    assert set(known) == set(teach)
    assert all(any(part in t for t in teach[lang]) for lang, sample in known.items() for part in sample[:3000].split("\n")[:-1] if part)
    got = language.classify(docs, ["doc_id"], language.train(docs), stretch=2048).collect()
    assert len(got) == len(rows)
    for r in sorted(got, key=lambda r: str(r.doc_id))[:40] + [r for r in got if r.doc_id is None or r.doc_id > 10_000]:
        text, cost = rows[r.doc_id].text or "", {}
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        text = text.lower()
        for lang, sample in known.items():
            n = 0
            for a in range(0, len(text), 2048):
                part, at = text[a : a + 2048], 0
                while at < len(part):
                    end = at + 1
                    while end < len(part) and part[at : end + 1] in sample:
                        end += 1
                    n, at = n + 1, end
            cost[lang] = n * np.log2(max(2, len(sample))) / len(text)
        first, second = sorted(cost, key=lambda k: (cost[k], k))[:2]
        assert r.lang_pred == first and r.score == pytest.approx(1 - cost[first] / cost[second], abs=1e-9)
    assert language.classify(docs.limit(0), ["doc_id"], language.train(docs)).count() == 0


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "en", "a"), (2, "12 !?", "en", "b"), (3, "the cat sat", "en", "c"), (None, "x", None, "d"), (5, "le chat", "fr", "e")], "doc_id long, text string, lang string, lang_pred string")
    model = language.Model({"en": "the cat sat on the mat", "fr": "le chat est la"})
    got = {r.doc_id: r.p for r in language.classify(df, ["doc_id", "lang_pred"], model, names=("p", "q")).collect()}
    assert got[1] == got[2] == "und" and got[3] == "en" and got[5] == "fr"
    assert language.train(df.limit(0)) is None
    assert {r.p for r in language.classify(df, ["doc_id"], None, names=("p", "q")).collect()} == {"und"}
    kept = language.keep_known(spark.read.parquet(f"{SF}/documents.parquet").withColumn("__lang_extra", F.lit(1)))
    assert "__lang_extra" in kept.columns and kept.count() >= 195


# ---- near duplicates --------------------------------------------------------------------------


def shingle_set(text):
    """Runs of five words, told by Python's own classes of characters and not by the operator's."""
    words = re.findall("[\u0e00-\u0eff\u1000-\u109f\u3041-\u30ff\u3400-\u9fff]|[^\\W_\u0e00-\u0eff\u1000-\u109f\u3041-\u30ff\u3400-\u9fff]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, bool(words)))}


def expected_classes(ids, texts):
    sets = [shingle_set(t) for t in texts]
    index, shared, root = defaultdict(list), Counter(), list(range(len(texts)))
    for i, s in enumerate(sets):
        for h in s:
            index[h].append(i)
    for places in index.values():
        shared.update((a, b) for k, b in enumerate(places) for a in places[:k])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), n in shared.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(texts))}


def test_prob_minhash_estimates():
    ids = near_dup.mix(np.arange(1, 1001, dtype=np.uint64))
    w = np.r_[np.linspace(1, 3, 900), np.linspace(1.2, 2.8, 900)]
    held = near_dup.prob_minhash(np.r_[ids[:900], ids[100:]], w, np.repeat([0, 1], 900), 2, 4096)
    x, y = np.zeros(1000), np.zeros(1000)
    x[:900], y[100:] = w[:900], w[900:]
    both_in = np.flatnonzero((x > 0) & (y > 0))
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both_in)
    assert abs((held[0] == held[1]).mean() - exact) < 0.03


def test_near_dup_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.class_id for r in near_dup.op8_probminhash_near_dup(spark, SF).collect()}
    assert got == expected_classes([d.doc_id for d in docs], [d.text for d in docs])


def test_near_dup_dense_groups(spark, monkeypatch):
    """Chains, hubs and groups that share much but not enough, compared in small blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(300)]
    texts = []
    for i in range(40):  # each a little further away from the first
        t = base[:]
        for k in range(i):
            t[(k * 7) % 300] = f"x{k}"
        texts.append(" ".join(t))
    for i in range(40):  # far from each other, with a common half
        texts.append(" ".join(base[:150] + [rng.choice(words) for _ in range(150)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    assert got == expected_classes(list(range(len(texts))), texts)


def test_near_dup_large_group_is_not_dealt_out_whole(spark, monkeypatch):
    """Copies of one text at many distances, some with repeated lines: at most four rows a text are left to be compared, and no link is lost."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    dealt, write = [], near_dup.materialize

    def written(df, name):
        out = write(df, name)
        if name == "rare":
            dealt.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "materialize", written)
    rng, texts = random.Random(3), []
    base = [f"w{i}" for i in range(150)]
    for i in range(240):
        t = base[:]
        for j in rng.sample(range(150), rng.randint(0, 7)):
            t[j] = f"x{i}y{j}"
        texts.append(" ".join(t + t[:8] * (i % 6 == 0) * rng.randint(1, 3)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    assert got == expected_classes(list(range(len(texts))), texts) and len(set(got.values())) > 20
    assert dealt and dealt[-1] <= 4 * len(texts), dealt


def test_near_dup_repeated_lines(spark):
    """Near copies of which one repeats a line hundreds of times are links of the sets all the same."""
    rng, texts = random.Random(5), []
    for i in range(60):
        base = [f"w{i}x{rng.randrange(10**6)}" for _ in range(104)]
        line = [f"r{i}x{j}" for j in range(20)]
        texts += [" ".join(base), " ".join(base + line * rng.choice([100, 200, 400]))]
    expected = expected_classes(list(range(120)), texts)
    assert all(expected[i + 1] == i for i in range(0, 120, 2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.classes(df).collect()} == expected


def test_near_dup_unspaced_scripts(spark):
    rng = random.Random(8)
    texts = []
    for a, b in ((0x4E00, 0x9000), (0x3041, 0x3090), (0xE01, 0xE2E)):
        for _ in range(4):
            base = [chr(rng.randint(a, b)) for _ in range(660)]
            texts += ["".join(base), "".join(base[:330] + ["\u3042"] + base[331:]), "。".join(["".join(base[:300]), "".join(base[300:])])]
            texts.append("".join(base[:220] + [chr(rng.randint(a, b)) for _ in range(440)]))
    expected = expected_classes(list(range(len(texts))), texts)
    assert [expected[i] % 4 for i in range(len(texts))] == [0, 0, 0, 3] * 12
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.classes(df).collect()} == expected


def test_near_dup_recall_by_similarity(spark):
    """Pairs of every similarity from 0.8 on, 150 a band: nearly all are found, and none below it."""
    rng, texts, similar = random.Random(9), [], []
    for changes in (1, 3, 5, 8, 11):
        for i in range(150):
            base = [f"b{changes}w{i}x{rng.randrange(10**6)}" for _ in range(400)]
            other = base[:]
            for k in rng.sample(range(0, 400, 10), changes):
                other[k] = f"y{rng.randrange(10**9)}"
            texts += [" ".join(base), " ".join(other)]
            a, b = shingle_set(texts[-2]), shingle_set(texts[-1])
            similar.append(len(a & b) / len(a | b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    linked = np.array([got[2 * i] == got[2 * i + 1] for i in range(len(similar))])
    similar = np.array(similar)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        here = (similar >= low) & (similar < high)
        assert here.sum() >= 100 and linked[here].mean() >= 0.99
    assert not linked[similar < 0.8].any() and (similar < 0.8).sum() >= 100


def test_near_dup_similarity_of_weights():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = (rng.integers(0, 5, 30) * (rng.random(30) < 0.8) for _ in range(2))
        a, b = np.flatnonzero(x), np.flatnonzero(y)
        shared = np.flatnonzero((x > 0) & (y > 0))
        exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in shared)
        sets = len(shared) / ((x > 0) | (y > 0)).sum()
        assert abs(near_dup.similarity(a, x[a], b, y[b]) - max(exact, sets)) < 1e-12
        assert near_dup.similarity(a, None, b, None) == sets
    assert near_dup.similarity(np.arange(4), None, np.arange(5), None) == 0.8 and near_dup.similarity(np.arange(2), np.array([1, 2]), np.arange(5, 7), None) == 0


@pytest.mark.parametrize("block", [8, 256])
def test_near_dup_links_of_weights(spark, monkeypatch, block):
    """Texts that are mostly one repeated passage, with different ends, are links by weight though their sets share half only."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng, texts = random.Random(6), []
    for g in range(12):
        line = [f"g{g}w{i}" for i in range(60)]
        for _ in range(3):
            texts.append(" ".join(line * 20 + [f"e{rng.randrange(10**9)}" for _ in range(30)]))  # shared: 1,196 of 1,226 by weight, 60 of 120 as sets
        texts.append(" ".join(line * 20 + [f"e{rng.randrange(10**9)}" for _ in range(900)]))  # 1,196 of 2,096 by weight
    sets = [shingle_set(t) for t in texts]
    assert all(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.6 for i in range(0, len(texts), 4))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    assert got == {i: i if i % 4 == 3 else i - i % 4 for i in range(len(texts))}


def test_near_dup_joined_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", -1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.class_id for r in near_dup.op8_probminhash_near_dup(spark, SF).collect()}
    assert got == expected_classes([d.doc_id for d in docs], [d.text for d in docs])


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_dup_edges(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(near_dup, "BROADCAST_ROWS", -1)
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "two words", 3), (4, "Two, WORDS!", 4), (5, "...", 5), (None, "two words", 6), (7, "two words", 7), (3, "two words", 8)], "doc_id long, text string, node int")
    rows = [(r.doc_id, r.class_id, r.class_size) for r in near_dup.classes(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, 1), (2, 2, 1), (5, 5, 1), (3, 3, 5), (3, 3, 5), (4, 3, 5), (None, 3, 5), (7, 3, 5)], key=str)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5]
    assert near_dup.classes(df.limit(0)).count() == 0


# ---- licenses ---------------------------------------------------------------------------------


def test_licenses_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    for r in licenses.op7_license_rules(spark, SF2).collect():
        low = docs[r.doc_id].translate({c: c + 32 for c in range(65, 91)})
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_licenses_rules_and_suppression(spark):
    assert len(licenses.rules()) > 200
    given = [
        "Licensed under the Apache License, Version 2.0. See LICENSE.",
        "cc by cc by CC-BY-SA 4.0",
        None,
        "",
        "mit licensed; permit license",
        "GPLv2 or later GNU General Public License version 3",
        "x " * 30_000 + "MIT License",
    ]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(given)], "doc_id int, text string, labels string")
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert rows[0].labels == "apache,apache-2.0,unspecified-license" and rows[0].score == 0.95
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word) == (3, 0, 4) and "cc-by-sa" in rows[1].labels
    assert (rows[2].n_words, rows[2].labels, rows[2].score, rows[2].first_word) == (0, "", 0.0, None) and rows[3].n_base == 0
    assert rows[4].base_labels == "" and rows[5].base_labels == "gpl" and "gpl-2.0" in rows[5].labels.split(",")
    assert (rows[6].n_words, rows[6].first_word) == (30_002, 30_000)
    inner = spark.range(1).select(F.expr("array(named_struct('start',0,'minus_end',-5,'minus_priority',-2,'ord',1,'label','a'), named_struct('start',1,'minus_end',-3,'minus_priority',-2,'ord',2,'label','b'), named_struct('start',1,'minus_end',-4,'minus_priority',-3,'ord',3,'label','c'), named_struct('start',0,'minus_end',-5,'minus_priority',-2,'ord',4,'label','d'), named_struct('start',4,'minus_end',-6,'minus_priority',-1,'ord',5,'label','e'))").alias("d"))
    assert [x.label for x in inner.select(licenses.suppress(F.col("d")).alias("k")).first().k] == ["a", "c", "e"]


def drawn(pattern, rng):
    """A random text that the pattern matches."""
    from re import _constants as c
    from re import _parser

    def part(op, arg):
        if op is c.LITERAL:
            return chr(arg)
        if op is c.IN:
            return part(*rng.choice(arg))
        if op is c.RANGE:
            return chr(rng.randint(*arg))
        if op is c.BRANCH:
            return run(rng.choice(arg[1]))
        if op is c.SUBPATTERN:
            return run(arg[3])
        if op is c.MAX_REPEAT:
            return "".join(run(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        assert op is c.ASSERT_NOT
        return ""

    run = lambda items: "".join(part(*x) for x in items)
    return run(_parser.parse(pattern))


# A text and the labels of its detections.
LICENSED = (
    ("released under the Expat License", "mit"),
    ("the FreeBSD license applies", "bsd-2-clause"),
    ("licensed under the GPL", "gpl"),
    ("the Apache license", "apache"),
    ("published under the LGPL", "lgpl"),
    ("SPDX-License-Identifier: MPL", "mpl"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("distributed under the terms of the GNU Lesser General Public License, version 2.1 or any later version", "lgpl-2.1"),
    ("GNU Affero General Public License version 3", "agpl-3.0"),
    ("Apache Software License 1.1", "apache-1.1"),
    ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4.0"),
    ("available under CC BY-NC-ND 3.0", "cc-by-nc-nd-3.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0", "cc-by,cc-by-4.0"),
    ("SIL Open Font License 1.1", "ofl-1.1"),
    ("Perl Artistic License 2.0", "artistic-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("Redistribution and use in source and binary forms", "bsd"),
    ("Neither the name of the copyright holder may be used to endorse or promote", "bsd-3-clause"),
    ("You may not use this file except in compliance with the License.", "apache-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("The Software shall be used for Good, not Evil.", "json"),
    ("with LLVM-exception", "llvm-exception"),
    ("As a special exception, the copyright holders give you permission to link", "linking-exception"),
    ("dual licensed", "dual-license"),
    ("3-Clause BSD License", "bsd-3-clause"),
    ("Zero-Clause BSD", "0bsd"),
    ("for academic research purposes only", "research-only"),
    ("Unauthorized copying of this file is strictly prohibited", "proprietary"),
    ("Business Source License 1.1", "busl"),
    # and what is none
    ("the permit licensee of mitten", ""),
    ("gplus one, apache helicopters, a boost of zlibs", ""),
    ("version 2.0 of the report; creative comments on attribution", ""),
    ("permission to be here was granted", ""),
    ("redistribution of income and use of sources", ""),
    ("an exceptional font, a bison, a llama", ""),
)


def test_licenses_examples(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LICENSED)], "doc_id int, text string")
    rows = sorted(licenses.scan(df).collect(), key=lambda r: r.doc_id)
    got = [(LICENSED[r.doc_id][0], ",".join(sorted({d.label for d in r.detections}))) for r in rows]
    assert got == list(LICENSED)
    assert licenses.scan(df.limit(0)).collect() == []


def test_licenses_every_rule(spark):
    """Texts drawn from a rule's regex are detected; the same with every word but the numbers spoilt are not."""
    rng, made = random.Random(4), licenses.rules()
    good = [(i, drawn(r["pattern"], rng)) for i, r in enumerate(made)]
    bad = [(1000 + i, re.sub("[a-z]+", lambda m: m[0] + "q", t)) for i, t in good]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(good + bad, "doc_id int, text string").repartition(4)).collect()}
    assert not [made[i] for i, _ in good if not rows[i].detections]
    assert not [t for i, t in bad if rows[i].detections]
    # suppressed or not, the rule's own label is found where no other rule covers the text
    alone = [i for i, _ in good if {d.ord for d in rows[i].detections} == {i}]
    assert len(alone) > 0.7 * len(made) and all({d.label for d in rows[i].detections} == {made[i]["label"]} for i in alone)


def test_licenses_gate_loses_nothing(spark, monkeypatch):
    rng, made = random.Random(6), licenses.rules()
    texts = ["released under the expat license", "the freebsd license", "spdx license identifier mitlicense", "isclicense"]
    texts += sorted({drawn(r["pattern"], rng) for r in made for _ in range(10)})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(4)
    gated = {r.doc_id: (r.labels, r.score, r.detections) for r in licenses.scan(df).collect()}
    assert all(gated[i][0] for i in range(len(texts)))
    monkeypatch.setattr(licenses, "rules", lambda: [{k: [" "] if k.startswith("keyword") else v for k, v in r.items()} for r in made])
    assert gated == {r.doc_id: (r.labels, r.score, r.detections) for r in licenses.scan(df).collect()}


# ---- packing ----------------------------------------------------------------------------------


def test_encoder_keeps_frequent_words_when_full():
    """Words met in every batch go to the tokenizer once, however many others fill the stores; ids stay the tokenizer's."""
    enc, sent = packing.Encoder(packing.default_tokenizer(), most=60), []
    learn = enc.learn_words
    enc.learn_words = lambda words: (sent.extend(words), learn(words))[1]
    for k in range(20):
        texts = [f"The quick Br\u00fccke, fox; caf\u00e9 n{chr(97 + k)}{chr(97 + i)}x, \u00c9t{chr(97 + k)}{chr(97 + i)}" for i in range(20)]
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    assert all(sent.count(w) == 1 for w in ("the", "quick", "fox", "caf\u00e9", ","))


def test_encoder_equals_tokenizer():
    enc, rng = packing.Encoder(packing.default_tokenizer(), most=500), random.Random(1)
    letters = "aAbİßẞéÉ'sS tT́Å12٣²Ⅳ.,!<|>\x1c ᠎​漢字ﬁΣσς\t\n|"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a<|endoftext|>b c", "don't we'll I'M 'S ''s", None]
    for a in range(0, len(texts), 200):
        assert enc.encode(texts[a : a + 200]) == [enc.plain(t or "") for t in texts[a : a + 200]]


@pytest.mark.parametrize("chunk", [16, 1 << 20])
def test_encoder_cuts_columns(monkeypatch, chunk):
    """Slices, nulls, words longer than a chunk, texts that end without white space, and special tokens in capitals."""
    monkeypatch.setattr(packing, "CHUNK", chunk)
    enc, rng = packing.Encoder(packing.default_tokenizer(), most=40), random.Random(2)
    parts = ["Fox", "fox,", "3a44", " ", "  ", "\n", "\t", "\x1c", "\x7f", "\0", "don't", "'s", "caf\u00e9", "H\u0331x", "\u0130", "<|", "<|ENDOFTEXT|>", "<|endoftext|>", "a<b", "|>", "\u00a0", "\u3000y", "x" * 40]
    texts = [None, "", "a", "b", " ", "<|ENDOFTEXT|> x", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(600))]
    for kind in (pa.string(), pa.large_string()):
        for a in range(0, len(texts), 101):
            got = enc.encode_column(pa.array([None, "skipped", *texts[a : a + 101]], kind)[2:])
            assert got == [enc.plain(t or "") for t in texts[a : a + 101]]
    assert enc.encode_column(pa.array([], pa.string())) == []


def test_worker_memory_of_packing():
    """A worker holds one model, and of many strings no more than its two stores."""
    code = """
import re
from mediaframe.llm import packing
held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
import json, regex, tokenizers, pyarrow, pyarrow.compute
before = held()
enc = packing.Encoder(packing.default_tokenizer(), most=1000)
print(held() - before)
for k in range(20):
    enc.encode([f"q{chr(97 + k)}{i}x, w{chr(97 + k)}y{i}." for i in range(300)])
print(sum(len(x) for x in vars(enc).values() if isinstance(x, dict)))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout.split()
    assert float(out[0]) < 40 and int(out[1]) <= 4000


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_plan(seed):
    rng = random.Random(seed)
    counts = {length: rng.randint(1, 30) for length in rng.sample(range(1, 101), 40)}
    plan, used = packing.best_fit(counts, 100)
    ranks, bins = defaultdict(set), defaultdict(list)
    for length, first, last, each, sequence, base in plan:
        for r in range(first, last):
            assert r not in ranks[length]
            ranks[length].add(r)
            bins[sequence + (r - first) // each].append((base + (r - first) % each * length, length))
    assert {k: len(v) for k, v in ranks.items()} == counts and len(bins) == used
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 100
    lower = -(-sum(k * v for k, v in counts.items()) // 100)
    assert used <= lower * 11 / 9 + 1


def test_packing_rows(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    df = spark.createDataFrame([(1, long, 9), (2, None, 9), (3, "", 9), (4, "a b", 9), (4, "a b", 9), (None, "c", 9)], "doc_id long, text string, length int")
    rows = packing.pack(packing.pieces(df)).collect()
    enc = packing.encoder(packing.default_tokenizer())
    ids = enc.plain(long) + packing.END
    mine = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.length for r in mine] == [2048] * (len(ids) // 8192) + ([len(ids) // 4 % 2048] if len(ids) % 8192 else [])
    assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in mine)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len([r for r in rows if r.doc_id == 4]) == 2 and {r.length for r in rows if r.doc_id in (2, 3)} == {1}
    assert packing.pack(packing.pieces(df.limit(0))).count() == 0


# ---- mixing -----------------------------------------------------------------------------------


def test_targets_and_splits():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    got = mixing.targets([10, 100, 100])
    assert got[0] == 20 and sum(got) == pytest.approx(315) and all(t <= 2 * s for t, s in zip(got, [10, 100, 100], strict=True))
    quota = np.array([5, 0, 1000, 33])
    dealt = mixing.split(quota, 7, 3)
    assert (dealt.sum(axis=0) == quota).all() and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 7 and (dealt == mixing.split(quota, 7, 3)).all()


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = mixing.report(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.report(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows} and all(r.taken <= 2 * r["size"] for r in rows)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, goal, size = Counter(), {}, Counter()
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r["size"]
        goal[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - goal[s]) <= 0.03 * goal[s] for s in goal)
    names = sorted(size)
    assert [goal[s] for s in names] == pytest.approx(mixing.targets([size[s] for s in names]))
    mixed = mixing.mix(docs)
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(taken.values())


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixing_through_the_tree(spark, monkeypatch, broadcast):
    """Sizes, targets and draws recomputed from the rows; each draw is in one shard, shards hold equal numbers of blocks."""
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    size = {i: len(re.findall("[^ \t-\r]+", d.text or "")) for i, d in docs.items()}
    by = Counter()
    for i, d in docs.items():
        by[d.source] += size[i]
    goal, names = {}, sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 4.0 * sum(by.values())
    for _ in range(200):  # the level at which the targets add up to the share
        unit = (low + high) / 2
        goal = {s: min(weight[s] * unit, 2 * by[s]) for s in names}
        low, high = (unit, high) if sum(goal.values()) < 1.5 * sum(by.values()) else (low, unit)
    rows = mixing.report(spark.read.parquet(f"{SF2}/documents.parquet"), shards=8, blocks=64).collect()
    assert {r.doc_id: r["size"] for r in rows} == size and len(rows) == len(docs)
    shards, taken = defaultdict(Counter), Counter()
    for r in rows:
        source = docs[r.doc_id].source
        drawn = [int(x) for x in r.shards.split(",") if x]
        assert r.taken == len(drawn) * size[r.doc_id] and len(drawn) <= 2 and all(0 <= x < 8 for x in drawn)
        assert r.source_size == by[source] and r.target == pytest.approx(goal[source], rel=1e-6)
        taken[source] += r.taken
        for x in drawn:
            shards[x][source] += size[r.doc_id]
    assert all(abs(taken[s] - goal[s]) <= 0.05 * goal[s] for s in names)
    assert sum((c for c in shards.values()), Counter()) == +taken and len(shards) == 8
    words = [sum(c.values()) for c in shards.values()]
    assert max(words) < 1.5 * min(words)
    mixed = mixing.mix(spark.read.parquet(f"{SF2}/documents.parquet"), shards=8, blocks=64)
    got = Counter((r.doc_id, r["__shard"]) for r in mixed.select("doc_id", "__shard").collect())
    assert got == Counter((r.doc_id, int(x)) for r in rows for x in r.shards.split(",") if x)


def test_mixing_with_a_dominant_document(spark):
    """A document too long for what is left is passed over, wherever the order puts it."""
    rows = [(1000 * s, "w " * 1000, f"s{s:02d}") for s in range(12)]
    rows += [(1000 * s + i, "w " * 10, f"s{s:02d}") for s in range(12) for i in range(1, 101)]
    rows += [(12_000 + i, "w " * 100, "s12") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, goal = Counter(), {}
    for r in mixing.report(docs, weights=(1,) * 12 + (400,)).collect():
        taken[r.doc_id // 1000] += r.taken
        goal[r.doc_id // 1000] = r.target
    assert all(goal[s] < 1000 for s in range(12))
    assert all(abs(taken[s] - goal[s]) <= 0.03 * goal[s] for s in goal)


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5), (1, "a b", "s", 5), (2, None, "s", 1), (3, "c d e", None, 2), (4, "x", "\U0001f600", 3), (None, "", "e", 4)], "doc_id long, text string, source string, size int")
    rows = {(r.doc_id, r["size"], r.source_size) for r in mixing.report(df).collect()}
    assert rows == {(1, 2, 4), (2, 0, 4), (3, 3, 3), (4, 1, 1), (None, 0, 0)}
    assert mixing.mixed(df).columns == df.columns
    assert mixing.report(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


# ---- search -----------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 2])
def test_topk_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 8).astype(float).tolist()) for i in range(0, 300)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)] + [(50, rows[50][1]), (301, None), (302, [float("nan")] * 8), (303, [None] * 8), (350, [float("inf")] * 8), (304, [0.5] * 3), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0, block=block).collect())
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    expected = []
    for q, qv in {i: v for i, v in good if i is not None and i % 50 == 0}.items():
        scored = sorted((-int(qv[: len(v)] @ v[: len(qv)]), i is None, i or 0, i) for i, v in good if i != q)
        expected += [(q, k + 1, s[3], -s[0]) for k, s in enumerate(scored[:5])]
    assert got == sorted(expected)


def test_topk_large_components(spark):
    """Products beyond 2^53 are exact, those beyond a long saturate, and the other rows are right."""
    rng = random.Random(3)
    vectors = {i: [rng.uniform(-1, 1) * 10 ** (i % 9) for _ in range(4)] for i in range(200)}
    vectors |= {201: [1e30, 1.0, 0.0, 0.0], 202: [-1e30, 1.0, 0.0, 0.0], 203: [3e15, 1.0, 2.0, 3.0], 204: [3e15, 2.0, 2.0, 3.0], 250: [1e30, 1e20, -1.0, 5.0]}
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()] + [(205, [1e308, 0.0, 0.0, 0.0], "x")], "vec_id long, embedding array<double>, score string").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()}
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors.items()}
    most = 2**63 - 1
    for q in (0, 50, 100, 150, 250):
        scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)
        assert [got[(q, k + 1)] for k in range(5)] == [(i, -s) for s, i in scored[:5]]


@pytest.mark.parametrize("block", [1, 4096])
def test_topk_queries_that_share_an_id(spark, block):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [2.0, 5.0]), (3, [1.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0, k=2, block=block).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted([(50, 1, 1, 3 * 65536), (50, 2, 2, 2 * 65536), (50, 1, 2, 5 * 65536), (50, 2, 3, 4 * 65536)])


def test_topk_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert topk.exact_topk(df, F.col("vec_id") == 0).count() == 2
    clashing = df.selectExpr("*", "1 AS v", "2 AS query_id", "3 AS rank", "4 AS score", "5 AS q")
    assert topk.exact_topk(clashing, F.col("vec_id") == 0).collect() == topk.exact_topk(df, F.col("vec_id") == 0).collect()
    assert topk.exact_topk(df, F.col("vec_id") == 9).count() == 0 and topk.exact_topk(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_topk_equals_sql(spark):
    ours, theirs = both(spark, queries.QUERIES, queries.ORACLES, "op10_exact_topk")
    assert ours == theirs
