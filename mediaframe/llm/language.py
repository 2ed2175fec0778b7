"""Language identification by cross-parsing entropy.

Each language keeps a suffix automaton of some labelled text. A document is parsed greedily against
it: a phrase is the longest match from where the last one ended. The language whose text explains the
document with the fewest phrases wins, phrases being normalised to bits per character by the log of
the labelled text's length. Every character of the labelled text is a class of its own; one that a
language does not know is a phrase by itself. The automata are turned into a table, dense for the most
frequent characters and sorted keys for all others, and whole batches of texts walk all of them at once,
one character a step.

The labelled text is a bounded sample: for each language and each of ``buckets`` hash buckets, a window
of ``window`` characters from the row with the smallest hash; with many languages, as much less of
each as keeps all of them below ``total`` characters. Texts are parsed whole, in stretches of
``stretch`` characters; a stretch starts a phrase, alike in every language.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the language
that sorts first; without labelled text everything is ``und``; rows with null lang or null doc_id
teach nothing; repeated rows are each a row of the result; the empty table gives no rows. Columns beside those
read are kept by keep_known(), whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm.common import aside, held_out, map_rows, read

UND = "und"
DENSE = 128  # classes with a column in the dense table; the transitions of all others are looked up by key
LETTER = re.compile(r"[^\W\d_]")


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton: state 0 accepts every substring of the text."""
    trans: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(trans)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


class Model:
    """Tables of all languages: entry = 2 * next state + whether the character starts a phrase."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        counts: dict[str, int] = {}
        for text in samples.values():
            for c in text:
                counts[c] = counts.get(c, 0) + 1
        known = sorted(counts, key=lambda c: (-counts[c], c))
        self.of = np.zeros(0x110000, np.int32)
        for i, c in enumerate(known):
            self.of[ord(c)] = i + 1
        self.classes_in_all = len(known) + 1
        self.width = min(self.classes_in_all, DENSE)
        tables, firsts, keys, entries, self.roots, self.bits, base = [], [], [], [], [], [], 0
        for lang in self.langs:
            trans = automaton(self.classes(samples[lang]).tolist())
            table = np.full((len(trans), self.width), -1, np.int64)
            first = np.full(self.classes_in_all, 2 * base + 1, np.int64)  # where a character leads that starts a phrase
            for c, to in trans[0].items():
                first[c] = 2 * (to + base) + 1
            for state, out in enumerate(trans[1:], 1):
                for c, to in out.items():
                    if c < self.width:
                        table[state, c] = 2 * (to + base)
                    else:
                        keys.append((state + base) * self.classes_in_all + c)
                        entries.append(2 * (to + base))
            # no state leads to the root, which so stands for being between phrases
            tables.append(np.where(table < 0, first[: self.width], table).astype(np.int32))
            firsts.append(first.astype(np.int32))
            self.roots.append(base)
            self.bits.append(np.log2(max(2, len(samples[lang]))))
            base += len(trans)
        self.table = np.concatenate(tables).ravel()
        self.first = np.stack(firsts)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.entries = np.array(keys, np.int64)[order], np.array(entries, np.int32)[order]

    def classes(self, text: str) -> np.ndarray:
        return self.of[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]

    def rare(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Entries of states (languages x texts) for characters outside the dense table."""
        wanted = state.astype(np.int64) * self.classes_in_all + c
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1) if len(self.keys) else None
        return self.first[:, c] if at is None else np.where(self.keys[at] == wanted, self.entries[at], self.first[:, c])

    def costs(self, texts: list[str], stretch: int) -> np.ndarray:
        """Bits per character of each non-empty text under each language."""
        coded = [self.classes(t) for t in texts]
        parts = [(i, x[a : a + stretch]) for i, x in enumerate(coded) for a in range(0, len(x), stretch)]
        parts.sort(key=lambda p: -len(p[1]))
        sizes = np.array([len(p[1]) for p in parts])
        grid = np.zeros((len(parts), sizes[0]), np.int32)
        for i, (_, x) in enumerate(parts):
            grid[i, : len(x)] = x
        grid = np.ascontiguousarray(grid.T)
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # stretches longer than each step
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(parts), axis=1)
        phrases = np.zeros(state.shape, np.int32)
        for step in range(sizes[0]):
            n = live[step]
            c = grid[step, :n]
            far = np.flatnonzero(c >= self.width)
            entry = self.table.take(state[:, :n] * self.width + np.where(c < self.width, c, 0))
            if len(far):
                entry[:, far] = self.rare(state[:, far], c[far])
            phrases[:, :n] += entry & 1
            state[:, :n] = entry >> 1
        owner = np.array([p[0] for p in parts])
        total = np.stack([np.bincount(owner, row, minlength=len(texts)) for row in phrases], axis=1)
        return total * np.array(self.bits) / np.array([len(x) for x in coded])[:, None]


def fold(text: str) -> str:
    return text.lower()


def samples(docs: DataFrame, buckets: int = 128, window: int = 256, total: int = 1 << 18) -> dict[str, str]:
    """The labelled text that each language is known by."""
    h = F.xxhash64("doc_id", "text")
    at = F.lit(1) + F.pmod(F.xxhash64(F.lit(1), h), F.greatest(F.lit(1), F.length("text") - window))
    # one bounded window per language and bucket: nothing grows with the rows of a language
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & ~held_out())
    rows = known.groupBy("lang", F.pmod(h, F.lit(buckets)).alias("b")).agg(F.min_by(F.col("text").substr(at.cast("int"), F.lit(window)), h).alias("t")).collect()
    parts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.b)):
        parts.setdefault(r.lang, []).append(fold(r.t))
    most = max(1, total // max(1, len(parts)))
    return {k: "\n".join(v)[:most] for k, v in parts.items()}


def train(docs: DataFrame, **bounds: int) -> Model | None:
    """The automata of the samples; bounds as in samples()."""
    known = samples(docs, **bounds)
    return Model(known) if known else None


def classify(docs: DataFrame, keep: list[str], model: Model | None, text: str = "text", stretch: int = 2048, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """keep, lang_pred, score (or other names). score: by how much the winner undercuts the second, from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def go(texts: list) -> tuple:
        pred, score = [UND] * len(texts), [0.0] * len(texts)
        model = held.value
        asked = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if model is None or not asked:
            return pred, score
        cost = model.costs([fold(texts[i]) for i in asked], stretch)
        order = np.argsort(cost, axis=1, kind="stable")
        for i, c, o in zip(asked, cost, order, strict=True):
            pred[i] = model.langs[o[0]]
            score[i] = 1.0 if len(o) == 1 else float(1 - c[o[0]] / c[o[1]])
        return pred, score

    return map_rows(docs, keep, [text], go, f"{names[0]} string, {names[1]} double")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without the rows that are ``und``."""
    docs, renamed = aside(docs, "doc_id", "text", "lang")
    named = classify(docs, docs.columns, train(docs), names=("__lang_pred", "__lang_score"))
    return renamed(named.where(F.col("__lang_pred") != UND))


def op9_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    model = train(docs)
    return classify(docs.withColumn("held_out", held_out()), ["doc_id", "held_out"], model)


QUERIES = {"op9_language_cross_parsing": op9_language_cross_parsing}
ORACLES: dict[str, str] = {}
