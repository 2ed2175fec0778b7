"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct character n-grams (lower-cased, framed by two marks), hashed into
2^18 slots. From labelled texts come the smoothed log-count ratio r of each slot; the slots with the
largest |r| * sqrt(document frequency) are kept, scaled by r, and weighed by logistic regression with
both classes counting half. Scores are the logistic of the weighted sum over the whole text.

The classifier is fitted on a bounded sample: of each class the row with the smallest hash in each of
``per_class`` hash buckets, texts of at most ``longest`` characters. Scoring covers every text.

Defined cases: null or empty text is scored like any other (its two marks make no known n-gram, so the
score is the bias); a document with several labels is toxic if one says so; without rows of both
classes every score is 0; a null doc_id is held out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm.common import held_out, map_rows, read

SLOTS = 1 << 18
SHORT, LONG = 3, 6
THRESHOLD = 0.7


def ngrams(text: str | None) -> np.ndarray:
    """Slots of the text's n-grams, with repeats."""
    code = np.frombuffer(("\x02" + (text or "").lower() + "\x03").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    rolled, out = code, []
    for n in range(2, LONG + 1):
        if len(code) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n >= SHORT:
            x = (rolled + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            out.append(((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def fit(texts: list[str], toxic: list[int], features: int = 2000, penalty: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(place of each slot among the kept features or -1, weights, bias); None without both classes."""
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return None
    rows = [np.unique(ngrams(t)) for t in texts]
    count = np.ones((2, SLOTS))
    for x, label in zip(rows, toxic, strict=True):
        count[int(label), x] += 1
    of = np.array([(y == 0).sum(), (y == 1).sum()], float)
    ratio = np.log(count[1] / (of[1] + 2)) - np.log(count[0] / (of[0] + 2))
    kept = np.argsort(-np.abs(ratio) * np.sqrt(count.sum(axis=0) - 2), kind="stable")[:features]
    place = np.full(SLOTS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    scale = ratio[kept]

    cols = [(p := place[x])[p >= 0] for x in rows]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    col = np.concatenate(cols)
    share = np.where(y > 0, 0.5 / of[1], 0.5 / of[0])
    w = np.zeros(len(kept) + 1)  # the bias last
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, (w[:-1] * scale)[col], minlength=len(y)) + w[-1]
        miss = (_logistic(z) - y) * share
        g = np.append(np.bincount(col, miss[row], minlength=len(kept)) * scale + penalty * w[:-1], miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return place, w[:-1] * scale, float(w[-1])


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int) -> tuple[list[str], list[int]]:
    """At most 2 * per_class labelled texts, none of a held-out document."""
    h = F.xxhash64("doc_id")
    # one short document per class and hash bucket; the aggregate is at most 2 * per_class rows
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    fits = docs.where(F.length("text") <= longest).select("doc_id")
    picked = known.join(fits, "doc_id", "left_semi").groupBy("toxic", F.pmod(h, F.lit(per_class)).alias("bucket")).agg(F.min_by("doc_id", h).alias("doc_id"))
    texts = docs.where(F.length("text") <= longest).join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    rows = sorted(texts.collect(), key=lambda r: r.doc_id)
    return [r.text for r in rows], [int(r.toxic > 0) for r in rows]


def score(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 16384, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labels = labels.select("doc_id", "toxic")
    held = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, per_class, longest)))

    def go(texts: list) -> tuple:
        if held.value is None:
            return [0.0] * len(texts), [0] * len(texts)
        place, w, bias = held.value
        out = [float(_logistic(w[np.unique(p[p >= 0])].sum() + bias)) for p in (place[ngrams(t)] for t in texts)]
        return out, [int(x >= threshold) for x in out]

    return map_rows(docs.withColumn("held_out", held_out()), ["doc_id", "held_out"], ["text"], go, "score double, predicted int")


def op1_toxicity_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op1_toxicity_nb_ngrams": op1_toxicity_nb_ngrams}
ORACLES: dict[str, str] = {}
