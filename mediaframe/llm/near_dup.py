"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification, components.

A text's shingles are runs of five words (all words, if fewer); a shingle weighs what it occurs in the text.
Each shingle is a Poisson process of that rate whose arrivals fall on random registers; a register keeps
the shingle that arrives first. Arrivals are drawn round by round for a whole batch of texts, and a shingle
stops once its next arrival is later than every register of its text, which is the early termination. The
chance that two texts agree in a register is the probability Jaccard similarity of their weights. A text that
repeats shingles has a second sketch in which each weighs 1, so that a copy with one line repeated over and over,
whose weights are mostly that line's, is still met by its set; for all others both sketches are one.

Texts that share a band of registers, of either sketch, are candidates; links are the pairs of which the probability
Jaccard similarity of the weights or the Jaccard similarity of the sets is at least 0.8, computed from
the shingles themselves, told apart by 32 bits of their hashes. Equal texts are one node from the start. In a bucket every text is compared with the bucket's hub, the text that shares most buckets with
most texts; a bucket that is then one component is done, so groups of thousands of copies never make all
their pairs. In the others pairs across components are compared, large buckets by the rare shingles
that linked sets must share, and only links that connect something more leave a task.

Words are runs of letters, digits and marks of any script, lower-cased; in scripts that do not put spaces
between words (Chinese, Japanese, Thai, Lao, Burmese, Khmer, Tibetan) every letter is a word.

Defined cases: null or empty texts and texts without words are classes of their own; equal texts are one
class; repeated rows are each a row of the result; a class is named by its smallest doc_id (null if it
has none); the empty table has no classes; a very long text is hashed whole in one task (some 40 bytes of
memory a character). Columns beside doc_id and text are kept by keep_one(), whatever their names, and left
out by classes(). Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaframe.llm.common import aside, map_rows, materialize, read, release
from mediaframe.operators.components import connected_components

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
BLOCK = 256
ROUNDING = 1e-12  # of sums of doubles
BROADCAST_ROWS = 500_000  # ids of 16 bytes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# The code points of scripts without spaces between words, first and last.
UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x1B000, 0x1B16F), (0x20000, 0x323AF))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The odd base's powers and inverse powers modulo 2^64, n at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@lru_cache
def kinds() -> np.ndarray:
    """For every code point 0 (no part of a word), 1 (part of one) or 2 (a word by itself)."""
    kind = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)], np.int8)
    for a, b in UNSPACED:
        kind[a : b + 1] *= 2
    return kind


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """64-bit hashes of the text's shingles in order, with repeats."""
    b = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.zeros(len(b) + 2, np.int8)
    kind[1:-1] = kinds()[b]
    # a word starts, and the one before ends, where the kind changes and at every letter of kind 2
    now, before = kind[1:], kind[:-1]
    change = (now != before) | (now == 2)
    start, end = np.flatnonzero(change & (now > 0)), np.flatnonzero(change & (before > 0))
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    n = len(word)
    if n < k:
        return mix((word * up[1 : n + 1]).sum(keepdims=True) + np.uint64(n))
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += word[j : n - k + 1 + j] * up[j + 1]
    return mix(out + np.uint64(k))


def prob_minhash(ids: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (texts x m, upper 32 bits of the shingle that arrived first) of a batch of weighted sets."""
    first = np.full(texts * m, np.inf)
    held = np.zeros(texts * m, np.uint32)
    at = np.zeros(len(ids))
    short, step = (ids >> np.uint64(32)).astype(np.uint32), 0
    while len(ids):
        step += 1
        draw = mix(ids + np.uint64(step * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weights
        register = owner * m + (mix(draw) % np.uint64(m)).astype(np.int64)
        early = at < first[register]
        np.minimum.at(first, register[early], at[early])
        won = early & (at == first[register])
        held[register[won]] = short[won]
        go = at < first.reshape(texts, m).max(axis=1)[owner]
        ids, weights, owner, at, short = ids[go], weights[go], owner[go], at[go], short[go]
    return held.reshape(texts, m)


def similarity(a: np.ndarray, x: np.ndarray | None, b: np.ndarray, y: np.ndarray | None) -> float:
    """The larger one of the probability Jaccard similarity of two weighted sets and the Jaccard similarity of the sets.

    a, b: distinct ids; x, y: their weights, None if all are 1. The former is the sum over shared ids s of
    1 / sum over all ids j of max(x_j / x_s, y_j / y_s). Of the two terms the first is the larger one where x_j / y_j is at least
    x_s / y_s, so the inner sums are running sums in the order of these quotients.
    """
    if x is None and y is None:
        n = len(np.intersect1d(a, b, assume_unique=True))
        return n / (len(a) + len(b) - n) if n else 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = (np.ones(len(ids)) if w is None else np.asarray(w, np.float64) for ids, w in ((a, x), (b, y)))
    order = np.argsort(x[i] / y[j], kind="stable")
    xs, ys = x[i][order], y[j][order]
    larger, smaller = x.sum() - np.cumsum(xs) + xs, y.sum() - ys[::-1].cumsum()[::-1]
    return max(len(i) / (len(a) + len(b) - len(i)), float((1 / (larger / xs + smaller / ys)).sum()))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node, sig, weighted: each text's registers for equal weights and for its own, the latter null where
    no shingle is repeated; both null for texts without words."""

    def go(texts: list) -> tuple:
        sets = [np.unique(shingles(t), return_counts=True) for t in texts]
        sizes = np.array([len(s) for s, _ in sets], np.int64)
        if not sizes.sum():
            return [None] * len(texts), [None] * len(texts)
        held = prob_minhash(np.concatenate([s for s, _ in sets]), np.ones(sizes.sum()), np.repeat(np.arange(len(texts)), sizes), len(texts))
        sig, weighted = [row.tobytes() if n else None for row, n in zip(held, sizes, strict=True)], [None] * len(texts)
        again = [i for i, (_, times) in enumerate(sets) if times.max(initial=1) > 1]
        if again:
            held = prob_minhash(*(np.concatenate([sets[i][k] for i in again]) for k in (0, 1)), np.repeat(np.arange(len(again)), sizes[again]), len(again))
            for i, row in zip(again, held, strict=True):
                weighted[i] = row.tobytes()
        return sig, weighted

    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("node"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, ["doc_id", "node"], ["text"], go, "sig binary, weighted binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles, times: the distinct 32-bit shingle hashes of each wanted node, read from one of its documents, and
    how often each occurs; times is null where none is repeated."""

    def go(texts: list) -> tuple:
        sets = [np.unique((shingles(t) >> np.uint64(32)).astype(np.uint32), return_counts=True) for t in texts]
        return [s.view(np.int32) for s, _ in sets], [n.astype(np.int32) if n.max(initial=1) > 1 else None for _, n in sets]

    ids = wanted.select("node", F.col("doc_id").alias("want"))
    small = ids.count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("node"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(ids) if small else ids, "node").where(F.col("doc_id").eqNullSafe(F.col("want")))
    made = map_rows(rows, ["node"], ["text"], go, "shingles array<int>, times array<int>")
    return materialize(made.groupBy("node").agg(F.first(F.struct("shingles", "times")).alias("set")).select("node", "set.*"), "sets")


def _sized(sa: str, ta: str, sb: str, tb: str, similar: float) -> Column:
    """Whether sets could be similar by their sizes alone; weights that differ say nothing about sizes."""
    return F.col(ta).isNotNull() | F.col(tb).isNotNull() | (F.least(F.size(sa), F.size(sb)) >= similar * F.greatest(F.size(sa), F.size(sb)) - ROUNDING)


def verified(docs: DataFrame, pairs: DataFrame, distinct: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) that are links."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = shingle_sets(docs, distinct.select("node", "doc_id").join(ends, "node", "left_semi"))
    one = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("times").alias("tb"))
    two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("times").alias("ta"))

    def rows(lists) -> list:
        ends, values, null = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False), lists.is_null().to_numpy(zero_copy_only=False)
        return [None if gone else values[i:j] for i, j, gone in zip(ends[:-1], ends[1:], null, strict=True)]

    def go(*lists) -> tuple:
        sa, ta, sb, tb = map(rows, lists)
        return (np.array([similarity(*x) for x in zip(sa, ta, sb, tb, strict=True)]),)

    sides = ["sa", "ta", "sb", "tb"]
    found = map_rows(pairs.join(one, "b").join(two, "a").where(_sized("sa", "ta", "sb", "tb", similar)), ["a", "b"], sides, go, "similarity double", raw=sides)
    links = materialize(found.where(F.col("similarity") >= similar - ROUNDING).select("a", "b"), "links")
    release(sets)
    return links


def _shared(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it is small; else it is joined by a shuffle whose large partitions are split."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def hub_pairs(members: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's hub; members: bucket, node, n (the bucket's size)."""
    reach = members.groupBy("node").agg(F.sum("n").alias("reach"))
    hub = materialize(members.join(reach, "node").groupBy("bucket").agg(F.max(F.struct("reach", "node")).alias("hub")), "hubs")
    pairs = members.join(_shared(hub), "bucket").where("node <> hub.node")
    return pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def rare_prefixes(facts: DataFrame, similar: float) -> DataFrame:
    """bucket, node, label, v, h, apt: the rarest shingles of each set, so many that two sets with a link and different labels share one.

    facts: node, label, shingles, times. Shingles that only one label holds are shared by no pair in question; the others
    are put into one order of all, by the number of sets that hold them, the rare ones first. What lies before the first
    shared one is not shared. With p and q the parts of two sets, or of their weights, that are not shared, the Jaccard similarity of the sets is
    (1 - p) (1 - q) / (1 - p q), and the probability Jaccard similarity of the weights that at most: in a term's inner sum
    are p / x_s + q / y_s and the larger one of (1 - p) / x_s and (1 - q) / y_s at least, and the terms then add up to this at most.
    So a set is dealt by a shingle only if p is 1 - ``similar`` at most, once by sets and once by weights, and two rows of a
    bucket can be a link only if each one's v is at most the other's h. By sets v is the size, and h the
    size up to which another one, of which it holds what is left, could be linked; by weights v is p and h the largest q.
    By weights one of the two, apt, must repeat shingles.
    """
    times = F.coalesce(F.get("times", "i"), F.lit(1))
    tokens = facts.select("node", "label", "times", F.posexplode("shingles").alias("i", "token")).select("node", "label", "token", times.alias("x"))
    held_by = tokens.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token", "m")
    held_by = materialize(held_by, "tokens")
    # The commonest go to the tasks as they are, at most one for BLOCK rows; so only rows of rare shingles are joined.
    common = held_by.where(F.col("m") > BLOCK).orderBy(F.desc("m"), "token").limit(BROADCAST_ROWS).toPandas().sort_values("token")
    often, many = common["token"].to_numpy(np.int32), common["m"].to_numpy(np.int64)
    others = held_by.where(F.col("m") <= (int(many.min()) if len(often) == BROADCAST_ROWS else BLOCK))
    seldom = tokens.join(others, "token").groupBy("node").agg(F.collect_list("token").alias("known"), F.collect_list("m").alias("ms"))

    def go(shingles: list, times: list, known: list, ms: list) -> tuple:
        out = []
        for ids, x, k, n_k in zip(shingles, times, known, ms, strict=True):
            ids = np.array(ids, np.int32)
            order = np.argsort(ids)
            ids, x, m = ids[order], np.ones(len(ids), np.int64) if x is None else np.array(x, np.int64)[order], np.zeros(len(ids), np.int64)
            if k:
                m[np.searchsorted(ids, np.array(k, np.int32))] = n_k
            at = np.searchsorted(often, ids)
            at[at == len(often)] = 0
            if len(often):
                m = np.where(often[at] == ids, many[at], m)
            shared = np.flatnonzero(m)
            shared = shared[np.lexsort((ids[shared], m[shared]))]
            n, weight, xs = len(ids), x.sum(), x[shared]
            before = n - len(shared) + np.arange(len(shared))
            p = (weight - xs.sum() + np.cumsum(xs) - xs) / weight
            q = (1 - similar - p) / (1 - p - similar * p)
            reach = (1 + similar) / similar * (n - before) - n
            out.append([{"rule": 0, "token": t, "v": float(n), "h": h} for t, h in zip(ids[shared].tolist(), (reach + 1e-6).tolist(), strict=True) if h >= similar * n])
            out[-1] += [{"rule": 1, "token": t, "v": v, "h": h} for t, v, h in zip(ids[shared].tolist(), p.tolist(), (q + 1e-9).tolist(), strict=True) if v <= 1 - similar + 1e-9]
        return (out,)

    rows = map_rows(facts.join(seldom, "node", "left"), ["node", "label", "repeats"], ["shingles", "times", "known", "ms"], go, "p array<struct<rule: int, token: int, v: double, h: double>>")
    rows = rows.select("node", "label", "repeats", F.inline("p"))
    return rows.select(F.xxhash64("rule", "token").alias("bucket"), "node", "label", "v", "h", (F.col("repeats") | (F.col("rule") == 0)).alias("apt"))


def reachable(rows: DataFrame) -> DataFrame:
    """rows (bucket, node, label, v, h, apt) without those of which aggregates show that their bucket has no partner of another label.

    A bucket's smallest label, mostly that of its largest component, is told from all others.
    """
    per = materialize(rows.groupBy("bucket", "label").agg(F.min("v").alias("v"), F.max("h").alias("h"), F.max("apt").alias("apt")), "reach")
    whole = per.groupBy("bucket").agg(F.min("label").alias("one"), F.max("label").alias("last"), F.min("v").alias("v_all"), F.max("h").alias("h_all"), F.max("apt").alias("apt_all")).where("one <> last and apt_all")
    rest = per.join(whole, "bucket").where("label <> one").groupBy("bucket").agg(F.first("one").alias("one"), F.first("v_all").alias("v_all"), F.first("h_all").alias("h_all"), F.min("v").alias("v_rest"), F.max("h").alias("h_rest"))
    mine = F.col("label") == F.col("one")
    kept = rows.join(rest, "bucket").where((F.when(mine, F.col("v_rest")).otherwise(F.col("v_all")) <= F.col("h")) & (F.col("v") <= F.when(mine, F.col("h_rest")).otherwise(F.col("h_all"))))
    return materialize(kept.select(*rows.columns), "rare")


def _split(rows: DataFrame) -> DataFrame:
    """rows (bucket, label, ...) of the buckets in which several components meet."""
    return rows.join(rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket"), "bucket")


def cross_links(docs: DataFrame, members: DataFrame, labels: DataFrame, distinct: DataFrame, similar: float) -> DataFrame:
    """Links between the components that still meet in a bucket of more than two texts.

    The members of a bucket of up to BLOCK texts are compared in one task, sets and all. Those of larger
    buckets are dealt out anew by their rarest shingles, one of which any two linked sets share, as far as sizes and
    parts that are not shared leave a partner possible; where even such a shingle is left in more than BLOCK
    of them, its holders are dealt to blocks and every two blocks
    are compared in one task. A pair is compared unless its ends are connected already, and of the links
    only those that connect something more leave the task: fewer rows than texts in it.
    """
    rows = members.where("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = materialize(_split(rows).select("bucket", "band", "node", "n", "label"), "unresolved")
    wanted = distinct.join(rows.select("node").distinct(), "node", "left_semi")
    facts = materialize(wanted.select("node", "sig").join(shingle_sets(docs, wanted.select("node", "doc_id")), "node"), "facts")
    large = rows.where(F.col("n") > BLOCK).select("node", "label").distinct()
    rows = rows.where(F.col("n") <= BLOCK).withColumns({"v": F.lit(0.0), "h": F.lit(0.0)})
    if large.limit(1).count():
        rare = rare_prefixes(facts.join(large, "node").withColumn("repeats", F.col("times").isNotNull()), similar)
        dealt = materialize(_split(reachable(reachable(materialize(rare, "dealt")))), "rare")
        dealt = dealt.join(dealt.groupBy("bucket").agg(F.count("*").alias("n")), "bucket").withColumn("band", F.lit(0))
        rows = rows.unionByName(dealt.select(*rows.columns))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), "node"), blocks).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", "band", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "node", "label", "v", "h").join(facts, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
        node, mine, sets, times = pdf["node"].to_numpy(), pdf["mine"].to_numpy(), pdf["shingles"].tolist(), pdf["times"].tolist()
        weighted = np.array([t is not None for t in times])
        size, band = np.array([len(s) for s in sets]), int(pdf["band"].iloc[0])
        v, h = pdf["v"].to_numpy(), pdf["h"].to_numpy()
        comp = pdf["label"].to_numpy().copy()  # changes as links are found
        left, right = np.flatnonzero(mine == pdf["p"].iloc[0]), np.flatnonzero(mine == pdf["q"].iloc[0])
        found = []
        for i in left:
            equal = sig[right] == sig[i]
            met = equal.reshape(len(right), -1, ROWS).all(axis=2)
            ok = ~met[:, :band].any(axis=1) & (comp[right] != comp[i]) & (v[right] <= h[i]) & (h[right] >= v[i])
            ok &= weighted[right] | weighted[i] | (np.minimum(size[right], size[i]) >= similar * np.maximum(size[right], size[i]) - ROUNDING)
            for j in right[ok]:
                if comp[i] != comp[j] and similarity(sets[i], times[i], sets[j], times[j]) >= similar - ROUNDING:
                    found.append((node[i], node[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return materialize(rows.groupBy("bucket", "p", "q").applyInPandas(compare, "a long, b long"), "cross-links")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, node, label, class_id, class_size, one row per document; class_id is the smallest doc_id of those with a label."""
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs), "signatures")
    distinct = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("sig", "weighted")).alias("s")).select("node", "doc_id", "s.*").where("sig is not null"), "distinct")
    bands = [F.array(*(F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring(c, 4 * ROWS * i + 1, 4 * ROWS)).alias("bucket")) for i in range(BANDS))) for c in ("sig", "weighted")]
    dealt = distinct.select("node", F.inline(F.when(F.col("weighted").isNull(), bands[0]).otherwise(F.array_union(*bands))))
    sizes = materialize(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members = materialize(dealt.join(_shared(sizes), "bucket"), "members")
    release(sizes)

    pairs = materialize(hub_pairs(members), "pairs")
    links = verified(docs, pairs, distinct, similar)
    labels = connected_components(links)
    extra = cross_links(docs, members, labels, distinct, similar)
    if extra.limit(1).count():
        labels = connected_components(links.unionByName(extra))

    # Texts without words keep to themselves: they have no node.
    named = signed.select("doc_id", F.when(F.col("sig").isNotNull(), F.col("node")).alias("node")).join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    groups = _shared(materialize(groups, "classes"))  # written, so that the join below is free to split the rows of a large class
    return named.join(groups, "label", "left").select("doc_id", "node", "label", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs without all but one row of each class: of the rows with its smallest doc_id one with the smallest node."""
    docs, renamed = aside(docs, "doc_id", "text")
    named = materialize(classes(docs, similar), "classes")
    several, first = F.col("class_size") > 1, F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = named.where(several & ~first).select("doc_id", "node")
    # classes in which several rows have the smallest doc_id, or all of them none
    again = materialize(named.where(several & first).groupBy("label").agg(F.first("doc_id").alias("__id"), F.min("node").alias("__stay"), F.count("*").alias("n")).where("n > 1"), "again")
    repeats = again.limit(1).count() > 0
    if repeats:
        gone = gone.unionByName(named.where(several & first).join(_shared(again), "label").where("node <> __stay").select("doc_id", "node"))
    gone = materialize(gone.distinct().select(F.col("doc_id").alias("__id"), F.col("node").alias("__gone")), "gone")
    rows = docs.withColumn("__node", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = rows.join(_shared(gone), (F.col("__node") == F.col("__gone")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    if repeats:
        twice = again.select("__id", "__stay")
        marked = rows.join(_shared(twice), (F.col("__node") == F.col("__stay")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
        rows = marked.where("__stay is null").unionByName(marked.where("__stay is not null").dropDuplicates(["doc_id", "__node"]))
    return renamed(rows)


def op8_probminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents", ["doc_id", "text"])).select("doc_id", "class_id", "class_size")


QUERIES = {"op8_probminhash_near_dup": op8_probminhash_near_dup}
ORACLES: dict[str, str] = {}
