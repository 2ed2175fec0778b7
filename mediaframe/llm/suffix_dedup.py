"""Removal of repeated passages by distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else. Three parts:

1. Prefilter. The anchor of a window of ``length`` bytes is its ``SEED``-byte string with the smallest
   hash (the leftmost of equal ones). Equal windows have equal anchors at equal distance; windows whose
   anchor's seed is unique in the corpus are unique. The windows of one anchor are a run. Runs that span
   equal bytes stand for each other: if there are several, all their windows repeat, and one of them goes on
   as witness where other runs hold the same seed. Hash values decide here only what is looked at.
2. Prefix doubling over the runs that are left, at their positions on a grid counted from the anchor, a
   fifth of ``length`` apart, so that equal windows meet on equal grids. Spark sorts the strings between
   grid positions and ranks them; then pairs of ranks (rank[i], rank[i + offset]) are sorted and ranked
   again, at offsets of 1, 2 and again 2 grid steps. Strings of one, two, four and six steps are so
   ranked. A position goes when its rank is unique: none of the windows that hold its string repeats.
   Six steps are past the threshold: where such a string repeats, so do the windows inside it.
3. Where four steps repeat and six do not, a window is the rank of the four steps it holds and the
   fifth of its bytes around them. Spark counts these pairs.

The strings and the bytes around them are compared themselves, not hashes of them; equal spans and equal
texts are told by 128-bit digests. Rows are never gathered by what they hold: counts are combined before
the shuffle and joined back, so a passage that a third of all documents share is dealt out like any other.

Defined cases: null text is empty; texts shorter than ``length`` stay whole; in equal texts of at least
``length`` bytes everything repeats; repeated rows are copies; a very long text is hashed whole in one task
(some 60 bytes of memory a byte of text within a stretch of 4 MB, 30 beyond); extra columns are kept by
rewrite() and left out by report().
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm.common import aside, map_rows, materialize, nested, read, release
from mediaframe.llm.near_dup import mix, powers

LENGTH = 200
SEED = 32
PARTS = 5  # grid steps a window spans
STRETCH = 1 << 22  # windows handled at once; positions within it fit the low bits of a packed minimum
LOW = np.uint64((1 << 23) - 1)
BROADCAST_KEYS = 2_000_000  # 8-byte names handed to every worker; beyond that they are joined instead
BROADCAST_IDS = 500_000


class Names:
    """Hashes of any substring of a text, from one pass of running sums. They choose anchors and name seeds."""

    def __init__(self, raw: bytes):
        b = np.frombuffer(raw, np.uint8)
        self.n = len(b)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def runs(names: Names, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(seed name, anchor, first window, past the last window) of the runs of windows with one anchor."""
    span = length - seed + 1
    out = []
    for base in range(0, names.n - length + 1, STRETCH):
        windows = min(STRETCH, names.n - length + 1 - base)
        at = np.arange(base, base + windows + span - 1)
        h = names.of(at, at + seed)
        blocks = -(-len(h) // span)
        packed = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
        packed[: len(h)] = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        grid = packed.reshape(blocks, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        anchor = (least[first] & LOW).astype(np.int64)
        out.append((h[anchor], anchor + base, first + base, np.r_[first[1:], windows] + base))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _joined(parts: list, kind=np.int64) -> np.ndarray:
    """Arrays one after the other, as signed numbers."""
    return np.concatenate([np.asarray(x).view(kind) for x in parts]) if parts else np.zeros(0, kind)


def _asked(rows, *columns: str) -> list[tuple]:
    """The structs of each row's list as arrays, one per column."""
    flat, ends = rows.values, rows.offsets.to_numpy()
    got = [flat.field(c).to_numpy(zero_copy_only=False) for c in columns]
    return [tuple(x[a:b] for x in got) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _raw(text: str | None) -> bytes:
    return (text or "").encode()


def _node(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_node().alias("node"), F.col("text").cast("string").alias("text"))


def repeated_seeds(docs: DataFrame, length: int) -> DataFrame:
    """key: the seed names that anchor more than one run."""

    def go(texts: list) -> tuple:
        found = [runs(Names(_raw(t)), length)[0] for t in texts]
        return (nested([len(x) for x in found], key=_joined(found)),)

    keys = map_rows(_texts(docs), [], ["text"], go, "k array<struct<key: long>>").select(F.inline("k"))
    return materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "seeds")


def repeated_runs(docs: DataFrame, seeds: DataFrame, length: int) -> DataFrame:
    """node, key, one, two, anchor, first, last, n: the runs at repeated seeds of the different texts.

    one and two are a digest of the bytes that the run spans, n the number of copies of the text.
    """
    few = seeds.count() <= BROADCAST_KEYS
    held = docs.sparkSession.sparkContext.broadcast(np.sort(seeds.toArrow()["key"].to_numpy()) if few else None)

    def go(texts: list) -> tuple:
        out, known = [], held.value
        for t in texts:
            raw = _raw(t)
            key, anchor, first, last = runs(Names(raw), length)
            if known is not None and len(key):
                at = np.minimum(np.searchsorted(known, key.view(np.int64)), len(known) - 1) if len(known) else None
                ok = known[at] == key.view(np.int64) if at is not None else np.zeros(len(key), bool)
                key, anchor, first, last = key[ok], anchor[ok], first[ok], last[ok]
            spans = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last - 1 + length).tolist(), strict=True))
            one, two = np.frombuffer(spans, np.int64).reshape(-1, 2).T
            out.append((key, one, two, anchor, first, last))
        cols = [_joined([x[i] for x in out]) for i in range(6)]
        return (nested([len(x[0]) for x in out], **dict(zip(("key", "one", "two", "anchor", "first", "last"), cols, strict=True))),)

    made = map_rows(_texts(docs), ["node"], ["text"], go, "r array<struct<key: long, one: long, two: long, anchor: long, first: long, last: long>>").select("node", F.inline("r"))
    # copies of a text bring the same rows; one of each is enough, with its count
    made = made if few else made.join(seeds, "key")
    return materialize(made.groupBy("node", "key", "one", "two", "anchor", "first", "last").agg(F.count("*").alias("n")), "runs")


def _copies(rows: DataFrame) -> DataFrame:
    """rows with ``again`` (the span of the run occurs again) and ``open`` (it does not, or it is the one
    witness of such a span at a seed that stands in single spans too)."""
    span, id64 = ["key", "one", "two"], F.xxhash64("node", "first")
    counts = materialize(rows.groupBy(*span).agg(F.sum("n").alias("c"), F.min(id64).alias("witness")), "counts")
    single = counts.groupBy("key").agg(F.max((F.col("c") == 1).cast("int")).alias("single")).where("single = 1").select("key", F.lit(True).alias("mixed"))
    again = F.col("c") > 1
    joined = rows.join(counts, span).join(materialize(single, "mixed"), "key", "left")
    return joined.select("node", "anchor", "first", "last", again.alias("again"), (F.col("mixed").isNotNull() & (~again | (F.col("witness") == id64))).alias("open"))


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (node, ...), one row per node, next to the node's text; copies of a text give one row."""
    ids = wanted.select("node")
    few = ids.count() <= BROADCAST_IDS
    texts = _texts(docs)
    texts = texts.join(F.broadcast(ids), "node", "left_semi") if few else texts
    return texts.dropDuplicates(["node"]).join(wanted, "node")


def _spans(docs: DataFrame, todo: DataFrame, length: int) -> DataFrame:
    """id, node, first, last, grid, cells, low, bytes: what the open runs span, from one grid step before.

    A cell is a grid position and the windows that start less than a step before it or at it; grid is the
    position of the first of the cells, low that of the first of the bytes.
    """
    import pyarrow as pa

    step = length // PARTS

    def go(texts: list, asked) -> tuple:
        out, spans = [], []
        for t, (anchor, first, last) in zip(texts, _asked(asked, "anchor", "first", "last"), strict=True):
            raw = _raw(t)
            grid = anchor - (anchor - first) // step * step
            final = anchor - (anchor - (last - 1)) // step * step
            low, end = np.maximum(grid - step, 0), np.minimum(final + length, len(raw))
            spans += [raw[a:b] for a, b in zip(low.tolist(), end.tolist(), strict=True)]
            out.append((first, last, grid, (final - grid) // step + 1, low))
        cols = {c: _joined([x[i] for x in out]) for i, c in enumerate(("first", "last", "grid", "cells", "low"))}
        return (nested([len(x[0]) for x in out], **cols, bytes=pa.array(spans, pa.binary())),)

    grouped = todo.groupBy("node").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("rows"))
    made = map_rows(_with_text(docs, grouped), ["node"], ["text", "rows"], go, "s array<struct<first: long, last: long, grid: long, cells: long, low: long, bytes: binary>>", raw=["rows"])
    return materialize(made.select("node", F.inline("s")).withColumn("id", F.monotonically_increasing_id()), "spans")


def _ranked(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """id, j, rank of the rows whose key occurs more than once; ranks are in the order of the sorted keys."""
    classes = rows.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1").select(*key)
    ranks = materialize(classes.orderBy(*key).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    out = materialize(rows.join(ranks, key).select("id", "j", "rank"), name)
    release(ranks)
    return out


def _paired(ranks: DataFrame, offset: int) -> DataFrame:
    """id, j, a, b: the rank at j and the rank at j + offset, where both are left."""
    held = ranks.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("j", "rank"))).alias("held"))
    both = F.filter(F.transform(F.map_entries("held"), lambda e: F.struct(e["key"].alias("j"), e["value"].alias("a"), F.col("held")[e["key"] + offset].alias("b"))), lambda e: e["b"].isNotNull())
    return held.select("id", F.inline(both))


def _doubled(spans: DataFrame, length: int) -> DataFrame:
    """node, first, last, mask: the windows of the spans that start elsewhere too.

    mask 0: all windows from first on and before last; else bit d is the window d bytes before first.
    """
    step = length // PARTS
    slot = F.explode(F.sequence(F.lit(-1), F.col("cells").cast("int") + PARTS - 2)).alias("j")
    at = F.col("grid") + F.col("j") * step - F.col("low")
    base = spans.select("id", "grid", "low", "bytes", slot).where((at >= 0) & (at + step <= F.octet_length("bytes")))
    one = _ranked(base.select("id", "j", F.substring("bytes", (at + 1).cast("int"), F.lit(step)).alias("x")), ["x"], "ranks-1")
    two = _ranked(_paired(one, 1), ["a", "b"], "ranks-2")
    four = _ranked(_paired(two, 2), ["a", "b"], "ranks-4")
    release(one, two)

    # Six steps from the one before a cell on hold all its windows. Runs may share grid positions, so a
    # string repeats only if it stands at two places. Of the cells with equal strings and equal windows one
    # stays as witness for windows that are equal though the strings around them are not.
    facts = spans.select("id", "node", "first", "last", "grid", "cells")
    cell = F.col("grid") + F.col("j") * step
    begin, end = F.greatest(F.col("first"), cell - step + 1), F.least(F.col("last"), cell + 1)
    six = _paired(four, 2).withColumn("j", F.col("j") + 1).join(facts, "id").where("0 <= j and j < cells")
    six = materialize(six.select("id", "j", "a", "b", (cell - begin).alias("most"), (cell - end).alias("least"), F.xxhash64("node", cell).alias("place")).where("least < most"), "pairs-6")
    same = materialize(six.groupBy("a", "b", "most", "least").agg(F.min("place").alias("x"), F.max("place").alias("y"), F.min("id").alias("witness")), "same-6")
    past = same.groupBy("a", "b").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").select("a", "b")
    past = same.join(past, ["a", "b"]).select("a", "b", "most", "least", "witness")
    past = materialize(six.join(past, ["a", "b", "most", "least"]).select("id", "j", (F.col("id") == F.col("witness")).alias("witness")), "past")
    cells = four.join(past, ["id", "j"], "left").join(facts, "id").where("0 <= j and j < cells")
    cells = cells.select("id", "j", "rank", "node", cell.alias("cell"), begin.alias("first"), end.alias("last"), F.col("witness").isNotNull().alias("past"), F.coalesce("witness", F.lit(True)).alias("asked")).where("first < last")
    cells = materialize(cells, "cells")
    release(four, six, same, past)

    left = materialize(cells.where("not past").select("rank").distinct(), "left")
    asked = cells.where("asked").join(left, "rank", "left_semi").join(spans.select("id", "low", "bytes"), "id")
    before = F.explode(F.sequence((F.col("cell") - F.col("last") + 1).cast("int"), (F.col("cell") - F.col("first")).cast("int"))).alias("d")
    windows = asked.select("id", "j", "rank", "cell", "low", "bytes", before)
    within = (F.col("cell") - F.col("low")).cast("int")
    around = F.concat(F.substring("bytes", within - F.col("d") + 1, F.col("d")), F.substring("bytes", within + (PARTS - 1) * step + 1, F.lit(step) - F.col("d")))
    windows = windows.select("id", "j", "rank", "d", around.alias("around"))
    twice = materialize(windows.groupBy("rank", "d", "around").agg(F.count("*").alias("m")).where("m > 1").drop("m"), "twice")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("d"))
    masks = windows.join(twice, ["rank", "d", "around"]).groupBy("id", "j").agg(F.bit_or(bit).alias("mask"))
    masks = cells.where("not past").select("id", "j", "node", "cell").join(masks, ["id", "j"])
    return cells.where("past").select("node", "first", "last", F.lit(0).cast("long").alias("mask")).unionByName(masks.select("node", F.col("cell").alias("first"), F.col("cell").alias("last"), "mask"))


def repeated_stretches(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """node, first, last, mask: windows that start elsewhere too, as _doubled() has them."""
    if length % PARTS or not SEED <= length <= 60 * PARTS:
        raise ValueError(f"length must be a multiple of {PARTS} from {SEED} to {60 * PARTS}")
    docs = docs.select("text")
    seeds = repeated_seeds(docs, length)
    rows = repeated_runs(docs, seeds, length)
    release(seeds)
    found = materialize(_copies(rows), "found-runs")
    release(rows)
    spans = _spans(docs, found.where("open").select("node", "anchor", "first", "last"), length)
    return found.where("again").select("node", "first", "last", F.lit(0).cast("long").alias("mask")).unionByName(_doubled(spans, length))


def windows_of(first: np.ndarray, last: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of stretches of windows, sorted by first; masks become windows of their own."""
    plain = mask == 0
    row, d = np.nonzero((mask[~plain, None] >> np.arange(63)) & 1)
    single = first[~plain][row] - d
    begin, end = np.concatenate([first[plain], single]), np.concatenate([last[plain], single + 1])
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order]


def cut(raw: bytes, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, maximal removed runs) for stretches of windows sorted by first."""
    if not len(first):
        return raw, 0, 0
    reach = np.maximum.accumulate(last - 1 + length)
    new = np.flatnonzero(np.r_[True, first[1:] > reach[:-1]])
    begin, end = first[new], reach[np.r_[new[1:] - 1, len(first) - 1]]
    kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True))
    return kept, int((end - begin).sum()), len(new)


def apply(docs: DataFrame, keep: list[str], schema: str, fn, length: int = LENGTH) -> DataFrame:
    """Columns to keep, then those that fn(text, first, last) makes, for every row of docs."""
    cuts = materialize(repeated_stretches(docs, length).groupBy("node").agg(F.collect_list(F.struct("first", "last", "mask")).alias("cuts")), "cuts")
    held = cuts.select(F.col("node").alias("__node"), F.col("cuts").alias("__cuts"))
    rows = docs.withColumn("__node", _node())
    ids = cuts.select(F.col("node").alias("__node"))
    none = F.array().cast(held.schema["__cuts"].dataType)
    if ids.count() <= BROADCAST_IDS:  # texts that stay whole need no shuffle
        whole = rows.join(F.broadcast(ids), "__node", "left_anti").withColumn("__cuts", none)
        rows = rows.join(F.broadcast(ids), "__node", "left_semi").join(held, "__node").unionByName(whole)
    else:
        rows = rows.join(held, "__node", "left").withColumn("__cuts", F.coalesce("__cuts", none))

    def go(texts: list, cuts) -> list:
        made = [fn(t, *windows_of(*x)) for t, x in zip(texts, _asked(cuts, "first", "last", "mask"), strict=True)]
        return list(zip(*made, strict=True)) or [[]] * len(schema.split(", "))

    return map_rows(rows, keep, ["text", "__cuts"], go, schema, raw=["__cuts"])


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def one(text: str | None, first: np.ndarray, last: np.ndarray) -> tuple:
        raw = _raw(text)
        kept, gone, spans = cut(raw, first, last, length)
        return len(raw), gone, spans, hashlib.sha256(kept).hexdigest()

    return apply(docs.select("doc_id", "text"), ["doc_id"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", one, length)


def rewrite(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated passages cut out of text; n_chars, where there is one, counts what is left.

    A cut may fall inside a character; its remaining bytes are dropped.
    """

    def one(text: str | None, first: np.ndarray, last: np.ndarray) -> tuple:
        kept = None if text is None else cut(_raw(text), first, last, length)[0].decode("utf-8", "ignore")
        return kept, len(kept or "")

    docs, renamed = aside(docs, "text", "n_chars")
    others = [c for c in docs.columns if c != "text"]
    out = apply(docs, others, "__kept string, __chars long", one, length).withColumnRenamed("__kept", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.col("__chars").cast(docs.schema["n_chars"].dataType))
    return renamed(out)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents", ["doc_id", "text"]))


QUERIES = {"op4_suffix_array_dedup": op4_suffix_array_dedup}
ORACLES: dict[str, str] = {}
