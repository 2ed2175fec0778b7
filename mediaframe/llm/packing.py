"""Best-fit packing planned on a histogram of lengths.

Documents become token pieces of at most ``capacity``. Only the number of pieces of each length, at
most ``capacity`` numbers, reaches the driver, where best-fit decreasing runs over counts: bins that
look alike are one group, and placing a length touches whole groups. The plan says which ranks within
a length go to which sequences; pieces then take their slots by joining on that rank. Ranks come from
two levels (dealt bucket, place in bucket), so a length that many pieces share is never one task's.

Defined cases: null or empty text is the closing id 0 alone; repeated rows are packed as often as they
stand; an empty table packs to an empty table; null doc_id stays null.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaframe.llm.common import KEPT, map_rows, materialize, read

CAPACITY = 2048
END = b"\0\0\0\0"
SPACE = re.compile(r"[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # white space beside the plain one
CHUNK = 1 << 20  # bytes that are cut into words at once
BLANK, LETTER, DIGIT, OTHER, WHOLE = range(5)  # what a byte is; stretches with one of the last kind are not cut here


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[*range(9, 14), 32]] = BLANK
    kinds[[*range(65, 91), *range(97, 123)]] = LETTER
    kinds[48:58] = DIGIT
    kinds[[39, *range(128, 256)]] = WHOLE  # the tokenizer has patterns that begin with an apostrophe
    return kinds


KINDS = _kinds()


class Encoder:
    """Ids as little-endian 32-bit bytes, by way of what is already known.

    The tokenizer treats words between white space alone. Stretches of plain ASCII are cut into its words by the
    kinds of their bytes, others are known whole; Arrow tells equal ones of a column apart, so each is looked up once. A full store becomes
    an older one, from which only what is met again is taken over, so frequent words are never learned anew. Unknown
    words go to the tokenizer many at a time, and its ids are cut where a word's last token ends.
    """

    def __init__(self, path: str, most: int = 300_000):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.most = Tokenizer.from_file(path), most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        # for words that are folded and cut already, those of printable ASCII even more so; one model serves all
        self.bare, self.letters = Tokenizer(self.tok.model), Tokenizer(self.tok.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        self.fold = self.tok.normalizer.normalize_str
        self.word = regex.compile(json.loads(self.tok.pre_tokenizer.__getstate__())["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.opening = {t.encode()[:2].lower() for t in self.special}
        suffix = self.tok.model.end_of_word_suffix
        self.ends = np.array([self.tok.id_to_token(i).endswith(suffix) for i in range(self.tok.get_vocab_size())])
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_words(self, words: list[str]) -> None:
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            text = " ".join(part)
            tok = self.letters if text.isascii() and text.isprintable() else self.bare
            ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            # words are folded already; only what is not ASCII could be changed by that once more
            if len(cuts) == len(part) and (text.isascii() or self.fold(text) == text):
                raw, at = ids.tobytes(), 0
                for word, cut in zip(part, (cuts * 4).tolist(), strict=True):
                    self.known[word], at = raw[at:cut], cut
            else:
                self.known.update((w, self.plain(w)) for w in part)

    def learn(self, strings: list[str]) -> None:
        """Words of ASCII letters, folded, and stretches that may hold several words; neither store has them."""
        words = [s for s in strings if s.isascii() and s.isalpha()]
        stretches, odd = [s for s in strings if not (s.isascii() and s.isalpha())], []
        text = " ".join(stretches)
        if any(x in text for x in self.special) or not text.isascii() and SPACE.search(text):
            odd = [s for s in stretches if SPACE.search(s) or any(x in s for x in self.special)]
            stretches = list(set(stretches).difference(odd))
        folded = self.fold(" ".join(stretches)).split(" ") if stretches else []
        if len(folded) != len(stretches):
            odd, stretches, folded = odd + stretches, [], []
        cut = [self.word.findall(x) for x in folded]
        more = set().union(*cut).difference(words, self.known)
        again = more & self.old.keys()
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        self.learn_words(words)
        self.learn_words(sorted(more - again, key=str.isascii))
        of = self.known
        for s, ws in zip(stretches, cut, strict=True):
            of[s] = of[ws[0]] if len(ws) == 1 else b"".join([of[w] for w in ws])
        for s in odd:
            of[s] = self.plain(s)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        import pyarrow as pa

        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow column; null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return []
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = memoryview(data)[: bounds[-1]] if data else memoryview(b"")
        made: list[list[bytes]] = [[] for _ in range(len(texts))]
        at, end = int(bounds[0]), int(bounds[-1])
        collects = gc.isenabled()
        gc.disable()  # no cycles are made here, and each look for them passes all words
        try:
            while at < end:
                stop = self.stop(whole, at, end, bounds)
                i, j = int(np.searchsorted(bounds, at, "right")) - 1, int(np.searchsorted(bounds, stop, "left"))
                ids, ends = self.chunk(whole[at:stop], np.minimum(bounds[i + 1 : j + 1], stop) - at)
                a = 0
                for k, b in enumerate((ends * 4).tolist(), i):
                    if b > a:
                        made[k].append(ids[a:b])
                    a = b
                at = stop
        finally:
            if collects:
                gc.enable()
        return [x[0] if len(x) == 1 else b"".join(x) for x in made]

    @staticmethod
    def stop(whole: memoryview, at: int, end: int, bounds: np.ndarray) -> int:
        """Where a chunk from at on ends: behind a space or a text, however long a word is."""
        if end - at <= CHUNK:
            return end
        size = CHUNK
        while at + size < end:
            space = bytes(whole[at : at + size]).rfind(b" ")
            text = int(bounds[np.searchsorted(bounds, at + size, "right") - 1])
            if space >= 0 or text > at:
                return max(at + space + 1, text)
            size *= 2
        return end

    def chunk(self, raw: memoryview, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of texts that lie one after the other, and how many there are up to each text's end."""
        import pyarrow as pa

        given, kinds = bytes(raw), KINDS
        lower = given.lower()
        if any(x in lower for x in self.opening):
            kinds = kinds.copy()
            kinds[[x[0] for x in self.opening]] = WHOLE
        text, folded, kind = (np.frombuffer(x, np.uint8) for x in (given, lower, given.translate(kinds.tobytes())))
        limits = ends[ends < len(text)]
        filled = kind != BLANK
        edge = np.empty(len(text), bool)
        edge[0] = True
        np.not_equal(filled[1:], filled[:-1], out=edge[1:])
        edge[limits] = True
        runs = np.flatnonzero(edge)
        fine = edge | (kind == DIGIT)
        fine[1:] |= kind[1:] != kind[:-1]
        uncut = np.flatnonzero(kind == WHOLE)
        if len(uncut):
            kept = np.zeros(len(runs), bool)
            kept[np.searchsorted(runs, uncut, "right") - 1] = True
            whole = np.repeat(kept, np.diff(runs, append=len(text)))
            fine = np.where(whole, edge, fine)
            folded = np.where(whole, text, folded)
        at = np.flatnonzero(fine)
        sizes = np.diff(at, append=len(text))
        words = filled[at]
        at, sizes = at[words], sizes[words]
        offsets = np.zeros(len(at) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(folded[filled])).dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        first = np.cumsum(lengths, dtype=np.int32) - lengths
        flat, which = np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
        many = lengths.take(which)
        upto = np.zeros(len(at) + 1, np.int32)
        np.cumsum(many, out=upto[1:])
        place = np.repeat(first.take(which) - upto[:-1], many)
        place += np.arange(len(place), dtype=np.int32)
        return flat.take(place).tobytes(), upto[np.searchsorted(at, ends)].astype(np.int64)

    def ids_of(self, strings: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        ids = list(map(self.known.get, strings))
        missing = [i for i, x in enumerate(ids) if x is None]
        new = []
        for i in missing:
            s = strings[i]
            if (x := self.old.get(s)) is None:
                new.append(s)
            else:
                self.known[s] = x
        if new:
            self.learn(new)
        for i in missing:
            ids[i] = self.known[strings[i]]
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


KEPT.append(encoder)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the closing 0, cut at capacity."""
    path = tokenizer or default_tokenizer()

    def go(texts) -> tuple:
        enc = encoder(path)
        out = []
        for ids in enc.encode_column(texts):
            ids += END
            out.append([{"piece": i, "start": i * capacity, "length": len(x) // 4, "ids_crc32": zlib.crc32(x)} for i, x in enumerate(ids[a : a + 4 * capacity] for a in range(0, len(ids), 4 * capacity))])
        return (out,)

    made = map_rows(docs, ["doc_id"], ["text"], go, "p array<struct<piece: int, start: long, length: long, ids_crc32: long>>", raw=["text"], kept=encoder)
    return made.select("doc_id", F.inline("p"))


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts.

    Returns the plan and the number of sequences. Of the pieces of a length, ranks from ``first`` up to
    ``last`` go, ``each`` to a sequence, to sequences from ``sequence`` up, at ``offset`` and following.
    """
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (bins, first sequence)
    plan, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, room = counts[length], 0, length
        while left:
            while room <= capacity and not open_bins[room]:
                room += 1
            if room <= capacity:
                bins, sequence = open_bins[room].pop()
                space = room
            else:
                space = capacity
                bins, sequence = max(1, left // (capacity // length)), used
                used += bins
            each = space // length
            if left < each:
                each = left
            filled = min(bins, left // each)
            plan.append((length, rank, rank + filled * each, each, sequence, capacity - space))
            open_bins[space - each * length].append((filled, sequence))
            if bins > filled:
                open_bins[space].append((bins - filled, sequence + filled))
            rank, left = rank + filled * each, left - filled * each
    return plan, used


def pack(parts: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Pieces with a sequence_id and an offset; parts has keys and a length from 1 to capacity."""
    spark = parts.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the pieces cost the tokenizer, and the buckets dealt here must not change any more.
    parts = materialize(parts.withColumn("bucket", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33) * 7, F.lit(buckets)).cast("int")), "pieces")
    per_bucket = parts.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit(counts, capacity)
    slots = spark.createDataFrame(plan or [(0, 0, 0, 1, 0, 0)], "slot_length long, first long, last long, each long, first_sequence long, base long")
    before = per_bucket.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    place = F.row_number().over(W.partitionBy("length", "bucket").orderBy(*keys))
    ranked = parts.withColumn("place", place - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))
    held = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    i = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(slots), held).select(
        *[c for c in parts.columns if c != "bucket"],
        (F.col("first_sequence") + F.floor(i / F.col("each"))).alias("sequence_id"),
        (F.col("base") + i % F.col("each") * F.col("length")).alias("offset"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(read(spark, sf_dir, "documents", ["doc_id", "text"])))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES: dict[str, str] = {}
