"""Token ids in compressed files: an adaptive context-mixing range coder over blocks coded side by side.

A file is a shard: documents in ascending order whose ids, each document's closed by the end id, are one
sequence cut into blocks, each with a CRC-32 of its ids. A shard can be read without the others. Its header lists its
distinct ids and how often each occurs, scaled to about a million; the coder works on their ranks. The next rank has the probability

    (count + weight 1 if order 1 predicts it + weight 2 if order 2 does) / total

Order 0 is the header's counts. Orders 1 and 2 predict the rank that followed the last one anywhere in the shard, or the last two
in the block, before, with a confidence from 0 to 7; both adapt at every step. Weights stand to the counts as order 2 being right, order 1
alone, or neither do: writing counts these per pair of confidences, and the header has the result. The sum's
interval drives a range coder of 48 bits with 24-bit words; carries go into the word before.

All blocks of a shard are coded side by side, one step of NumPy per place in a block: what a step costs is mostly
its number of array operations, so blocks are short and many. All of it is integers
(quotients are taken in doubles where those are exact), so files do not depend on the machine.

Layout, little-endian. Header: magic, partition and shard numbers, tokens, documents, block length, bytes
of the tables, CRC-32 of the tables. Tables (deflated): whether each key is null, keys, document lengths, words and CRC-32 of the ids
per block, weights, distinct ids, bytes of their list, the id gaps as varints, and counts as bytes, those of 255 and more as 255 with
their 32-bit numbers behind. Body: the words, block after block. A line feed ends the file.

A shard closes at the first document's end past ``SHARD`` tokens, so a task holds one shard; one document is never cut
by files, however long. Files are a row each of Spark's text writer, whose commit protocol drops what failed
or repeated tasks wrote.

Defined cases: null and empty texts are the end id alone; documents are ordered by key, null keys first, equal keys by
a hash of the text and the text; repeated rows are written as often as they stand; an empty table gives
no file and no rows; columns beside key and text are left out, whatever their names. A damaged file raises an error.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaframe.llm.common import KEPT, configure, let_go, map_rows, materialize, read, shared_dir

MAGIC = b"MFTOKCM2"
HEAD = struct.Struct("<8sIIQIIII")
SHARD = 1 << 22  # tokens after which a file closes
BLOCK, LEAST, LANES = 500, 128, 8400  # most and fewest ids a block (powers of two share cache lines), and blocks a shard is cut into where it is small
SCALE = 1 << 20  # what the counts of a shard with more tokens are scaled to
TABLE = 512  # places of order 2 a block
SURE = 7  # the highest confidence
MOST = 1 << 23  # of both weights together
SPAN = 22  # bits of a count, or a sum of all
TOP, WIDE = 48, 24  # bits of the coder's interval, and of a word: any interval holds all totals, and one word at most is due a step


# ---- the model --------------------------------------------------------------------------------


def _of(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table.take(at, axis=0, mode="clip")


class Mixer:
    """The models of blocks that are coded side by side.

    sizes: distinct ids of each block, or of all where blocks tells how many share them; counts: how often each occurs;
    weights: of orders 1 and 2, per pair of confidences.
    """

    def __init__(self, sizes: np.ndarray, counts: np.ndarray | None = None, weights: np.ndarray | None = None, blocks: int | None = None):
        counts = np.ones(int(sizes.sum()), np.int64) if counts is None else counts.astype(np.int64)
        first, upto = np.cumsum(sizes) - sizes, np.cumsum(counts)
        start = (upto - counts)[first]
        inside = upto - counts - np.repeat(start, sizes)
        self.total = np.add.reduceat(counts, first)
        # Per rank the count of all lower ones and its own, and its last place of those that order 0 has; per place its rank.
        self.spans, self.ends = inside << SPAN | counts, inside + counts - 1
        self.slots = np.repeat((np.arange(len(counts)) - np.repeat(first, sizes)).astype(np.uint16 if sizes.max() <= 1 << 16 else np.int32), counts)
        self.first, self.start = (None, None) if blocks else (first, start)
        self.weights = np.full((2, 64), 1 << 8, np.int64) if weights is None else weights.astype(np.int64)
        n = blocks or len(sizes)
        self.one, self.two = np.zeros(len(counts), np.int32), np.zeros(n * TABLE, np.int32)  # what followed, and the confidence
        self.places, self.last, self.older = np.arange(n) * TABLE, np.zeros(n, np.int64), np.zeros(n, np.int64)

    def at(self, x: np.ndarray, m: int) -> np.ndarray:
        return x if self.first is None else self.first[:m] + x

    def foresee(self, m: int) -> None:
        """What orders 1 and 2 say of the next rank of the first m blocks."""
        self.at1 = self.at(self.last[:m], m)
        at = self.last[:m] * 2_654_435
        at += self.older[:m]
        at >>= 4
        at &= TABLE - 1
        at += self.places[:m]
        self.at2, self.e1, self.e2 = at, _of(self.one, self.at1), _of(self.two, at)
        self.p1, self.k1, self.p2, self.k2 = self.e1 >> 3, self.e1 & SURE, self.e2 >> 3, self.e2 & SURE
        self.state = self.k2 << 3
        self.state |= self.k1

    def predict(self, m: int) -> None:
        """The same, with the weights and what all of the distribution comes to."""
        self.foresee(m)
        self.w1, self.w2 = _of(self.weights[0], self.state), _of(self.weights[1], self.state)
        self.all = self.w1 + self.w2
        self.all += self.total[:m]

    def interval(self, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, width and total of the mixed distribution at x."""
        width = _of(self.spans, self.at(x, m))
        start = width >> SPAN
        start += self.w1 * (self.p1 < x)
        start += self.w2 * (self.p2 < x)
        width &= (1 << SPAN) - 1
        width += self.w1 * (self.p1 == x)
        width += self.w2 * (self.p2 == x)
        return start, width, self.all

    def find(self, v: np.ndarray, m: int) -> np.ndarray:
        """The rank whose interval holds v. A weight lies behind its rank's own places: taken out, all of it falls on the last of them."""
        past = v - _of(self.ends, self.at(self.p1, m))
        past -= self.w2 * (self.p2 < self.p1)
        np.maximum(past, 0, out=past)
        v = v - np.minimum(past, self.w1, out=past)
        past = v - _of(self.ends, self.at(self.p2, m))
        np.maximum(past, 0, out=past)
        v -= np.minimum(past, self.w2, out=past)
        if self.start is not None:
            v += self.start[:m]
        return _of(self.slots, v).astype(np.int64)

    def update(self, x: np.ndarray, m: int) -> None:
        new = x.astype(np.int32)
        new <<= 3
        new |= 1
        for table, at, e, p, k in ((self.one, self.at1, self.e1, self.p1, self.k1), (self.two, self.at2, self.e2, self.p2, self.k2)):
            surer = e + 1
            np.minimum(surer, e | SURE, out=surer)
            table[at] = np.where(p == x, surer, np.where(k > 2, e - 2, new))  # a miss takes 2, and below 1 the new rank moves in
        self.older[:m], self.last[:m] = self.last[:m], x


# ---- the coder --------------------------------------------------------------------------------


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b, exact for a below 2^53."""
    return (a / b).astype(np.int64)


def learn(ranks: np.ndarray, model: Mixer, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights that suit the blocks, and per place what orders 1 and 2 say: below the rank (bits 9, 8), right (7, 6), confidences."""
    length, n = ranks.shape
    told = np.zeros((length, n), np.uint16)
    for t in range(length):
        m = n if t < last else n - 1
        if not m:
            break
        x = ranks[t, :m]
        model.foresee(m)
        bits = (model.p1 < x).view(np.uint8)
        for more in (model.p2 < x, model.p1 == x, model.p2 == x):
            bits <<= 1
            bits |= more.view(np.uint8)
        said = bits.astype(np.uint16)
        said <<= 6
        said |= model.state.astype(np.uint16)
        told[t, :m] = said
        model.update(x, m)
    seen = (np.bincount(told[:last].reshape(-1), minlength=1024) + np.bincount(told[last:, :-1].reshape(-1), minlength=1024)).reshape(4, 4, 64).sum(0)
    neither, right2, right1, both = seen
    weights = np.array([right1, right2 + both]) * (int(model.total[0]) / (neither + 0.5))
    weights *= np.minimum(1, MOST / np.maximum(weights.sum(0), 1))
    return weights.astype(np.int64), told


def squeeze(ranks: np.ndarray, counts: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, words and their number per block. ranks: a row per place, a column per block, of which the last has ``last`` places only."""
    length, n = ranks.shape
    model = Mixer(np.array([len(counts)]), counts, blocks=n)
    weights, told = learn(ranks, model, last)
    say = np.arange(1024)
    w1, w2 = weights[:, say & 63]
    ahead, more, total = w1 * (say >> 9) + w2 * (say >> 8 & 1), w1 * (say >> 7 & 1) + w2 * (say >> 6 & 1), (w1 + w2 + model.total[0]).astype(float)
    low, width = np.zeros(n, np.int64), np.full(n, 1 << TOP, np.int64)
    words, due = np.zeros((length + 2, n), np.uint32), np.zeros((length + 2, n), bool)
    for t in range(length):
        m = n if t < last else n - 1
        if not m:
            break
        if m < len(width):
            words[length:, m], width = (low[m] >> WIDE, low[m] & (1 << WIDE) - 1), width[:m]
            low = low[:m]
        say, share = told[t, :m].astype(np.int64), _of(model.spans, ranks[t, :m])
        part = _quotient(width, _of(total, say))
        start = share >> SPAN
        start += _of(ahead, say)
        start *= part
        low = low + start
        share &= (1 << SPAN) - 1
        share += _of(more, say)
        width = share * part
        thin = np.less(width, 1 << WIDE, out=due[t, :m])
        words[t, :m] = low >> WIDE  # with a carry, or not due
        low &= thin - np.int64(1) | (1 << WIDE) - 1
        shift = thin * WIDE
        low <<= shift
        width <<= shift
    words[length, : len(low)], words[length + 1, : len(low)], due[length:] = low >> WIDE, low & (1 << WIDE) - 1, True
    flat = np.ascontiguousarray(words.T)[np.ascontiguousarray(due.T)]
    while len(over := np.flatnonzero(flat >> WIDE)):
        flat[over] -= 1 << WIDE
        flat[over - 1] += 1
    return weights, flat, due.sum(0)


def expand(flat: np.ndarray, counted: np.ndarray, counts: np.ndarray, weights: np.ndarray, length: int, last: int) -> np.ndarray:
    """The ranks that squeeze() was given."""
    n = len(counted)
    model, held = Mixer(np.array([len(counts)]), counts, weights, n), np.concatenate([flat, np.zeros(3, np.uint32)]).astype(np.int64)
    used = np.cumsum(counted, dtype=np.int64) - counted
    above, width = _of(held, used) << WIDE | _of(held, used + 1), np.full(n, 1 << TOP, np.int64)  # the code's distance to the interval's start
    used += 2
    out = np.zeros((length, n), np.int32)
    for t in range(length):
        m = n if t < last else n - 1
        if not m:
            break
        if m < len(width):
            above, width, used = above[:m], width[:m], used[:m]
        model.predict(m)
        part = _quotient(width, model.all)
        v = _quotient(above, part)
        x = model.find(np.minimum(v, model.all - 1, out=v), m)
        start, width, _ = model.interval(x, m)
        model.update(x, m)
        start *= part
        above = above - start
        width *= part
        thin = width < 1 << WIDE
        shift = thin * WIDE
        above <<= shift
        above |= _of(held, used) * thin
        width <<= shift
        used = used + thin
        out[t, :m] = x
    return out


def _varints(gaps: np.ndarray) -> bytes:
    """Numbers below 2^21 in 7-bit groups, low ones first; the last byte of a number has no high bit."""
    more = 1 + (gaps >= 1 << 7).astype(np.int64) + (gaps >= 1 << 14)
    ends = np.cumsum(more)
    out = np.zeros(int(ends[-1]), np.uint8)
    for i in range(3):
        has = more > i
        out[(ends - more)[has] + i] = gaps[has] >> 7 * i & 127 | np.where(more[has] > i + 1, 128, 0)
    return out.tobytes()


def _gaps(raw: np.ndarray) -> np.ndarray:
    b = raw.astype(np.int64)
    final = np.flatnonzero(b < 128)
    first = np.concatenate([[0], final[:-1] + 1])
    shift = (np.arange(len(b)) - np.repeat(first, final - first + 1)) * 7
    return np.add.reduceat((b & 127) << shift, first)


def write_shard(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, partition: int, shard: int) -> bytes:
    """The bytes of a file, of at least one document. ids below 2^21, of all documents one after the other."""
    total = len(ids)
    length = int(min(BLOCK, max(LEAST, -(-total // LANES))))
    blocks = -(-total // length)
    last = total - (blocks - 1) * length
    counts = np.bincount(ids)
    own = np.flatnonzero(counts)
    counts = counts[own]
    if total > SCALE:
        counts = np.maximum(counts * SCALE // total, 1)
    rank = np.zeros(int(own[-1]) + 1, np.int32)
    rank[own] = np.arange(len(own))
    ranks = np.zeros(blocks * length, np.int32)
    ranks[:total] = rank.take(ids)
    crcs = [zlib.crc32(ids[a : a + length].astype("<u4").tobytes()) for a in range(0, total, length)]
    weights, words, counted = squeeze(np.ascontiguousarray(ranks.reshape(blocks, length).T), counts, last)
    null, listed = np.array([k is None for k in keys]), _varints(np.diff(own, prepend=-1) - 1)
    tables = b"".join(
        (
            np.packbits(null).tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), np.asarray(lengths, "<u4").tobytes(),
            counted.astype("<u4").tobytes(), np.array(crcs, "<u4").tobytes(), weights.astype("<u4").tobytes(),
            np.array([len(own), len(listed)], "<u4").tobytes(), listed, np.minimum(counts, 255).astype("u1").tobytes(), counts[counts >= 255].astype("<u4").tobytes(),
        )
    )
    packed = zlib.compress(tables, 1)
    body = words.astype("<u4").view("u1").reshape(-1, 4)[:, :3].tobytes()
    return b"".join((HEAD.pack(MAGIC, partition, shard, total, len(keys), length, len(packed), zlib.crc32(packed)), packed, body))


def read_shard(raw: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """Partition and shard number, keys, document lengths and ids of a file's bytes; every block is checked."""
    try:
        magic, partition, shard, total, docs, length, size, crc = HEAD.unpack_from(raw)
        packed = raw[HEAD.size : HEAD.size + size]
        if magic != MAGIC or zlib.crc32(packed) != crc:
            raise ValueError("no token file, or its tables are damaged")
        tables, at = zlib.decompress(packed), 0
        blocks = -(-total // length)

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(tables, kind, n, at)
            at += out.nbytes
            return out

        null = np.unpackbits(column("u1", -(-docs // 8)), count=docs).astype(bool)
        keys, lengths = column("<i8", docs), column("<u4", docs)
        counted, crcs, weights = column("<u4", blocks), column("<u4", blocks), column("<u4", 128).reshape(2, 64)
        distinct, listed = column("<u4", 2).tolist()
        own = (np.cumsum(_gaps(column("u1", listed)) + 1) - 1).astype(np.uint32)
        counts = column("u1", distinct).astype(np.int64)
        many = counts == 255
        counts[many] = column("<u4", int(many.sum()))
        at, used = HEAD.size + size, int(counted.sum(dtype=np.int64))
        if len(raw) < at + 3 * used:
            raise ValueError("a token file is cut short")
        words = np.zeros((used, 4), np.uint8)
        words[:, :3] = np.frombuffer(raw, "u1", 3 * used, at).reshape(-1, 3)
        ranks = expand(words.view("<u4").reshape(-1), counted, counts, weights, length, total - (blocks - 1) * length)
        ids = own.take(np.ascontiguousarray(ranks.T).reshape(-1)[:total])
        for i in range(blocks):
            if zlib.crc32(ids[i * length : (i + 1) * length].astype("<u4").tobytes()) != crcs[i]:
                raise ValueError(f"block {i} of a token file is damaged")
    except (struct.error, zlib.error, IndexError, ZeroDivisionError) as e:
        raise ValueError("a token file is damaged") from e
    return partition, shard, [None if z else int(k) for z, k in zip(null, keys, strict=True)], lengths, ids


# ---- the tokenizer ----------------------------------------------------------------------------

CHUNK = 1 << 20  # bytes that are cut into words at once
BLANK, LETTER, DIGIT, OTHER, WHOLE, LEAD = range(6)  # what a byte is; stretches with a WHOLE one are not cut here


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[*range(9, 14), 32]] = BLANK
    kinds[[*range(65, 91), *range(97, 123)]] = LETTER
    kinds[48:58] = DIGIT
    kinds[[39, *range(128, 256)]] = WHOLE  # the tokenizer has words that begin with an apostrophe
    kinds[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = LEAD  # all from U+00C0 to U+027F and U+0400 to U+047F are letters, but for two
    return kinds


KINDS = _kinds().tobytes()


class ByteEncoder:
    """Ids of a byte-level tokenizer as little-endian 32-bit bytes, by way of what is already known.

    Its words are runs of letters, of digits, of other characters or of white space, with one space before them. Texts
    are cut into them by the kinds of their bytes; stretches between white space with an apostrophe or with characters
    that are not sorted here stay whole. Arrow tells equal ones of a batch apart, so each is looked up once. A full store becomes an older one,
    from which only what is met again is taken over. Unknown words go to the tokenizer's model, whole stretches to the tokenizer.
    So do all texts, one by one, where it normalizes or has words of another kind.
    """

    PURE = re.compile("[\0-&(-\x7f]+| ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u027f\u0400-\u047f]+")
    SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # white space beyond ASCII
    BREAK = re.compile(rb"(?s:.*)[!-~](?= [!-~])")  # up to the last space that stands alone
    LONGEST = 256  # characters of what is kept

    def __init__(self, path: str, most: int = 300_000):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tok, self.most = Tokenizer.from_file(path), most
        self.model = self.tok.model
        before = self.tok.pre_tokenizer
        self.usual = self.tok.normalizer is None and before is not None and json.loads(before.__getstate__()) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as they are
        hidden = [b for b in range(256) if b not in shown]
        self.shown = "".join(chr(b if b in shown else 256 + hidden.index(b)) for b in range(256))
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, strings: list[str]) -> list[bytes]:
        flat, ends, whole, tokenize, pure, number = [], [], [], self.model.tokenize, self.PURE.fullmatch, attrgetter("id")
        for s in strings:
            if not pure(s):
                whole.append(s)
            elif s.isascii() and s.isprintable():
                flat.extend(map(number, tokenize(s.replace(" ", "\u0120"))))
            else:
                flat.extend(map(number, tokenize(charmap_decode(s.encode(), "strict", self.shown)[0])))
            ends.append(len(flat) * 4)
        raw = np.array(flat, "<u4").tobytes()
        made = [raw[a:b] for a, b in zip([0, *ends], ends)]
        if whole:
            found = iter(self.tok.encode_batch_fast(whole, add_special_tokens=False))
            made = [x or np.array(next(found).ids, "<u4").tobytes() for x in made]
        return made

    def ids_of(self, strings: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        ids = list(map(self.known.get, strings))
        missing = [i for i, x in enumerate(ids) if x is None]
        part = [strings[i] for i in missing]
        found = list(map(self.old.get, part))
        if None in found:
            new = iter(self.learn([s for s, x in zip(part, found, strict=True) if x is None]))
            found = [next(new) if x is None else x for x in found]
        self.known.update(zip(part, found, strict=True) if max(map(len, part), default=0) <= self.LONGEST else ((s, x) for s, x in zip(part, found, strict=True) if len(s) <= self.LONGEST))
        for i, x in zip(missing, found, strict=True):
            ids[i] = x
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        import pyarrow as pa

        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow column; null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts) or not self.usual:
            return [self.plain(t) for t in texts.to_pylist()]
        odd = [pc.match_substring(texts, x) for x in self.special]
        if not pc.all(pc.string_is_ascii(texts)).as_py():
            odd.append(pc.match_substring_regex(texts, self.SPACE))
        alone = np.flatnonzero(np.any([x.to_numpy(zero_copy_only=False) for x in odd], axis=0)) if odd else []
        plain = {int(i): self.plain(texts[int(i)].as_py()) for i in alone}
        if plain:
            texts = pa.array([None if i in plain else x for i, x in enumerate(texts.to_pylist())], pa.large_string()).fill_null("")
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
                ids, ends = self.chunk(bytes(whole[at:stop]), np.minimum(bounds[i + 1 : j + 1], stop) - at)
                a = 0
                for k, b in enumerate((ends * 4).tolist(), i):
                    if b > a:
                        made[k].append(ids[a:b])
                    a = b
                at = stop
        finally:
            if collects:
                gc.enable()
        return [plain.get(i) or (x[0] if len(x) == 1 else b"".join(x)) for i, x in enumerate(made)]

    def stop(self, whole: memoryview, at: int, end: int, bounds: np.ndarray) -> int:
        """Where a chunk from at on ends: at a text's end or before a space that stands alone, however far that is."""
        size = CHUNK
        while at + size < end:
            text = int(bounds[np.searchsorted(bounds, at + size, "right") - 1])
            if text > at:
                return text
            if found := self.BREAK.match(bytes(whole[at : at + size])):
                return at + found.end()
            size *= 2
        return end

    def chunk(self, given: bytes, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of texts that lie one after the other, and how many there are up to each text's end."""
        import pyarrow as pa

        text, kind = np.frombuffer(given, np.uint8), np.frombuffer(bytearray(given.translate(KINDS)), np.uint8)
        limits = ends[ends < len(text)]
        leads = np.flatnonzero(kind == LEAD)
        if len(leads):
            sign = (text[leads] == 0xC3) & (text[leads + 1] & 0xDF == 0x97)  # of multiplication and division
            kind[leads] = kind[leads + 1] = np.where(sign, WHOLE, LETTER)
        opens = np.empty(len(text), bool)
        opens[0] = True
        np.not_equal(kind[1:], kind[:-1], out=opens[1:])
        opens[limits] = True
        filled = kind != BLANK
        uncut = np.flatnonzero(kind == WHOLE)
        if len(uncut):
            edge = np.empty(len(text), bool)
            edge[0] = True
            np.not_equal(filled[1:], filled[:-1], out=edge[1:])
            edge[limits] = True
            runs = np.flatnonzero(edge)
            kept = np.zeros(len(runs), bool)
            kept[np.searchsorted(runs, uncut, "right") - 1] = True
            opens = np.where(np.repeat(kept, np.diff(runs, append=len(text))), edge, opens)
        blank = filled[1:] > filled[:-1]  # the last before a word: a space belongs to it
        blank[limits[limits > 0] - 1] = False
        blank = np.flatnonzero(blank)
        opens[blank] = True
        opens[blank[text[blank] == 32] + 1] = False
        at = np.flatnonzero(opens)
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(text)).astype(np.int32)), pa.py_buffer(given)).dictionary_encode()
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


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


KEPT.append(encoder)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- tables -----------------------------------------------------------------------------------


def write_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 0, shard: int = SHARD, partitions: int | None = None) -> None:
    """Token files of all documents below path, in ascending order of the key, which becomes a long."""
    import pyarrow as pa

    name, closing = tokenizer or default_tokenizer(), np.array([end], "<u4").tobytes()
    configure(docs.sparkSession)

    def files(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        let_go(encoder)
        enc, partition, number = encoder(name), TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[bytes] = []
        size = 0

        def close():
            nonlocal size, number
            raw = write_shard(keys, np.array([len(x) // 4 for x in held]), np.frombuffer(b"".join(held), "<u4"), partition, number)
            keys.clear()
            held.clear()
            size, number = 0, number + 1
            # A text column's bytes pass to the writer as they are.
            return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int64)), pa.py_buffer(raw)])], names=["value"])

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), enc.encode_column(batch.column(1)), strict=True):
                keys.append(k)
                held.append(ids + closing)
                size += len(ids) // 4 + 1
                if size >= shard:
                    yield close()
        if keys:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange(partitions, "k", "h") if partitions else rows.repartitionByRange("k", "h")
    dealt.sortWithinPartitions("k", "h", "t").select("k", "t").mapInArrow(files, "value string").write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """partition, shard, place, key, start, ids: every document of the files below path; start: the ids of its shard before it."""
    import pyarrow as pa

    def go(batches: Iterator) -> Iterator:
        let_go()
        for batch in batches:
            for raw in batch.column(0):
                partition, shard, keys, lengths, ids = read_shard(raw.as_buffer().to_pybytes())
                ends = np.cumsum(lengths.astype(np.int64))
                for a in range(0, len(keys), 1024):
                    b = min(a + 1024, len(keys))
                    base = int(ends[a] - lengths[a])
                    offsets = np.concatenate([[0], ends[a:b] - base]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[base : int(ends[b - 1])].astype(np.int32)))
                    n = b - a
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, partition, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(a, b, dtype=np.int32)), pa.array(keys[a:b], pa.int64()), pa.array(ends[a:b] - lengths[a:b]), lists], names=["partition", "shard", "place", "key", "start", "ids"])

    # Files are as long as a shard: one a batch.
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return found.mapInArrow(go, "partition int, shard int, place int, key long, start long, ids array<int>")


def checksums(documents: DataFrame) -> DataFrame:
    """partition, shard, place, key, start, n_tokens, ids_crc32 of what read_files() returns, without a row's ids ever leaving its task."""

    def go(lists) -> tuple:
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum([0, *lists.value_lengths().to_pylist()])
        return ([int(x) for x in np.diff(ends)], [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)])

    return map_rows(documents, ["partition", "shard", "place", "key", "start"], ["ids"], go, "n_tokens long, ids_crc32 long", raw=["ids"])


def starts(rows: DataFrame) -> DataFrame:
    """rows with start counted over all files: sums by shard, then by partition, of which there is one a row."""
    shards = rows.groupBy("partition", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = shards.groupBy("partition").agg(F.sum("n").alias("n"))
    ahead = parts.select("partition", (F.sum("n").over(W.orderBy("partition")) - F.col("n")).alias("ahead"))
    inside = shards.withColumn("before", F.sum("n").over(W.partitionBy("partition").orderBy("shard")) - F.col("n")).drop("n")
    base = inside.join(ahead, "partition").select("partition", "shard", (F.col("ahead") + F.col("before")).alias("base"))
    return rows.join(base, ["partition", "shard"]).withColumn("start", F.col("base") + F.col("start")).drop("base")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    write_files(read(spark, sf_dir, "documents", ["doc_id", "text"]), path)
    rows = materialize(checksums(read_files(spark, path)), "token-checksums")
    return starts(rows).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {"op12_token_files": op12_token_files}
ORACLES: dict[str, str] = {}
