"""Media columns: Matroska files held in a binary column, and the packet tables parsed from them.

A file here is EBML all the way down: every element is a variable-length id, a variable-length size
and a body. The writer lays samples out as 8-bit PCM packets, several packets to a laced SimpleBlock,
blocks to a Cluster, and one cue point per cluster. The reader is general: any id and size width,
unknown-size segments and clusters, SimpleBlocks and BlockGroups, no / Xiph / fixed / EBML lacing.

Defined cases: null media gives no packets; a null or empty text is 64 zero bytes of payload; a file
that is cut short gives the packets that are whole and ``intact = false``; equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm.common import map_rows, read

# Element ids of the Matroska container.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION = 0x23E383
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

UNIT = 64
SAMPLE_RATE = 8000
FRAME = 1024  # samples a packet: 128 ms
LACED = 8  # packets a block
BLOCKS = 4  # blocks a cluster: 4096 ms, so relative timestamps fit 16 bits

PACKET = {"track": "int", "cluster": "int", "block": "int", "lacing": "string", "timestamp_ms": "long", "byte_start": "long", "byte_length": "long", "keyframe": "boolean", "cued": "boolean"}


# ---- writing ----------------------------------------------------------------------------------


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:  # all ones means unknown
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(eid: int, body: bytes) -> bytes:
    return _id(eid) + _size(len(body)) + body


def _uint(eid: int, n: int) -> bytes:
    return _element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(eid: int, x: float) -> bytes:
    return _element(eid, struct.pack(">d", x))


def _signed_size(n: int) -> bytes:
    width = 1
    while not -((1 << 7 * width - 1) - 1) <= n <= (1 << 7 * width - 1) - 1:
        width += 1
    return ((n + (1 << 7 * width - 1) - 1) | 1 << 7 * width).to_bytes(width, "big")


def _block(at: int, frames: list[bytes]) -> bytes:
    """A SimpleBlock of track 1: fixed lacing for equal frames, EBML lacing otherwise, none for one."""
    sizes = [len(x) for x in frames]
    if len(frames) == 1:
        flags, lace = 0x80, b""
    elif len(set(sizes)) == 1:
        flags, lace = 0x84, bytes([len(frames) - 1])
    else:
        flags = 0x86
        lace = bytes([len(frames) - 1]) + _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return _element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at, flags) + lace + b"".join(frames))


_HEAD = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
_TRACK = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // SAMPLE_RATE) + _element(CODEC_ID, b"A_PCM/INT/LIT")
                                   + _element(AUDIO, _float(RATE, float(SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def mux(samples: bytes) -> bytes:
    """Samples, a positive multiple of 64 bytes, as a Matroska file with one 8-bit PCM track."""
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, len(samples) * 1000 / SAMPLE_RATE) + _element(MUXING_APP, b"mediaframe") + _element(WRITING_APP, b"mediaframe"))
    body, cues, step = [info, _TRACK], [], FRAME * LACED * BLOCKS
    at = len(info) + len(_TRACK)
    for start in range(0, len(samples), step):
        ms = start * 1000 // SAMPLE_RATE
        blocks = [_uint(TIMESTAMP, ms)]
        for b in range(start, min(start + step, len(samples)), FRAME * LACED):
            end = min(b + FRAME * LACED, len(samples))
            blocks.append(_block(b * 1000 // SAMPLE_RATE - ms, [samples[i : min(i + FRAME, end)] for i in range(b, end, FRAME)]))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, ms) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(body))


# ---- reading ----------------------------------------------------------------------------------


class _Cut(Exception):
    """The file ends inside an element."""


def _vint(buf: bytes, at: int, keep_marker: bool) -> tuple[int, int, int]:
    """(value, next offset, width) of the variable-length integer at an offset."""
    if at >= len(buf) or not buf[at]:
        raise _Cut
    width = 9 - buf[at].bit_length()
    if at + width > len(buf):
        raise _Cut
    n = int.from_bytes(buf[at : at + width], "big")
    return (n if keep_marker else n & ~(1 << 7 * width)), at + width, width


def _children(buf: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(id, body start, body end, size known) of the elements from at to end."""
    while at < end:
        eid, at, _ = _vint(buf, at, True)
        n, at, width = _vint(buf, at, False)
        known = n != (1 << 7 * width) - 1
        stop = at + n if known else end
        if stop > end:
            if eid not in (SEGMENT, CLUSTER):
                raise _Cut
            stop, known = end, False
        yield eid, at, stop, known
        at = stop


def _lace(buf: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, length) of each frame in a block's data."""
    if kind == 0:
        return [(at, end - at)]
    n, at = buf[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        sizes = [(end - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while buf[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + buf[at])
            at += 1
    else:
        for k in range(n - 1):
            x, at, width = _vint(buf, at, False)
            sizes.append(x if k == 0 else sizes[-1] + x - ((1 << 7 * width - 1) - 1))
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise _Cut
        out.append((at, size))
        at += size
    return out


_LACING = ("none", "xiph", "fixed", "ebml")


def demux(buf: bytes) -> tuple[list[tuple], dict]:
    """Packets (track, cluster, block, lacing, timestamp, start, length, keyframe, cued) and facts about the file."""
    packets: list[tuple] = []
    facts: dict = {"clusters": 0, "cues": 0, "intact": True, "codec": None, "duration": None}
    cues: set[int] = set()
    starts: list[int] = []
    scale, frame_ns = 1_000_000, 0

    def uint(a: int, b: int) -> int:
        return int.from_bytes(buf[a:b], "big")

    def block(a: int, b: int, base: int, n: int, simple: bool) -> None:
        track, a, _ = _vint(buf, a, False)
        if a + 3 > b:
            raise _Cut
        (rel, flags), a = struct.unpack(">hB", buf[a : a + 3]), a + 3
        kind = flags >> 1 & 3
        for i, (start, length) in enumerate(_lace(buf, a, b, kind)):
            packets.append((track, len(starts) - 1, n, _LACING[kind], ((base + rel) * scale + i * frame_ns) // 1_000_000, start, length, bool(flags & 0x80) or not simple))

    def cluster(a: int, b: int) -> int:
        """Ends early where an unknown-size cluster meets the next top-level element."""
        base = n = 0
        for eid, x, y, known in _children(buf, a, b):
            if eid in TOP_LEVEL:
                return x - len(_id(eid)) - _width(buf, x, eid)
            if eid == TIMESTAMP:
                base = uint(x, y)
            elif eid == SIMPLE_BLOCK:
                block(x, y, base, n, True)
                n += 1
            elif eid == BLOCK_GROUP:
                for inner, p, q, _ in _children(buf, x, y):
                    if inner == BLOCK:
                        block(p, q, base, n, False)
                        n += 1
        return b

    def segment(a: int, b: int) -> None:
        nonlocal scale, frame_ns
        first, at = a, a
        while at < b:
            for eid, x, y, known in _children(buf, at, b):
                head = at
                at = y
                if eid == INFO:
                    for inner, p, q, _ in _children(buf, x, y):
                        if inner == TIMESTAMP_SCALE:
                            scale = uint(p, q)
                        elif inner == DURATION:
                            facts["duration"] = struct.unpack(">d" if q - p == 8 else ">f", buf[p:q])[0]
                elif eid == TRACKS:
                    for inner, p, q, _ in _children(buf, x, y):
                        for leaf, u, v, _ in _children(buf, p, q) if inner == TRACK_ENTRY else ():
                            if leaf == CODEC_ID:
                                facts["codec"] = buf[u:v].decode("latin-1")
                            elif leaf == DEFAULT_DURATION:
                                frame_ns = uint(u, v)
                elif eid == CLUSTER:
                    starts.append(head - first)
                    at = cluster(x, y)
                elif eid == CUES:
                    for inner, p, q, _ in _children(buf, x, y):
                        for mid, u, v, _ in _children(buf, p, q) if inner == CUE_POINT else ():
                            for leaf, m, n, _ in _children(buf, u, v) if mid == CUE_POSITIONS else ():
                                if leaf == CUE_CLUSTER:
                                    cues.add(uint(m, n))
                if at != y:
                    break

    try:
        for eid, a, b, known in _children(buf, 0, len(buf)):
            if eid == SEGMENT:
                facts["intact"] &= known or b == len(buf)
                segment(a, b)
    except (_Cut, IndexError, struct.error):
        facts["intact"] = False
    facts |= {"clusters": len(starts), "cues": len(cues)}
    return [(*p, starts[p[1]] in cues) for p in packets], facts


def _width(buf: bytes, body: int, eid: int) -> int:
    """Width of the size field that ends where an element's body starts."""
    for width in range(1, 9):
        if body - width >= 0 and 9 - buf[body - width].bit_length() == width and buf[body - width - len(_id(eid)) : body - width] == _id(eid):
            return width
    raise _Cut


# ---- DataFrames -------------------------------------------------------------------------------


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: each text's padded bytes as the samples of a Matroska file."""

    def go(texts: list) -> tuple:
        made = [payload(x) for x in texts]
        return [n for _, n in made], [mux(p) for p, _ in made]

    return map_rows(df, [key], [text], go, "n_bytes long, media binary")


def packets(df: DataFrame, row: str, media: str = "media") -> DataFrame:
    """The packet table: one row per packet with its track, timestamp and byte range in the file."""

    def go(files: list) -> tuple:
        return ([[] if m is None else [dict(zip(PACKET, p, strict=True)) for p in demux(m)[0]] for m in files],)

    made = map_rows(df, [row], [media], go, f"packets array<struct<{', '.join(f'{k}: {v}' for k, v in PACKET.items())}>>")
    return made.select(row, F.inline("packets"))


def digest(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Read each file back through its packets and describe what they hold."""

    def one(buf: bytes) -> tuple:
        got, facts = demux(buf)
        back = b"".join(buf[p[5] : p[5] + p[6]] for p in got)
        x = np.frombuffer(back, np.uint8)
        feature = f"packets={len(got)};clusters={facts['clusters']};cues={facts['cues']};blocks={len({(p[1], p[2]) for p in got})};ms={len(back) * 1000 // SAMPLE_RATE};sum={int(x.sum(dtype=np.int64))};peak={int(x.max(initial=0))};rises={int((x[1:] > x[:-1]).sum())}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(buf), hashlib.sha256(buf).hexdigest(), feature

    def go(files: list) -> list:
        return list(zip(*(one(m or b"") for m in files), strict=True)) or [[]] * 6

    return map_rows(df, [key, "n_bytes"], [media], go, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(read(spark, sf_dir, "documents", ["doc_id", "text"])))


QUERIES = {"op5_media_matroska": op5_media_matroska}
ORACLES: dict[str, str] = {}
