"""Media files as tables: scanning folders, EXIF, dimensions."""

from __future__ import annotations

import io
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.functions import paths, text
from mediaframe.sources import tree

# Folders that a scan never enters.
EXCLUDED_NAMES = ("Library", "System", "Applications", "Volumes", "node_modules", "__MACOSX", "Backups.backupdb", "private", "usr", "bin", "sbin", "etc", "var", "dev", "opt", "cores")
EXCLUDED_SUFFIXES = (".app", ".photoslibrary", ".framework", ".bundle", ".xcodeproj", ".xcassets")
JUNK = ("Thumbs.db", "desktop.ini")

EXIF = "date_taken string, camera_make string, camera_model string, lens_model string, focal_length double, aperture double, iso int, gps_latitude double, gps_longitude double, gps_altitude double, orientation int, width int, height int"


def scannable(path: Column, root: str = "", names: tuple[str, ...] = EXCLUDED_NAMES, suffixes: tuple[str, ...] = EXCLUDED_SUFFIXES) -> Column:
    """Whether a scan of the root keeps the file: no hidden or excluded part below the root, and media by extension."""
    below = F.substr(path, F.lit(len(root.rstrip("/")) + 1)) if root else path
    parts = F.filter(F.split(below, "/"), lambda p: p != "")
    folders, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    bad = F.exists(folders, lambda p: p.startswith(".") | p.isin(*names) | _ends_with_any(p, suffixes))
    hidden = name.startswith(".") | name.isin(*JUNK) | F.contains(path, F.lit("/.")) | F.contains(path, F.lit("__MACOSX"))
    return ~bad & ~hidden & paths.media_type(name).isNotNull()


def _ends_with_any(x: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | x.endswith(s)
    return out


def scan(spark: SparkSession, root: str, names: tuple[str, ...] = EXCLUDED_NAMES, suffixes: tuple[str, ...] = EXCLUDED_SUFFIXES) -> DataFrame:
    """file_path, file_name, file_size, mime_type, media_type, modified_at of the media below root.

    Excluded folders are never entered. Only listings are read, no contents. See tree.files() for what a walk follows.
    """
    files = tree.files(spark, root, names, suffixes, hidden=False)
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(mtime))")  # in UTC whatever the session's zone
    rows = files.select(F.col("path").alias("file_path"), F.col("size").alias("file_size"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("modified_at"))
    name = paths.file_name(F.col("file_path"))
    return rows.where(scannable(F.col("file_path"), root.removeprefix("file://"), names, suffixes)).select("file_path", name.alias("file_name"), "file_size", paths.mime_type(name).alias("mime_type"), paths.media_type(name).alias("media_type"), "modified_at")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, size, mtime of every file below root, hidden ones too: what sync plans compare."""
    top = root.removeprefix("file://").rstrip("/")
    return tree.files(spark, root).select(F.substr("path", F.lit(len(top) + 2)).alias("rel_path"), "size", "mtime")


# ---- EXIF -------------------------------------------------------------------------------------

# TIFF tag numbers.
TAGS = {0x010F: "camera_make", 0x0110: "camera_model", 0x0112: "orientation", 0x0132: "date_time", 0x8769: "exif_ifd", 0x8825: "gps_ifd", 0x829A: "exposure_time", 0x829D: "aperture", 0x8827: "iso", 0x9003: "date_original", 0x920A: "focal_length", 0xA002: "width", 0xA003: "height", 0xA434: "lens_model"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


GPS_TAGS = range(1, 7)
BLOCK = 4096
LONGEST = 1 << 16  # bytes of a value; none of the wanted ones comes near


class Ranged:
    """Bytes of an open file by place, in blocks that are fetched once; ``fetched`` counts what was."""

    def __init__(self, file, start: int = 0, end: int | None = None):
        self.file, self.blocks, self.fetched = file, {}, 0
        self.start, self.end = start, file.seek(0, 2) if end is None else end

    def part(self, start: int, end: int) -> Ranged:
        """The same file between two places, which share its blocks."""
        out = object.__new__(Ranged)
        out.__dict__ = self.__dict__ | {"start": self.start + start, "end": min(self.end, self.start + end), "whole": getattr(self, "whole", self)}
        return out

    def _block(self, i: int) -> bytes:
        if i not in self.blocks:
            self.file.seek(i * BLOCK)
            self.blocks[i] = self.file.read(BLOCK)
            getattr(self, "whole", self).fetched += len(self.blocks[i])
        return self.blocks[i]

    def __getitem__(self, at: slice) -> bytes:
        a, b = self.start + at.start, min(self.start + at.stop, self.end)
        if a >= b:
            return b""
        first, last = a // BLOCK, (b - 1) // BLOCK
        return b"".join(self._block(i) for i in range(first, last + 1))[a - first * BLOCK : b - first * BLOCK]

    def unpack(self, kind: str, at: int) -> tuple:
        return struct.unpack(kind, self[at : at + struct.calcsize(kind)])


def _ifd(tiff: Ranged, at: int, order: str, wanted) -> dict[int, list]:
    """Values by tag; only those of wanted tags are fetched."""
    out: dict[int, list] = {}
    (n,) = tiff.unpack(order + "H", at)
    for i in range(n):
        tag, kind, count = tiff.unpack(order + "HHI", at + 2 + 12 * i)
        size = SIZES.get(kind, 0) * count
        if not size or size > LONGEST or tag not in wanted:
            continue
        start = at + 10 + 12 * i if size <= 4 else tiff.unpack(order + "I", at + 10 + 12 * i)[0]
        raw = tiff[start : start + size]
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = [raw.split(b"\0")[0].decode("utf-8", "replace").strip()]
        elif kind in (5, 10):
            pairs = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
            out[tag] = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * count, raw))
    return out


def _degrees(values: list | None, ref: list | None) -> float | None:
    if not values or len(values) < 3 or not ref or None in values[:3]:
        return None
    x = values[0] + values[1] / 60 + values[2] / 3600
    return -x if ref[0].upper() in ("S", "W") else x


def _segments(image: Ranged):
    """Marker, place and length of a JPEG's segments up to the picture, by their headers alone."""
    at = 2
    while image[0:2] == b"\xff\xd8" and len(head := image[at : at + 4]) == 4 and head[0] == 0xFF:
        size = int.from_bytes(head[2:4], "big")
        yield head[1], at, size
        if head[1] == 0xDA:
            return
        at += 2 + max(size, 2)


def _tiff_of(image: Ranged) -> Ranged | None:
    """The TIFF block of a JPEG's APP1 segment, or the file itself if it is TIFF."""
    if image[0:4] in (b"II*\0", b"MM\0*"):
        return image
    for marker, at, size in _segments(image):
        if marker == 0xE1 and image[at + 4 : at + 10] == b"Exif\0\0":
            return image.part(at + 10, at + 2 + size)
    return None


def _dimensions(image: Ranged) -> tuple[int, int] | None:
    head = image[0:26]
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    for marker, at, _ in _segments(image):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            size = image[at + 5 : at + 9]
            return struct.unpack(">HH", size)[::-1] if len(size) == 4 else None
    return None


def dimensions(content: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP or JPEG."""
    return _dimensions(Ranged(io.BytesIO(content)))


def exif_in(image: Ranged) -> dict:
    """EXIF facts of an image; all null where there are none or they cannot be read."""
    out: dict = dict.fromkeys((c.split()[0] for c in EXIF.split(", ")))
    try:
        if (tiff := _tiff_of(image)) is not None:
            order = "<" if tiff[0:2] == b"II" else ">"
            main = _ifd(tiff, tiff.unpack(order + "I", 4)[0], order, TAGS)
            sub = _ifd(tiff, main[0x8769][0], order, TAGS) if 0x8769 in main else {}
            gps = _ifd(tiff, main[0x8825][0], order, GPS_TAGS) if 0x8825 in main else {}
            named = {TAGS[t]: v[0] for d in (main, sub) for t, v in d.items() if v}
            for c in ("camera_make", "camera_model", "lens_model", "focal_length", "aperture", "iso", "orientation", "width", "height"):
                out[c] = named.get(c)
            taken = named.get("date_original") or named.get("date_time")
            out["date_taken"] = taken[:10].replace(":", "-") + taken[10:] if taken else None
            out["gps_latitude"], out["gps_longitude"] = _degrees(gps.get(2), gps.get(1)), _degrees(gps.get(4), gps.get(3))
            if gps.get(6) and gps[6][0] is not None:
                out["gps_altitude"] = -gps[6][0] if gps.get(5) == [1] else gps[6][0]
    except (struct.error, KeyError, IndexError, ValueError, TypeError):
        out = dict.fromkeys(out)
    if out["width"] is None and (size := _dimensions(image)):
        out["width"], out["height"] = size
    return out


def exif_of(content: bytes | None) -> dict:
    return exif_in(Ranged(io.BytesIO(content or b"")))


def _exif_rows(files: DataFrame, key: str, *more: str):
    """files mapped to key and EXIF columns by a function of one row's last value."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = to_arrow_schema(StructType.fromDDL(EXIF))

    def mapped(facts):
        def go(batches):
            for batch in batches:
                rows = [facts(b) for b in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in made)], names=["k", *made.names])

        kind = dict(files.dtypes)[key]
        return files.select(F.col(key).alias("k"), *(F.col(c) for c in more)).mapInArrow(go, f"k {kind}, {EXIF}").withColumnRenamed("k", key)

    return mapped


def read_exif(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key and the EXIF columns of each file's content."""
    return _exif_rows(files, key, content)(exif_of)


def read_exif_files(files: DataFrame, key: str = "path", path: str = "file_path") -> DataFrame:
    """key and the EXIF columns of files on a file system that all executors share.

    Segment headers and directories are followed by seeking, so of a file of any size some blocks of 4 KB are
    read. Files that cannot be opened have null columns.
    """

    def facts(name: str | None) -> dict:
        try:
            with open(name or "", "rb", buffering=0) as f:
                return exif_in(Ranged(f))
        except OSError:
            return exif_of(None)

    return _exif_rows(files, key, path)(facts)


def gps_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    return text.dms_degrees(d, m, s, ref)
