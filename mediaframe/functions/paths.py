"""Path columns: parents, extensions, ancestors, containment, globs, and the types they imply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that count as media, and the wider file types of folder reports.
IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif", "heic", "heif", "avif", "raw", "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "pef", "sr2", "raf")
VIDEOS = ("mp4", "mov", "avi", "mkv", "wmv", "flv", "webm", "m4v", "3gp", "mts", "m2ts")
FILE_TYPES = {
    "image": ("jpg", "jpeg", "png", "heic", "webp", "gif", "bmp", "tiff", "tif", "raw", "cr2", "nef", "arw", "dng", "svg", "ico"),
    "video": ("mp4", "mov", "avi", "mkv", "webm", "m4v", "wmv", "flv"),
    "audio": ("mp3", "wav", "flac", "aac", "ogg", "m4a", "wma"),
    "document": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "csv", "md"),
    "archive": ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "dmg", "iso"),
}
# MIME types by extension; any other extension is application/<extension>.
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tiff": "image/tiff", "tif": "image/tiff", "heic": "image/heif", "heif": "image/heif",
    "avif": "image/avif", "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm",
}


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column, name: Column) -> Column:
    """The folder, by the length of the file name."""
    return F.substr(path, F.lit(1), F.length(path) - F.length(name) - 1)


def parent_of(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def extension(name: Column) -> Column:
    """Lower-case extension; null if there is none. A leading dot alone starts no extension."""
    found = F.regexp_extract(name, "[^/]\\.([^./]*)$", 1)
    return F.when(found != "", F.lower(found))


def mime_type(name: Column) -> Column:
    ext = extension(name)
    known = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(F.try_element_at(known, ext), F.concat(F.lit("application/"), ext))


def media_type(name: Column) -> Column:
    """image, video, or null for what a scan does not keep."""
    ext = extension(name)
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*VIDEOS), "video")


def file_type(name: Column) -> Column:
    """image, video, audio, document, archive or other."""
    ext = extension(name)
    out = F.lit("other")
    for kind, names in FILE_TYPES.items():
        out = F.when(ext.isin(*names), kind).otherwise(out)
    return out


def ancestors(path: Column) -> Column:
    """Every folder above the path, from the top down; a leading slash belongs to the first."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.filter(F.when(n >= 1, made).otherwise(F.array().cast("array<string>")), lambda p: p != "")


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def under(path: Column, folder: str) -> Column:
    """Whether the path lies below the folder: no wildcards, and /a/b does not hold /a/bc."""
    return path.startswith(folder.rstrip("/") + "/")


def move_prefix(path: Column, old: str, new: str) -> Column:
    """The path after its folder has moved; itself where it lies elsewhere."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when(path == old, F.lit(new)).when(under(path, old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def glob_regex(pattern: str) -> str | None:
    """A regex for a glob: ``*`` and ``?`` cross slashes, ``**`` must be a whole component; None if malformed."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            j = i
            while j < len(pattern) and pattern[j] == "*":
                j += 1
            if j - i > 2:
                return None
            if j - i == 2:
                if (i and pattern[i - 1] != "/") or (j < len(pattern) and pattern[j] != "/"):
                    return None
                if j < len(pattern):  # "**/" also stands for no folder at all
                    out, i = out + "(?:.*/)?", j + 1
                    continue
            out, i = out + ".*", j
            continue
        if c == "[":
            close = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "!" else 2))
            if close < 0:
                return None
            inner = pattern[i + 1 : close]
            negated = inner.startswith("!")
            body = (inner[1:] if negated else inner).replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("^", "\\^").replace("&", "\\&")
            out, i = out + f"[{'^' if negated else ''}{body}]", close + 1
            continue
        out += "." if c == "?" else "\\" + c if c in "\\.^$|()[]{}+-&#~" else c
        i += 1
    return "(?s)^" + out + "$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern matches the whole relative path or its last component; malformed ones match nothing."""
    folded = F.translate(path, "\\", "/")
    name = file_name(folded)
    tests = [c.rlike(regex) for p in patterns if (regex := glob_regex(p)) for c in (folded, name)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))
