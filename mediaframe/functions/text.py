"""Text matching as the catalog's searches define it, and small formatters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def escape_like(s: str) -> str:
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def fold(x: Column) -> Column:
    """Lower case for ASCII letters only, which is how LIKE compares here."""
    return F.translate(x, UPPER, LOWER)


def fold_str(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def contains(x: Column, needle: str) -> Column:
    """LIKE %needle% with the needle's wildcards escaped."""
    return fold(x).contains(fold_str(needle))


def like_raw(x: Column, pattern: str) -> Column:
    """LIKE with the pattern's own % and _ in force and no escape character."""
    return fold(x).like(fold_str(pattern).replace("\\", "\\\\"))


def error_code(x: Column) -> Column:
    """n of a message that starts ``[n] ``, else null."""
    return F.regexp_extract(x, "^\\[([0-9]+)\\]", 1).try_cast("int")


def base_url(x: Column) -> Column:
    """Trimmed, without trailing slashes, with http:// where no scheme is given."""
    bare = F.regexp_replace(F.trim(x), "/+$", "")
    return F.when(F.contains(bare, F.lit("://")), bare).otherwise(F.concat(F.lit("http://"), bare))


def human_size(n: Column) -> Column:
    """Bytes in B, KB, MB, GB or TB with one decimal from KB up, halves to the even one; null for null."""
    n = n.cast("double")
    out = F.when(n.isNotNull(), F.format_string("%.0f B", n))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024.0**i, F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**i, 1))).otherwise(out)
    return out


def coordinates(lat: Column, lng: Column) -> Column:
    side = lambda x, pos, neg: F.concat(F.format_string("%.4f", F.abs(x)), F.when(x >= 0, pos).otherwise(neg))
    return F.concat_ws(", ", side(lat, "°N", "°S"), side(lng, "°E", "°W"))


def short_path(x: Column) -> Column:
    """The last two segments."""
    parts = F.split(x, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def version_parts(v: Column) -> Column:
    """Numbers of a dotted version; a part without leading digits is 0."""
    bare = F.regexp_replace(F.trim(v), "^[vV]+", "")
    return F.transform(F.split(bare, "\\."), lambda p: F.coalesce(F.regexp_extract(p, "^([0-9]+)", 1).try_cast("long"), F.lit(0)))


def is_newer(latest: Column, current: Column) -> Column:
    """Whether one version's parts come after the other's; a longer version beats its own prefix."""
    return version_parts(latest) > version_parts(current)


def dms_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Signed degrees of degrees, minutes, seconds; south and west are negative; null without a reference."""
    x = d + m / 60 + s / 3600
    return F.when(F.upper(ref).isin("S", "W"), -x).when(ref.isNotNull(), x)
