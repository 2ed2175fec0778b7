"""Date columns over text: effective dates, day labels, folder names, tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCATEGORIZED = "미분류"  # fixed value: the folder of files without a usable date
# Timestamp formats in circulation.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
# Month folder names.
MONTHS = ("01-Jan", "02-Feb", "03-Mar", "04-Apr", "05-May", "06-Jun", "07-Jul", "08-Aug", "09-Sep", "10-Oct", "11-Nov", "12-Dec")


def effective_date(taken: Column, modified: Column) -> Column:
    """When it was taken, else when it was modified; text, compared as text."""
    return F.coalesce(taken, modified)


def day_label(taken: Column, modified: Column) -> Column:
    return F.coalesce(F.translate(F.substring(taken, 1, 10), ":", "-"), F.substring(modified, 1, 10))


def _pad2(x: Column) -> Column:
    """Left-padded to two characters; longer ones stay as they are."""
    return F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)


def day_folder(date: Column) -> Column:
    """YYYY-MM-DD of a date in any of its spellings, else the uncategorized folder. No range check."""
    parts = F.split(F.trim(date), "[:\\-T ]")
    year, month, day = (F.trim(F.get(parts, i)) for i in range(3))
    good = (F.size(parts) >= 3) & (F.octet_length(year) == 4) & year.rlike("^(19|20)")
    return F.when(good, F.concat_ws("-", year, _pad2(month), _pad2(day))).otherwise(F.lit(UNCATEGORIZED))


def month_folder(taken: Column) -> Column:
    """YYYY/MM-Mon; an unknown month stands as it is; null without at least a year and a month."""
    parts = F.split(F.get(F.split(F.trim(taken), "\\s+"), F.lit(0)), "[:-]")
    month = F.get(parts, F.lit(1))
    known = F.create_map(*(F.lit(x) for m in MONTHS for x in (m[:2], m)))
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.coalesce(F.try_element_at(known, month), month)))


def dated_name(name: Column) -> Column:
    """YYYY-MM-DD<suffix> of a name that starts YYYYMMDD with a plausible date, else null."""
    part = lambda a, n: F.substring(name, a, n).try_cast("int")
    good = name.rlike("^[0-9]{8}") & part(1, 4).between(1900, 2099) & part(5, 2).between(1, 12) & part(7, 2).between(1, 31)
    return F.when(good, F.concat(F.concat_ws("-", F.substring(name, 1, 4), F.substring(name, 5, 2), F.substring(name, 7, 2)), F.substr(name, F.lit(9))))


def parse(date: Column) -> Column:
    """A zoneless timestamp in the first format that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(date, F.lit(f)) for f in FORMATS)).cast("timestamp_ntz")
