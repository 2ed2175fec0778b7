"""Mounted volumes from key: value listings, network shares from JSON listings, release feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import text


def volume_facts(lines: DataFrame, volume: str = "volume", line: str = "value") -> DataFrame:
    """volume, facts: a map of each volume's listing; the value is all that follows the first colon."""
    parts = F.split(F.trim(line), ":", 2)
    rows = lines.select(volume, F.trim(parts[0]).alias("k"), F.trim(F.get(parts, F.lit(1))).alias("v")).where("k <> '' and v is not null")
    # a repeated key keeps its largest value, so that the map does not depend on the order of lines
    one = rows.groupBy(volume, "k").agg(F.max("v").alias("v"))
    return one.groupBy(volume).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("facts"))


def byte_value(x: Column) -> Column:
    """Bytes of ``31.9 GB (31914983424 Bytes)`` or ``500107862016 B``, else null."""
    inner = F.regexp_extract(x, "\\(([^)]*)[Bb]ytes\\)", 1)
    bare = F.regexp_replace(F.trim(x), "( [Bb])+$", "")
    return F.coalesce(F.trim(inner).try_cast("long"), bare.try_cast("long"))


def is_removable(facts: Column) -> Column:
    """By removable media, by protocol, or by an external location that is not virtual."""
    get = lambda k: F.lower(F.coalesce(F.try_element_at(facts, F.lit(k)), F.lit("")))
    media, protocol = get("Removable Media"), get("Protocol")
    return F.contains(media, F.lit("removable")) | (media == "yes") | F.contains(protocol, F.lit("usb")) | F.contains(protocol, F.lit("secure digital")) | (F.contains(get("Location"), F.lit("external")) & (get("Virtual") != "yes"))


def share_folders(responses: DataFrame, body: str = "body") -> DataFrame:
    """name, path of the folders in JSON listings of a share; files are left out."""
    kind = "data struct<shares: array<struct<isdir: boolean, name: string, path: string>>, files: array<struct<isdir: boolean, name: string, path: string>>>"
    parsed = responses.select(F.from_json(body, kind).alias("r"))
    entries = F.concat(F.coalesce("r.data.shares", F.array().cast("array<struct<isdir: boolean, name: string, path: string>>")), F.coalesce("r.data.files", F.array().cast("array<struct<isdir: boolean, name: string, path: string>>")))
    return parsed.select(F.inline(entries)).where("isdir").select("name", "path")


def updates(releases: DataFrame, current: str, version: str = "version") -> DataFrame:
    """Releases newer than the current version."""
    return releases.where(text.is_newer(F.col(version), F.lit(current)))
