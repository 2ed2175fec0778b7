"""Exact duplicates by a narrowing funnel, and near duplicates by banded perceptual hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaframe.functions import hashing
from mediaframe.operators import bloom, diameter, ranges
from mediaframe.operators.components import connected_components
from mediaframe.plans.storage import materialize

FLOOR = 102_400  # bytes; files must be larger
BUCKET_CAP = 500  # larger buckets are skipped: part of the result's definition
THRESHOLD = 5


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return df.join(counts, list(keys), "left_semi")


def exact_groups(files: DataFrame, floor: int = FLOOR, size: str = "file_size", content: str = "content", key: str = "id") -> DataFrame:
    """group_id, id, size, is_preferred: members of groups with equal content.

    Sizes that occur once drop out, then quick hashes that occur once, then full hashes. Contents are never
    shuffled, and only those of rows are read that pass a Bloom filter of the sizes that repeat; only those
    that pass one of the quick hashes that repeat are hashed whole. A filter lets nothing fall that repeats; what
    it lets through besides is told apart by the exact counts after it. A group is named by its smallest
    member, which is the preferred one. Null content drops out.
    """
    above = files.where(F.col(content).isNotNull() & (F.col(size) > floor)).select(F.col(key).alias("id"), F.col(size).alias("size"), F.col(content).alias("content"))
    sizes = materialize(above.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size"), "sizes")  # reads the size column alone
    some = bloom.passing(above, bloom.build(sizes, "size"), "size").withColumn("quick", hashing.quick_hash(F.col("content")))
    quick = materialize(some.groupBy("size", "quick").agg(F.count("*").alias("n")).where("n > 1").select("size", "quick"), "quick")
    few = bloom.passing(some, bloom.build(quick, "size", "quick"), "size", "quick")
    return _groups(materialize(few.select("id", "size", "quick", hashing.full_hash(F.col("content")).alias("full")), "full"))  # contents are hashed once


def exact_groups_of_files(listing: DataFrame, floor: int = FLOOR, path: str = "file_path", size: str = "file_size") -> DataFrame:
    """exact_groups of files on a file system that all executors share.

    Only files whose size repeats are opened, for their first 4096 bytes, and only those whose first
    bytes repeat as well are read through. Files that cannot be read drop out.
    """
    import hashlib

    import pandas as pd

    def hashed(name: str, most: int):
        def go(batches):
            for pdf in batches:
                out = []
                for p in pdf["id"]:
                    try:
                        with open(p, "rb") as f:
                            digest, left = hashlib.sha256(), most
                            while left and (chunk := f.read(min(left, hashing.BUFFER))):
                                digest.update(chunk)
                                left -= len(chunk)
                        out.append(digest.hexdigest())
                    except OSError:
                        out.append(None)
                yield pd.concat([pdf, pd.Series(out, name=name, index=pdf.index, dtype=object)], axis=1)

        return go

    rows = _repeated(listing.where(F.col(size) > floor).select(F.col(path).alias("id"), F.col(size).alias("size")), "size")
    quick = materialize(rows.mapInPandas(hashed("quick", hashing.QUICK_BYTES), "id string, size long, quick string").where("quick is not null"), "quick")
    some = _repeated(quick, "size", "quick")
    full = materialize(some.mapInPandas(hashed("full", 1 << 62), "id string, size long, quick string, full string").where("full is not null"), "full")
    return _groups(full)


def _groups(rows: DataFrame) -> DataFrame:
    groups = rows.groupBy("size", "quick", "full").agg(F.count("*").alias("n"), F.min("id").alias("group_id")).where("n > 1")
    return rows.join(groups, ["size", "quick", "full"]).select("group_id", "id", "size", (F.col("id") == F.col("group_id")).alias("is_preferred"))


def group_summary(members: DataFrame) -> DataFrame:
    """group_id, n, size, saved: what deleting all but one of each group frees."""
    return members.groupBy("group_id").agg(F.count("*").alias("n"), F.max("size").alias("size")).withColumn("saved", F.col("size") * (F.col("n") - 1))


def group_details(members: DataFrame, media: DataFrame) -> DataFrame:
    """Groups with an array of their members, in one join."""
    rows = members.join(media.withColumnRenamed("id", "media_id"), "media_id")
    return rows.groupBy("group_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("media_id", "file_path", "file_size", "is_preferred"))).alias("members"))


def group_pages(members: DataFrame, media: DataFrame, size: int = 500, page: int | None = None) -> DataFrame:
    """group_id, n, page, members: the members of every group in pages of ``size``, or one page of each.

    The array holds a page's members, never a whole group's, however many rows the group has.
    """
    rows = members.join(media.withColumnRenamed("id", "media_id"), "media_id").select("group_id", "media_id", "file_path", "file_size", "is_preferred")
    counts = rows.groupBy("group_id").agg(F.count("*").alias("n"))
    paged = ranges.pages(rows, "group_id", ["media_id"], size, page)
    arrays = paged.groupBy("group_id", "page").agg(F.array_sort(F.collect_list(F.struct("media_id", "file_path", "file_size", "is_preferred"))).alias("members"))
    return arrays.join(counts, "group_id").select("group_id", "n", "page", "members")


def trash_preview(members: DataFrame, groups: DataFrame, media: DataFrame, keep: str) -> DataFrame:
    """Members of pending groups that are not the kept one."""
    live = groups.where("status = 'pending'").select(F.col("id").alias("group_id"))
    return members.where(~F.col(keep)).join(live, "group_id", "left_semi").join(media.withColumnRenamed("id", "media_id"), "media_id")


def similar_candidates(media: DataFrame, exact_members: DataFrame) -> DataFrame:
    """Images that are not the surplus of an exact group."""
    surplus = exact_members.where("not is_preferred").select(F.col("media_id").alias("id"))
    return media.where("media_type = 'image'").join(surplus, "id", "left_anti")


def similar_pairs(hashes: DataFrame, threshold: int = THRESHOLD, cap: int = BUCKET_CAP, key: str = "id", phash: str = "phash") -> DataFrame:
    """a, b, distance: pairs within the threshold that share a band in a bucket of at most cap members.

    Buckets are counted and cut before the self-join, which bounds its skew at cap * cap / 2 pairs.
    """
    rows = hashes.where(F.col(phash).isNotNull()).select(F.col(key).alias("id"), F.col(phash).alias("h"))
    dealt = rows.select("id", "h", F.explode(hashing.bands(F.col("h"))).alias("bucket")).select("id", "h", "bucket.band", "bucket.value")
    sizes = dealt.groupBy("band", "value").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= cap)).drop("n")
    held = dealt.join(sizes, ["band", "value"])
    left, right = held.select("band", "value", F.col("id").alias("a"), F.col("h").alias("ha")), held.select("band", "value", F.col("id").alias("b"), F.col("h").alias("hb"))
    distance = hashing.hamming(F.col("ha"), F.col("hb"))
    return left.join(right, ["band", "value"]).where((F.col("a") < F.col("b")) & (distance <= threshold)).select("a", "b", distance.alias("distance")).distinct()


def similar_pairs_exact(hashes: DataFrame, threshold: int = THRESHOLD, key: str = "id", phash: str = "phash") -> DataFrame:
    """a, b, distance: every two different hashes within the threshold, by the smallest ids that hold them, and
    every other holder of a hash with its smallest.

    No bucket is skipped. The 64 bits are cut into threshold / 2 + 1 bands, so two hashes within the
    threshold differ by at most one bit in some band: one side looks up its bands, the other its bands
    and what is one bit away from them. With the threshold of 5 a band has 21 or 22 bits, so a bucket of N
    different hashes holds about N / 2 million of them. A pair counts in the first band that finds it.

    Both sides are sorted and merged: Spark takes them to be as small as the file of hashes before they are
    multiplied, 67 times on one side, and would otherwise broadcast them through the driver.
    """
    rows = materialize(hashes.where(F.col(phash).isNotNull()).select(F.col(key).alias("id"), F.col(phash).alias("h")), "rows")
    distinct = materialize(rows.groupBy("h").agg(F.min("id").alias("id")), "hashes")
    parts = threshold // 2 + 1
    ends = [64 * i // parts for i in range(parts + 1)]
    cut = lambda x, i: F.shiftrightunsigned(x, 64 - ends[i + 1]).bitwiseAND((1 << (ends[i + 1] - ends[i])) - 1)
    bands = F.array(*(F.struct(F.lit(i).alias("band"), cut("h", i).alias("value")) for i in range(parts)))
    near = [F.struct(F.lit(i).alias("band"), cut("h", i).bitwiseXOR(F.lit(flip)).alias("value")) for i in range(parts) for flip in [0, *(1 << k for k in range(ends[i + 1] - ends[i]))]]
    left = distinct.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.inline(bands))
    right = distinct.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.inline(F.array(*near)))
    distance = hashing.hamming(F.col("ha"), F.col("hb"))
    unmet = [(F.col("band") <= i) | (F.bit_count(cut(F.col("ha").bitwiseXOR(F.col("hb")), i)) > 1) for i in range(parts - 1)]  # by the bands before
    pairs = left.join(right.hint("merge"), ["band", "value"]).where(reduce(Column.__and__, unmet, (F.col("a") < F.col("b")) & (distance <= threshold))).select("a", "b", distance.alias("distance"))
    copies = rows.join(distinct.select("h", F.col("id").alias("a")).hint("merge"), "h").where("id <> a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return pairs.unionByName(copies)


def fill_hashes(media: DataFrame, *pictures: DataFrame, key: str = "id", phash: str = "phash") -> DataFrame:
    """id, phash, computed: stored hashes, and for media that lack one the hash of the first picture that is there.

    pictures: tables of id and cells, 64 gray values row by row, the preferred one (thumbnails) first. Only pictures of
    media without a hash are read on. Media without either have a null hash.
    """
    rows = materialize(media.select(F.col(key).alias("id"), F.col(phash).alias("phash")), "stored")  # what is lacking is asked for several times
    lacking = rows.where("phash is null").select("id")
    made = lacking
    for i, p in enumerate(pictures):
        one = p.where(F.size("cells") == 64).join(lacking.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("cells").alias(f"__c{i}"))
        made = made.join(one, "id", "left")
    cells = F.coalesce(*(F.col(f"__c{i}") for i in range(len(pictures)))) if pictures else F.lit(None).cast("array<long>")
    made = made.select("id", hashing.average_hash(cells).alias("phash")).distinct()
    return rows.where("phash is not null").withColumn("computed", F.lit(False)).unionByName(made.withColumn("computed", F.col("phash").isNotNull()))


def similar_job(media: DataFrame, exact_members: DataFrame, *pictures: DataFrame, exact: bool = True, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The whole job: (hashes to store, clusters). media: id, media_type, phash and what else it has.

    Candidates are images that are no surplus of an exact group; hashes that are missing are computed from pictures and come
    back for the store. exact: all pairs within the threshold; otherwise those of the original's capped bands.
    """
    hashes = materialize(fill_hashes(similar_candidates(media, exact_members), *pictures), "hashes")
    pairs = similar_pairs_exact(hashes, threshold) if exact else similar_pairs(hashes, threshold)
    return hashes.where("computed").select("id", "phash"), similar_clusters(pairs)


def similar_savings(clusters: DataFrame, media: DataFrame) -> DataFrame:
    """cluster, n, saved: what deleting all but the largest file of each cluster frees."""
    rows = media.select(F.col("id").alias("node"), "file_size").join(clusters.hint("merge"), "node")  # clusters are written small, and are as many rows as media
    return rows.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n"), (F.sum("file_size") - F.max("file_size")).alias("saved"))


def similar_clusters(pairs: DataFrame) -> DataFrame:
    """node, label: members of clusters, which are named by their smallest member."""
    return connected_components(pairs)


def cluster_scores(clusters: DataFrame, hashes: DataFrame, key: str = "id", phash: str = "phash") -> DataFrame:
    """cluster, n, score: 1 - (largest distance of any two members) / 64, over the whole cluster, by pivots and blocks."""
    rows = clusters.join(hashes.select(F.col(key).alias("node"), F.col(phash).alias("h")).hint("merge"), "node")
    far = diameter.farthest(rows)
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.join(far.hint("merge"), "label").select(F.col("label").alias("cluster"), "n", (1.0 - F.col("far") / 64.0).alias("score"))


def preferred(members: DataFrame, group: str, order: list[str], flag: str = "is_preferred") -> DataFrame:
    """Flags the member that is largest by order, the later of equal ones."""
    best = members.groupBy(group).agg(F.max(F.struct(*order)).alias("__best"))
    rows = members.join(best, group)
    return rows.withColumn(flag, F.struct(*order).eqNullSafe(F.col("__best"))).drop("__best")


def first_in_group(members: DataFrame, group: str, order: list[str], flag: str = "is_preferred") -> DataFrame:
    return members.withColumn(flag, F.row_number().over(W.partitionBy(group).orderBy(*order)) == 1)
