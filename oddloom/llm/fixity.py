"""Merkle fixity audit of archive replicas.

A record is hashed with its offset and length. Records that start in the same 64 KiB of a file form a leaf, sixteen
neighbouring nodes a node above, up to one root per file: every node stands for an ordered range of offsets. Replicas
are compared root by root, and only mismatching branches are descended, down to the records that differ.

Cases: rows without a file or offset are no records; equal records at one offset are one leaf entry with their number,
different ones enter by order-free sums, so that no group grows with repeats; null lengths and digests differ from any
value; other columns are left out; an empty replica misses every record, two empty ones differ in nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.running import running_sums
from ..session import cut_lineage

LEAF, FAN, FILE = 1 << 16, 16, 1 << 24
AT = ["file_no", "rec_offset"]


def warc_record(url: str, body: str) -> Column:
    """A response record: header lines, a blank line, the body, two line ends."""
    own = F.coalesce(F.col(body), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(own).cast("string"), F.lit("\r\n\r\n"), own, F.lit("\r\n\r\n"))


def laid_out(records: DataFrame, order: list[str], length: str, file_bytes: int = FILE) -> DataFrame:
    """Adds file_no and rec_offset: records one after another in ``order``, a new file every ``file_bytes``."""
    tied = records.withColumn("__tie", F.monotonically_increasing_id())
    placed = running_sums(tied, [*order, "__tie"], {"__at": F.col(length).cast("long")}, inclusive=False)
    return placed.withColumn("file_no", F.floor(F.col("__at") / file_bytes).cast("long")).withColumn(
        "rec_offset", F.pmod("__at", F.lit(file_bytes)).cast("long")).drop("__at", "__tie")


def _entries(records: DataFrame) -> DataFrame:
    """One row per file and offset, hashed; the first length stands for the place."""
    digest, length = F.coalesce("digest", F.lit("-")), F.coalesce("rec_length", F.lit(-1))
    return records.filter("file_no IS NOT NULL AND rec_offset IS NOT NULL").groupBy(*AT).agg(
        F.min("rec_length").alias("rec_length"),
        F.concat_ws(":", F.col("rec_offset"), F.count("*"), F.min(length), F.max(length), F.min(digest), F.max(digest),
                    F.sum(F.xxhash64(digest, length).cast("decimal(38,0)"))).alias("entry"),
    ).select(*AT, "rec_length", F.sha2("entry", 256).alias("digest"))


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Entries, then the nodes (file_no, node, digest) of every level from the leaves to the root."""
    entries = cut_lineage(_entries(records), "entries")
    at, key = F.col("rec_offset"), F.floor(F.col("rec_offset") / LEAF).cast("long")
    below = entries.select("file_no", key.alias("node"), at.alias("place"), "digest")
    out = [entries]
    for level in range(levels):
        parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        nodes = below.groupBy("file_no", "node").agg(F.sha2(F.array_join(parts, ""), 256).alias("digest"))
        nodes = cut_lineage(nodes, f"level{level}")
        out.append(nodes)
        below = nodes.select("file_no", F.floor(F.col("node") / FAN).cast("long").alias("node"), F.col("node").alias("place"), "digest")
    return out


def levels_for(*replicas: DataFrame) -> int:
    """Levels until one node spans the longest file of any replica."""
    last = max(r.agg(F.max("rec_offset")).first()[0] or 0 for r in replicas)
    levels, span = 1, LEAF
    while span <= last:
        levels, span = levels + 1, span * FAN
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    both = a.join(b.withColumnRenamed("digest", "digest2").drop("rec_length"), keys, "full_outer")
    return both.filter(~F.col("digest").eqNullSafe(F.col("digest2")))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """file_no, rec_offset, rec_length, damage of every place where the replicas differ.

    Records are (file_no, rec_offset, rec_length, digest); damage is changed, missing (from the replica) or extra.
    """
    levels = levels_for(primary, replica)
    ours, theirs = tree(primary, levels), tree(replica, levels)
    bad = _differing(ours[-1], theirs[-1], ["file_no", "node"]).select("file_no", "node")
    for level in range(levels - 1, 0, -1):
        def under(nodes: DataFrame) -> DataFrame:
            above = F.floor(F.col("node") / FAN).cast("long")
            return nodes.withColumn("above", above).join(bad.toDF("file_no", "above"), ["file_no", "above"], "left_semi").drop("above")

        bad = _differing(under(ours[level]), under(theirs[level]), ["file_no", "node"]).select("file_no", "node")

    def inside(entries: DataFrame) -> DataFrame:
        leaf = F.floor(F.col("rec_offset") / LEAF).cast("long")
        return entries.withColumn("node", leaf).join(bad, ["file_no", "node"], "left_semi").drop("node")

    left, right = inside(ours[0]), inside(theirs[0]).withColumnRenamed("rec_length", "length2")
    both = left.join(right.withColumnRenamed("digest", "digest2"), AT, "full_outer")
    damage = F.when(F.col("digest2").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return both.filter(~F.col("digest").eqNullSafe(F.col("digest2"))).select(
        *AT, F.coalesce("rec_length", "length2").alias("rec_length"), damage.alias("damage"))
