"""Contiguous shards of near-equal bytes by global prefix sums.

The corpus is put in one order: groups of equal texts by their hash, and within a group by doc_id. Prefix sums come from totals,
in three levels that are each small or evenly dealt: totals of a fixed number of buckets of groups, sums over the groups of a
bucket, and for the rows of a group its parts (by a hash of doc_id), so that no window ever holds a large group whole. Shards
are cut at equal targets of the total. A group no larger than the largest document goes whole to the shard of its middle,
which leaves the balance as good as single documents allow; larger groups are cut row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, written

BUCKETS = 4096
#: Parts of a group of equal texts; a window holds one part at most.
PARTS = 256
OVERHEAD = 16


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"),
    )


GROUP = ["h1", "h2", "size"]


def shards(docs: DataFrame, count: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, a row for each row of ``docs``; the law is ``bytes``.

    Null texts are empty ones. Rows alike in doc_id and text get neighbouring slots; null doc_ids are dealt like others. Shards
    without a row are possible only if a document is larger than a shard's target. Texts of any length count with their bytes; only
    hashes of them are moved. An empty table gives an empty result. Other
    columns are neither read nor returned.
    """
    rows = written(sized(docs), "sized")
    parts = rows.groupBy(*GROUP, "part").agg(F.count("*").alias("n"))
    parts = written(parts, "parts")
    groups = parts.groupBy(*GROUP).agg(F.sum("n").alias("rows")).withColumn("bytes", F.col("size") * F.col("rows"))
    groups = written(groups.withColumn("bucket", F.shiftrightunsigned("h1", 52)), "groups")
    total = groups.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"), F.max("size").alias("largest"))
    total = written(total.coalesce(1), "totals")
    sums = total.agg(F.sum("b"), F.max("largest")).first()
    whole, largest = sums[0] or 1, sums[1] or 0
    before = offsets(offsets(total, ["bucket"], "b", "b0"), ["bucket"], "r", "r0").select("bucket", "b0", "r0")
    w = Window.partitionBy("bucket").orderBy(*GROUP).rowsBetween(Window.unboundedPreceding, -1)
    # before: a row for each of BUCKETS buckets at most, which bounds the broadcast
    placed = groups.join(F.broadcast(before), "bucket").select(
        *GROUP, "bytes",
        (F.col("b0") + F.coalesce(F.sum("bytes").over(w), F.lit(0))).alias("byte_at"),
        (F.col("r0") + F.coalesce(F.sum("rows").over(w), F.lit(0))).alias("row_at"),
    )
    in_group = Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(in_group), F.lit(0))).join(placed, GROUP)
    parts = parts.select(*GROUP, "part", "bytes", "byte_at", "row_at", "ahead")
    at = F.col("ahead") + F.row_number().over(Window.partitionBy(*GROUP, "part").orderBy("doc_id")) - 1
    # Both sides are dealt by (group, part), so the join needs no other shuffle than the window's.
    row = rows.join(parts, [*GROUP, "part"]).withColumn("at", at)
    middle = F.when(F.col("bytes") <= largest, 2 * F.col("byte_at") + F.col("bytes")).otherwise(2 * (F.col("byte_at") + F.col("at") * F.col("size")) + F.col("size"))
    row = row.withColumn("shard", F.least(F.expr("1L") * F.floor(middle / (2 * whole / count)), F.lit(count - 1)).cast("int"))
    row = written(row.select("doc_id", "size", "text_crc32", "shard", (F.col("row_at") + F.col("at")).alias("index")), "indexed")
    first = row.groupBy("shard").agg(F.min("index").alias("first"))
    # first: a row for each of ``count`` shards at most
    return row.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
