"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import key_of, stage, text_or_empty

SEED = "shard-1"
SLICE_DIGITS = 3
#: Slices of the fractional ranks; each is ordered by itself.
RANK_SLICES = 4096


def interleave(docs: DataFrame, shards: int = 24, seed: str = SEED) -> DataFrame:
    """Put each row of ``docs`` (doc_id, text, source) into one of ``shards`` shards.

    Rows are shuffled by a seed within their source; the row of rank r among n
    stands at (2 r - 1) / (2 n), so that in the order of these fractions every
    stretch holds the sources in their proportions.  The order is cut into
    shards whose counts are at most one apart (law ``rows``).  Neither ranking
    brings a source together: both count slices first and rank within a slice.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot,
    grown_shard (null, for the law ``key`` only), and source.  A null text is
    empty; a null source is a source of its own; repeated rows each get a slot.
    With fewer rows than shards some shards stay empty; without rows the result
    is empty.  Other columns are not read.
    """
    crc = F.crc32(text_or_empty())
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        key_of("source").alias("skey"),
        (F.octet_length(text_or_empty()) + 8).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
    )
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    rows = stage(rows.withColumn("draw", draw).withColumn("slice", F.substring("draw", 1, SLICE_DIGITS)), "shard_rows")

    slices = rows.groupBy("skey", "slice").agg(F.count(F.lit(1)).alias("n"))
    of_source = Window.partitionBy("skey")
    before = of_source.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("skey", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("slice_start"), F.sum("n").over(of_source).alias("source_rows"))
    within = Window.partitionBy("skey", "slice").orderBy("draw", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("place", F.row_number().over(within)).join(slices, ["skey", "slice"])
    share = (2 * (F.col("slice_start") + F.col("place")) - 1).cast("double") / (2 * F.col("source_rows")).cast("double")
    ranked = stage(ranked.select("doc_id", "source", "size", "text_crc32", "draw", share.alias("share"), F.floor(share * RANK_SLICES).cast("int").alias("cut")), "shard_ranks")

    cuts = ranked.groupBy("cut").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select("cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cut_start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("cut").orderBy("share", "draw", "doc_id", "source", "size", "text_crc32")
    placed = ranked.withColumn("place", F.row_number().over(within)).join(cuts, "cut")
    at = F.col("cut_start") + F.col("place") - 1
    shard = F.expr(f"at * {shards} div total")
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    placed = placed.withColumn("at", at).withColumn("shard", shard).withColumn("slot", F.col("at") - start)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
