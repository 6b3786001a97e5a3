"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import WORD_CLASS, key_of, stage, text_or_empty

SEED = "mix-1"
#: Hex digits of the seeded order that name a slice of a source.
SLICE_DIGITS = 3


def cycled_weights(position: Column) -> Column:
    """Weights 1, 2, 3, 1, 2, 3, ... by a source's place in code point order."""
    return F.pmod(position - 1, F.lit(3)) + 1


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights=cycled_weights) -> DataFrame:
    """Capped water-filling over one row a source (skey, source_size).

    The sources share the total of all sizes by weight, none above
    ``max_epochs`` times its size; what a capped source leaves goes to the
    others by weight.  In the order of cap over weight, a source is capped
    exactly if its cap is at most its share of what the sources before it left.
    """
    dec = "decimal(38,0)"
    by_name = Window.orderBy(F.col("skey").startswith("n"), "skey")
    t = sizes.withColumn("w", weights(F.row_number().over(by_name)).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    level = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before, whole = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(whole)).withColumn("w_total", F.sum("w").over(whole))
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.col("w_total") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("capped", F.col("cap").cast(dec) * F.col("w_left") <= F.col("w").cast(dec) * F.col("left"))
    t = t.withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0)))
    t = t.withColumn("w_rest", F.sum(F.when(~F.col("capped"), F.col("w"))).over(whole))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("rest")).cast("double") / F.col("w_rest").cast("double"))
    return t.select("skey", "source_size", target.alias("target"))


def mix(docs: DataFrame, max_epochs: int = 3, seed: str = SEED, weights=cycled_weights, key: str | None = None) -> DataFrame:
    """How often the mixture takes each row of ``docs`` (doc_id, text, source).

    Returns doc_id, row, size, source_size, target, times, taken.  Every row is
    taken floor(target / source_size) times; the remaining fraction of a source
    is a prefix of its rows in seeded order: a row is in it when its middle
    word is, so a source misses its target by at most half of one document.
    ``row`` is the caller's ``key``, if one is named.  Null and blank texts have
    size 0 and count as in the prefix as any other; a null source is a source of
    its own, after all others; the order is drawn by doc_id (null: none) and
    text, so that only repeated rows share a place in it.  Without rows the
    result is empty.  Other columns are not read.
    """
    keep = ["row"] if key else []
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_or_empty())))
    size = F.regexp_count(text_or_empty(), F.lit(WORD_CLASS)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(key).cast("long").alias("row") for _ in keep], key_of("source").alias("skey"), draw.alias("draw"), size.alias("size"))
    rows = stage(rows.withColumn("slice", F.substring("draw", 1, SLICE_DIGITS)), "sizes")
    slices = rows.groupBy("skey", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    targets = source_targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), max_epochs, weights)
    slices = slices.join(targets, "skey").drop("slice_size")
    within = Window.partitionBy("skey", "slice").orderBy("draw", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(slices, ["skey", "slice"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.col("target") - F.col("whole") * F.col("source_size")
    middle = (F.col("slice_start") + F.col("before")) * 2 + F.col("size")
    rows = rows.withColumn("whole", whole)
    times = F.col("whole") + F.when(middle < part * 2, F.lit(1)).otherwise(F.lit(0))
    return rows.select("doc_id", *keep, "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))
