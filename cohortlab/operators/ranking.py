"""Ranks and running sums that no single task has to sort.

A group may hold a large share of all rows. It is cut into blocks along its order; counts
of the blocks give each block's first rank, and rows are ranked inside blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a source in one block, and hex digits that cut a hash order into blocks.
BLOCK, DIGITS = 4096, 3


def _ranked(df: DataFrame, keys: list[str], block: Column, order: list[Column | str], rank: str, total: str) -> DataFrame:
    rows = df.withColumn("_block", block)
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_c"))
    starts = counts.select(*keys, "_block", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_start"), F.sum("_c").over(Window.partitionBy(*keys)).alias(total))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return rows.join(starts, [*keys, "_block"]).withColumn(rank, F.col("_start") + F.row_number().over(inside)).drop("_block", "_start")


def in_source_order(df: DataFrame) -> DataFrame:
    """Adds rn (1..n by frame_number, sample_id inside the source) and n."""
    return _ranked(df, ["source_key"], F.floor(F.col("frame_number") / BLOCK), ["frame_number", "sample_id"], "rn", "n")


def in_hash_order(df: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """Adds r (rank inside the stratum by md5 of seed and key) and m (rows of the stratum)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)).cast("binary"))
    return _ranked(df.withColumn("_h", digest), [stratum], F.substring("_h", 1, DIGITS), ["_h", key], "r", "m").drop("_h")


def score_totals(df: DataFrame, keys: list[str], blocks: int = 1024) -> DataFrame:
    """Per distinct score, highest first: tp, fp, and the running totals above and with it
    (ctp, cfp), with the group's pos and neg."""
    ties = df.groupBy(*keys, "prob_flip").agg(F.count_if(F.col("target") == 1).alias("tp"), F.count_if(F.col("target") == 0).alias("fp"))
    ties = ties.withColumn("_block", -F.floor(F.col("prob_flip") * blocks))
    by_block = ties.groupBy(*keys, "_block").agg(F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    starts = by_block.select(
        *keys, "_block", F.coalesce(F.sum("_tp").over(before), F.lit(0)).alias("_stp"), F.coalesce(F.sum("_fp").over(before), F.lit(0)).alias("_sfp"), F.sum("_tp").over(every).alias("pos"), F.sum("_fp").over(every).alias("neg")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(F.col("prob_flip").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ties.join(starts, [*keys, "_block"]).select(*keys, "prob_flip", "tp", "fp", (F.col("_stp") + F.sum("tp").over(inside)).alias("ctp"), (F.col("_sfp") + F.sum("fp").over(inside)).alias("cfp"), "pos", "neg")


def median(df: DataFrame, value: str, *keys: str, blocks: int = 1024) -> DataFrame:
    """(keys.., median) of a value between 0 and 1: counts of blocks of the value tell in which the
    middle lies, so that no task holds all values of a group."""
    ties = df.groupBy(*keys, value).agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col(value) * blocks))
    by_block = ties.groupBy(*keys, "_block").agg(F.sum("_n").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_block.select(*keys, "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_all"))
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")
    held = starts.withColumn("_end", F.lead("_start", 1).over(Window.partitionBy(*keys).orderBy("_block")))
    held = held.where((F.col("_start") <= high) & (F.coalesce("_end", "_all") > low))  # the one or two blocks of the middle
    inside = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = ties.join(held.select(*keys, "_block", "_start", "_all"), [*keys, "_block"]).withColumn("_upto", F.col("_start") + F.sum("_n").over(inside))
    at = lambda k: F.max(F.when((k < F.col("_upto")) & (k >= F.col("_upto") - F.col("_n")), F.col(value)))
    return rows.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))
