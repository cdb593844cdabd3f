"""Sharding by proportional stratified interleaving.

Rows of a source are put in a seeded random order and get the fractional rank
(rank + offset) / n; sorting all rows by that fraction interleaves the sources evenly,
and equal cuts of the order are shards that each hold every source's share.

Both ranks are global and neither sorts in one task. A histogram over equal ranges of
the sort value gives each range's starting rank; a window ranks the rows inside a range
alone. Ranges split every source, so a hot source is dealt to as many tasks as its size
needs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import materialize, row_hash, source_key, text_or_empty

#: Bits of the shuffle hash.
BITS = 52
#: Rows for which one more range is opened, and the least and most ranges (powers of 2).
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1 << 15, 1 << 6, 1 << 16


def ranges_for(n: int) -> int:
    return 1 << min(max(math.ceil(math.log2(max(1, n / RANGE_ROWS))), LEAST_RANGES.bit_length() - 1), MOST_RANGES.bit_length() - 1)


def shard_rows(docs: DataFrame, *, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, text_crc32, shard, slot.

    Shards hold row counts at most one apart, and each source's rows at most two apart
    from its share; slots are gapless from 0 in each shard. Size is the text's UTF-8
    bytes plus 1; null text has no bytes and crc 0; a null source is a source of its own;
    rows equal in every column read are interchangeable; with fewer rows than shards some
    shards are empty. Only the named columns are read.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            source_key(source_col).alias("key"),
            (F.octet_length(text_or_empty(text_col)) + 1).cast("long").alias("size"),
            F.crc32(text_or_empty(text_col).cast("binary")).alias("crc"),
            F.conv(F.substring(row_hash(seed, id_col, text_col), 1, BITS // 4), 16, 10).cast("long").alias("h"),
        )
    )
    total = rows.count()
    k = ranges_for(total)
    rows = rows.withColumn("r", F.shiftright("h", BITS - k.bit_length() + 1))
    before = Window.partitionBy("key").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("key", "r").agg(F.count("*").alias("c")).select("key", "r", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(Window.partitionBy("key")).alias("n"))
    inside = Window.partitionBy("key", "r").orderBy("h", "id", "crc", "size")
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("key")).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    ranked = (
        rows.join(materialize(starts), ["key", "r"])
        .withColumn("frac", ((F.col("start") + F.row_number().over(inside) - 1) + offset) / F.col("n"))
        .select("id", "source", "key", "size", "crc", "h", "frac", F.least(F.floor(F.col("frac") * k), F.lit(k - 1)).cast("int").alias("g"))
    )
    ranked = materialize(ranked)
    upto = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    cuts = materialize(ranked.groupBy("g").agg(F.count("*").alias("c")).select("g", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("start")))
    order = Window.partitionBy("g").orderBy("frac", "key", "h", "id", "crc", "size")
    pos, n = F.col("pos"), F.lit(total).cast("long")
    return (
        ranked.join(cuts, "g")
        .withColumn("pos", F.col("start") + F.row_number().over(order) - 1)
        .withColumn("shard", F.expr(f"pos * {shards} div {max(1, total)}").cast("int"))
        .select(F.col("id").alias(id_col), "source", "size", F.col("crc").alias("text_crc32"), "shard", (pos - F.expr(f"(shard * {max(1, total)}L + {shards - 1}) div {shards}")).cast("long").alias("slot"))
    )
