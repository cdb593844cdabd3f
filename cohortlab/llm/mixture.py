"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 48-bit hash of (seed, id, text), written as 12 hex digits. A source
takes whole copies of all its rows and, for what then is left of its target, the rows
whose hash lies below a threshold. The threshold is found from sums: one histogram of
words by (source, first three digits) gives the bucket in which the target is crossed;
only that bucket is looked at again with three more digits, and so on. Rows are never
sorted, and the final pass is a filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import WORD, materialize, row_hash, source_key, text_or_empty

DIGITS, LEVELS = 3, 4


def word_count(text_col: str):
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(key, source_size) -> (key, source_size, target): water-filling by weight.

    Weights repeat over the sources in code point order, null last. A source holds
    cap x its size at most; what it cannot hold is shared again by weight. With the
    sources sorted by cap / weight, the water level follows from running sums.
    """
    by_key, by_fill = Window.orderBy("key"), Window.orderBy("fill", "key")
    upto, every = by_fill.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("w", w)
        .withColumn("room", F.col("source_size") * float(cap))
        .withColumn("fill", F.col("room") / F.col("w"))
        .withColumn("level", (F.sum("source_size").over(every) - (F.sum("room").over(upto) - F.col("room"))) / (F.sum("w").over(every) - (F.sum("w").over(upto) - F.col("w"))))
        .withColumn("level", F.coalesce(F.min_by(F.when(F.col("fill") >= F.col("level"), F.col("level")), F.when(F.col("fill") >= F.col("level"), F.struct("fill", "key"))).over(every), F.lit(0.0)))
        .select("key", "source_size", F.least("room", F.col("w") * F.col("level")).alias("target"))
    )


def boundary(rows: DataFrame, state: DataFrame, digits: int) -> DataFrame:
    """Refine each source's threshold to `digits` hex digits.

    state: key, need (words still to take), prefix. A source whose rows all fit gets
    the prefix 'g', which is above every hash.
    """
    hist = rows.groupBy("key", F.substring("hash", 1, digits).alias("b")).agg(F.sum("size").alias("s"))
    w = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    crossed = (
        hist.join(state, "key")
        .withColumn("cum", F.sum("s").over(w))
        .where(F.col("cum") > F.col("need"))
        .groupBy("key")
        .agg(F.min_by(F.struct("b", (F.col("need") - (F.col("cum") - F.col("s"))).alias("left"), "s"), "b").alias("x"))
    )
    return materialize(
        state.join(crossed, "key", "left").select(
            "key",
            F.coalesce("x.left", "need").alias("need"),
            F.coalesce("x.b", F.when(F.col("prefix") == "", F.lit("g")).otherwise(F.col("prefix"))).alias("prefix"),
            F.coalesce("x.s", F.lit(0)).cast("long").alias("edge"),
        )
    )


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    return {"key": source_key(source_col), "size": word_count(text_col), "hash": F.substring(row_hash(seed, id_col, text_col), 1, DIGITS * LEVELS)}


def mix_plan(rows: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(key, size, hash) rows -> (key, source_size, target, whole, prefix, with_edge), one row a source.

    A source's row is held `whole` times, and once more if its hash is below `prefix`, or
    equal to it where `with_edge`.
    """
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = materialize(source_targets(sizes, weights, cap).withColumn("whole", whole.cast("long")))
    state = targets.select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"), F.lit("").alias("prefix"))
    inside = rows
    for level in range(1, LEVELS + 1):
        state = boundary(inside, state.select("key", "need", "prefix"), DIGITS * level)
        inside = inside.join(state.select("key", "prefix"), "key").where(F.startswith("hash", "prefix")).select("key", "size", "hash")
        if level == 1:
            inside = materialize(inside)
    edge = state.select("key", "prefix", (F.col("edge") <= 2 * F.col("need")).alias("with_edge"))
    return materialize(targets.join(edge, "key"))


def _copies(hash_: Column) -> Column:
    return F.col("whole") + ((hash_ < F.col("prefix")) | ((hash_ == F.col("prefix")) & F.col("with_edge"))).cast("long")


def mix_sources(docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    `copies` is how often the mix holds the document (0 .. ceil(cap)), `taken` its words
    there. Null text has size 0 and is never counted; a null source is a source of its
    own, sorted last; rows equal in id and text share one hash and so one fate; the row at
    the threshold is taken when that comes nearer to the target; an empty table gives an
    empty result. Only the named columns are read, so further columns cannot clash.
    """
    cols = _keyed(docs, seed, id_col, text_col, source_col)
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *[c.alias(n) for n, c in cols.items()]))
    plan = mix_plan(rows.select("key", "size", "hash"), weights, cap)
    return rows.join(plan, "key").withColumn("copies", _copies(F.col("hash"))).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: all columns of `docs`, each row as often as the mix holds it."""
    cols = _keyed(docs, seed, id_col, text_col, source_col)
    plan = mix_plan(materialize(docs.select(*[c.alias(n) for n, c in cols.items()])), weights, cap)
    inner = docs.select(F.struct("*").alias("row"), cols["key"].alias("key"), cols["hash"].alias("hash"))
    held = inner.join(plan, "key").select("row", _copies(F.col("hash")).cast("int").alias("copies")).where(F.col("copies") > 0)
    return held.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("row.*")
