"""Manifest construction from paths, and its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import FLIP, NOTFLIP
from cohortlab.operators.constraints import accepted


def parse_paths(paths: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """relative_path -> sample_id, label, target, supplied_split, video_id, frame_number,
    source_key, valid.

    The label is the one class directory of the relative path, the file stem must be two
    groups of digits joined by an underscore; other rows are not valid and have nulls.
    """
    p = F.col(path_col)
    parts = F.transform(F.split(p, "/"), F.lower)
    found = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.isin(FLIP, NOTFLIP))
    stem = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    rows = paths.select(
        p.alias("relative_path"),
        F.when(F.size(F.array_distinct(found)) == 1, F.element_at(found, -1)).alias("label"),
        F.get(F.filter(parts, lambda x: x.isin("training", "testing")), F.lit(0)).alias("supplied_split"),
        F.nullif(F.regexp_extract(stem, r"^(\d+)_(\d+)\z", 1), F.lit("")).alias("video_id"),
        F.nullif(F.regexp_extract(stem, r"^(\d+)_(\d+)\z", 2), F.lit("")).cast("long").alias("frame_number"),
    )
    valid = F.col("label").isNotNull() & F.col("video_id").isNotNull()
    return rows.select(
        "*",
        F.substring(F.sha2(F.col("relative_path").cast("binary"), 256), 1, 16).alias("sample_id"),
        (F.col("label") == FLIP).cast("int").alias("target"),
        F.when(valid, F.concat("label", F.lit("::"), "video_id")).alias("source_key"),
        valid.alias("valid"),
    )


def build(paths: DataFrame) -> DataFrame:
    """The manifest of valid paths; raises on rows that cannot be told."""
    rows = parse_paths(paths)
    accepted(rows, F.col("valid") & F.col("supplied_split").isNotNull(), "paths without one class directory, a split directory or a video_frame stem")
    repeated = rows.groupBy("sample_id").agg(F.count("*").alias("n"))
    accepted(repeated, F.col("n") == 1, "sample ids repeat")
    return rows.drop("valid")


def collisions(frames: DataFrame) -> DataFrame:
    """Numeric ids that occur under both classes."""
    both = frames.groupBy("video_id").agg(F.count_distinct("label").alias("k")).where(F.col("k") == 2)
    return both.select(F.col("video_id").alias("shared_numeric_environment_id"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """All rows whose keys occur more than once, with the count."""
    many = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return df.join(many, list(keys))


def audit(frames: DataFrame, content: Column) -> DataFrame:
    """One row of counts; `content` is the digest that tells equal contents."""
    base = frames.agg(F.count("*").alias("n_images"), F.count_if(F.col("label") == FLIP).alias("n_flip"), F.count_if(F.col("label") == NOTFLIP).alias("n_notflip"), F.count_distinct("source_key").alias("n_reconstructed_sources"), F.count_distinct("video_id").alias("n_numeric_ids"))
    clash = collisions(frames).agg(F.count("*").alias("cross_label_numeric_collisions"))

    def over(keys: list[Column], name: str) -> DataFrame:
        return frames.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias(name))

    out = base
    for one in (clash, over([F.col("source_key"), F.col("frame_number")], "repeated_source_frames"), over([content.alias("c")], "duplicate_content_rows")):
        out = out.join(F.broadcast(one))  # one row each
    return out


def describe_sources(frames: DataFrame) -> DataFrame:
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    per = frames.groupBy("source_key").agg(F.count("*").alias("n"))
    s = per.agg(F.count("*").alias("count"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), q.alias("q"), F.max("n").alias("max"))
    return s.select("count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def histogram(frames: DataFrame, bins: int = 20) -> DataFrame:
    """Sources by frames in min(bins, sources) equal bins, the last one closed."""
    per = frames.groupBy("source_key").agg(F.count("*").alias("n"))
    span = per.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.least(F.count("*"), F.lit(bins)).alias("bins"))
    at = F.when(F.col("hi") == F.col("lo"), F.expr("bins div 2")).otherwise(F.least(F.expr("(n - lo) * bins div (hi - lo)"), F.col("bins") - 1))
    return per.join(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("sources"), F.min("n").alias("least"), F.max("n").alias("most"))


def fingerprint(splits: DataFrame, levels: int = 1) -> DataFrame:
    """Per regime, sha256 over the sorted rows: of blocks by three digits of the id for each of
    `levels`, then of the blocks of each coarser level, so that no task holds all rows. One
    level is for some ten million rows, two for 10^10; the digest depends on the number."""
    digest = lambda x: F.sha2(F.array_join(F.sort_array(F.collect_list(x)), "\n").cast("binary"), 256)
    rows = splits.select("regime", F.substring("sample_id", 1, 3 * levels).alias("b"), F.concat_ws("|", "sample_id", "source_key", "role").alias("x"))
    for level in range(levels - 1, -1, -1):
        blocks = rows.groupBy("regime", "b").agg(digest("x").alias("d"))
        rows = blocks.select("regime", F.substring("b", 1, 3 * level).alias("b"), F.concat_ws(":", "b", "d").alias("x"))
    return rows.groupBy("regime").agg(digest("x").alias("sha256"))


def first_per_label(frames: DataFrame) -> DataFrame:
    return frames.groupBy("label").agg(F.min_by("relative_path", "sample_id").alias("relative_path"), F.min("sample_id").alias("sample_id"))


def in_first(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
