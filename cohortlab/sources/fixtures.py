"""Inputs: events stand in for labelled frames of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.columns import FLIP, NOTFLIP, THRESHOLD, hash_number, prediction
from cohortlab.operators import ranking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def padded(c, width: int):
    """Left-padded with zeros, never cut."""
    text = c.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a user's events of one class are one source, ordered by time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    flip = F.col("event_type").isin("click", "purchase")
    rows = events.select(
        F.substring(F.sha2(F.col("event_id").cast("string").cast("binary"), 256), 1, 16).alias("sample_id"),
        "event_id",
        "ts",
        F.when(flip, FLIP).otherwise(NOTFLIP).alias("label"),
        flip.cast("int").alias("target"),
        F.when(hash_number("s", F.col("event_id")) % 5 == 0, "testing").otherwise("training").alias("supplied_split"),
        padded(F.col("user_id"), 4).alias("video_id"),
    ).withColumn("source_key", F.concat("label", F.lit("::"), "video_id"))
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (30 * 86_400_000_000))
    rows = ranking._ranked(rows, ["source_key"], day, ["ts", "event_id"], "frame_number", "_n").drop("_n", "ts")
    path = F.concat("supplied_split", F.lit("/"), "label", F.lit("/"), "video_id", F.lit("_"), padded(F.col("frame_number"), 6), F.lit(".jpg"))
    return rows.withColumn("relative_path", path)


def predictions(frames: DataFrame, salt: str = "p") -> DataFrame:
    """Scores in whole ten-thousandths, pulled to the true class less and less along a source."""
    pull = F.when(F.col("target") == 1, 4000 - 20 * F.col("frame_number")).otherwise(1000 + 20 * F.col("frame_number"))
    noise = F.expr("_noise div 2")
    score = F.greatest(F.lit(0), F.least(F.lit(9999), noise + pull)) / 10000.0
    scored = frames.withColumn("_noise", hash_number(salt, F.col("event_id")) % 10000).withColumn("prob_flip", score).drop("_noise")
    return scored.withColumn("prediction", prediction(THRESHOLD)).withColumn("correct", F.col("prediction") == F.col("target"))


def epoch_batches(spark: SparkSession, runs: int = 20, epochs: int = 30, batches: int = 8) -> DataFrame:
    """A training log: (run, epoch, batch, loss)."""
    grid = spark.range(runs * epochs * batches).select((F.expr(f"id div {epochs * batches}") + 1).alias("run"), (F.expr(f"id div {batches}") % epochs + 1).alias("epoch"), (F.col("id") % batches).alias("batch"))
    return grid.withColumn("loss", (hash_number("l", F.col("run"), F.col("epoch"), F.col("batch")) % 10000 + F.expr("100000 div epoch")) / 10000.0)


def epoch_scores(spark: SparkSession, runs: int = 20, epochs: int = 30) -> DataFrame:
    """Validation scores: (run, epoch, f1)."""
    grid = spark.range(runs * epochs).select((F.expr(f"id div {epochs}") + 1).alias("run"), (F.col("id") % epochs + 1).alias("epoch"))
    return grid.withColumn("f1", (hash_number("v", F.col("run"), F.col("epoch")) % 300 + 20 * F.least(F.col("epoch"), F.lit(12))) / 1000.0)


def trials(spark: SparkSession, sweeps: int = 4, attempts: int = 150) -> DataFrame:
    """Tuning attempts: (sweep, attempt, status, f1, weight_decay_mode, positive_weight_decay)."""
    grid = spark.range(sweeps * attempts).select((F.expr(f"id div {attempts}") + 1).alias("sweep"), (F.col("id") % attempts + 1).alias("attempt"))
    kind, number = hash_number("k", F.col("sweep"), F.col("attempt")) % 10, hash_number("t", F.col("sweep"), F.col("attempt"))
    return grid.select(
        "sweep",
        "attempt",
        F.when(kind == 0, "failed").otherwise("finished").alias("status"),
        F.when(kind == 0, F.lit(None)).when(kind == 1, 0.0).otherwise((number % 900 + 50) / 1000.0).alias("f1"),
        F.when(number % 3 == 0, "zero").otherwise("positive").alias("weight_decay_mode"),
        ((number % 50 + 1) / 10000.0).alias("positive_weight_decay"),
    )
