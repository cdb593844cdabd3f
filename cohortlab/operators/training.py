"""Training-log and tuning analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.functions import columns as C
from cohortlab.operators.constraints import ConstraintViolation


def epoch_log(batches: DataFrame) -> DataFrame:
    return batches.groupBy("run", "epoch").agg(F.round(F.avg("loss"), 9).alias("train_loss"), F.count("*").alias("batches"))


def improvements(scores: DataFrame) -> DataFrame:
    """Adds improved: strictly better than every earlier epoch of the run. NaN is never better."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    real = F.nanvl("f1", F.lit(None))
    return scores.withColumn("improved", F.coalesce(real > F.coalesce(F.max(real).over(before), F.lit(-1.0)), F.lit(False)))


def best_epoch(scores: DataFrame) -> DataFrame:
    """The earliest epoch of the run's best score; NaN scores do not count."""
    return scores.where(~F.isnan("f1")).groupBy("run").agg(F.max("f1").alias("best_f1"), F.max_by("epoch", F.struct("f1", -F.col("epoch"))).alias("best_epoch"))


def early_stop(scores: DataFrame, patience: int = 5) -> DataFrame:
    """Where each run stops: the first epoch `patience` after the last improvement, or its last."""
    upto = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    rows = improvements(scores).withColumn("last", F.max(F.when(F.col("improved"), F.col("epoch"))).over(upto))
    stop = F.min(F.when(F.col("epoch") - F.col("last") >= patience, F.col("epoch")))
    ends = rows.groupBy("run").agg(stop.alias("stop"), F.max("epoch").alias("end"))
    kept = rows.join(ends, "run").where(F.col("epoch") <= F.coalesce("stop", "end"))
    return kept.groupBy("run").agg(F.max("epoch").alias("last_epoch"), F.max("last").alias("best_epoch"), F.max("f1").alias("best_f1"), F.bool_or(F.col("stop").isNotNull()).alias("stopped_early"))


def best_stage(stages: DataFrame) -> DataFrame:
    """The stage of each run with the best score, the earlier one in a tie."""
    return stages.groupBy("run").agg(F.max_by("stage", F.struct("f1", -F.col("stage_order"))).alias("selected_stage"), F.max("f1").alias("f1"))


def qualifying(trials: DataFrame) -> DataFrame:
    """Adds qualifies: finished with a positive, finite score."""
    good = (F.col("status") == "finished") & (F.col("f1") > 0) & (F.col("f1") < float("inf"))  # NaN is above infinity
    return trials.withColumn("qualifies", F.coalesce(good, F.lit(False)))


def sweep_stop(trials: DataFrame, target: int = 30, factor: int = 5) -> DataFrame:
    """The attempts that are made: until `target` qualify, or factor x target attempts."""
    before = Window.partitionBy("sweep").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.sum(F.col("qualifies").cast("int")).over(before), F.lit(0))
    return qualifying(trials).withColumn("had", had).where((F.col("had") < target) & (F.col("attempt") <= factor * target)).drop("had")


def best_trial(trials: DataFrame) -> DataFrame:
    made = sweep_stop(trials).where((F.col("status") == "finished") & F.col("f1").isNotNull() & ~F.isnan("f1"))
    return made.groupBy("sweep").agg(F.max_by("attempt", F.struct("f1", -F.col("attempt"))).alias("attempt"), F.max("f1").alias("f1"))


def sweep_summary(trials: DataFrame, target: int = 30) -> DataFrame:
    made = sweep_stop(trials, target)
    s = made.groupBy("sweep").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "finished").alias("finished"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("f1") == 0).alias("zero_f1"), F.count_if("qualifies").alias("qualifying"), F.max("f1").alias("best_f1"))
    return s.withColumn("target_reached", F.col("qualifying") >= target)


def require_trials(trials: DataFrame, target: int = 30) -> None:
    """Raise if a sweep ends with fewer than `target` qualifying trials."""
    short = sweep_summary(trials, target).where(~F.col("target_reached")).orderBy("sweep").limit(5).collect()
    if short:
        raise ConstraintViolation("too few qualifying trials: " + ", ".join(f"sweep {r.sweep}: {r.qualifying}" for r in short))


def resolve_config(trials: DataFrame) -> DataFrame:
    return trials.withColumn("weight_decay", F.when(F.col("weight_decay_mode") == "zero", 0.0).otherwise(F.col("positive_weight_decay")))


def append_log(rows: DataFrame, path: str) -> None:
    """Add epoch or trial rows to the log table at `path`, which keeps what it has."""
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The rows of a log table; of rows that a repeated attempt has logged again (equal keys,
    and a logged_at) the last one."""
    rows = spark.read.parquet(path)
    if not keys:
        return rows
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "logged_at").alias("r")).select(*keys, "r.*")


def losses(logits: DataFrame) -> DataFrame:
    """(logit, target) -> probability and cross-entropy."""
    return logits.withColumn("prob", F.round(C.sigmoid(F.col("logit")), 9)).withColumn("loss", F.round(C.log_loss(F.col("logit"), F.col("target")), 9))


def channels(configs: DataFrame, most: int = 256) -> DataFrame:
    """(depth, filters) -> the channels of each layer, doubled up to `most`."""
    grow = F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda k: F.least(F.col("filters") * F.pow(F.lit(2), k), F.lit(most)).cast("int"))
    return configs.select("depth", "filters", F.posexplode(grow).alias("layer", "channels"))
