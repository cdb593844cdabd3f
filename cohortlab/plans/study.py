"""Drivers: a model a regime, and the progressive study, over the distributed stand-in model.

A step's tables are written below a folder of its own together with the fingerprint of what
went into it; a step whose fingerprint is there is read and not run again, one with another
fingerprint is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.columns import REGIMES
from cohortlab.operators import metrics, models, temporal
from cohortlab.operators.constraints import ConstraintViolation, enforce
from cohortlab.sources import files


def input_digest(rows: DataFrame, *settings: object) -> str:
    """A digest of the rows' ids and parts, whatever their order, and of the settings."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "sample_id", "part").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    total = rows.agg(F.count("*").alias("n"), F.sum(h).alias("s")).first()
    return f"{total.n}:{total.s}:{'|'.join(map(str, settings))}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def step(rows: DataFrame, array_col: str, folder: str, *, epochs: int = 20, decay: float = 0.01) -> DataFrame:
    """Fit on the rows of part train, score those of part future or test, and keep the scores
    below `folder`; rows have sample_id, part, target and the features."""
    spark = rows.sparkSession
    digest = input_digest(rows, array_col, epochs, decay)
    if _exists(spark, f"{folder}/digest/_SUCCESS"):
        had = files.read_document(spark, f"{folder}/digest", "digest string").first().digest
        if had != digest:
            raise ConstraintViolation(f"{folder} holds a step of other rows or settings")
        return spark.read.parquet(f"{folder}/predictions")
    model = models.fit(rows.where("part = 'train'"), array_col, epochs=epochs, decay=decay)
    models.save(model, f"{folder}/model")
    files.write_table(models.score(rows.where("part IN ('future', 'test')"), model, array_col).drop(array_col), f"{folder}/predictions")
    files.write_document(spark.createDataFrame([(digest,)], "digest string"), f"{folder}/digest")  # last: the step is whole
    return spark.read.parquet(f"{folder}/predictions")


def regimes(splits: DataFrame, features: DataFrame, array_col: str, folder: str, **options) -> DataFrame:
    """Metrics of a model for each regime, fitted on its train rows and scored on its test rows.

    features: (sample_id, array). One step a regime, below `folder`/regime=..."""
    done = []
    for regime in REGIMES:
        rows = splits.where(F.col("regime") == regime).withColumn("part", F.col("role")).join(features.select("sample_id", array_col), "sample_id")
        done.append(step(rows, array_col, f"{folder}/regime={regime}", **options).withColumn("regime", F.lit(regime)))
    return metrics.basic(reduce(DataFrame.unionByName, done), "regime")


def progressive(frames: DataFrame, features: DataFrame, array_col: str, folder: str, *, coverages: tuple[int, ...] = temporal.COVERAGES, **options) -> dict[str, DataFrame]:
    """The tables of a progressive study: predictions, coverage, overall, horizon.

    One step a regime and coverage, in report order; a study that was broken off goes on behind
    its last whole step. The rules of the checkpoints are enforced before the first."""
    points = temporal.checkpoints(frames, coverages=coverages)
    broken = temporal.rules(points).withColumn("regime", F.concat_ws(" ", "regime", "coverage_percent"))
    enforce(broken.select("regime", "rule", "violations"))
    done = []
    for regime in ("T", "ST"):
        for percent in coverages:
            rows = points.where((F.col("regime") == regime) & (F.col("coverage_percent") == percent)).join(features.select("sample_id", array_col), "sample_id")
            done.append(step(rows, array_col, f"{folder}/regime={regime}/coverage={percent}", **options))
    scored = reduce(DataFrame.unionByName, done)
    return {"predictions": scored, "coverage": temporal.coverage(points), "overall": temporal.matched_suffix(scored), "horizon": temporal.horizon(scored)}

