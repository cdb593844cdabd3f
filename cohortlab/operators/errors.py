"""Error profiles and the choice of cases to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import columns as C
from cohortlab.operators.cohorts import regime_order
from cohortlab.operators.manifest import in_first
from cohortlab.operators.ranking import median


def profile(pred: DataFrame, *by: str, high: float = 0.9) -> DataFrame:
    wrong = F.col("prediction") != F.col("target")
    sure = wrong & (C.confidence() >= high)
    s = pred.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_errors"), F.count_if(sure).alias("high_confidence_errors"), *C.cells())
    return s.select(*by, "n_errors", F.round(C.ratio(F.col("n_errors"), F.col("n")), 6).alias("error_rate"), "fp", "fn", "high_confidence_errors", F.round(C.or_zero(C.ratio(F.col("high_confidence_errors"), F.col("n_errors"))), 6).alias("high_confidence_error_share"))


def extended(pred: DataFrame, *by: str) -> DataFrame:
    """Of the errors: which kind prevails, and how sure the model was of them."""
    e = pred.where(F.col("prediction") != F.col("target")).withColumn("c", C.confidence())
    s = e.groupBy(*by).agg(F.count_if(F.col("target") == 1).alias("fn"), F.count_if(F.col("target") == 0).alias("fp"), F.avg("c").alias("m"))
    q = median(e, "c", *by)
    s = s.join(q, list(by)) if by else s.join(F.broadcast(q))  # one row
    return s.select(*by, F.when(F.col("fn") >= F.col("fp"), "false_negative").otherwise("false_positive").alias("dominant_error_type"), F.round("m", 6).alias("mean_error_confidence"), F.round("median", 6).alias("median_error_confidence"), F.round(1 - F.col("m"), 6).alias("mean_error_true_class_probability"))


def _pools(by: list[str], pred: DataFrame, roles: dict[str, tuple[Column, str]], depth: int) -> DataFrame:
    """For each role its first `depth` rows a group: (by.., role, k, sample_id, ..).

    One scan: a row is laid out once a role that it may fill; the rank limit is applied
    before the shuffle as well as after it.
    """
    keys = {"confidence": -C.confidence(), "distance": F.abs(F.col("prob_flip") - 0.5)}
    may = F.array_compact(F.array(*[F.when(condition, F.struct(F.lit(role).alias("role"), keys[key].alias("k"))) for role, (condition, key) in roles.items()]))
    rows = pred.select(*by, "sample_id", "relative_path", "target", "prob_flip", "prediction", F.inline(may))
    return in_first(rows, [*by, "role"], [F.col("k"), F.col("sample_id")], depth)


def _conditions() -> tuple[Column, Column]:
    return F.col("prediction") != F.col("target"), F.col("prediction") == F.col("target")


def _resolve(by: list[str], pools: DataFrame, order: list[str]) -> DataFrame:
    """Role after role takes its first row that no earlier role has taken. A group has a
    handful of candidates, so the choice is a fold over one small array a group."""
    rank = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("role"))
    items = pools.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(rank.alias("o"), "k", "sample_id", "role", "relative_path", "target", "prob_flip", "prediction"))).alias("xs"))
    def add(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda y: (y["sample_id"] == x["sample_id"]) | (y["o"] == x["o"]))
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)
    chosen = items.select(*by, F.explode(F.aggregate("xs", F.slice("xs", 1, 0), add)).alias("x"))
    return chosen.select(*by, "x.*").drop("o", "k")


def four_cases(pred: DataFrame, *by: str) -> DataFrame:
    """Four roles a group, none twice the same sample; a role without a row has found = false."""
    wrong, right = _conditions()
    # fixed values: the names of the roles
    roles = {"Correct notflip": (right & (F.col("target") == 0), "confidence"), "Correct flip": (right & (F.col("target") == 1), "confidence"), "High-confidence error": (wrong, "confidence"), "Borderline error": (wrong, "distance")}
    chosen = _resolve(list(by), _pools(list(by), pred, roles, 2), list(roles))
    every = pred.select(*by).distinct().withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles])))
    return every.join(chosen, [*by, "role"], "left").withColumn("found", F.col("sample_id").isNotNull())


def many_cases(pred: DataFrame) -> DataFrame:
    """Five roles a regime and one more borderline row of regime O; only rows that exist."""
    wrong, right = _conditions()
    # fixed values: the names of the roles
    roles = {"correct_notflip": (right & (F.col("target") == 0), "confidence"), "correct_flip": (right & (F.col("target") == 1), "confidence"), "highest_conf_error": (wrong, "confidence"), "near_threshold_error": (wrong, "distance"), "near_threshold_correct": (right, "distance")}
    roles |= {"additional_borderline": (F.col("regime") == "O", "distance")}
    out = _resolve(["regime"], _pools(["regime"], pred, roles, 6), list(roles))
    return out.withColumnsRenamed({"role": "selection_role", "prediction": "predicted"})


def preview(cases: DataFrame, n: int = 4) -> DataFrame:
    """The first cases, in the order of regimes, roles and samples."""
    return cases.orderBy(regime_order(), "selection_role", "sample_id").limit(n)
