"""Metrics of scored predictions, as functions of confusion counts and score totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import columns as C
from cohortlab.operators.ranking import score_totals


def confusion(pred: DataFrame, *by: str) -> DataFrame:
    return pred.groupBy(*by).agg(*C.cells())


def basic(pred: DataFrame, *by: str) -> DataFrame:
    six = lambda c: F.round(c, 6)
    return confusion(pred, *by).select(
        *by, (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_images"),
        six(C.accuracy()).alias("accuracy"), six(C.balanced_accuracy()).alias("balanced_accuracy"), six(C.macro_f1()).alias("macro_f1"),
        six(C.or_zero(C.ratio(F.col("tp"), F.col("tp") + F.col("fp")))).alias("flip_precision"), six(C.or_zero(C.recall("tp", "fn"))).alias("flip_recall"),
        "tn", "fp", "fn", "tp",
    )


def extended(pred: DataFrame, *by: str) -> DataFrame:
    """Per-class scores, support-weighted F1, and the correlation coefficient."""
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    weighted = C.ratio(C.f1("tp") * pos + C.f1("tn") * neg, pos + neg)
    return confusion(pred, *by).select(
        *by,
        *[
            F.round(c, 6).alias(n)
            for n, c in {
                "notflip_precision": C.or_zero(C.ratio(F.col("tn"), F.col("tn") + F.col("fn"))),
                "notflip_recall": C.or_zero(C.recall("tn", "fp")),
                "notflip_f1": C.f1("tn"),
                "flip_f1": C.f1("tp"),
                "weighted_f1": weighted,
                "mcc": C.or_zero(C.mcc()),
            }.items()
        ],
    )


def roc_auc(pred: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve, ties averaged; null when a class is absent."""
    t = score_totals(pred, list(by))
    area = F.sum(F.col("fp") * (F.col("ctp") - F.col("tp") / 2))
    return t.groupBy(*by).agg(F.round(C.ratio(area, F.max("pos") * F.max("neg")), 6).alias("roc_auc_flip"))


def average_precision(pred: DataFrame, *by: str) -> DataFrame:
    """Step sum of precision over recall; null when a class is absent."""
    t = score_totals(pred, list(by))
    step = F.sum(C.ratio(F.col("tp"), F.col("pos")) * C.ratio(F.col("ctp"), F.col("ctp") + F.col("cfp")))
    return t.groupBy(*by).agg(F.round(F.when((F.max("pos") > 0) & (F.max("neg") > 0), step), 6).alias("pr_auc_flip"))


def missed_rate(pred: DataFrame, *by: str) -> DataFrame:
    return confusion(pred, *by).select(*by, (F.col("tp") + F.col("fn")).alias("positives"), F.col("fn").alias("missed"), F.round(C.ratio(F.col("fn"), F.col("tp") + F.col("fn")), 6).alias("missed_rate"))
