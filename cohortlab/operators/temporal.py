"""Chronological prefixes, their protected futures, and horizon windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions import columns as C
from cohortlab.operators.cohorts import _flagged, long_enough, unseen_sources
from cohortlab.operators.constraints import ConstraintViolation, not_empty
from cohortlab.operators.ranking import in_source_order

#: Shares of a source that are observed, and what a window needs to be reported.
COVERAGES = (25, 50, 75, 90)
WIDTH, LEAST_FRAMES, LEAST_SOURCES = 3, 20, 8


def checkpoints(frames: DataFrame, seed: int = 42, coverages: tuple[int, ...] = COVERAGES, regimes: tuple[str, ...] = ("T", "ST")) -> DataFrame:
    """Every row at every coverage and regime T and ST: part, horizon_position, frame_position_percent.

    The first floor(coverage x n) rows of a source, two at least, are observed; the last
    fifth of them, one at least, validates; the others train; the rest is future. In ST,
    withheld sources give the future only and the other sources all but the future. Other
    regimes and coverages, and sources of fewer than four rows, are refused.
    """
    if not regimes or not coverages or set(regimes) - {"T", "ST"} or set(coverages) - set(COVERAGES):
        raise ConstraintViolation(f"regimes {regimes} or coverages {coverages}")
    rows = _flagged(in_source_order(frames), unseen_sources(frames, seed), "source_key", "unseen")
    rows = rows.withColumn("coverage_percent", F.explode(F.array(*[F.lit(c) for c in coverages])))
    rows = rows.withColumn("observed", F.greatest(F.lit(2), F.floor(F.col("coverage_percent") / 100.0 * F.col("n"))))
    fitted = F.greatest(F.lit(1), F.col("observed") - F.greatest(F.lit(1), F.floor(F.lit(0.2) * F.col("observed"))))
    part = F.when(F.col("rn") <= fitted, "train").when(F.col("rn") <= F.col("observed"), "validation").otherwise("future")
    future = F.col("part") == "future"
    rows = rows.withColumn("part", long_enough(part, "progressive")).withColumn("regime", F.explode(F.array(*[F.lit(r) for r in regimes])))
    rows = rows.where((F.col("regime") == "T") | (F.col("unseen") == future))
    return rows.withColumn("horizon_position", F.when(future, F.col("rn") - F.col("observed"))).withColumn("frame_position_percent", F.when(future, F.col("rn") / F.col("n") * 100)).drop("observed")


def coverage(points: DataFrame) -> DataFrame:
    count = lambda p: F.count_if(F.col("part") == p).alias(f"n_{p}")
    return points.groupBy("regime", "coverage_percent").agg(count("train"), count("validation"), count("future"), F.count_distinct(F.when(F.col("part") == "future", F.col("source_key"))).alias("n_future_sources"))


def rules(points: DataFrame) -> DataFrame:
    """(regime, coverage_percent, rule, violations): each part holds rows of both classes, none is
    empty, no sample is in two parts and, in ST, no source is in the future and before it."""
    parts = ("train", "validation", "future")
    of = lambda p: F.col("part") == p
    per = points.groupBy("regime", "coverage_percent", "sample_id").agg(F.count_distinct("part").alias("k"))
    twice = per.groupBy("regime", "coverage_percent").agg(F.count_if(F.col("k") > 1).alias("samples_disjoint"))
    by = points.groupBy("regime", "coverage_percent", "source_key").agg(
        *[F.count_if(of(p) & (F.col("label") == label)).alias(f"{p}_{label}") for p in parts for label in ("flip", "notflip")]
    )
    rows = lambda p: F.col(f"{p}_flip") + F.col(f"{p}_notflip")
    both = F.count_if((rows("future") > 0) & (rows("train") + rows("validation") > 0))
    facts = by.groupBy("regime", "coverage_percent").agg(
        both.alias("both"), *[F.sum(rows(p)).alias(p) for p in parts], *[((F.sum(f"{p}_flip") == 0) | (F.sum(f"{p}_notflip") == 0)).cast("int").alias(f"{p}_one") for p in parts]
    )
    found = {
        "rows_in_every_part": F.lit(0) + sum(((F.col(p) == 0).cast("int") for p in parts[1:]), (F.col("train") == 0).cast("int")),
        "both_classes": F.col("train_one") + F.col("validation_one") + F.col("future_one"),
        "samples_disjoint": F.col("samples_disjoint"),
        "sources_disjoint": F.when(F.col("regime") == "ST", F.col("both")).otherwise(0),
    }
    rows_ = facts.join(twice, ["regime", "coverage_percent"])
    return rows_.select("regime", "coverage_percent", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), v.cast("long").alias("violations")) for n, v in found.items()])))


def future(points: DataFrame) -> DataFrame:
    return points.where(F.col("part") == "future")


def enriched(scored: DataFrame, ahead: DataFrame) -> DataFrame:
    """The scored rows with their place in each checkpoint's future. A sample has one score, and
    one place a checkpoint: the query fails on a sample that repeats on either side."""
    once = scored.groupBy("sample_id").agg(F.count("*").alias("_c"), *[F.first(c).alias(c) for c in scored.columns if c != "sample_id"])
    place = ahead.groupBy("regime", "coverage_percent", "sample_id").agg(F.count("*").alias("_k"), F.first("horizon_position").alias("horizon_position"), F.first("frame_position_percent").alias("p"))
    rows = once.join(place, "sample_id")
    checked = F.when((F.col("_c") > 1) | (F.col("_k") > 1), F.raise_error(F.concat(F.lit("not one to one: "), "sample_id")).cast("string")).otherwise(F.col("sample_id"))
    return rows.withColumn("sample_id", checked).withColumn("frame_position_percent", F.round("p", 6)).drop("_c", "_k", "p")


def horizon(pred: DataFrame, width: int = WIDTH, least_frames: int = LEAST_FRAMES, least_sources: int = LEAST_SOURCES) -> DataFrame:
    """Windows of `width` future positions; metrics only where each class has enough rows and sources."""
    k = F.floor((F.col("horizon_position") - 1) / width)
    def of(label: str, c) -> object:
        return F.when(F.col("label") == label, c)
    s = pred.groupBy("regime", "coverage_percent", k.alias("k")).agg(
        F.count("*").alias("n_frames"), F.count_distinct("source_key").alias("n_sources"), F.count(of("flip", F.lit(1))).alias("n_flip"), F.count(of("notflip", F.lit(1))).alias("n_notflip"),
        F.count_distinct(of("flip", F.col("source_key"))).alias("flip_sources"), F.count_distinct(of("notflip", F.col("source_key"))).alias("notflip_sources"), *C.cells(),
    )
    s = s.withColumn("reportable", (F.least("n_flip", "n_notflip") >= least_frames) & (F.least("flip_sources", "notflip_sources") >= least_sources))
    shown = lambda c: F.when(F.col("reportable"), c)
    return s.select(
        "regime", "coverage_percent", (F.col("k") * width + 1).alias("start_horizon"), (F.col("k") * width + width).alias("end_horizon"), "n_frames", "n_sources", "n_flip", "n_notflip", "flip_sources", "notflip_sources", "reportable",
        shown(F.round(C.macro_f1(), 6)).alias("macro_f1"), shown(F.round(C.or_zero(C.recall("tp", "fn")), 6)).alias("flip_recall"), shown(F.col("fn").cast("double")).alias("false_negatives"), shown(F.col("fp").cast("double")).alias("false_positives"),
    )


def matched_suffix(pred: DataFrame) -> DataFrame:
    """The whole future of each checkpoint beside the last tenth that all have in common."""
    late = pred.where(F.col("frame_position_percent") > 90)
    all_rows = pred.groupBy("regime", "coverage_percent").agg(F.count("*").alias("n_future"), *C.cells())
    precision, recall = C.or_zero(C.ratio(F.col("tp"), F.col("tp") + F.col("fp"))), C.or_zero(C.recall("tp", "fn"))
    whole = all_rows.select(
        "regime", "coverage_percent", "n_future", F.round(C.macro_f1(), 6).alias("future_macro_f1"), F.round(recall, 6).alias("future_flip_recall"),
        F.round(2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12)), 6).alias("future_flip_f1"), F.col("fn").alias("false_negatives"), F.col("fp").alias("false_positives"),
    )
    part = late.groupBy("regime", "coverage_percent").agg(F.count("*").alias("n_matched"), *C.cells()).select("regime", "coverage_percent", "n_matched", F.round(C.macro_f1(), 6).alias("matched_macro_f1"), F.round(recall, 6).alias("matched_flip_recall"))
    return whole.join(part, ["regime", "coverage_percent"], "left")


def coverage_delta(overall: DataFrame) -> DataFrame:
    """Change from the least to the greatest coverage, and whether every step rises."""
    w = Window.partitionBy("regime").orderBy("coverage_percent")
    steps = overall.withColumn("step", F.col("matched_macro_f1") - F.lag("matched_macro_f1").over(w))
    first, last = F.min_by("matched_macro_f1", "coverage_percent"), F.max_by("matched_macro_f1", "coverage_percent")
    return steps.groupBy("regime").agg(F.round(first, 6).alias("first_macro_f1"), F.round(last, 6).alias("last_macro_f1"), F.round(last - first, 6).alias("delta"), F.coalesce(F.bool_and(F.col("step") > 0), F.lit(False)).alias("rises"))


def frozen_cohort(frames: DataFrame, split: DataFrame) -> DataFrame:
    """One row of facts that a frozen ST split must keep: it covers the manifest, and its
    known and unseen sources are disjoint, complete, and both early and late."""
    by = split.groupBy("source_key").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("train", "validation", "context_unseen_early", "test")])
    known, unseen = F.col("train") + F.col("validation") > 0, F.col("context_unseen_early") + F.col("test") > 0
    per = by.agg(F.count_if(known).alias("known_sources"), F.count_if(unseen).alias("unseen_sources"), F.count_if(known & unseen).alias("in_both"), F.count_if(unseen & ((F.col("context_unseen_early") == 0) | (F.col("test") == 0))).alias("incomplete_unseen"), F.sum("context_unseen_early").alias("n_context"), F.sum("test").alias("n_late"))
    missing = frames.select("source_key").distinct().join(split.select("source_key").distinct(), "source_key", "left_anti").agg(F.count("*").alias("missing_sources"))
    return per.join(F.broadcast(missing))  # one row


def require_cohort(facts: DataFrame, unseen_sources: int | None = None, n_context: int | None = None, n_late: int | None = None) -> None:
    """Raise unless a frozen split is complete and disjoint and has the expected counts."""
    r = not_empty(facts).first()
    wrong = [n for n in ("in_both", "incomplete_unseen", "missing_sources") if r[n]]
    wrong += [n for n, want in (("unseen_sources", unseen_sources), ("n_context", n_context), ("n_late", n_late)) if want is not None and r[n] != want]
    if wrong:
        raise ConstraintViolation(f"frozen cohort: {', '.join(f'{n} = {r[n]}' for n in wrong)}")
