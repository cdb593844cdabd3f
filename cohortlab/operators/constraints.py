"""Rules that cohorts must keep, as counts of violations (0: kept)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.columns import REGIMES

#: Rows that a source must have in each regime and in a progressive study.
LEAST = {"S": 1, "T": 3, "ST": 2, "progressive": 4}
DEV = ("train", "validation")


def accounting(frames: DataFrame, splits: DataFrame) -> DataFrame:
    """Per regime: manifest rows missing, rows unknown to the manifest, ids that repeat."""
    per_id = splits.groupBy("regime", "sample_id").agg(F.count("*").alias("c"))
    marked = per_id.join(frames.select("sample_id", F.lit(1).alias("known")).distinct(), "sample_id", "left")
    per = marked.groupBy("regime").agg(F.count("known").alias("found"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("c") > 1).alias("repeated"))
    total = frames.agg(F.count_distinct("sample_id").alias("ids"))
    return per.join(F.broadcast(total)).select("regime", (F.col("ids") - F.col("found")).alias("missing"), "unknown", "repeated")  # total is one row


def leakage(splits: DataFrame) -> DataFrame:
    """Per regime: test sources, and how many of them are also in development."""
    by = splits.groupBy("regime", "source_key").agg(F.bool_or(F.col("role") == "test").alias("t"), F.bool_or(F.col("role").isin(*DEV)).alias("d"), F.count_distinct("role").alias("roles"))
    return by.groupBy("regime").agg(F.count_if("t").alias("test_sources"), F.count_if(F.col("t") & F.col("d")).alias("also_in_development"), F.count_if(F.col("roles") > 1).alias("sources_with_many_roles"))


def _edge(kind, role: str) -> Column:
    return kind(F.when(F.col("role") == role, F.col("frame_number")))


def chronology(splits: DataFrame) -> DataFrame:
    """Per regime T and ST: sources whose roles are not strictly in order."""
    by = splits.where(F.col("regime").isin("T", "ST")).groupBy("regime", "source_key").agg(
        *[_edge(f, r).alias(f"{n}_{r}") for r in ("train", "validation", "test", "context_unseen_early") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    )
    t = (F.col("hi_train") < F.col("lo_validation")) & (F.col("hi_validation") < F.col("lo_test"))
    st = F.when(F.col("hi_train").isNotNull(), F.col("hi_train") < F.col("lo_validation")).otherwise(F.col("hi_context_unseen_early") < F.col("lo_test"))
    kept = F.coalesce(F.when(F.col("regime") == "T", t).otherwise(st), F.lit(False))
    return by.groupBy("regime").agg(F.count("*").alias("sources"), F.count_if(~kept).alias("violations"))


def constraints(frames: DataFrame, splits: DataFrame) -> DataFrame:
    """(regime, rule, violations) of every rule: one pass by source, one by sample."""
    at = {"train": "train", "validation": "validation", "test": "test", "early": "context_unseen_early"}
    of = {n: F.col("role") == r for n, r in at.items()}
    edges = [f(F.when(of[n], F.col("frame_number"))).alias(f"{e}_{n}") for n in at for f, e in ((F.min, "lo"), (F.max, "hi"))]
    classes = [F.bool_or(of[n] & (F.col("label") == label)).alias(f"{n}_{label}") for n in ("train", "validation", "test") for label in ("flip", "notflip")]
    by = splits.groupBy("regime", "source_key").agg(*edges, *classes, F.count_distinct("role").alias("roles"))
    in_order = (F.col("hi_train") < F.col("lo_validation")) & (F.col("hi_validation") < F.col("lo_test"))
    early_late = F.when(F.col("hi_train").isNotNull(), F.col("hi_train") < F.col("lo_validation")).otherwise(F.col("hi_early") < F.col("lo_test"))
    kept = F.coalesce(F.when(F.col("regime") == "T", in_order).otherwise(early_late), F.lit(False))
    developed, tested = F.col("lo_train").isNotNull() | F.col("lo_validation").isNotNull(), F.col("lo_test").isNotNull()
    first = F.col("lo_train").isNotNull() | F.col("lo_early").isNotNull()
    lacks = sum((1 - (F.max(F.col(f"{n}_flip").cast("int")) * F.max(F.col(f"{n}_notflip").cast("int"))) for n in ("validation", "test")), 1 - F.max(F.col("train_flip").cast("int")) * F.max(F.col("train_notflip").cast("int")))
    facts = by.groupBy("regime").agg(
        lacks.cast("long").alias("both_classes"), F.count_if(tested & developed).alias("test_sources_disjoint"), F.count_if(F.col("roles") > 1).alias("one_role_a_source"),
        F.count_if(~kept).alias("chronology"), F.count_if(~first).alias("fitting_rows"),
    )
    applies = {"both_classes": REGIMES, "test_sources_disjoint": ("S", "ST"), "one_role_a_source": ("S",), "chronology": ("T", "ST"), "fitting_rows": ("T", "ST")}
    told = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations"), F.lit(list(regimes)).alias("where")) for rule, regimes in applies.items()])
    told = facts.select("regime", F.inline(told)).where(F.array_contains("where", F.col("regime"))).drop("where")
    a = accounting(frames, splits)
    n = frames.groupBy("source_key").agg(F.count("*").alias("n"))
    lengths = n.agg(*[F.count_if(F.col("n") < least).alias(r) for r, least in LEAST.items()])
    lengths = lengths.select(F.inline(F.array(*[F.struct(F.lit(r).alias("regime"), F.lit("minimum_length").alias("rule"), F.col(r).alias("violations")) for r in LEAST])))
    return a.select("regime", F.lit("row_accounting").alias("rule"), (F.col("missing") + F.col("unknown") + F.col("repeated")).alias("violations")).unionByName(told).unionByName(lengths)


class ConstraintViolation(ValueError):
    """A cohort breaks a rule; the message names the first ones."""


def enforce(rules: DataFrame) -> None:
    """Raise if any rule is violated."""
    bad = rules.where(F.col("violations") > 0).orderBy("regime", "rule").limit(10).collect()
    if bad:
        raise ConstraintViolation("; ".join(f"{r.regime}: {r.rule} ({r.violations})" for r in bad))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ConstraintViolation(f"missing columns: {missing}")
    return df


def accepted(df: DataFrame, condition: Column, message: str, first: int = 5) -> DataFrame:
    """`df`, after checking that every row meets the condition; the message names the first
    offenders by their first column."""
    bad = df.where(~F.coalesce(condition, F.lit(False))).select(df.columns[0]).limit(first).collect()
    if bad:
        raise ConstraintViolation(f"{message}: {', '.join(str(r[0])[:200] for r in bad)}")
    return df


def not_empty(df: DataFrame, message: str = "no rows") -> DataFrame:
    if df.isEmpty():
        raise ConstraintViolation(message)
    return df
