"""Report tables and their comparison with measured ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.cohorts import regime_order
from cohortlab.operators.temporal import COVERAGES


def drift(table: DataFrame, evidence: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells whose exact decimal values differ between two tables of text cells."""
    both = table.alias("a").join(evidence.alias("b"), key, "full")
    dec = lambda side, c: F.col(f"{side}.{c}").cast("decimal(18,6)")
    cells = [both.select(F.col(key).cast("int").alias(key), F.lit(c).alias("column"), dec("a", c).cast("double").alias("reported"), dec("b", c).cast("double").alias("measured")).where(~dec("a", c).eqNullSafe(dec("b", c))) for c in columns]
    return reduce(DataFrame.unionByName, cells)


def report_rules(table: DataFrame, evidence: DataFrame, *, url_prefix: str, sources: dict[str, int], rows_of_t: int) -> DataFrame:
    """(rule, violations) of a published table of eight progressive runs, as text cells.

    Eight rows, each run once; four runs of T before four of ST, each through the coverages in
    order; as many future sources as the regime has; all rows of T in one of its three parts;
    shares between 0 and 1; every run's address begins with `url_prefix` and stands in the
    evidence, a table of text lines. A cell that is no number breaks its rule.
    """
    n = F.col("run_number").try_cast("int")
    number = lambda c: F.col(c).try_cast("decimal(18,6)")
    regime = F.when(n <= 4, "T").otherwise("ST")
    coverage = F.element_at(F.array(*[F.lit(c) for c in COVERAGES]), F.greatest((n - 1) % 4 + 1, F.lit(1)))
    expected = F.when(F.col("regime") == "T", sources["T"]).otherwise(sources["ST"])
    shares = [number(c).between(0, 1) for c in ("future_macro_f1", "future_flip_recall", "matched_macro_f1", "matched_flip_recall")]
    told = {
        "run_order": n.between(1, 8) & (F.col("regime") == regime),
        "coverage_cycle": F.col("coverage_percent").try_cast("int") == coverage,
        "future_sources": F.col("n_future_sources").try_cast("int") == expected,
        "accounting": (F.col("regime") != "T") | (number("n_train") + number("n_validation") + number("n_future") == rows_of_t),
        "shares": reduce(lambda a, b: a & b, shares),
        "address": F.startswith(F.col("run_url"), F.lit(url_prefix)),
    }
    facts = table.agg((F.abs(F.count("*") - 8) + F.abs(F.count("*") - F.count_distinct("run_number"))).alias("eight_runs"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(rule) for rule, ok in told.items()])
    # addresses and lines are few: a report's
    shown = table.select("run_number", F.coalesce("run_url", F.lit("")).alias("run_url")).join(evidence.select("line"), F.contains(F.col("line"), F.col("run_url")) & (F.col("run_url") != ""), "left_anti")
    facts = facts.join(F.broadcast(shown.agg(F.count("*").alias("address_in_evidence"))))
    names = ["eight_runs", *told, "address_in_evidence"]
    return facts.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("violations")) for r in names])))


def error_bars(intervals: DataFrame) -> DataFrame:
    """Distances from the point to the interval's ends, 0 at least, regimes in report order."""
    point = F.col("point_macro_f1")
    return intervals.select(regime_order().cast("int").alias("position"), "regime", point, F.round(F.greatest(point - F.col("ci_lower"), F.lit(0.0)), 6).alias("below"), F.round(F.greatest(F.col("ci_upper") - point, F.lit(0.0)), 6).alias("above"))


def wide_metrics(rows: DataFrame, key: str, split: str, values: list[str], splits: list[str]) -> DataFrame:
    """One row a key with every metric prefixed by its split."""
    return rows.groupBy(key).agg(*[F.max(F.when(F.col(split) == s, F.col(v))).alias(f"{s}_{v}") for s in splits for v in values])


def transposed(one_row: DataFrame) -> DataFrame:
    """A single row as (name, value) rows of text."""
    names = one_row.columns
    return one_row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])))
