"""Cluster, paired and frame bootstrap over sufficient statistics.

Macro F1 depends on four counts that add over sources. A resample is the sum of the drawn
sources' counts, so the cost is resamples x sources however many frames there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import columns as C
from cohortlab.operators import draws as D
from cohortlab.operators import ranking
from cohortlab.operators.constraints import ConstraintViolation

PARTS = ("tn", "fp", "fn", "tp")
#: Characters of a source's key that make a block.
PREFIX = 11


def numbered(per_source: DataFrame, *by: str) -> DataFrame:
    """Adds idx (0.. by source_key, as draws number them) and k (sources); ranked in blocks."""
    rows = ranking._ranked(per_source, list(by), F.substring("source_key", 1, PREFIX), ["source_key"], "idx", "k")
    return rows.withColumn("idx", F.col("idx") - 1)


def numpy_sums(per: DataFrame, names: tuple[str, ...], reps: int, seed: int, *by: str) -> DataFrame:
    """The sums of draws as numpy's default generator makes them row after row, for each group anew."""
    rows = []
    for g in per.select(*by, "k").distinct().collect():  # a row a group
        rng = np.random.default_rng(seed)
        rows += [(*[g[b] for b in by], r + 1, rng.integers(0, g.k, g.k).tolist()) for r in range(reps)]
    kinds = "".join(f"`{b}` {per.schema[b].dataType.simpleString()}, " for b in by)
    drawn = per.sparkSession.createDataFrame(rows, f"{kinds}rep int, idx array<long>").select(*by, "rep", F.explode("idx").alias("idx"))
    return drawn.join(per.select(*by, "idx", *names), [*by, "idx"]).groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])


def cluster_bootstrap(pred: DataFrame, *by: str, reps: int = 5000, seed: int = 42, draws: str = "hash") -> DataFrame:
    """Percentile interval of macro F1 over resampled sources; `draws` is hash or numpy."""
    counts = pred.groupBy(*by, "source_key").agg(*C.cells()).persist()  # a short row a source; all below reads no frame again
    per = numbered(counts, *by).persist()
    sums = {"hash": D.sums, "numpy": numpy_sums}[draws](per, PARTS, reps, seed, *by)
    scores = sums.select(*by, C.macro_f1().alias("s"))
    point = per.groupBy(*by).agg(F.count("*").alias("n_sources"), *[F.sum(p).alias(p) for p in PARTS]).select(*by, "n_sources", F.round(C.macro_f1(), 6).alias("point_macro_f1"))
    return point.join(interval(scores, *by), list(by)) if by else point.join(F.broadcast(interval(scores)))


def interval(scores: DataFrame, *by: str) -> DataFrame:
    q = F.percentile("s", F.array(F.lit(0.025), F.lit(0.975)))
    s = scores.groupBy(*by).agg(F.count("*").alias("n_resamples"), F.avg("s").alias("m"), F.stddev_samp("s").alias("sd"), q.alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return s.select(*by, "n_resamples", F.round("m", 6).alias("bootstrap_mean"), F.round("sd", 6).alias("bootstrap_std"), F.round(lo, 6).alias("ci_lower"), F.round(hi, 6).alias("ci_upper"), F.round(hi - lo, 6).alias("ci_width"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both prediction sets by sample: target, source_key, prediction_a, prediction_b."""
    left = a.select("sample_id", "source_key", "target", F.col("prediction").alias("prediction_a"))
    return left.join(b.select("sample_id", F.col("prediction").alias("prediction_b")), "sample_id")


def pairing(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows, rows of each side without a partner, ids that repeat on a side."""
    one = lambda df, n: df.groupBy("sample_id").agg(F.count("*").alias(n))
    both = one(a, "ca").join(one(b, "cb"), "sample_id", "full")
    return both.agg(F.count_if(F.col("ca").isNotNull() & F.col("cb").isNotNull()).alias("paired"), F.count_if(F.col("cb").isNull()).alias("only_a"), F.count_if(F.col("ca").isNull()).alias("only_b"), F.count_if((F.col("ca") > 1) | (F.col("cb") > 1)).alias("repeated"))


def require_paired(a: DataFrame, b: DataFrame) -> None:
    """Raise unless both prediction sets hold exactly the same samples, each once."""
    r = pairing(a, b).first()
    if not r.paired or r.only_a or r.only_b or r.repeated:
        raise ConstraintViolation(f"predictions are not exactly paired: {r.asDict()}")


def paired_bootstrap(a: DataFrame, b: DataFrame, reps: int = 5000, seed: int = 42) -> DataFrame:
    """Interval of macro F1 of b minus a over the same resampled sources; raises unless the two
    prediction sets hold the same samples, each once."""
    require_paired(a, b)
    rows = paired(a, b)
    def cells(side: str) -> list:
        hit = lambda t, p: F.count_if((F.col("target") == t) & (F.col(f"prediction_{side}") == p))
        return [hit(t, p).alias(f"{n}_{side}") for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    names = tuple(f"{p}_{s}" for s in "ab" for p in PARTS)
    counts = rows.groupBy("source_key").agg(*cells("a"), *cells("b")).persist()  # as in cluster_bootstrap
    per = numbered(counts).persist()
    sums = D.sums(per, names, reps, seed)
    total = per.agg(*[F.sum(n).alias(n) for n in names])
    def side(df: DataFrame, s: str, out: str) -> DataFrame:
        return df.withColumns({p: F.col(f"{p}_{s}") for p in PARTS}).withColumn(out, C.macro_f1()).drop(*PARTS)
    delta = lambda df: side(side(df, "a", "fa"), "b", "fb").select((F.col("fb") - F.col("fa")).alias("s"))
    point = delta(total).select(F.round("s", 6).alias("point_delta"))
    return point.join(F.broadcast(interval(delta(sums)).select("n_resamples", "ci_lower", "ci_upper")))  # one row


def frame_bootstrap(pred: DataFrame, *by: str, reps: int = 5000, seed: int = 42, draws: str = "hash") -> DataFrame:
    """Interval of macro F1 over resampled frames.

    A draw only matters by its confusion cell, so frames are drawn from the four counts and
    no frame is joined; `draws="multinomial"` takes each resample's four counts at once,
    whatever the number of frames.
    """
    counts = pred.groupBy(*by).agg(F.count("*").alias("k"), *C.cells()).persist()  # a row a group, read twice
    if draws == "multinomial":
        rows = []
        for i, r in enumerate(counts.orderBy(*by).collect()):  # a row a group
            parts = [r[p] for p in PARTS]
            for taken in np.random.default_rng([seed, i]).multinomial(r.k, np.array(parts) / r.k, reps).tolist():
                rows.append((*[r[b] for b in by], *taken))
        kinds = [f"`{b}` {counts.schema[b].dataType.simpleString()}" for b in by] + [f"{p} long" for p in PARTS]
        sums = counts.sparkSession.createDataFrame(rows, ", ".join(kinds))
        point = counts.select(*by, F.round(C.macro_f1(), 6).alias("point_macro_f1"))
        scores = interval(sums.select(*by, C.macro_f1().alias("s")), *by)
        return point.join(scores, list(by)) if by else point.join(F.broadcast(scores))
    sums = D.sums(counts, PARTS, reps, seed, *by, cells=True)
    point = counts.select(*by, F.round(C.macro_f1(), 6).alias("point_macro_f1"))
    return point.join(interval(sums.select(*by, C.macro_f1().alias("s")), *by), list(by))
