"""Draws are digests in numpy, never rows of a table."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import cohorts, draws, reports, resample
from cohortlab.plans import catalog


def number(seed, rep, slot):
    return int(hashlib.md5(f"{seed}|{rep}|{slot}".encode()).hexdigest()[:8], 16)


def most_rows(df):
    """The most rows that any node of the plan made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
    return most


@pytest.fixture(scope="module")
def frames(spark):
    rows = spark.range(6000).select((F.col("id") % 2000).cast("string").alias("source_key"), F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("target"), F.lit("a").alias("regime"))
    return rows.withColumn("prediction", (F.hash("sample_id") % 3 == 0).cast("int")).persist()


@pytest.mark.parametrize("seed, rep, upto", [(42, 5000, 20_000), (42, 7, 1200), (7, 12, 40), (12345678901, 123456, 1100)])
def test_digests(seed, rep, upto):
    got = [int(x) for _, tile in draws.tiles(upto) for x in tile.numbers(f"{seed}|{rep}|".encode())]
    assert got == [number(seed, rep, s) for s in range(1, upto + 1)]


def test_sums_in_one_pass_and_in_several(spark, monkeypatch):
    sizes = {"a": 70, "b": 9, "c": 1}
    rows = [(g, k, i, i * i % 11, i % 3) for g, k in sizes.items() for i in range(k)]
    want = defaultdict(lambda: [0, 0])
    for g, k in sizes.items():
        for rep in range(1, 21):
            for slot in range(1, k + 1):
                i = number(42, rep, slot) % k
                want[g, rep] = [want[g, rep][0] + i * i % 11, want[g, rep][1] + i % 3]
    df = spark.createDataFrame(rows, "g string, k long, idx long, x int, y int")
    for pack, held in ((4096, 1 << 22), (8, 20)):
        monkeypatch.setattr(draws, "PACK", pack)
        monkeypatch.setattr(draws, "HELD", held)
        got = {(r.g, r.rep): [r.x, r.y] for r in draws.sums(df, ("x", "y"), 20, 42, "g").collect()}
        assert got == want


def test_cluster_draws_are_no_rows(frames):
    """2,000 sources and 100 resamples: 200,000 draws."""
    assert most_rows(resample.cluster_bootstrap(frames, "regime", reps=100)) < 50_000


def test_frame_draws_are_no_rows_and_equal_a_loop(frames):
    """6,000 frames and 30 resamples: 180,000 draws."""
    df = resample.frame_bootstrap(frames, "regime", reps=30)
    assert most_rows(df) < 50_000
    cells = [tuple(r) for r in frames.select("target", "prediction").collect()]
    ends = [cells.count((0, 0)), cells.count((0, 1)), cells.count((1, 0))]
    scores = []
    for rep in range(1, 31):
        at = [number(42, rep, s) % 6000 for s in range(1, 6001)]
        tn, fp, fn = (sum(sum(ends[:i]) <= x < sum(ends[: i + 1]) for x in at) for i in range(3))
        tp = 6000 - tn - fp - fn
        scores.append((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2)
    assert df.first().bootstrap_mean == pytest.approx(sum(scores) / 30, abs=2e-6)


def test_error_bars_draw_no_rows(frames):
    assert most_rows(reports.error_bars(resample.cluster_bootstrap(frames.withColumn("regime", F.lit("T")), "regime", reps=100))) < 50_000


def test_paired_draws_are_no_rows(frames):
    other = frames.withColumn("prediction", F.col("target"))
    assert most_rows(resample.paired_bootstrap(frames, other, reps=100)) < 50_000


def reads(df):
    """How often the plan reads its frames; what is kept is read once."""
    todo, kept, n = [df._jdf.queryExecution().sparkPlan()], [], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "InMemoryTableScanExec":
            built = node.relation().cacheBuilder()
            if not any(built.equals(k) for k in kept):
                kept.append(built)
                todo.append(built.cachedPlan())
        elif kind == "AdaptiveSparkPlanExec":
            todo.append(node.inputPlan())
        else:
            n += not node.children().size()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


@pytest.fixture(scope="module")
def read_frames(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 40).cast("string").alias("source_key"), F.expr("id div 40").alias("frame_number"))
    rows = rows.withColumn("target", (F.col("source_key").cast("int") % 2)).withColumn("label", F.when(F.col("target") == 1, "flip").otherwise("notflip"))
    return rows.withColumns({"supplied_split": F.when(F.col("frame_number") % 5 == 0, "testing").otherwise("training"), "prediction": (F.hash("sample_id") % 3 == 0).cast("int")})


def test_cohorts_of_all_regimes_read_the_frames_a_few_times(read_frames):
    assert reads(cohorts.all_splits(read_frames)) <= 10


def test_held_out_sources_are_two_hold_outs(read_frames):
    """Those that validate are a tenth of what the test leaves, in the same order."""
    known = cohorts.sources(read_frames)
    unseen = {r.source_key for r in cohorts.holdout(known, "source_key", 0.2, 42).collect()}
    held = {r.source_key for r in cohorts.holdout(known.where(~F.col("source_key").isin(*unseen)), "source_key", 0.1, 42).collect()}
    got = {r.source_key: r.role for r in cohorts.source_roles(read_frames).collect()}
    assert len(unseen) == 8 and len(held) == 4 and len(got) == 40
    assert got == {k: "test" if k in unseen else "validation" if k in held else "train" for k in got}


def test_error_bars_read_the_predictions_once(read_frames):
    assert reads(reports.error_bars(resample.cluster_bootstrap(read_frames.withColumn("regime", F.lit("T")), "regime", reps=10))) == 1


def test_paired_bootstrap_reads_the_pairs_once(read_frames):
    other = read_frames.withColumn("prediction", F.col("target"))
    assert reads(resample.paired_bootstrap(read_frames, other, reps=10)) == 2


def test_both_sides_of_the_pairs_share_their_cohort(spark):
    a, b = catalog._pair(spark, "/root/testdata/sf0.001")
    assert reads(resample.paired(a, b)) == reads(a)
