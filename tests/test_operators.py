from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.operators import cohorts, constraints, errors, manifest, metrics, models, ranking, resample, temporal, training
from cohortlab.sources import files
from cohortlab.streaming import replay

random.seed(1)


def source(label, video, n, split="training"):
    return [(f"{label[0]}{video}_{i:04d}", label, int(label == "flip"), f"{label}::{video}", video, i, "testing" if i % 5 == 0 else split, f"{split}/{label}/{video}_{i:04d}.jpg") for i in range(1, n + 1)]


COLUMNS = "sample_id string, label string, target int, source_key string, video_id string, frame_number long, supplied_split string, relative_path string"


@pytest.fixture(scope="module")
def frames(spark):
    rows = [r for v, n in enumerate([4, 5, 15, 25, 35, 9, 12, 40, 11, 22]) for label in ("flip", "notflip") for r in source(label, f"{v:04d}", n)]
    random.shuffle(rows)
    return spark.createDataFrame(rows, COLUMNS).cache()


#: Rows of each part for sources of these lengths, worked by hand from the rules.
GOLDEN = {
    4: ((2, 1, 1), (3, 1), (1, 1, 2), (1, 1, 2), (2, 1, 1), (2, 1, 1)),
    5: ((3, 1, 1), (4, 1), (1, 1, 3), (1, 1, 3), (2, 1, 2), (3, 1, 1)),
    15: ((11, 2, 2), (12, 3), (2, 1, 12), (6, 1, 8), (9, 2, 4), (11, 2, 2)),
    25: ((21, 2, 2), (20, 5), (5, 1, 19), (10, 2, 13), (15, 3, 7), (18, 4, 3)),
    35: ((27, 4, 4), (28, 7), (7, 1, 27), (14, 3, 18), (21, 5, 9), (25, 6, 4)),
}


def test_chronological_roles_by_source_length(frames):
    t = {}
    for r in cohorts.split_t(frames).groupBy("source_key", "role").count().collect():
        t.setdefault(r.source_key, {})[r.role] = r["count"]
    late = {}
    for r in cohorts.split_st(frames).groupBy("source_key", "role").count().collect():
        late.setdefault(r.source_key, []).append(r["count"])
    points = {}
    for r in temporal.checkpoints(frames).where("regime = 'T'").groupBy("source_key", "coverage_percent", "part").count().collect():
        points.setdefault((r.source_key, r.coverage_percent), {})[r.part] = r["count"]
    for v, n in enumerate([4, 5, 15, 25, 35]):
        for label in ("flip", "notflip"):
            key = f"{label}::{v:04d}"
            want = GOLDEN[n]
            assert tuple(t[key][k] for k in ("train", "validation", "test")) == want[0]
            assert sorted(late[key], reverse=True) == list(want[1])
            for c, parts in zip(temporal.COVERAGES, want[2:], strict=True):
                assert tuple(points[key, c][k] for k in ("train", "validation", "future")) == parts


def test_splits_keep_every_rule_and_breaches_are_seen(spark, frames):
    splits = cohorts.all_splits(frames)
    rules = constraints.constraints(frames, splits)
    constraints.enforce(rules)
    single = {"O": cohorts.split_o(frames), "S": cohorts.split_s(frames), "T": cohorts.split_t(frames), "ST": cohorts.split_st(frames)}
    for regime, df in single.items():
        a = sorted((r.sample_id, r.role) for r in df.collect())
        assert a == sorted((r.sample_id, r.role) for r in splits.where(f"regime = '{regime}'").collect())
    n = frames.where("supplied_split = 'training'").count()
    assert single["O"].where("role = 'validation'").count() == math.ceil(0.1 * n)
    assert single["S"].where("role = 'test'").select("source_key").distinct().count() == math.ceil(0.2 * 20)

    def broken(df):
        return {(r.regime, r.rule) for r in constraints.constraints(frames, df).where("violations > 0").collect()}

    some = splits.where("regime = 'T' AND role = 'test'").limit(1)
    assert ("T", "row_accounting") in broken(splits.union(some))
    moved = splits.withColumn("role", __import__("pyspark.sql.functions", fromlist=["expr"]).expr("CASE WHEN frame_number = 1 AND regime IN ('S', 'T', 'ST') THEN 'test' ELSE role END"))
    assert {("S", "test_sources_disjoint"), ("S", "one_role_a_source"), ("T", "chronology"), ("ST", "test_sources_disjoint")} <= broken(moved)
    assert ("O", "both_classes") in broken(splits.where("NOT (regime = 'O' AND role = 'validation' AND label = 'flip')"))
    short = frames.where("source_key <> 'flip::0000' OR frame_number <= 2")
    rules = {(r.regime, r.rule): r.violations for r in constraints.constraints(short, splits).collect()}
    assert rules["T", "minimum_length"] == 1 and rules["ST", "minimum_length"] == 0 and rules["progressive", "minimum_length"] == 1
    with pytest.raises(constraints.ConstraintViolation):
        constraints.enforce(constraints.constraints(short, splits))


def test_ranks_in_blocks_equal_ranks_of_one_sort(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 7)
    rows = [(f"s{i}", random.choice("ab"), random.randint(0, 60)) for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id string, source_key string, frame_number long")
    got = {r.sample_id: (r.rn, r.n) for r in ranking.in_source_order(df).collect()}
    for k in "ab":
        own = sorted((f, s) for s, g, f in rows if g == k)
        for rank, (_, s) in enumerate(own, 1):
            assert got[s] == (rank, len(own))


def brute_auc(y, p):
    pos, neg = [b for a, b in zip(y, p, strict=True) if a], [b for a, b in zip(y, p, strict=True) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def brute_ap(y, p):
    if not 0 < sum(y) < len(y):
        return None
    out, seen = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit, all_ = sum(a for a, b in zip(y, p, strict=True) if b >= t), sum(b >= t for b in p)
        out += (hit / sum(y) - seen) * hit / all_
        seen = hit / sum(y)
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=1, max_size=40))
def test_rank_metrics_with_ties(spark, rows):
    df = spark.createDataFrame([("g", y, p / 20) for y, p in rows], "g string, target int, prob_flip double")
    y, p = [r[0] for r in rows], [r[1] / 20 for r in rows]
    auc, ap = metrics.roc_auc(df, "g").first().roc_auc_flip, metrics.average_precision(df, "g").first().pr_auc_flip
    assert (auc is None) == (brute_auc(y, p) is None) and (auc is None or auc == pytest.approx(brute_auc(y, p), abs=1e-6))
    assert (ap is None) == (brute_ap(y, p) is None) and (ap is None or ap == pytest.approx(brute_ap(y, p), abs=1e-6))


#: Published confusion counts with the metrics they give.
PUBLISHED = [("O", 307, 0, 3, 287, 0.994969, 0.9900), ("S", 330, 12, 13, 255, 0.958387, 0.9168), ("T", 154, 0, 27, 120, 0.909140, 0.8334), ("ST", 68, 0, 14, 39, 0.877246, 0.7812)]


def test_published_confusion_counts(spark):
    rows = [(r, t, p) for r, tn, fp, fn, tp, _, _ in PUBLISHED for t, p, n in ((0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)) for _ in range(n)]
    df = spark.createDataFrame(rows, "regime string, target int, prediction int")
    basic = {r.regime: r for r in metrics.basic(df, "regime").collect()}
    more = {r.regime: r for r in metrics.extended(df, "regime").collect()}
    for regime, tn, fp, fn, tp, macro, mcc in PUBLISHED:
        assert (basic[regime].tn, basic[regime].fp, basic[regime].fn, basic[regime].tp) == (tn, fp, fn, tp)
        assert basic[regime].macro_f1 == pytest.approx(macro, abs=1e-6) and more[regime].mcc == pytest.approx(mcc, abs=5e-5)


def test_one_class_only(spark):
    df = spark.createDataFrame([("g", 1, 0), ("g", 1, 1)], "regime string, target int, prediction int")
    r = metrics.basic(df, "regime").first()
    assert r.balanced_accuracy == 0.5 and r.macro_f1 == pytest.approx(1 / 3, abs=1e-6) and r.flip_precision == 1.0


def test_bootstrap_with_numpy_draws(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", int(k % 2), int(rng.random() < 0.7) ^ (1 - k % 2)) for k in range(9) for _ in range(k + 3)]
    df = spark.createDataFrame(rows, "source_key string, target int, prediction int")
    got = resample.cluster_bootstrap(df, reps=60, seed=42, draws="numpy").first()
    groups = [[r for r in rows if r[0] == k] for k in sorted({r[0] for r in rows})]
    draw, scores = np.random.default_rng(42), []
    for _ in range(60):
        picked = [r for k in draw.integers(0, len(groups), len(groups)) for r in groups[k]]
        f = []
        for c in (0, 1):
            tp = sum(t == c and p == c for _, t, p in picked)
            wrong = sum((t == c) != (p == c) for _, t, p in picked)
            f.append(2 * tp / (2 * tp + wrong) if tp + wrong else 0.0)
        scores.append(sum(f) / 2)
    assert got.ci_lower == pytest.approx(np.percentile(scores, 2.5), abs=1e-6) and got.ci_upper == pytest.approx(np.percentile(scores, 97.5), abs=1e-6)
    assert got.bootstrap_mean == pytest.approx(np.mean(scores), abs=1e-6) and got.n_sources == 9


def test_identity_weights_give_the_point(spark):
    df = spark.createDataFrame([("only", t, p) for t, p in ((0, 0), (1, 1), (1, 0))], "source_key string, target int, prediction int")
    r = resample.cluster_bootstrap(df, reps=5).first()
    assert r.ci_lower == r.ci_upper == r.point_macro_f1


def test_case_selection_is_greedy(spark):
    rows = [(f"x{i}", random.randint(0, 1), round(random.random(), 2)) for i in range(60)] + [("y0", 0, 0.5)]
    df = spark.createDataFrame([(s, f"p/{s}", t, p, int(p >= 0.5), "O") for s, t, p in rows], "sample_id string, relative_path string, target int, prob_flip double, prediction int, regime string")
    sure = lambda r: r[2] if r[2] >= 0.5 else 1 - r[2]
    wrong = [r for r in rows if (r[2] >= 0.5) != r[1]]
    right = [r for r in rows if (r[2] >= 0.5) == r[1]]
    by_conf, by_dist = (lambda r: (-sure(r), r[0])), (lambda r: (abs(r[2] - 0.5), r[0]))
    pools = [sorted((r for r in right if r[1] == 0), key=by_conf), sorted((r for r in right if r[1] == 1), key=by_conf), sorted(wrong, key=by_conf), sorted(wrong, key=by_dist), sorted(right, key=by_dist), sorted(rows, key=by_dist)]
    used, want = set(), []
    for pool in pools:
        hit = next((r[0] for r in pool if r[0] not in used), None)
        if hit:
            used.add(hit)
            want.append(hit)
    order = ["correct_notflip", "correct_flip", "highest_conf_error", "near_threshold_error", "near_threshold_correct", "additional_borderline"]
    got = {r.selection_role: r.sample_id for r in errors.many_cases(df).collect()}
    assert [got[r] for r in order] == want
    none = errors.four_cases(df.where("prediction = target"), "regime").where("NOT found").collect()
    assert sorted(r.role for r in none) == ["Borderline error", "High-confidence error"]


def test_early_stopping_replays_a_loop(spark):
    rows = [(run, e, round(random.random(), 2)) for run in range(12) for e in range(1, 25)]
    df = spark.createDataFrame(rows, "run int, epoch int, f1 double")
    got = {r.run: (r.last_epoch, r.best_epoch, r.best_f1) for r in training.early_stop(df, patience=4).collect()}
    for run in range(12):
        best, at, end = -1.0, 0, 0
        for _, e, f in [r for r in rows if r[0] == run]:
            end = e
            if f > best:
                best, at = f, e
            elif e - at >= 4:
                break
        assert got[run] == (end, at, best)


def test_manifest_rules(spark, tmp_path):
    ok = [("training/flip/0001_000002.JPG",), ("testing/notflip/12_3.png",)]
    rows = manifest.build(spark.createDataFrame(ok, "relative_path string")).orderBy("relative_path").collect()
    assert [(r.label, r.video_id, r.frame_number, r.supplied_split, r.source_key) for r in rows] == [("notflip", "12", 3, "testing", "notflip::12"), ("flip", "0001", 2, "training", "flip::0001")]
    for bad in ("training/0001_2.jpg", "training/flip/notflip/1_2.jpg", "training/flip/1-2.jpg", "other/flip/1_2.jpg", "training/flip/1_2\n.jpg"):
        with pytest.raises(constraints.ConstraintViolation):
            manifest.build(spark.createDataFrame([*ok, (bad,)], "relative_path string"))
    with pytest.raises(constraints.ConstraintViolation):
        manifest.build(spark.createDataFrame([*ok, ok[0]], "relative_path string"))
    for name in ("training/flip/0001_1.JPG", "training/notflip/0002_1.webp", "notes.txt"):
        (tmp_path / "images" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "images" / name).write_bytes(b"x")
    found = files.discover_images(spark, str(tmp_path / "images"))
    assert sorted(r.relative_path for r in found.collect()) == ["training/flip/0001_1.JPG", "training/notflip/0002_1.webp"]
    assert manifest.build(found.select("relative_path")).count() == 2
    assert files.content_digests(spark, str(tmp_path / "images")).select("sha256").distinct().count() == 1
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("")
    with pytest.raises(constraints.ConstraintViolation):
        files.discover_images(spark, str(tmp_path / "none"))


def test_tables_and_documents(spark, tmp_path):
    df = spark.createDataFrame([("0007", 1.5)], "video_id string, x double")
    files.write_csv(df, f"{tmp_path}/t.csv")
    assert files.read_table(spark, f"{tmp_path}/t.csv", df.schema).first().video_id == "0007"
    files.write_table(df, f"{tmp_path}/t.parquet")
    files.write_document(df, f"{tmp_path}/d.json")
    assert files.read_document(spark, f"{tmp_path}/d.json", "video_id string, x double").first() == df.first()
    (tmp_path / "n.ipynb").write_text('{"cells": [{"cell_type": "code", "source": ["a\\n", "b"]}]}')
    assert files.notebook_cells(spark, f"{tmp_path}/n.ipynb").first().source == "a\nb"
    (tmp_path / "a.csv").write_text("<PARSED TEXT FOR SHEET: 1\nTAB: x>k,v\n1,a\n2,b\n")
    assert [tuple(r) for r in files.read_archived_file(spark, f"{tmp_path}/a.csv", "k int, v string").collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(constraints.ConstraintViolation):
        files.read_archived(spark.createDataFrame([("<PARSED TEXT FOR SHEET\nno mark\n1,a",)], "text string"), "k int, v string")
    with pytest.raises(constraints.ConstraintViolation):
        files.pipe_table(spark.createDataFrame([("| 1 | a |",)], "line string"), ["x", "y", "z"])
    with pytest.raises(constraints.ConstraintViolation):
        constraints.require_columns(df, "role")


def test_settings_from_the_environment(monkeypatch):
    monkeypatch.setenv("COHORTLAB_SEED", "7")
    monkeypatch.setenv("COHORTLAB_PROJECT", "p")
    s = files.Settings.from_env()
    assert s.seed == 7 and s.resamples == 5000 and s.extra == {"project": "p"}


def test_running_counts_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("b", 1, 0)], "g string, target int, prediction int")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = replay.running_metrics(stream, "g").writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.g, r.tp, r.fp, r.fn) for r in spark.sql("SELECT * FROM running").collect()} == {("a", 1, 1, 0), ("b", 0, 0, 1)}


def test_stand_in_model_is_stored_and_applied(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(2 * (i % 2) - 1, 1, 4)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x array<double>, target int")
    model = models.fit(df, "x")
    models.save(model, f"{tmp_path}/m")
    got = models.score(df, models.load(f"{tmp_path}/m"), "x").collect()
    assert np.mean([r.prediction == r.target for r in got]) > 0.9
    assert all((r.prob_flip >= 0.5) == r.prediction for r in got)


def test_cases_that_must_raise(spark, frames):
    for bad in ({"regimes": ("O",)}, {"coverages": (60,)}, {"regimes": ()}):
        with pytest.raises(constraints.ConstraintViolation):
            temporal.checkpoints(frames, **bad)
    facts = temporal.frozen_cohort(frames, cohorts.split_st(frames))
    r = facts.first()
    temporal.require_cohort(facts, r.unseen_sources, r.n_context, r.n_late)
    with pytest.raises(constraints.ConstraintViolation):
        temporal.require_cohort(facts, r.unseen_sources + 1)
    with pytest.raises(constraints.ConstraintViolation):
        temporal.require_cohort(temporal.frozen_cohort(frames, cohorts.split_st(frames).where("source_key <> 'flip::0003'")))
    pred = frames.selectExpr("sample_id", "source_key", "target", "1 AS prediction")
    resample.require_paired(pred, pred)
    for other in (pred.limit(5), pred.union(pred.limit(1)), pred.limit(0)):
        with pytest.raises(constraints.ConstraintViolation):
            resample.require_paired(pred, other)
    with pytest.raises(constraints.ConstraintViolation):
        constraints.not_empty(pred.limit(0))
    trials = spark.createDataFrame([(1, k, "finished", 0.5) for k in range(1, 6)], "sweep int, attempt int, status string, f1 double")
    training.require_trials(trials, 5)
    with pytest.raises(constraints.ConstraintViolation):
        training.require_trials(trials, 6)


def test_checkpoint_parts_never_overlap(frames):
    points = temporal.checkpoints(frames)
    per = points.groupBy("regime", "coverage_percent", "sample_id").count().where("count > 1")
    assert per.isEmpty()
    st_rows = points.where("regime = 'ST'").groupBy("source_key").agg({"part": "collect_set"}).collect()
    assert all(set(r[1]) == {"future"} or "future" not in r[1] for r in st_rows)
    t = points.where("regime = 'T'").groupBy("coverage_percent").count().collect()
    assert {r["count"] for r in t} == {frames.count()}


def test_roles_do_not_depend_on_row_order(frames):
    a = sorted((r.regime, r.sample_id, r.role) for r in cohorts.all_splits(frames).collect())
    b = sorted((r.regime, r.sample_id, r.role) for r in cohorts.all_splits(frames.repartition(7).sortWithinPartitions("frame_number")).collect())
    assert a == b


def test_bootstraps_take_5000_resamples_of_every_regime(spark):
    from cohortlab.plans import catalog

    known, d = catalog.queries(), "/root/testdata/sf0.001"
    regimes = {r.regime: r.point_macro_f1 for r in known["bootstrap"](spark, d).collect()}
    assert len(regimes) == 4
    for name in ("bootstrap", "frame_bootstrap_multinomial"):
        rows = known[name](spark, d).collect()
        assert {r.regime: r.point_macro_f1 for r in rows} == regimes
        assert all(r.n_resamples == 5000 and r.ci_lower <= r.bootstrap_mean <= r.ci_upper for r in rows)
    assert known["paired_bootstrap"](spark, d).first().n_resamples == 5000


def test_refusals_name_what_is_wrong(spark, frames):
    from pyspark.sql import functions as F

    few = {"T": 2, "ST": 1, "progressive": 3}
    for regime, split in (("T", cohorts.split_t), ("ST", cohorts.split_st), ("progressive", temporal.checkpoints), ("T", cohorts.all_splits)):
        short = frames.union(spark.createDataFrame(source("flip", "0099", few[regime]), COLUMNS))
        with pytest.raises(Exception, match=f"{regime}: source flip::0099"):
            split(short).collect()
    odd = frames.withColumn("supplied_split", F.when(F.col("sample_id") == "f0000_0001", "other").otherwise(F.col("supplied_split")))
    for split in (cohorts.split_o, cohorts.all_splits):
        with pytest.raises(Exception, match="supplied split of f0000_0001"):
            split(odd).collect()
    with pytest.raises(constraints.ConstraintViolation, match="f0000_0001"):
        constraints.accepted(odd.select("sample_id", "supplied_split"), F.col("supplied_split") != "other", "odd rows")
    pred = frames.withColumn("prediction", F.lit(1))
    with pytest.raises(constraints.ConstraintViolation):
        resample.paired_bootstrap(pred, pred.where("frame_number > 1"), reps=5)


def test_rules_of_a_study_see_breaches(spark, frames):
    from pyspark.sql import functions as F

    points = temporal.checkpoints(frames)
    broken = lambda p: {(r.regime, r.rule) for r in temporal.rules(p).where("violations > 0").collect()}
    assert broken(points) == set()
    late = points.where("regime = 'ST' AND part = 'future'").withColumn("part", F.lit("train"))
    assert broken(points.union(late)) == {("ST", "samples_disjoint"), ("ST", "sources_disjoint")}
    assert ("T", "both_classes") in broken(points.where("part <> 'future' OR label = 'flip'"))
    assert broken(points.where("part <> 'future'")) == {(r, k) for r in ("T", "ST") for k in ("rows_in_every_part", "both_classes")}
    twice = frames.withColumn("prob_flip", F.lit(0.5)).select("sample_id", "prob_flip")
    assert temporal.enriched(twice, points.where("part = 'future'")).count() == points.where("part = 'future'").count()
    with pytest.raises(Exception, match="not one to one"):
        temporal.enriched(twice.union(twice.limit(1)), points.where("part = 'future'")).collect()


def test_scores_that_are_no_numbers_never_win(spark):
    nan, inf = float("nan"), float("inf")
    trials = spark.createDataFrame([(1, 1, "finished", 0.5), (1, 2, "finished", nan), (1, 3, "finished", inf), (1, 4, "finished", None)], "sweep int, attempt int, status string, f1 double")
    assert [r.qualifies for r in training.qualifying(trials).orderBy("attempt").collect()] == [True, False, False, False]
    assert training.best_trial(trials.where("attempt <> 3")).first().attempt == 1
    scores = spark.createDataFrame([(1, 1, 0.2), (1, 2, nan), (1, 3, 0.3)], "run int, epoch int, f1 double")
    assert [r.improved for r in training.improvements(scores).orderBy("epoch").collect()] == [True, False, True]
    assert training.best_epoch(scores).first().best_epoch == 3


def test_log_table_keeps_the_last_attempt(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "run int, epoch int, loss double, logged_at long"
    training.append_log(spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.4, 2)], schema), path)
    training.append_log(spark.createDataFrame([(1, 2, 0.3, 5)], schema), path)
    assert training.read_log(spark, path).count() == 3
    assert sorted((r.epoch, r.loss) for r in training.read_log(spark, path, "run", "epoch").collect()) == [(1, 0.5), (2, 0.3)]


def test_report_rules(spark):
    from cohortlab.operators import reports

    def row(k, **other):
        cells = {"run_number": k, "regime": "T" if k <= 4 else "ST", "coverage_percent": (25, 50, 75, 90)[(k - 1) % 4], "n_train": 10, "n_validation": 5, "n_future": 85, "n_future_sources": 9 if k <= 4 else 3}
        cells |= {c: 0.5 for c in ("future_macro_f1", "future_flip_recall", "matched_macro_f1", "matched_flip_recall")} | {"run_url": f"https://x.org/{k}"}
        return {c: str(v) for c, v in (cells | other).items()}

    def broken(rows, lines=8):
        evidence = spark.createDataFrame([(f"see https://x.org/{k} .",) for k in range(1, lines + 1)], "line string")
        got = reports.report_rules(spark.createDataFrame(rows), evidence, url_prefix="https://x.org/", sources={"T": 9, "ST": 3}, rows_of_t=100)
        return {r.rule for r in got.collect() if r.violations}

    good = [row(k) for k in range(1, 9)]
    assert broken(good) == set()
    assert broken(good[:7]) == {"eight_runs"}
    assert broken([*good[:7], row(7)]) == {"eight_runs"}
    assert broken(good, lines=7) == {"address_in_evidence"}
    for cell, value, rule in (("regime", "ST", "run_order"), ("coverage_percent", "30", "coverage_cycle"), ("n_future_sources", "8", "future_sources"), ("n_train", "x", "accounting"), ("matched_macro_f1", "1.2", "shares")):
        assert rule in broken([row(1, **{cell: value}), *good[1:]])
    assert broken([row(1, run_url="http://x.org/1"), *good[1:]]) >= {"address"}


def test_class_activation_against_loops(spark):
    from cohortlab.operators import maps

    rng = np.random.default_rng(3)
    width, rows, size = 3, 2, 5
    m, g = rng.normal(size=(4, rows * width)), rng.normal(size=(4, rows * width))
    df = spark.createDataFrame([(1, m.tolist(), g.tolist()), (2, [[0.0] * 6], [[1.0] * 6]), (3, [], [])], "k int, m array<array<double>>, g array<array<double>>")
    got = {r.k: r.heat for r in maps.class_activation(df, "m", "g", ["k"], width, size).collect()}
    s = np.maximum((g.mean(1)[:, None] * m).sum(0), 0).reshape(rows, width)
    want = np.zeros((size, size))
    for y in range(size):
        for x in range(size):
            v, u = max((y + 0.5) * rows / size - 0.5, 0), max((x + 0.5) * width / size - 0.5, 0)
            a, b = int(v), int(u)
            c, d = min(a + 1, rows - 1), min(b + 1, width - 1)
            want[y, x] = (s[a, b] * (1 - u + b) + s[a, d] * (u - b)) * (1 - v + a) + (s[c, b] * (1 - u + b) + s[c, d] * (u - b)) * (v - a)
    want = (want - want.min()) / (want.max() - want.min() + 1e-8)
    assert np.allclose(got[1], want.ravel()) and got[2] == [0.0] * 25 and 3 not in got
    laid = maps.overlay(spark.createDataFrame([([0.0, 255.0], [1.0, 1.0])], "a array<double>, b array<double>"), "a", "b").first().overlay
    assert laid == pytest.approx([0.55, 1.0])


def test_studies_go_on_behind_their_last_step(spark, frames, tmp_path):
    from pyspark.sql import functions as F

    from cohortlab.plans import study

    features = frames.select("sample_id", F.array(F.col("target") + F.col("frame_number") / 100.0, F.lit(1.0)).alias("x"))
    folder = str(tmp_path / "study")
    out = study.progressive(frames, features, "x", folder, coverages=(50, 90))
    assert {(r.regime, r.coverage_percent) for r in out["overall"].collect()} == {(r, c) for r in ("T", "ST") for c in (50, 90)}
    assert all(r.future_macro_f1 > 0.9 for r in out["overall"].collect())
    again = study.progressive(frames, features, "x", folder, coverages=(50, 90))
    assert again["predictions"].count() == out["predictions"].count()
    with pytest.raises(constraints.ConstraintViolation):
        study.progressive(frames, features, "x", folder, coverages=(50, 90), decay=0.5)
    rows = study.regimes(cohorts.all_splits(frames), features, "x", str(tmp_path / "regimes")).collect()
    assert {r.regime for r in rows} == {"O", "S", "T", "ST"}


def test_own_scorer_streams_over_batches(spark):
    df = spark.range(2500).withColumnRenamed("id", "k")
    got = models.score_with(df, lambda rows: (rows["k"] % 10) / 10, batch=100)
    assert got.where("prediction = 1").count() == 1250
    with pytest.raises(Exception, match="one probability a row"):
        models.score_with(df, lambda rows: rows["k"] * 1.0).collect()


def test_roots_identities_and_counts(spark, tmp_path):
    for split in ("training", "testing"):
        (tmp_path / "images" / split).mkdir(parents=True)
    assert files.dataset_root(spark, str(tmp_path)) == f"{tmp_path}/images" == files.dataset_root(spark, f"{tmp_path}/images")
    with pytest.raises(constraints.ConstraintViolation):
        files.dataset_root(spark, str(tmp_path / "images" / "training"))
    (tmp_path / "cells.csv").write_text('id,note,x\n007,"a, ""b""",0.50\n')
    assert [tuple(r) for r in files.read_cells(spark, str(tmp_path / "cells.csv")).collect()] == [("007", 'a, "b"', "0.50")]
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([("x", 1)], "s string, n int")
    assert files.identity(a).first().identity == files.identity(b).first().identity
    assert files.require_rows(a, 1).count() == 1
    for n in (0, 2):
        with pytest.raises(constraints.ConstraintViolation):
            files.require_rows(a, n)


def test_median_by_blocks_equals_a_sort(spark):
    rows = [("a" if random.random() < 0.7 else "b", round(random.random(), 2)) for _ in range(301)] + [("one", 0.25), ("two", 1.0), ("two", 0.0)]
    got = {r.g: r.median for r in ranking.median(spark.createDataFrame(rows, "g string, v double"), "v", "g", blocks=7).collect()}
    assert got == {g: pytest.approx(float(np.median([v for k, v in rows if k == g]))) for g in ("a", "b", "one", "two")}


def test_fingerprints_of_more_levels(spark, frames):
    split = cohorts.all_splits(frames)
    one, two = ({r.regime: r.sha256 for r in manifest.fingerprint(s, levels=n).collect()} for s, n in ((split, 1), (split.repartition(5), 2)))
    assert len(one) == len(two) == 4 and len(set(one.values()) | set(two.values())) == 8
    assert two == {r.regime: r.sha256 for r in manifest.fingerprint(split, levels=2).collect()}
