"""The registered queries of the evaluation analytics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.functions import columns as C
from cohortlab.operators import cohorts, constraints, errors, manifest, maps, metrics, models, reports, resample, temporal, training
from cohortlab.sources import files, fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Resamples, as the reports to be reproduced have them.
REPS, SEED = 5000, 42
#: Queries that SQL does not repeat.
MORE: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def more(f: Query) -> Query:
    MORE[f.__name__] = f
    return f


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.manifest(spark, d)


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.all_splits(_frames(spark, d))


def _tests(spark: SparkSession, d: str, salt: str = "p") -> DataFrame:
    """Predictions of every regime's test rows."""
    return fixtures.predictions(cohorts.test_rows(_splits(spark, d)), salt)


def _points(spark: SparkSession, d: str) -> DataFrame:
    return temporal.checkpoints(_frames(spark, d))


def _future(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.predictions(temporal.future(_points(spark, d)))


# manifest


@query
def parse_name(spark, d):
    paths = _frames(spark, d).select("relative_path")
    odd = spark.createDataFrame([("training/flip/0001.jpg",), ("testing/other/0001_2.jpg",), ("training/flip/notflip/0001_2.jpg",), ("training/FLIP/0007_010.x.PNG",), ("notflip/0007_010\n.png",)], "relative_path string")
    none = {c: F.coalesce(F.col(c), F.lit(-1)) for c in ("frame_number", "target")}
    return manifest.parse_paths(paths.union(odd)).withColumns(none)


@query
def class_counts(spark, d):
    return _frames(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query
def frames_per_source(spark, d):
    return _frames(spark, d).groupBy("source_key").agg(F.count("*").alias("n"))


@query
def source_describe(spark, d):
    return manifest.describe_sources(_frames(spark, d))


@query
def source_hist(spark, d):
    return manifest.histogram(_frames(spark, d))


@query
def collisions(spark, d):
    return manifest.collisions(_frames(spark, d))


@query
def dup_positions(spark, d):
    lines = fixtures.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return manifest.repeated(lines, "l_orderkey", "l_linenumber")


@query
def dup_content(spark, d):
    docs = fixtures.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_sha256"))
    return manifest.repeated(docs, "content_sha256")


@query
def audit(spark, d):
    return manifest.audit(_frames(spark, d), F.md5((F.col("event_id") % 997).cast("string").cast("binary")))


@query
def fingerprint(spark, d):
    return manifest.fingerprint(_splits(spark, d))


@query
def first_per_label(spark, d):
    return manifest.first_per_label(_frames(spark, d))


# cohorts

ROLE_COLUMNS = ("sample_id", "source_key", "label", "role")


@query
def split_o(spark, d):
    return cohorts.split_o(_frames(spark, d)).select(*ROLE_COLUMNS)


@query
def split_s(spark, d):
    return cohorts.split_s(_frames(spark, d)).select(*ROLE_COLUMNS)


@query
def split_t(spark, d):
    return cohorts.split_t(_frames(spark, d)).select(*ROLE_COLUMNS)


@query
def split_st(spark, d):
    return cohorts.split_st(_frames(spark, d)).select(*ROLE_COLUMNS)


@query
def split_summary(spark, d):
    return cohorts.summary(_splits(spark, d))


@query
def role_label_crosstab(spark, d):
    return cohorts.crosstab(_splits(spark, d))


@query
def accounting(spark, d):
    return constraints.accounting(_frames(spark, d), _splits(spark, d))


@query
def leakage(spark, d):
    return constraints.leakage(_splits(spark, d))


@query
def chronology(spark, d):
    return constraints.chronology(_splits(spark, d))


@query
def constraints_(spark, d):
    return constraints.constraints(_frames(spark, d), _splits(spark, d))


QUERIES["constraints"] = QUERIES.pop("constraints_")

# temporal


@query
def coverage(spark, d):
    return temporal.coverage(_points(spark, d))


@query
def st_cohort(spark, d):
    frames = _frames(spark, d)
    cohort = cohorts._flagged(cohorts.sources(frames), cohorts.unseen_sources(frames), "source_key", "unseen")
    return cohort.select("source_key", "label", F.when(F.col("unseen"), "unseen").otherwise("known").alias("cohort"))


@query
def frozen_cohort(spark, d):
    frames = _frames(spark, d)
    return temporal.frozen_cohort(frames, cohorts.split_st(frames))


@query
def progressive_rules(spark, d):
    return temporal.rules(_points(spark, d))


@query
def future_enrich(spark, d):
    """Every checkpoint's future rows with their scores, which exist once a frame."""
    scored = fixtures.predictions(_frames(spark, d)).select("sample_id", "prob_flip", "prediction", "correct")
    return temporal.enriched(scored, temporal.future(_points(spark, d)))


@query
def horizon(spark, d):
    return temporal.horizon(_future(spark, d))


@query
def matched_suffix(spark, d):
    return temporal.matched_suffix(_future(spark, d))


@query
def coverage_delta(spark, d):
    return temporal.coverage_delta(temporal.matched_suffix(_future(spark, d)))


# metrics


@query
def score(spark, d):
    return fixtures.predictions(_frames(spark, d)).select("sample_id", "target", "prob_flip", "prediction", "correct")


@query
def confidence(spark, d):
    return fixtures.predictions(_frames(spark, d)).select("sample_id", F.round(C.confidence(), 6).alias("confidence"), F.round(F.abs(F.col("prob_flip") - 0.5), 6).alias("distance"))


@query
def confusion(spark, d):
    return metrics.confusion(_tests(spark, d), "regime")


@query
def metrics_(spark, d):
    return metrics.basic(_tests(spark, d), "regime")


QUERIES["metrics"] = QUERIES.pop("metrics_")


@query
def metrics_ext(spark, d):
    return metrics.extended(_tests(spark, d), "regime")


@query
def roc_auc(spark, d):
    return metrics.roc_auc(_tests(spark, d), "regime")


@query
def avg_precision(spark, d):
    return metrics.average_precision(_tests(spark, d), "regime")


@query
def missed_rate(spark, d):
    return metrics.missed_rate(_tests(spark, d), "regime")


@query
def errorbars(spark, d):
    return reports.error_bars(resample.cluster_bootstrap(_tests(spark, d), "regime", reps=REPS, seed=SEED))


# errors


@query
def errors_(spark, d):
    return errors.profile(_tests(spark, d), "regime")


QUERIES["errors"] = QUERIES.pop("errors_")


@query
def errors_ext(spark, d):
    return errors.extended(_tests(spark, d), "regime")


@query
def cases4(spark, d):
    return errors.four_cases(_tests(spark, d), "regime")


@query
def cases21(spark, d):
    return errors.many_cases(_tests(spark, d))


# resampling


@query
def bootstrap(spark, d):
    return resample.cluster_bootstrap(_tests(spark, d), "regime", reps=REPS, seed=SEED)


def _pair(spark, d):
    tests = cohorts.test_rows(cohorts.split_st(_frames(spark, d))).persist()  # both sides, twice each
    return fixtures.predictions(tests, "p"), fixtures.predictions(tests, "g")


@query
def paired_join(spark, d):
    a, b = _pair(spark, d)
    return resample.pairing(a, b.where(F.col("frame_number") % 7 > 0))


@query
def paired_bootstrap(spark, d):
    return resample.paired_bootstrap(*_pair(spark, d), reps=REPS, seed=SEED)


@query
def frame_bootstrap(spark, d):
    return resample.frame_bootstrap(_tests(spark, d), "regime", reps=REPS, seed=SEED)


@more
def frame_bootstrap_multinomial(spark, d):
    """The form for many frames: each resample's four counts are one multinomial draw."""
    return resample.frame_bootstrap(_tests(spark, d), "regime", reps=REPS, seed=SEED, draws="multinomial")


# training log


@query
def epoch_log(spark, d):
    return training.epoch_log(fixtures.epoch_batches(spark))


@query
def best_epoch(spark, d):
    return training.best_epoch(fixtures.epoch_scores(spark))


@query
def early_stop(spark, d):
    return training.early_stop(fixtures.epoch_scores(spark))


@query
def best_stage(spark, d):
    stage = F.when(F.col("epoch") <= 5, "head").when(F.col("epoch") <= 20, "full").otherwise("continued")
    order = F.when(F.col("epoch") <= 5, 1).when(F.col("epoch") <= 20, 2).otherwise(3)
    stages = fixtures.epoch_scores(spark).groupBy("run", stage.alias("stage"), order.alias("stage_order")).agg(F.max("f1").alias("f1"))
    return training.best_stage(stages)


@query
def best_trial(spark, d):
    return training.best_trial(fixtures.trials(spark))


@query
def sweep_stop(spark, d):
    return training.sweep_stop(fixtures.trials(spark)).select("sweep", "attempt", "status", "f1", "qualifies")


@query
def sweep_summary(spark, d):
    return training.sweep_summary(fixtures.trials(spark))


@query
def resolve_config(spark, d):
    return training.resolve_config(fixtures.trials(spark)).select("sweep", "attempt", "weight_decay_mode", "positive_weight_decay", "weight_decay")


@query
def bce(spark, d):
    scored = fixtures.predictions(_frames(spark, d)).select("sample_id", ((F.col("prob_flip") - 0.5) * 20).alias("logit"), "target")
    return training.losses(scored).select("sample_id", "prob", "loss")


@query
def cnn_channels(spark, d):
    configs = spark.range(1, 8).select(F.col("id").cast("int").alias("depth")).withColumn("filters", F.explode(F.array(*[F.lit(k) for k in (8, 16, 33, 64)])))
    return training.channels(configs)


# maps and reports


@query
def activation_stats(spark, d):
    return maps.activation_stats(fixtures.table(spark, d, "embeddings"), "embedding", ["vec_id"])


@query
def run_numbers(spark, d):
    points = temporal.coverage(_points(spark, d))
    order = F.when(F.col("regime") == "T", 1).otherwise(2)
    return points.select("regime", "coverage_percent", F.row_number().over(Window.orderBy(order, "coverage_percent")).alias("run_number"))


@query
def global_epoch(spark, d):
    """Epochs of the full stage count on from the five of the head stage."""
    stage = F.when(F.col("epoch") <= 5, "head").otherwise("full")
    own = fixtures.epoch_scores(spark).select("run", stage.alias("stage"), F.when(F.col("epoch") <= 5, F.col("epoch")).otherwise(F.col("epoch") - 5).alias("epoch"))
    return own.withColumn("global_epoch", F.col("epoch") + F.when(F.col("stage") == "full", 5).otherwise(0))


@query
def prefixed_metrics(spark, d):
    scored = fixtures.predictions(_splits(spark, d).where("role IN ('validation', 'test')"))
    rows = metrics.basic(scored, "regime", "role").withColumn("role", F.when(F.col("role") == "validation", "val").otherwise("test"))
    return reports.wide_metrics(rows, "regime", "role", ["macro_f1", "accuracy"], ["val", "test"])


@query
def audit_rows(spark, d):
    return reports.transposed(audit(spark, d))


@more
def stand_in_model(spark, d):
    """Scores of a classifier trained on two thirds of the embeddings, applied to the rest."""
    rows = fixtures.table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("target"))
    held = C.hash_number("m", F.col("vec_id")) % 3 == 0
    model = models.fit(rows.where(~held), "embedding")
    return models.score(rows.where(held), model, "embedding").select("vec_id", "target", F.round("prob_flip", 6).alias("prob_flip"), "prediction")


#: The form of an archived export, and a small report table and the same as
#: measured, with two cells changed.
ARCHIVE = f'{files.SHEET_MARK}: 1 / 1 TABS>\nTAB NAME: 16_x.csv>index,regime,finding,point\n0,O,"near, ceiling",0.994969\r\n\n1,S,"lower ""than""",0.958387\n'
PLAIN = "index,regime,finding,point\n2,T,a > b,0.90914\n3,ST,,\n"
RUNS = ["| run | regime | n_train | n_future | macro_f1 |", "|---:|---|---:|---:|---:|", "| 1 | T | 579 | 2,291 | 0.739814 |", "| 2 | T | 1,208 | 1,510 | 0.707684 |", "| 3 | ST | 460 | 467 | 66.2% |", "| total | | 2,247 | | |", "no table | 4 | x |", "| 9 | T | 1 | 1 | 1 |"]
COLUMNS = ["run", "regime", "n_train", "n_future", "macro_f1"]


def _written(spark: SparkSession, texts: list[str]) -> str:
    """A folder with a file a text."""
    folder = files.scratch(spark)
    for k, text in enumerate(texts):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{folder}/{k}")
    return folder


@query
def archive_read(spark, d):
    return files.read_archived_file(spark, _written(spark, [ARCHIVE, PLAIN]) + "/*", "index int, regime string, finding string, point double")


@query
def md_table(spark, d):
    return files.pipe_rows_of(spark, _written(spark, ["\n".join(RUNS)]) + "/0", COLUMNS)


@query
def drift(spark, d):
    measured = spark.createDataFrame([("1", "T", "579", "2291", "0.7398140"), ("2", "T", "1208", "1511", "0.707684"), ("3", "ST", "460", "467", "66.3")], ", ".join(f"{c} string" for c in COLUMNS))
    return reports.drift(md_table(spark, d), measured, "run", COLUMNS[2:])


@query
def round_trip(spark, d):
    """Counts as a CSV file, as a table and as a document, written and read back."""
    folder, counts = files.scratch(spark), class_counts(spark, d)
    files.write_csv(counts, f"{folder}/csv")
    files.write_table(counts, f"{folder}/table")
    wide = counts.agg(F.max(F.when(F.col("label") == "flip", F.col("n"))).alias("flip"), F.max(F.when(F.col("label") == "notflip", F.col("n"))).alias("notflip"))
    files.write_document(wide, f"{folder}/document")
    document = files.read_document(spark, f"{folder}/document", "flip long, notflip long").select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in ("flip", "notflip")])))
    cells = files.read_cells(spark, f"{folder}/csv").select("label", F.col("n").cast("long").alias("n"))
    ways = {"csv": files.read_table(spark, f"{folder}/csv", "label string, n long"), "cells": cells, "table": spark.read.parquet(f"{folder}/table"), "document": document}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(way).alias("way"), "label", "n") for way, rows in ways.items()])


@query
def case_preview(spark, d):
    return errors.preview(cases21(spark, d))


@query
def report_rules(spark, d):
    """The rules of a published table, held against one that is made here, with two faults: the
    last run's address stands nowhere, and the first run's rows do not add up."""
    late = temporal.matched_suffix(_future(spark, d)).select("regime", "coverage_percent", "future_macro_f1", "future_flip_recall", "matched_macro_f1", "matched_flip_recall")
    table = run_numbers(spark, d).join(temporal.coverage(_points(spark, d)), ["regime", "coverage_percent"]).join(late, ["regime", "coverage_percent"])
    table = table.withColumn("n_train", F.col("n_train") + F.when(F.col("run_number") == 1, 1).otherwise(0)).withColumn("run_url", F.concat(F.lit("https://runs.example/"), F.col("run_number").cast("string")))
    cells = table.select(*[F.col(c).cast("string").alias(c) for c in table.columns])
    frames = _frames(spark, d)
    unseen = cohorts.unseen_sources(frames).count()
    every = frames.agg(F.count("*").alias("n"), F.count_distinct("source_key").alias("k")).first()
    evidence = spark.range(1, 8).select(F.concat(F.lit("run at https://runs.example/"), F.col("id").cast("string"), F.lit(" .")).alias("line"))
    return reports.report_rules(cells, evidence, url_prefix="https://runs.example/", sources={"T": every.k, "ST": unseen}, rows_of_t=every.n)


@query
def class_activation(spark, d):
    """Embeddings as four channels of 4 x 4 cells, whose gradients are the next channel's cells."""
    part = lambda k: F.transform(F.slice("embedding", 16 * (k % 4) + 1, 16), lambda v: v.cast("double"))
    rows = fixtures.table(spark, d, "embeddings").select("vec_id", F.array(*[part(k) for k in range(4)]).alias("m"), F.array(*[part(k + 1) for k in range(4)]).alias("g"))
    heat = maps.class_activation(rows, "m", "g", ["vec_id"], 4, 4)
    rounded = F.aggregate("heat", F.lit(0.0), lambda a, x: a + x)
    return heat.select("vec_id", F.round(rounded, 6).alias("total"), F.round(F.element_at("heat", 1), 6).alias("first"), F.round(F.element_at("heat", 16), 6).alias("last"))


def queries() -> dict[str, Query]:
    """The queries with SQL, and those without."""
    return QUERIES | MORE


__all__ = ["queries"]
