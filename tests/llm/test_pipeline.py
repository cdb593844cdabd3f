from __future__ import annotations

import random

import corpus_pipeline as cp
from cohortlab.llm import decontam, mixture, neardup

random.seed(8)
SYLLABLES = {"en": "the and ing er tion of is wh", "de": "der sch ung ein ich keit zu", "fr": "eau que les oi ent ai", "es": "cion que ar os ado ll"}


def prose(lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(random.choice(s) for _ in range(random.randint(1, 3))) for _ in range(n))


def test_stages_in_order_on_odd_rows(spark, tmp_path):
    langs = ["en", "de", "fr", "es"]
    bench = [(k, prose("en", 25)) for k in range(3)]
    rows = [(i, prose(langs[i % 4], random.randint(30, 90)), langs[i % 4], f"s{i % 3}") for i in range(160)]
    rows += [(200, rows[5][1], "de", "s1"), (201, rows[6][1] + " oi", "fr", None), (5, rows[5][1], "de", "s1")]  # copies
    rows += [(210, f"{prose('en', 20)} {bench[0][1]} {prose('en', 20)}", "en", "s0")]
    rows += [(220, None, None, "s0"), (221, "", "en", "s0"), (222, "12 34 !!", "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, row string")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    told = cp.identify(spark, docs, str(tmp_path))
    assert told.columns == docs.columns
    assert sorted(r.doc_id for r in told.collect()) == sorted(r[0] for r in rows if r[0] not in (220, 221, 222))

    single = cp.deduplicate(spark, told, str(tmp_path))
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({r[0] for r in rows} - {200, 201, 220, 221, 222})

    clean = cp.decontaminate(spark, single, str(tmp_path))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()} == {210}

    mixed = cp.mix(spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixture.mix_sources(clean).collect() if r.copies}
    got: dict = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want

    cut = cp.shard(spark, mixed, str(tmp_path)).collect()
    assert len(cut) == sum(got.values()) and max(r.shard for r in cut) <= 7
    for k in range(8):
        assert sorted(r.slot for r in cut if r.shard == k) == list(range(sum(r.shard == k for r in cut)))
    assert [name for name, _ in cp.STAGES] == ["language", "neardup", "decontamination", "mixture", "sharding"]
    again = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in cut)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_null_ids_and_equal_ids_keep_one_row_a_class(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s t u v w x"), (1, "one"), (1, "two"), (1, "one"), (2, "two"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, id int")
    got = sorted(((r.doc_id or 0), r.text or "") for r in neardup.one_of_each(docs).collect())
    assert got == [(0, "a b c d e f g"), (0, "q r s t u v w x"), (1, "one"), (1, "two"), (3, "")]
    assert decontam.clean(docs, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == len(rows)
