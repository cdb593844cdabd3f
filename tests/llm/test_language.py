from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cohortlab.llm import language, queries

random.seed(9)
SYLLABLES = {"en": "the and ing er tion of is wh", "de": "der sch ung ein ich keit zu", "fr": "eau que les oi ent ai", "es": "cion que ar os ado ll", "xx": "zyx qwq kjk"}


def prose(lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(random.choice(s) for _ in range(random.randint(1, 3))) for _ in range(n))


def test_machines_separate_classes_they_can():
    rng = np.random.default_rng(0)
    bags = [(np.unique(rng.integers(0, 50, 10) + (50 if y > 0 else 0)), None) for y in [1, -1] * 60]
    bags = [(at, np.full(at.size, at.size**-0.5)) for at, _ in bags]
    y = np.array([1.0, -1.0] * 60)
    w = language.train_svm(bags, y)
    assert all(w[at].dot(x) * t > 0 for (at, x), t in zip(bags, y, strict=True))


def test_families_then_languages():
    model = language.fit([(prose(x, random.randint(3, 60)), x) for x in SYLLABLES for _ in range(60)])
    assert model.families == ["germanic", "romance", "xx"] and ["en"] not in model.members and model.members[0] == ["de", "en"]
    right = [model.predict(prose(x, random.randint(5, 80)))[0] == x for x in SYLLABLES for _ in range(40)]
    assert np.mean(right) > 0.97
    for text in (None, "", " 12 !? \n", "😀"):
        assert model.predict(text) == ("und", None, 0.0)
    name, family, score = model.predict(prose("de", 40) + " 99 ")
    assert (name, family) == ("de", "germanic") and 0 <= score <= 1
    assert model.predict("der schung " * 200_000)[0] == "de"  # beyond one piece


def brute_grams(text):
    """Rows of all n-grams, one by one, over letters and single gaps."""
    out, flat = Counter(), " "
    for ch in text.lower():
        if ch.isalpha():
            flat += ch
        elif flat[-1] != " ":
            flat += " "
    for k in range(language.ORDERS):
        for i in range(len(flat) - k):
            h = 0
            for j in range(k + 1):
                h = (h * 2654435761 + (ord(flat[i + j]) + 1) * (0x9E3779B1 + 2 * j)) % 2**32
            out[(h >> (32 - language.BITS)) + (k << language.BITS)] += 1
    return out


def brute_predict(model, text):
    bag = brute_grams(text)
    n = sum(bag.values())
    margin = [sum(model.table[row, j] * times for row, times in bag.items()) / n**0.5 for j in range(model.table.shape[1])]
    family = max(range(len(model.families)), key=lambda f: margin[f])
    votes, support = Counter(), Counter()
    for j, (f, a, b) in enumerate(model.pairs, len(model.families)):
        if f == family:
            votes[a if margin[j] >= 0 else b] += 1
            support[a] += margin[j]
            support[b] -= margin[j]
    best = max(range(len(model.members[family])), key=lambda i: (votes[i], support[i], -i))
    return model.members[family][best], model.families[family]


def test_predictions_against_a_loop_over_bags(spark, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 37)
    codes = [*SYLLABLES, "nl", "pt"]
    more = SYLLABLES | {"nl": "oe ij aan het een van", "pt": "cao que nh lh ar os"}
    prose_ = lambda x, n: " ".join("".join(random.choice(more[x].split()) for _ in range(random.randint(1, 3))) for _ in range(n))
    model = language.fit([(prose_(x, random.randint(3, 60)), x) for x in codes for _ in range(40)])
    texts = [prose_(random.choice(codes), random.choice((1, 2, 7, 60))) + random.choice(("", " 12.", "\n-- É")) for _ in range(60)] + ["a", "  É!x", "ǅ İ"]
    rows = [(i, t, "x") for i, t in enumerate([*texts, texts[0], None, "", "7 !"])]
    got = {r.doc_id: (r.lang_pred, r.family) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model, ["doc_id"]).collect()}
    assert got == {i: brute_predict(model, t) if t and any(c.isalpha() for c in t) else ("und", None) for i, t, _ in rows}


def test_training_reads_whole_texts(spark):
    long = "".join(random.choice("abcdefg hij") for _ in range(5000))
    cut = language.pieces(long)
    assert cut[0] + "".join(x[language.ORDERS - 1 :] for x in cut[1:]) == long
    whole, parts = brute_grams(long), Counter()
    for x in cut:
        parts |= brute_grams(x)
    assert set(whole) <= set(parts) | set(brute_grams(" "))
    docs = spark.createDataFrame([(1, long, "en"), (2, None, "en"), (3, "x", None), (None, "abc", "fr")], "doc_id long, text string, lang string")
    assert sorted(language.training_texts(docs)) == sorted([(x, "en") for x in cut] + [("abc", "fr")])
    assert language.training_texts(docs.limit(0)) == []


def test_one_language_or_none():
    only = language.fit([("abc def", "en")] * 3)
    assert only.predict("anything")[0] == "en" and only.predict("1")[0] == "und"
    assert language.fit([]).predict("abc")[0] == "und"


def test_query_on_held_out_documents(spark):
    rows = queries.op4_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_filter_keeps_columns_and_drops_letterless_rows(spark):
    model = language.fit([(prose(x, 20), x) for x in ("en", "fr") for _ in range(30)])
    df = spark.createDataFrame([(1, prose("en", 9), "a", 0.5), (2, None, "b", 0.5), (3, "12", None, 0.5), (1, prose("fr", 9), "a", None)], "doc_id long, text string, lang_pred string, score double")
    got = language.identified(df, model)
    assert got.columns == df.columns and [r.doc_id for r in got.collect()] == [1, 1]
    assert language.identified(df.limit(0), model).count() == 0
    named = df.select("doc_id", "text", F.when(F.col("doc_id") == 1, F.lit(None)).otherwise("xx").cast("string").alias("lang"))
    assert {r.lang for r in language.identified(named, model).collect()} == {"en", "fr"}
    assert language.identify(df.limit(0), model, ["doc_id"]).count() == 0
