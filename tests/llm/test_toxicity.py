from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from cohortlab.llm import toxicity as tx

random.seed(2)
CLEAN = ["".join(random.choice("aeiou" if k % 2 else "bdlmnrst") for k in range(random.randint(3, 8))) for _ in range(400)]


def prose(n, bad=()):
    words = [random.choice(CLEAN) for _ in range(n)]
    for w in bad:
        words.insert(random.randrange(len(words) + 1), w)
    return " ".join(words)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tx.Network.fresh().p.items()}
    n, t, g = 3, 5, 4
    word, grams = rng.integers(0, 40, (n, t)), rng.integers(0, 40, (n, t, g))
    counts, mask = rng.integers(1, g + 1, (n, t)), np.ones((n, t))
    mask[0, 3:] = 0
    args = word, grams, counts * (mask > 0), mask, np.array([1.0, 0, 1]), np.array([1.0, 0.5, 2]), (rng.random((n, t)) > 0.3) * mask
    _, _, grad = tx.loss_and_grads(p, *args)
    for name in p:
        flat = p[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(grad[name].reshape(-1)) > 1e-7), 4) if np.abs(grad[name]).max() > 1e-7 else []:
            old, e = flat[i], 1e-4
            flat[i] = old + e
            up = tx.loss_and_grads(p, *args)[0]
            flat[i] = old - e
            down = tx.loss_and_grads(p, *args)[0]
            flat[i] = old
            assert grad[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), rel=0.02, abs=2e-5), name


def one_window(net, words):
    """The training forward pass over one window, without padding."""
    buckets, run, at = tx.word_rows(words)
    size = np.diff(np.append(at, run.size))
    grams = np.zeros((1, len(words), size.max()), np.int64)
    for i, (a, k) in enumerate(zip(at, size, strict=True)):
        grams[0, i, :k] = run[a : a + k]
    ones = np.ones((1, len(words)), np.float32)
    return float(tx.loss_and_grads(net.p, buckets[None], grams, size[None], ones, np.zeros(1), np.ones(1), ones)[1][0])


def test_text_score_is_its_worst_window():
    net = tx.Network.fresh(9)
    net.slope, net.shift = 1.3, 0.2
    texts = [prose(1), prose(24), prose(25), prose(37), prose(300), None, "", "!!!", "é😀 \n"]
    got = net.scores(texts)
    for text, score in zip(texts, got, strict=True):
        words = tx.words_of(text)
        if not words:
            assert score == 0.0
            continue
        worst = max(one_window(net, words[s : s + tx.WINDOW]) for s in range(0, max(1, len(words) - tx.WINDOW + tx.STRIDE), tx.STRIDE))
        assert score == pytest.approx(1 / (1 + np.exp(-(worst * 1.3 + 0.2))), abs=1e-5)
    assert (net.scores([*texts, *texts])[: len(texts)] == net.scores(texts)).all()


def test_all_characters_of_long_words_count():
    net, long = tx.Network.fresh(9), "x" * 100_000
    assert tx.words_of(long + " y") == ["x" * 24] * 4166 + ["x" * 16, "y"]
    assert net.scores([long + "q"])[0] != net.scores([long])[0]


def test_labels_that_differ_teach_nothing_and_repeated_ones_count_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)] + [(2, "second text of 2")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (2, 0), (2, 0), (3, 5), (4, None), (None, 1)], "doc_id long, toxic int")
    rows, prior, toxic = tx.labelled_sample(docs, labels, clean=10, toxic_texts=10, id_col="doc_id", text_col="text", label_col="toxic")
    assert sorted((r.id, r.text, r.y) for r in rows.collect()) == [(0, "text 0", 1), (2, "second text of 2", 0), (2, "text 2", 0)]
    assert (prior, toxic) == (0.5, 1)


def test_query_on_the_smallest_tables(spark):
    from cohortlab.llm import queries

    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_learns_words_and_unseen_forms_of_them(spark):
    def bad(k):
        return [f"grumf{random.choice(CLEAN)}" if random.random() < 0.5 else "blakk" for _ in range(k)]

    rows = [(i, prose(random.randint(5, 200), bad(3) if i % 4 == 0 else ()), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows[:400]] + [(None, "x", 0.1), (1, None, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:400]] + [(None, 1), (7, None)], "doc_id long, toxic int")
    net = tx.train(docs, labels, per_label=80, mined=2)
    test = spark.createDataFrame([(i, t) for i, t, _ in rows[400:]] + [(9001, None), (9002, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in tx.score(test, net, ["doc_id"]).collect()}
    assert got[9001] == got[9002] == 0.0
    hits = [(got[i] >= 0.3) == bool(y) for i, _, y in rows[400:]]
    assert np.mean(hits) > 0.95


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.train(docs, none) is None
    assert [r.score for r in tx.score(docs, None, ["doc_id"]).collect()] == [0.0]
    assert tx.score(docs.limit(0), None, ["doc_id"]).count() == 0
