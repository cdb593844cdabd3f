from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import lm, queries

random.seed(5)
TEXTS = ["a b a b a c", "A b\ta b", "x", "", None, "a b a c a b", "z a b é\x0bq", "a b " * 300, " lead and trail \n"]
TEXTS += [" ".join(random.choice("abcdefghijkl") * random.choice((1, 1, 2)) for _ in range(random.choice((3, 30, 200)))) for _ in range(40)]


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


class Brute:
    """The same model from dictionaries of word tuples, each probability by recursion."""

    def __init__(self, texts):
        self.c = Counter()
        for t in texts:
            w = brute_words(t)
            self.c.update((x,) for x in w)
            self.c.update(zip(["<s>", *w], w))
            self.c.update(zip(["<s>", *w], w, w[1:]))
        one = {g[0]: n for g, n in self.c.items() if len(g) == 1}
        self.n, self.v = sum(one.values()), len(one)
        n1, n2 = (sum(x == k for x in one.values()) for k in (1, 2))
        self.d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.m = {k: self.strength(k) for k in (2, 3)}

    def context(self, h):
        """How often the context stands before a token."""
        if h == ("<s>",):
            return self.c[("</s>",)]
        return self.c[h]

    def strength(self, k):
        grams = [g for g in self.c if len(g) == k]
        contexts = [self.context(h) for h in {g[:-1] for g in grams}]
        places = sum(self.c[g] for g in grams)
        if not places:
            return 1.0
        share = sum(self.c[g] == 1 for g in grams) / places
        low, high = 1e-3, 1e6
        for _ in range(200):
            mid = math.sqrt(low * high)
            new = sum(c * mid / (c - 1 + mid) for c in contexts) / sum(contexts)
            low, high = (mid, high) if new < share else (low, mid)
        return low

    def p(self, h, w):
        if not h:
            c = self.c[(w,)]
            return (c - self.d) / self.n if c else self.d * self.v / self.n
        if not self.context(h):
            return self.p(h[1:], w)
        m = self.m[len(h) + 1]
        return (self.c[(*h, w)] + m * self.p(h[1:], w)) / (self.context(h) + m)

    def score(self, text):
        words = ["<s>", *brute_words(text)]
        return sum(math.log10(self.p(tuple(words[max(0, i - 2) : i]), words[i])) for i in range(1, len(words)))


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, t, i % 5 != 1, "x") for i, t in enumerate([*TEXTS, "new words a b", "a b", "a b", None])]
    df = spark.createDataFrame([*rows, (None, "a b", None, "x")], "id long, text string, yes boolean, base_score string").repartition(3)
    out, model = lm.score(df, F.col("yes"), ["id"])
    return rows, out.collect(), model


def test_scores_against_a_dictionary_model(scored):
    rows, got, model = scored
    brute = Brute([t for _, t, yes, _ in rows if yes])
    assert (model.tokens, model.types) == (brute.n, brute.v) and model.discount == pytest.approx(brute.d)
    assert model.pair == pytest.approx(brute.m[2], rel=1e-6) and model.triple == pytest.approx(brute.m[3], rel=1e-6)
    by = {r.id: r for r in got}
    assert len(got) == len(rows) + 1
    z = brute.n + 0.5 * (brute.v + 1)
    for i, t, *_ in [*rows, (None, "a b")]:
        words = brute_words(t)
        assert by[i].n_tokens == len(words) and by[i].n_known == sum(brute.c[(w,)] > 0 for w in words)
        assert by[i].base_score == pytest.approx(sum(math.log10((brute.c[(w,)] + 0.5) / z) for w in words))
        assert by[i].score == pytest.approx(brute.score(t), rel=1e-5)


def test_every_context_is_a_distribution(scored):
    rows, _, _ = scored
    brute = Brute([t for _, t, yes, _ in rows if yes])
    words = [g[0] for g in brute.c if len(g) == 1] + ["unknown"]
    contexts = [(), ("<s>",), ("a",), ("a", "b"), ("<s>", "a"), ("never", "a"), ("never",)]
    for h in contexts:
        assert sum(brute.p(h, w) for w in words) == pytest.approx(1.0)


def test_blocks_and_parts_do_not_change_scores(spark, scored, monkeypatch):
    rows, got, _ = scored
    for name, size in (("BLOCK_TOKENS", 64), ("PART_GRAMS", 32)):
        monkeypatch.setattr(lm, name, size)
    df = spark.createDataFrame(rows, "id long, text string, yes boolean, base_score string").repartition(2)
    out, _ = lm.score(df, F.col("yes"), ["id"])
    assert {r.id: round(r.score, 6) for r in out.collect()} == {r.id: round(r.score, 6) for r in got if r.id is not None}


def test_words_are_hashed_alike_whatever_stands_around_them(monkeypatch):
    text = ("Ab é\x0b" + "x" * 500 + " y\n\n" + "long words here " * 40).encode()
    whole = lm._hash(np.frombuffer(text, np.uint8))[1]
    assert whole.size == np.unique(whole).size + 3 * 39
    monkeypatch.setattr(lm, "PIECE", 64)
    assert (lm.word_hashes(text) == whole).all()
    hashes, sizes = lm.token_hashes([text.decode(), "", None, "AB", " ab "])
    assert sizes.tolist() == [whole.size + 1, 1, 1, 2, 2]
    assert (hashes[: whole.size] == whole).all() and hashes[-2] == hashes[-4] == whole[0]


def test_no_training_text_and_empty_table(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    out, model = lm.score(df, F.lit(False), ["text"])
    assert model.tokens == 0
    assert [(r.n_tokens, r.n_known, r.score, r.base_score) for r in sorted(out.collect(), key=lambda r: r.text or "")] == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert lm.score(df.limit(0), F.lit(True), ["text"])[0].count() == 0


def test_query(spark):
    rows = queries.op7_lm(spark, "/root/testdata/sf0.001").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    assert {r.train_tokens for r in rows} == {sum(r.n_tokens for r in rows if not r.held_out)}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
