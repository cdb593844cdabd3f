from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import licenses as L

random.seed(5)
WORDS = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30))
def test_rising_is_longest(values):
    got = [values[i] for i in L.rising(values)]
    assert got == sorted(set(got))
    best = [0] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < v], default=0)
    assert len(got) == max(best, default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=14), st.lists(st.sampled_from("abcdef"), max_size=14))
def test_patience_is_a_rising_match(a, b):
    pairs = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) <= len(L.common_words(a, b))
    if len(set(a)) == len(a) and a == b:
        assert len(pairs) == len(a)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=14), st.lists(st.sampled_from("abcdef"), max_size=14))
def test_common_words_are_a_longest_match(a, b):
    pairs = L.common_words(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(pairs) == best[-1][-1]


def test_offsets_are_those_of_the_text_as_it_stands(spark):
    rows = [(1, "İİİİİ Sed RELEASED under the MIT License. After"), (2, "ΑΣ ß Licensed under the MIT License\u0301 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.passage for r in L.find_licenses(df).collect()}
    assert got == {1: "RELEASED under the MIT License", 2: "Licensed under the MIT License"}


def test_a_long_license_of_repeated_words():
    words = [random.choice(["shall", "may", "must", "work", "copy", "term"]) for _ in range(900)]
    known = L.templates({"own": (" ".join(words),)}, 0.85)
    lost = [w for i, w in enumerate(words) if i % 12]
    got = L.scan(f"{prose(50)} {' '.join(lost)} {prose(50)}", known, 0.85)
    assert [(g[0], g[2]) for g in got] == [("own", len(lost))]


def all_windows(text, known, coverage):
    """Licenses found by the longest common subsequence of every stretch with every template."""
    words = L.WORD.findall(text.lower())
    found = set()
    for t in known:
        n = len(t.words)
        for lo in range(0, len(words)):
            same = len(L.common_words(words[lo : lo + n + 6], list(t.words)))
            if same >= coverage * n - 1e-9:
                found.add((same, same / n, t.license))
    return {name for *most, name in found if tuple(most) == max(found)[:2]}


def test_planted_notices_against_all_windows():
    short = {k: tuple(x for x in v if len(x) < 90) for k, v in L.TEMPLATES.items()}
    known = [t for t in L.templates(short, 0.85)]
    for name, versions in short.items():
        for text in versions:
            for planted in (text, text.upper(), text.replace(" ", "\n"), f"{text[:9]}{text[9:]}"):
                doc = f"{prose(40)} license {prose(8)} {planted} {prose(40)}"
                got = L.scan(doc, known, 0.85)
                assert [g[0] for g in got] == [name]
                assert doc[got[0][3] : got[0][4]].lower().split()[0] in planted.lower()
                assert name in all_windows(doc, known, 0.85)
    for _ in range(20):
        doc = prose(120) + " license " + prose(20)
        assert L.scan(doc, known, 0.85) == [] and all_windows(doc, known, 0.85) == set()


def test_long_headers_with_holders_and_lost_words():
    known = L.templates(L.TEMPLATES, 0.85)
    mit = L.TEMPLATES["MIT"][2].split()
    mit[20:20] = ["Copyright", "(c)", "2020", "Ada"]
    del mit[40:44]
    got = L.scan(f"{prose(50)} {' '.join(mit)} {prose(50)}", known, 0.85)
    assert [g[0] for g in got] == ["MIT"] and 0.9 < got[0][1] < 1
    two = f"{L.TEMPLATES['Apache-2.0'][1]} {prose(30)} {L.TEMPLATES['MIT'][0]} {prose(3)} {L.TEMPLATES['MIT'][0]}"
    assert [g[0] for g in L.scan(two, known, 0.85)] == ["Apache-2.0", "MIT", "MIT"]


def test_long_notices_twice_near_one_another():
    known = L.templates(L.TEMPLATES, 0.85)
    for name in ("MIT", "Apache-2.0", "BSD-3-Clause"):
        notice = max(L.TEMPLATES[name], key=len)
        for gap in (0, 10, 40, 60, 80, 150):
            for copies in (2, 3):
                text = f" {prose(gap)} ".join([notice] * copies)
                got = L.scan(f"{prose(200)} {text} {prose(200)}", known, 0.85)
                assert [g[0] for g in got] == [name] * copies, (name, gap, copies)
                assert all(g[1] > 0.95 for g in got)


def test_table_with_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (None, "licensed under cc by-sa 4.0")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, license int")
    got = sorted((r.doc_id or 0, r.license, r.start) for r in L.find_licenses(df).collect())
    assert got == [(0, "CC-BY-SA-4.0", 0), (4, "MIT", 0), (4, "MIT", 0)]
    assert L.find_licenses(df.limit(0)).count() == 0
