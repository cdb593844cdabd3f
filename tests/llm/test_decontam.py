from __future__ import annotations

import random
from collections import defaultdict

import regex

from cohortlab.llm import decontam as dc
from cohortlab.llm import queries

random.seed(12)
WORDS = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "e", "io", "un", "arl", "ost", "ing")]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def plain_tokens(text):
    """(slot kind or '', lower-case value), told word by word."""
    out, last_number = [], None
    for m in regex.finditer(r"\p{Nd}+(?:[.,:/]\p{Nd}+)*|[\p{L}\p{M}\p{N}]+", text or ""):
        w = m.group()
        if regex.fullmatch(r"\p{Nd}+(?:[.,:/]\p{Nd}+)*", w):
            out.append(("number", w))
            last_number = m.end()
            continue
        near = last_number is not None and regex.fullmatch(r"[ \t]?", text[last_number : m.start()])
        if near and regex.fullmatch(f"(?i:{dc.UNITS})", w):
            kind = "unit"
        elif regex.match(r"\p{Lu}\p{Ll}", w) and w not in dc.OPENERS.split("|"):
            kind = "name"
        else:
            kind = ""
        out.append((kind, w.lower()))
        last_number = None
    return out


def brute(docs, bench, width=8, least=3, consistency=0.75):
    """Pairs by comparing every window of every document with every window of every item."""
    found = set()

    def windows(words, k):
        for x in range(len(words) - k + 1):
            u = tuple(words[x : x + k])
            dense = 2 * sum(bool(kind) for kind, _ in u) > k
            yield x, u, (dense, u if dense else tuple((a, "" if a else w) for a, w in u))

    of = []
    for j, text in bench:
        b = plain_tokens(text)
        k, by = min(width, len(b)), defaultdict(list)
        for y, v, key in windows(b, k) if k else ():
            by[key].append((y, v))
        of.append((j, len(b), k, by))
    for i, text in docs:
        d = plain_tokens(text)
        own = {k: list(windows(d, k)) for k in {k for *_, k, _ in of} if k}
        for j, _, k, by in of:
            if not k or k < dc.LEAST_TOKENS and len(d) != k:
                continue
            places = defaultdict(lambda: ([], []))
            for x, u, key in own[k]:
                for y, v in by.get(key, ()):
                    places[x - y][key[0]].append((y, [(q, p) for (a, p), (_, q) in zip(u, v, strict=True) if a]))
            light, dense = set(), set()
            for some, dense_ in places.values():
                pairs = {p for _, ps in some for p in ps}
                if not pairs or min(len({p[0] for p in pairs}), len({p[1] for p in pairs})) >= consistency * len(pairs):
                    light |= {y for y, _ in some}
                dense |= {y for y, _ in dense_}
            n, m = sum(map(len, by.values())), sum(len(v) for key, v in by.items() if not key[0])
            if len(light) >= max(1, min(least, m)) or len(light) + len(dense) >= min(least, n):
                found.add((i, j))
    return found


def question(rng):
    kinds = [lambda: rng.choice(["Mary", "Anna", "Peter", "Ida"]), lambda: str(rng.randint(1, 99)), lambda: f"{rng.randint(1, 9)} {rng.choice(['km', 'miles', 'kg'])}", *[lambda: rng.choice(WORDS)] * 5]
    return [rng.choice(kinds)() for _ in range(rng.randint(6, 24))]


def test_slots_against_brute_force(spark):
    rng = random.Random(21)
    items = [question(rng) for _ in range(25)]
    bench = [(k, " ".join(x)) for k, x in enumerate(items)] + [(90, "word"), (91, "Mary 3 km"), (92, "two such words")]
    docs = []
    for i in range(200):
        x = list(rng.choice(items))
        names = {n: rng.choice(["Mary", "Olga", "Karl"]) for n in ("Mary", "Anna", "Peter", "Ida")}
        change = rng.choice([0, 0.2, 1])
        x = [names[w] if w in names and rng.random() < change else str(rng.randint(1, 99)) if w.isdigit() and rng.random() < change else w for w in x]
        cut = rng.choice([0, 0, 3])
        docs.append((i, " ".join([*question(rng), rng.choice([".", "", "The"]), *x[cut:], *question(rng)])))
    docs += [(300, "word"), (301, "one word more"), (302, "Anna 4 miles"), (303, "Mary 3 km"), (304, "two such words")]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, bench)
    assert {(300, 90), (303, 91), (304, 92)} <= {(r.doc_id, r.item_id) for r in got} and not [r for r in got if r.doc_id in (301, 302)]


def test_names_where_a_sentence_begins_and_names_that_fall_together(spark):
    item = "Mary sells rope to Paul and then Paul sells it on to Mary again today"
    docs = {1: "Olga sells rope to Karl and then Karl sells it on to Olga again today", 2: "Olga sells rope to Olga and then Olga sells it on to Olga again today"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in dc.contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert sorted(got) == [1] and got[1].windows == got[1].item_windows


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = queries.op5_decontamination(spark, path).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, bench)


def test_plain_passages_against_brute_force(spark):
    bench = [(k, prose(random.randint(9, 50))) for k in range(12)] + [(50, prose(5)), (51, None), (52, ""), (53, "...")]
    docs = []
    for i in range(120):
        own = prose(random.randint(5, 120))
        if i % 3 == 0:
            b = random.choice(bench[:13])[1].split()
            cut = random.choice([0, 0, 4, len(b) // 2])
            own = f"{own} {' '.join(b[cut:])} {prose(20)}"
        docs.append((i, own))
    docs += [(200, None), (201, ""), (202, bench[0][1] + " x" * 20_000), (3, docs[3][1]), (None, bench[1][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, h int")
    b = spark.createDataFrame([(*r, 1) for r in bench], "item_id long, text string, pos int")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()}
    assert got == brute(docs, bench)
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(d.limit(0), b).collect()} == set()
    assert dc.contaminated(d, b.limit(0)).count() == 0


def test_other_numbers_names_and_units_are_the_same_question(spark):
    item = "If the shop of Mary sells 15 km of rope to 9 men, then Mary has 15 km less rope today."
    docs = {
        1: "Well. If the shop of Anna sells 12 km of rope to 3 men, then Anna has 12 km less rope today.",
        2: "hm the shop of Peter sells 7.5 miles of rope to 4 men, then Peter has 7.5 miles less rope today.",
        3: "hm the shop of Peter sells 77 km of rope to 4 men, then Paul has 78 km less rope today.",  # slots disagree
        4: "if the shop of the town sells some rope to the men then it has less rope",
        5: item,
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.contaminated(d, b).collect()}
    assert sorted(got) == [1, 2, 5]
    assert got[5].verbatim and not got[1].verbatim and got[1].slots >= 3 and got[1].consistency == 1.0


def test_windows_of_slots_alone_do_not_match(spark):
    d = spark.createDataFrame([(1, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "90 91 92 93 94 95 96 97 98 99 100 101")], "item_id long, text string")
    assert dc.contaminated(d, b).count() == 0


def test_verbatim_copies_of_slot_heavy_items_are_found(spark):
    items = {1: "What is 12 + 34 * 56?", 2: "7 11 18 29 47 76 123 199 322 521 843", 3: "the winners were, Anna Berg, Carl Dahl, Eva Falk, Gert Holm, Ida Juhl"}
    docs = [(k, f"some words stand here first. {t} and some more follow") for k, t in items.items()]
    docs += [(11, "first. What is 13 + 34 * 57? and more"), (12, "first 7 11 18 29 47 75 123 198 322 520 843 and more")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.verbatim) for r in dc.contaminated(d, b).collect()) == [(k, k, True) for k in items]


def test_slot_heavy_windows_do_not_raise_what_the_others_need(spark):
    item = "please add up the numbers of this list 7 11 18 29 47 76 123 199 322"
    d = spark.createDataFrame([(1, "now please add up the numbers of this list 8 12 19 30 48 77 124 200 323")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, "add up the numbers of this list 5 6 7 8 9 1 2")], "item_id long, text string")
    assert 1 in {r.item_id for r in dc.contaminated(d, b).collect()}
