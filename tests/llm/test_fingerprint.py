from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cohortlab.llm import fingerprint as fp
from cohortlab.llm import queries
from cohortlab.llm.arrow import code_points

random.seed(3)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(500)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def brute(text: str) -> np.ndarray:
    """The walk one step at a time, every slot choosing its step afterwards."""
    c = code_points(text)
    out = np.zeros((fp.WALKS, fp.SLOTS), np.uint8)
    pad = np.concatenate([c + np.uint32(1), np.zeros(fp.WIDE, np.uint32)])
    for walk in range(fp.WALKS if c.size else 0):
        path, k, j = [], 0, 0
        while k < c.size and j < fp.STEPS * c.size:
            path.append(k)
            cls = max(1, (int(pad[k]) * 2654435761 % 2**32) >> 24)
            k += int(fp.walk_bits(walk)[j % fp.CYCLE, cls])
            j += 1
        plan = fp.samples(walk)
        plan.extend(fp.STEPS * c.size)
        for slot in range(fp.SLOTS):
            step = max(s for s in plan.steps[plan.slots == slot] if s < len(path))
            h = 0
            for x in pad[path[step] : path[step] + fp.WIDE]:
                h = (h * 0x9E3779B1 + int(x)) % 2**32
            out[walk, slot] = (h * 0x85EBCA6B % 2**32) >> 24
    return out.ravel()


def test_batch_equals_one_step_at_a_time():
    texts = ["", "a", "ab", "é😀x", *(prose(n) for n in (3, 30, 200)), *(prose(20) for _ in range(40))]
    got = fp.fingerprints([code_points(t) for t in texts])
    for t, g in zip(texts, got, strict=True):
        assert (brute(t) == g).all()


def test_likeness_follows_edit_distance():
    near, half, far = [], [], []
    for _ in range(30):
        t = prose(500)
        few = list(t)
        for i in sorted(random.sample(range(len(t)), 5), reverse=True):
            few[i : i + 1] = random.choice(["", "zz", "q"])
        a, b, c, d = fp.fingerprints([code_points(x) for x in (t, "".join(few), t[: 2 * len(t) // 3] + prose(500)[: len(t) // 3], prose(500))])
        near.append(fp.likeness(a, b))
        half.append(fp.likeness(a, c))
        far.append(fp.likeness(a, d))
    assert np.mean(near) > 0.75 and 0.5 < min(half) and max(half) < 0.9 and max(far) < 0.15


@pytest.mark.parametrize("rows_per_part", [2, 1000])
def test_query_rows_against_a_plain_loop(spark, rows_per_part, monkeypatch):
    monkeypatch.setattr(fp.in_order, "__defaults__", (rows_per_part, 20_000))
    rows = [(i * 7 % 23, prose(i)) for i in range(23)] + [(5, "tie b"), (5, "tie a"), (None, None), *[(None, prose(k)) for k in range(7)], (40, ""), (41, "x" * 5000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.near_next) for r in fp.fingerprint_edits(df, chars=300).collect())
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).digest()))
    want = []
    for k, (i, t) in enumerate(order):
        o = order[(k + 1) % len(order)][1]
        f = fp.fingerprints([code_points(t), code_points(o)])
        want.append((i is not None, i or 0, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + o[: len(t) // 3]).encode()).hexdigest(), float(fp.likeness(f[0], f[1]))))
    assert got == sorted(want)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.fingerprint_edits(empty).count() == 0
    one = fp.fingerprint_edits(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 7


def test_text_ids_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(fp.in_order, "__defaults__", (2, 20_000))
    rows = [(f"id-{chr(97 + k % 26)}{k}", prose(k)) for k in range(30)] + [(None, "x y"), ("", "z"), ("é", "w")]
    got = {r.doc_id: r.edited_sha256 for r in fp.fingerprint_edits(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()), reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        o = order[(k + 1) % len(order)][1]
        want[i] = hashlib.sha256((t[: len(t) - len(t) // 3] + o[: len(t) // 3]).encode()).hexdigest()
    assert got == want


def classes(prints, least=0.8):
    """Classes by comparing all pairs."""
    at = list(range(len(prints)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(fp.likeness(np.broadcast_to(prints[i], prints[:i].shape), prints[:i]) >= least) if i else ():
            at[root(i)] = root(int(j))
    return [root(i) for i in range(len(prints))]


def test_classes_against_all_pairs(spark):
    """Recall of pairs that are alike over all pairs, with a crowded band: texts of one beginning."""
    texts, start = [], prose(200)
    for _ in range(150):
        base = prose(300)
        few = list(base)
        for i in sorted(random.sample(range(len(few)), random.choice([1, 3, 6])), reverse=True):
            few[i : i + 1] = random.choice(["", "zz", "q"])
        texts += [base, "".join(few)]
    texts += [start + prose(260) for _ in range(60)] + [texts[0], "", "", "ab", "x"]
    prints = fp.fingerprints([code_points(t) for t in texts])
    df = spark.createDataFrame([(i, x.tobytes().hex(), "c") for i, x in enumerate(prints)] + [(None, None, "n"), (None, prints[0].tobytes().hex(), "n")], "doc_id long, fingerprint string, label string")
    rows = fp.near_classes(df).collect()
    assert len(rows) == len(texts) + 2 and {r.label for r in rows} == {"c", "n"}
    got = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    want = classes(prints)
    least = {}
    for i, r in enumerate(want):
        least[r] = min(i, least.get(r, i))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    assert len(pairs) > 100 and sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert not [1 for i in range(len(texts)) for j in range(i) if got[i] == got[j] and want[i] != want[j]]
    assert {r.class_id for r in rows if r.doc_id is None} == {None, 0}
    assert fp.near_classes(df.limit(0)).count() == 0


def same_classes(spark, prints):
    df = spark.createDataFrame([(i, x.tobytes().hex()) for i, x in enumerate(prints)], "doc_id long, fingerprint string")
    want, least = classes(prints), {}
    for i, r in enumerate(want):
        least[r] = min(i, least.get(r, i))
    return {r.doc_id: r.class_id for r in fp.near_classes(df).collect()} == {i: least[r] for i, r in enumerate(want)}


@pytest.mark.parametrize("block", [4096, 50])
def test_crowded_bands_lose_no_class(spark, monkeypatch, block):
    """Slots of two values each: nearly every band is crowded, few of its nodes are alike."""
    monkeypatch.setattr(fp, "BLOCK", block, raising=False)
    rng = np.random.default_rng(5)
    prints = np.full((300, fp.WALKS * fp.SLOTS), 7, np.uint8)
    prints[:, rng.permutation(fp.WALKS * fp.SLOTS)[:88]] += rng.integers(0, 2, (300, 88), np.uint8)
    want = classes(prints)
    assert 20 < len(set(want)) < 280
    assert same_classes(spark, prints)


@pytest.mark.parametrize("block", [4096, 40])
def test_crowded_bands_are_told_in_one_pass(spark, monkeypatch, block):
    """Groups of near copies that meet in crowded bands: one table of links, whatever the bands."""
    calls, real = [], fp.components
    monkeypatch.setattr(fp, "BLOCK", block)
    monkeypatch.setattr(fp, "components", lambda links: calls.append(1) or real(links))
    rng = np.random.default_rng(9)
    prints = np.repeat(rng.integers(0, 2, (3, fp.WALKS * fp.SLOTS), np.uint8), 70, 0)
    prints[:, rng.permutation(fp.WALKS * fp.SLOTS)[:40]] = rng.integers(0, 9, (210, 40), np.uint8)
    want = classes(prints)
    assert 3 < len(set(want)) < 210
    assert same_classes(spark, prints) and len(calls) == 1


def test_any_two_alike_share_a_first_band():
    bands = fp.whole_bands(0.8)
    assert len(bands) == 13 * fp.WALKS and sorted(k for b in bands for k in b) == list(range(fp.WALKS * fp.SLOTS))
    assert len(fp.whole_bands(1.0)) == fp.WALKS and len(fp.whole_bands(0.0)) == fp.SLOTS * fp.WALKS


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op6_fingerprint(spark, path).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r.doc_id)
    same = {}
    for k, r in enumerate(order):
        t, o, g = r.text or "", order[(k + 1) % len(order)].text or "", got[r.doc_id]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 3] + o[: len(t) // 3]).encode()).hexdigest()
        assert same.setdefault(t, (g.fingerprint, g.class_id)) == (g.fingerprint, g.class_id) and g.class_id <= r.doc_id
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
