from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import mixture, queries

random.seed(4)


def brute_targets(sizes, weights=(1, 2, 3), cap=3.0):
    """Shared by weight; what lies above a source's cap is shared again, until none is above."""
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    target, left, open_ = dict.fromkeys(keys, 0.0), float(sum(sizes.values())), set(keys)
    while open_ and left > 1e-9:
        share = {k: target[k] + left * w[k] / sum(w[x] for x in open_) for k in open_}
        left = sum(max(0.0, v - cap * sizes[k]) for k, v in share.items())
        for k, v in share.items():
            target[k] = min(v, cap * sizes[k])
        open_ = {k for k in open_ if target[k] < cap * sizes[k] - 1e-9}
    return target


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets, out = brute_targets(sizes), []
    for s, total in sizes.items():
        own = [(hashlib.md5(f"0|{'~' if i is None else i}|{t or ''}".encode()).hexdigest()[:12], i, size(t)) for i, t, x in rows if x == s]
        whole = int(targets[s] / total + 1e-12) if total else 0
        need, cum, extra = targets[s] - whole * total, 0, {}
        for h in sorted({o[0] for o in own}):
            tie = sum(o[2] for o in own if o[0] == h)
            extra[h] = cum + tie <= need or (cum <= need and tie <= 2 * (need - cum))
            cum += tie
        out += [(i, n, total, round(targets[s], 6), n * (whole + extra[h])) for h, i, n in own]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, hash string")


@pytest.mark.parametrize("kind", ["mixed", "one_hot", "tiny"])
def test_against_brute_force(spark, kind):
    texts = lambda: " ".join("w" for _ in range(random.randint(0, 60)))
    if kind == "mixed":
        rows = [(i, texts(), random.choice(["a", "b", "é", "z"])) for i in range(300)] + [(None, "x y", None), (7, None, None), (8, "", "b"), (9, "t " * 4000, "a"), (9, "t " * 4000, "a")]
    elif kind == "one_hot":
        rows = [(i, texts(), "hot" if i % 10 else f"s{i % 7}") for i in range(400)]
    else:
        rows = [(1, "one", "a"), (2, None, "b"), (3, "two words", "c")]
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixture.mix_sources(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    for s in {r[2] for r in rows}:
        own = [g for g, r in zip(got, got, strict=True)]
        assert all(taken <= 3 * size for _, size, _, _, taken in own), s


def test_empty_table(spark):
    assert mixture.mix_sources(table(spark, [])).count() == 0
    assert mixture.mixed(table(spark, [])).count() == 0


def test_sql_is_text_and_its_queries_exist():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert all(isinstance(x, str) for x in queries.oracle_sql().values())


def test_query_against_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.sql(queries.OP8_SQL).fetchall())
    cols = [c[0] for c in con.sql(queries.OP8_SQL).description]
    got = sorted(tuple(r) for r in queries.op8_mixture(spark, d).select(*cols).collect())
    assert [(a[:3], a[4]) for a in got] == [(tuple(b[:3]), b[4]) for b in want]
    assert [a[3] for a in got] == pytest.approx([b[3] for b in want])
    sums = queries.op8_mixture(spark, d).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.target) <= r.m for r in sums)
