from __future__ import annotations

import random
import zlib

import pytest

from cohortlab.llm import sharding

random.seed(6)


@pytest.mark.parametrize(("n", "shards"), [(500, 8), (5, 8), (1, 3), (64, 1)])
def test_shards_are_even_gapless_and_match_the_mixture(spark, n, shards):
    rows = [(i if i % 50 else None, random.choice(["x é", "", None, "same", "y" * random.randint(0, 3000)]), random.choice(["hot", "hot", "hot", "a", None])) for i in range(n)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, shard int")
    got = sharding.shard_rows(df, shards=shards).collect()
    assert sorted(str((r.doc_id, r.source, r.size, r.text_crc32)) for r in got) == sorted(str((i, s, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, s in rows)
    sizes = [sum(r.shard == k for r in got) for k in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
        for s in ("hot", "a", None):
            share = sum(r.source == s for r in got) * sizes[k] / n
            assert abs(sum(r.source == s and r.shard == k for r in got) - share) <= 3
    again = sharding.shard_rows(df.repartition(3), shards=shards).collect()
    key = lambda r: str((r.doc_id, r.size, r.text_crc32, r.shard, r.slot))
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_order_is_that_of_one_global_sort(spark):
    """Ranks from histograms equal ranks from sorting everything."""
    df = spark.createDataFrame([(i, f"t{i}", f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(df, shards=4, seed=1).collect()}
    import hashlib

    h = {i: int(hashlib.md5(f"1|{i}|t{i}".encode()).hexdigest()[:13], 16) for i in range(300)}
    placed = []
    for s in range(3):
        u = (int(hashlib.md5(f"1|0s{s}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        own = sorted((i for i in range(300) if i % 3 == s), key=h.get)
        placed += [((r + u) / len(own), s, h[i], i) for r, i in enumerate(own)]
    for pos, (*_, i) in enumerate(sorted(placed)):
        assert got[i] == (pos * 4 // 300, pos - -(-(pos * 4 // 300) * 300 // 4))


def test_empty_table(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
