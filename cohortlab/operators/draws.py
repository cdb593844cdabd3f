"""Sums over drawn rows, many resamples at a time.

Slot s of resample r draws row number md5("seed|r|s") mod k, the first eight hex digits
counting; k is the group's number of rows. The digests do not depend on the group: they are
computed once for all groups, in numpy, a tile of slots at a time, and no draw becomes a row
of a table. A task takes some resamples and reads the counts of all rows, packed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.shipping import ship

#: Slots digested at once, rows packed into one, rows a task holds at once (more are gone through
#: in several passes over the digests) and tasks a core.
TILE, PACK, HELD, TASKS = 16384, 4096, 1 << 22, 4

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in four]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_FULL = 0xFFFFFFFF
_ADDS, _LEFT, _RIGHT = ([np.array(x, np.uint32) for x in xs] for xs in (_K, _TURN, [32 - x for x in _TURN]))


def _mixed(i: int, b, c, d):
    return d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | (d ^ np.uint32(_FULL)))


class Tile:
    """The digests of slots first .. first + n - 1, all of as many digits."""

    def __init__(self, first: int, n: int) -> None:
        self.n, self.width = n, len(str(first))
        slots = np.arange(first, first + n)
        self.digits = np.stack([slots // 10**e % 10 + 48 for e in range(self.width - 1, -1, -1)], 1).astype(np.uint8)
        self.words: dict[int, list[np.ndarray]] = {}
        self.spare = [np.empty(n, np.uint32) for _ in range(2)]

    def behind(self, shift: int) -> list[np.ndarray]:
        """Words of the digits and the mark of the end, from `shift` bytes into a word on."""
        if shift not in self.words:
            raw = np.zeros((self.n, -(-(shift + self.width + 1) // 4) * 4), np.uint8)
            raw[:, shift : shift + self.width] = self.digits
            raw[:, shift + self.width] = 0x80
            self.words[shift] = list(np.ascontiguousarray(raw.view("<u4").T).astype(np.uint32))
        return self.words[shift]

    def numbers(self, prefix: bytes) -> np.ndarray:
        """Of prefix + slot: the first eight hex digits of the md5, as a number."""
        begin, shift = divmod(len(prefix), 4)
        if len(prefix) + self.width > 55:
            raise ValueError("seed, resample and slot are longer than one block")
        head = np.frombuffer(prefix + bytes(-len(prefix) % 4), "<u4").tolist()
        tail = self.behind(shift)
        if shift:
            tail = [tail[0] | np.uint32(head[begin]), *tail[1:]]
        words = [*head[:begin], *tail, *[0] * (16 - begin - len(tail))]
        words[14] = 8 * (len(prefix) + self.width)
        a, b, c, d = _START
        for i in range(begin):  # the same for all slots
            f = (d ^ (b & (c ^ d))) + a + _K[i] + words[i] & _FULL
            a, b, c, d = d, b + (f << _TURN[i] | f >> 32 - _TURN[i]) & _FULL, b, c
        a, b, c, d = map(np.uint32, (a, b, c, d))
        with np.errstate(over="ignore"):
            for i in range(begin, begin + 4):
                f = _mixed(i, b, c, d) + a + np.uint32(_K[i]) + (words[i] if isinstance(words[i], np.ndarray) else np.uint32(words[i]))
                a, b, c, d = d, b + (f << np.uint32(_TURN[i]) | f >> np.uint32(32 - _TURN[i])), b, c
        (t, u), (add, xor, both) = self.spare, (np.add, np.bitwise_xor, np.bitwise_and)
        for i in range(begin + 4, 61):  # the last three steps leave the first word alone
            if i < 16:
                xor(c, d, t)
                both(t, b, t)
                xor(t, d, t)
            elif i < 32:
                xor(b, c, t)
                both(t, d, t)
                xor(t, c, t)
            elif i < 48:
                xor(b, c, t)
                xor(t, d, t)
            else:
                np.invert(d, t)
                np.bitwise_or(t, b, t)
                xor(t, c, t)
            add(a, t, a)
            word = words[_WORD[i]]
            if isinstance(word, np.ndarray):
                add(a, word, a)
                word = 0
            add(a, np.array(_K[i] + word & _FULL, np.uint32) if word else _ADDS[i], a)
            np.right_shift(a, _RIGHT[i], u)
            np.left_shift(a, _LEFT[i], a)
            np.bitwise_or(a, u, a)
            add(a, b, a)
            a, b, c, d = d, a, b, c
        return (b + np.uint32(_START[0])).byteswap()


def tiles(upto: int) -> Iterator[tuple[int, Tile]]:
    """Slots 1 .. upto."""
    first = 1
    while first <= upto:
        last = min(upto, first + TILE - 1, 10 ** len(str(first)) - 1)
        yield first, Tile(first, last - first + 1)
        first = last + 1


def remainder(numbers: np.ndarray, k: int) -> np.ndarray:
    """numbers mod k, for numbers below 2^32."""
    return numbers if k > _FULL else numbers - numbers // np.uint32(k) * np.uint32(k)


class Drawn:
    """Rows low .. low + len - 1 of a group's k, of which counts are added up."""

    def __init__(self, k: int, low: int, counts: np.ndarray, reps: int) -> None:
        self.k, self.low, self.counts, self.sums = k, low, counts, np.zeros((reps, len(counts)), np.int64)

    def add(self, rep: int, numbers: np.ndarray) -> None:
        at, (many, n) = remainder(numbers, self.k), self.counts.shape
        if n < self.k:
            at = at.astype(np.int64) - self.low
            at = at[(at >= 0) & (at < n)]
        for j in range(many):
            self.sums[rep, j] += self.counts[j].take(at).sum()


class Cells:
    """A group of k frames in the order of its cells, whose counts are given."""

    def __init__(self, k: int, low: int, counts: np.ndarray, reps: int) -> None:
        self.k, self.ends, self.sums = k, np.cumsum(counts[:, 0]).tolist(), np.zeros((reps, len(counts)), np.int64)

    def add(self, rep: int, numbers: np.ndarray) -> None:
        at = remainder(numbers, self.k)
        below = [np.count_nonzero(at < end) if end <= _FULL else at.size for end in self.ends[:-1]]
        self.sums[rep] += np.diff([0, *below, at.size])


def sums(rows: DataFrame, names: tuple[str, ...], reps: int, seed: int, *by: str, cells: bool = False) -> DataFrame:
    """(by.., rep, names..): sums of the counts `names` over the k rows that a resample draws.

    `rows` has by.., k, idx (0 .. k - 1 in a group) and the counts; or, with `cells`, one row a
    group, whose counts are those of its k frames by cell, and the frames are drawn.
    """
    ship(rows.sparkSession)
    tasks = min(reps, TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    packed = rows.withColumn("idx", F.lit(0)) if cells else rows
    row = F.struct(F.col("idx").cast("long").alias("idx"), *[F.col(n).cast("long").alias(n) for n in names])
    packed = packed.groupBy(*by, F.col("k").cast("long").alias("k"), F.expr(f"idx div {PACK}").alias("pack")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    packed = packed.select(*by, "k", "pack", *[F.col(f"rows.{n}").alias(n) for n in names])
    dealt = packed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    dealt = dealt.repartitionById(tasks, "task").sortWithinPartitions("task", *by, "pack")
    kind, most, span = Cells if cells else Drawn, HELD, [reps * t // tasks for t in range(tasks + 1)]
    out = [f for f in rows.select(*by).schema.fields] if by else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(task: int, types: list) -> Iterator[pa.RecordBatch]:
            low, n = span[task], span[task + 1] - span[task]
            groups: list[tuple[tuple, object]] = []
            at = 0
            while at < len(held):
                end = next((e for e in range(at + 1, len(held)) if held[e][0] != held[at][0]), len(held))
                groups.append((held[at][0], kind(held[at][1], held[at][2] * PACK, np.concatenate([h[3] for h in held[at:end]], 1), n)))
                at = end
            prefixes = [f"{seed}|{low + r + 1}|".encode() for r in range(n)]
            for first, tile in tiles(max(g.k for _, g in groups)):
                there = [(g, min(tile.n, g.k - first + 1)) for _, g in groups if g.k >= first]
                for r, prefix in enumerate(prefixes):
                    numbers = tile.numbers(prefix)
                    for g, upto in there:
                        g.add(r, numbers[:upto])
            for key, g in groups:
                cols = [pa.array([v] * n, t) for v, t in zip(key, types, strict=True)]
                cols += [pa.array(np.arange(low + 1, low + n + 1), pa.int32()), *[pa.array(c) for c in g.sums.T]]
                yield pa.RecordBatch.from_arrays(cols, [*by, "rep", *names])
            held.clear()

        task, size, types = None, 0, []
        for batch in batches:
            types = [batch.schema.field(b).type for b in by]
            keys = zip(*(batch.column(b).to_pylist() for b in by), strict=True) if by else [()] * batch.num_rows
            for i, (key, t, k, pack) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in ("task", "k", "pack")), strict=True)):
                counts = np.stack([batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in names])
                if held and (t != task or size + counts.shape[1] > most):
                    yield from flush(task, types)
                    size = 0
                task, size = t, size + counts.shape[1]
                held.append((key, k, pack, counts))
        if held:
            yield from flush(task, types)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in out], "rep int", *[f"{n} long" for n in names]])
    return dealt.mapInArrow(run, schema).groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])
