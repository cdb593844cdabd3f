"""Document fingerprints from a randomised edit embedding.

A pointer walks over the text: at step j it emits the character it points at and moves on
by a bit that depends on j and that character, the same bits for all texts. Texts at a
small edit distance fall into step again soon after each edit, so that their emitted
strings have a small Hamming distance. A text ends in a pad that never moves the pointer;
the walk ends there, after about 2 n steps (3 n at most).

The fingerprint samples the emitted string at fixed steps: slot k takes the walk's step
with the least priority under a hash of (k, step), so that texts of different lengths
sample the same step as often as their lengths allow, and records 8 bits of a hash of
the four characters there. Two independent walks fill half of the slots each: a walk that
an edit throws out of step may take long to fall in again, but seldom both. Likeness is the
larger share of equal slots of the two. Bands are sampled bits: all bits of a few slots of
one walk, drawn by a seed, which part the walk's slots so that fingerprints alike have one in
common for certain. Fingerprints that are equal in a band are candidates, which are then
verified by their likeness.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortlab.llm.arrow import code_points, map_batches, ship
from cohortlab.llm.common import materialize, sized
from cohortlab.llm.graph import components

WALKS, SLOTS, STEPS, WIDE = 2, 64, 3, 4
#: Steps after which the walk's random bits repeat, and classes of characters.
CYCLE, CLASSES = 1 << 13, 256
#: Fingerprints of a band value all of whose links are told, and of a block of larger ones; pairs
#: of small ones that are compared at once.
SMALL, BLOCK, AT_ONCE = 8, 4096, 8192
#: Below this many walks at once, a walk is stepped alone.
FEW = 24


@functools.lru_cache(maxsize=WALKS)
def walk_bits(walk: int) -> np.ndarray:
    bits = np.random.default_rng((20240607, walk)).integers(0, 2, (CYCLE, CLASSES), np.uint8)
    bits[:, 0] = 0  # the pad
    return bits


@functools.lru_cache(maxsize=WALKS)
def walk_rows(walk: int) -> list[bytes]:
    return [row.tobytes() for row in walk_bits(walk)]


class Samples:
    """Which slot takes which step: `records` are (step, slot) in order of step, a record
    replacing the slot's earlier one in all texts that are long enough."""

    BLOCK = 1 << 16

    def __init__(self, walk: int) -> None:
        self.walk = walk
        self.steps, self.slots = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.best, self.upto = np.full(SLOTS, np.inf), 0

    def extend(self, upto: int) -> None:
        while self.upto < upto:
            rng = np.random.default_rng((71, self.walk, self.upto // self.BLOCK))
            found = []
            for slot in range(SLOTS):
                x = rng.random(self.BLOCK)
                low = np.minimum.accumulate(x)
                new = np.flatnonzero((x == low) & (x < self.best[slot]) & (np.append(np.inf, low[:-1]) > x))
                found.append(np.stack([new + self.upto, np.full(new.size, slot)]))
                self.best[slot] = min(self.best[slot], low[-1])
            both = np.concatenate(found, 1)
            both = both[:, np.lexsort((both[1], both[0]))]
            self.steps, self.slots = np.append(self.steps, both[0]), np.append(self.slots, both[1])
            self.upto += self.BLOCK


@functools.lru_cache(maxsize=WALKS)
def samples(walk: int) -> Samples:
    return Samples(walk)


def fingerprints(texts: list[np.ndarray]) -> np.ndarray:
    """(texts, WALKS x SLOTS) bytes; an empty text has all slots 0."""
    out = np.zeros((len(texts), WALKS * SLOTS), np.uint8)
    size = np.array([t.size for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not order.size:
        return out
    # all texts in one array, each with pads behind it
    begin = np.concatenate([[0], np.cumsum(size[order] + WIDE)])
    flat = np.zeros(int(begin[-1]), np.uint32)
    for at, i in zip(begin[:-1], order, strict=True):
        flat[at : at + size[i]] = texts[i] + np.uint32(1)
    cls = np.where(flat > 0, np.maximum((flat * np.uint32(2654435761)) >> np.uint32(24), 1), 0).astype(np.uint8)
    gram = flat.copy()
    for k in range(1, WIDE):
        gram[: -WIDE + 1] = gram[: -WIDE + 1] * np.uint32(0x9E3779B1) + flat[k : flat.size - WIDE + 1 + k]
    gram = ((gram * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)
    last = begin[:-1] + size[order]
    for walk in range(WALKS):
        _walk(walk, flat_views=(cls, gram), begin=begin[:-1], last=last, longest=int(size[order[0]]), order=order, out=out[:, walk * SLOTS : (walk + 1) * SLOTS])
    return out


def _walk(walk: int, flat_views: tuple[np.ndarray, np.ndarray], begin: np.ndarray, last: np.ndarray, longest: int, order: np.ndarray, out: np.ndarray) -> None:
    """All texts step together, longest first; those at their end drop off at the back."""
    cls, gram = flat_views
    plan, bits, rows = samples(walk), walk_bits(walk), walk_rows(walk)
    plan.extend(STEPS * longest)
    ptr, moving, step = begin.copy(), order.size, 0
    for r, (at, slot) in enumerate(zip(plan.steps.tolist(), plan.slots.tolist(), strict=True)):
        if moving < FEW:
            break
        while step < at:
            if not step & 63:
                while moving and ptr[moving - 1] == last[moving - 1]:
                    moving -= 1
            p = ptr[:moving]
            p += bits[step % CYCLE].take(cls.take(p))
            step += 1
        p = ptr[:moving]
        on = np.flatnonzero((p < last[:moving]) & (STEPS * (last - begin)[:moving] > at))
        out[order[on], slot] = gram.take(p[on])
    else:
        return
    for lane in range(moving):
        i, p, end = order[lane], int(ptr[lane]), int(last[lane])
        c, n, j, k = cls[p : end + 1].tolist(), end - p, step, 0
        for at, slot in zip(plan.steps[r:].tolist(), plan.slots[r:].tolist(), strict=True):
            while j < at and k < n:
                k += rows[j % CYCLE][c[k]]
                j += 1
            if k >= n or at >= STEPS * (end - int(begin[lane])):
                break
            out[i, slot] = gram[p + k]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).reshape(*a.shape[:-1], WALKS, SLOTS).mean(-1).max(-1)


def edited(text: np.ndarray, other: np.ndarray) -> np.ndarray:
    """`text` with its last third replaced by as much of the beginning of `other`."""
    third = text.size // 3
    return np.concatenate([text[: text.size - third], other[:third]])


_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _packed(text: str) -> bytes:
    return _ZSTD.compress(text.encode("utf-8", "surrogatepass"))


def _unpacked(raw: bytes) -> str:
    return _UNZSTD.decompress(raw).decode("utf-8", "surrogatepass")


def _parts(d: DataFrame, rows_per_part: int, most_parts: int) -> DataFrame:
    """Adds `part`: ranges of the id, higher ones first in the order; rows without an id follow,
    dealt by their `tie`, in parts below 0. Ids that are no numbers go by their first six bytes."""
    if isinstance(d.schema["id"].dataType, NumericType):
        place = F.col("id").cast("double")
    else:
        place = F.conv(F.rpad(F.hex(F.substring(F.encode(F.col("id").cast("string"), "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    d = d.withColumn("place", place)
    n, none = d.agg(F.count("id"), F.count_if(F.col("id").isNull())).first()
    wanted, wanted_none = (min(most_parts, max(1, -(-x // rows_per_part))) for x in (n, none))
    cuts = d.agg(F.percentile_approx("place", [i / wanted for i in range(1, wanted)], 20 * wanted)).first()[0] if wanted > 1 else None
    splits = [-float("inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="known", outputCol="bucket").transform(d.withColumn("known", F.coalesce("place", F.lit(0.0))))
    hashed = F.conv(F.hex(F.substring("tie", 1, 4)), 16, 10).cast("double") / float(1 << 32)
    part = F.when(F.col("id").isNull(), -1 - F.floor(hashed * wanted_none)).otherwise(F.col("bucket")).cast("int")
    return rows.withColumn("part", part).drop("place", "known", "bucket")


def in_order(docs: DataFrame, id_col: str, text_col: str, rows_per_part: int = 1024, most_parts: int = 20_000) -> DataFrame:
    """Rows (id, text, ahead, part): documents in descending order of id, null last, ties by md5
    of the text, the texts compressed. A part's rows are followed by the first row of the
    part that comes next (`ahead`; after the last part, the first).

    Only the range limits and each part's first row, a short row a part, leave the rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tie"))
    d = _parts(d, rows_per_part, most_parts)
    heads = d.groupBy("part").agg(F.max("id").alias("top"), F.min("tie").alias("top_tie"))
    up, every = Window.orderBy("part"), Window.partitionBy()
    heads = materialize(heads.select("part", "top", "top_tie", F.coalesce(F.lead("part").over(up), F.min("part").over(every)).alias("before")))
    first = F.col("id").eqNullSafe(F.col("top")) & (F.col("id").isNotNull() | (F.col("tie") == F.col("top_tie")))
    kind = d.schema["id"].dataType.simpleString()

    def small(cols: dict[str, list]) -> dict[str, object]:
        return cols | {"text": list(map(_packed, cols["text"]))}

    # heads has one row a part, `most_parts` at most of ids and of rows without one
    rows = map_batches(d.join(F.broadcast(heads), "part").select("id", "text", "tie", "part", F.when(first, F.col("before")).alias("before")), small, f"id {kind}, text binary, tie binary, part int, before int", slice_rows=256)
    dealt = F.array_append(F.array(F.struct(F.col("part"), F.lit(False).alias("ahead"))), F.struct(F.col("before").alias("part"), F.lit(True).alias("ahead")))
    rows = rows.select("id", "text", "tie", F.inline(F.when(F.col("before").isNull(), F.slice(dealt, 1, 1)).otherwise(dealt)))
    return rows.repartition("part").sortWithinPartitions("part", "ahead", F.col("id").desc_nulls_last(), "tie").select("id", "text", "ahead", "part")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars: int = 8_000_000) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, one row per document.

    The edited text has its last third replaced by the beginning of the next document's, in
    descending order of id, null ids last; rows of equal id follow one another by md5 of the
    text. Null text is empty; texts of fewer than three characters are their own edited text;
    a single document is its own next one; repeated rows give a row each; an empty table gives
    an empty result. Only the named columns are read. Rows stream through in
    order; `chars` bounds what is embedded at once, but for a single longer text.
    """
    rows = in_order(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def close(todo: list, after: str) -> pa.RecordBatch:
            texts = [t for _, t in todo]
            points = [code_points(t) for t in [*texts, after]]
            cut = [t[: len(t) - len(t) // 3] + o[: len(t) // 3] for t, o in zip(texts, [*texts[1:], after], strict=True)]
            fp = fingerprints(points + [edited(a, b) for a, b in zip(points, points[1:], strict=False)])
            own, nxt, new = fp[: len(texts)], fp[1 : len(texts) + 1], fp[len(texts) + 1 :]
            cols = {
                id_col: pa.array([i for i, _ in todo], id_type),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in cut]),
                "fingerprint": pa.array([x.tobytes().hex() for x in own]),
                "edited_fingerprint": pa.array([x.tobytes().hex() for x in new]),
                "near_edited": pa.array(likeness(own, new)),
                "near_next": pa.array(likeness(own, nxt)),
            }
            return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        todo, held, here, closed = [], 0, None, True
        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, raw, ahead, part in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "ahead", "part")), strict=True):
                text = _unpacked(raw)
                if part != here:
                    here, closed = part, False
                if ahead:
                    if todo:
                        yield close(todo, text)
                    todo, held, closed = [], 0, True
                    continue
                if held > chars:
                    yield close(todo, text)
                    todo, held = [], 0
                todo.append((i, text))
                held += len(text)
        if todo or not closed:
            raise ValueError("a part has no following row")

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def whole_bands(least: float) -> list[list[int]]:
    """Slots of each walk in one part more than slots that can differ at a likeness of `least`:
    fingerprints alike are equal in a whole part."""
    rng, parts = np.random.default_rng(17), next(d for d in range(SLOTS + 1) if d == SLOTS or (SLOTS - d - 1) / SLOTS < least) + 1
    return [sorted(int(x) + walk * SLOTS for x in part) for walk in range(WALKS) for part in np.array_split(rng.permutation(SLOTS), min(parts, SLOTS))]


def _banded(nodes: DataFrame, bands: list[list[int]]) -> DataFrame:
    """(bucket, node) of (node, fp): equal values of a band."""
    values = [F.xxhash64(F.lit(len(bands)), F.lit(i), F.concat(*[F.substring("fp", k + 1, 1) for k in slots])) for i, slots in enumerate(bands)]
    return nodes.select("node", F.explode(F.array(*values)).alias("bucket"))


def _links(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links between the nodes of each bucket of (bucket, size, node, fp), all of them in a
    small bucket, in a crowded one enough to join all classes that have any. There every two
    nodes are compared, a block with a block, but those linked already over others of the two."""
    blocks = F.when(F.col("size") > SMALL, F.ceil(F.col("size") / BLOCK)).otherwise(1).cast("long")
    dealt = rows.withColumn("own", F.pmod("node", blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "size", "node", "fp")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    ship(rows.sparkSession)

    def told(fp: Iterable[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(fp), np.uint8).reshape(-1, WALKS * SLOTS)

    def crowded(held: list[tuple]) -> Iterator[tuple[int, int]]:
        _, i, j, own, _, node, fp = zip(*held, strict=True)
        prints, label, own = told(fp), np.arange(len(fp)), np.array(own)
        right = np.flatnonzero(own == j[0])
        across, heads = np.ascontiguousarray(prints[right].T), []

        def joined(x: int, at: np.ndarray) -> Iterator[tuple[int, int]]:
            """Links of x with those of the right at `at`; its class takes theirs in."""
            same = (across[:, at] == prints[x][:, None]).reshape(WALKS, SLOTS, -1).sum(1, dtype=np.uint8).max(0)
            for y in at[same / SLOTS >= least].tolist():
                if label[right[y]] != label[x]:
                    label[label == label[right[y]]] = label[x]
                    if all(label[right[h]] != label[x] for h in heads):
                        heads.append(y)
                    yield node[x], node[right[y]]

        for x in np.flatnonzero(own == i[0]).tolist():
            if i[0] != j[0] and heads:  # one of each class that has links: mostly all that is needed
                yield from joined(x, np.array(heads))
            apart = label[right] != label[x]
            if i[0] == j[0]:
                apart &= right > x
            at = np.flatnonzero(apart)
            if at.size:
                yield from joined(x, at)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        few: list[tuple] = []  # pairs (node, fp, node, fp) of small buckets

        def found(pairs: Iterable[tuple[int, int]]) -> pa.RecordBatch:
            p = np.array(list(pairs), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(p.max(1)), pa.array(p.min(1))], ["a", "b"])

        def small() -> pa.RecordBatch:
            a, fa, b, fb = zip(*few, strict=True)
            alike = np.flatnonzero(likeness(told(fa), told(fb)) >= least).tolist()
            few.clear()
            return found((a[k], b[k]) for k in alike)

        def close() -> Iterator[pa.RecordBatch]:
            if held[0][4] > SMALL:
                yield found(crowded(held))
            else:
                few.extend((*x[5:], *y[5:]) for k, x in enumerate(held) for y in held[:k])
                if len(few) >= AT_ONCE:
                    yield small()
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield from close()
                held.append(row)
        if held:
            yield from close()
        if few:
            yield small()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_classes(prints: DataFrame, *, least: float = 0.8, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """The rows of `prints` with class_id and links (verified links of the row's fingerprint).

    Equal fingerprints are one node; the others are linked at a likeness of `least`. Any two so
    alike share a band. Nodes of a band are compared where they meet (`_links`), all pairs of
    few, and of a crowded band those of different classes, so that no class is missed or split:
    work there grows with pairs. `links` counts the links that were verified; nodes of a crowded
    band that are of one class already are not all compared.
    class_id is the least id of the linked nodes, null if none has one. Null fingerprints are
    a class of their own; repeated rows get a row each; an empty table gives an empty result.
    """
    rows = prints.select(F.col(id_col).alias("id"), F.coalesce(print_col, F.lit("")).alias("fp"))
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("fp")))
    known = nodes.where(F.length("fp") == 2 * WALKS * SLOTS).select("node", F.unhex("fp").alias("fp"))
    buckets = _banded(known, whole_bands(least))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    links = materialize(_links(buckets.join(sizes, "bucket").join(known, "node").select("bucket", "size", "node", "fp"), least))
    labels = components(links)
    count = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    told = nodes.join(labels, "node", "left").where(F.col("label").isNotNull() | (F.col("copies") > 1)).withColumn("label", F.coalesce("label", "node"))
    of = told.join(told.groupBy("label").agg(F.min("rep").alias("class_id")), "label").join(count, "node", "left")
    of = sized(materialize(of.select("fp", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))))
    inner = prints.select(F.struct("*").alias("row"), F.coalesce(print_col, F.lit("")).alias("fp")).join(of, "fp", "left")
    alone = F.col("links").isNull()  # neither linked nor repeated
    return inner.select("row.*", F.when(alone, F.col("row")[id_col]).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
