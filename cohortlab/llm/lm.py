"""Language-model scoring with a weighted backoff automaton.

Tokens are runs of non-space bytes, ASCII letters lower-cased, plus one end a text. Every
n-gram of the training texts up to three tokens is an arc, whatever its count: a state
stands for a context of one or two tokens, an arc for an n-gram, a failure arc for the
context without its first token. A text is read once from left to right, from state to
state, and the weights of the arcs taken are summed. The state behind a token is the
longest context that ends there, whichever arcs led to it, so that all texts of a block
are read together, place by place of one array.

Probabilities: with m of the context's order,

    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m)

so that a state's failure arc weighs m / (c(h) + m) and every state's probabilities sum
to 1 over the training vocabulary and one unknown word. At the root a word has
(c - D) / N and the unknown word D V / N. m is chosen from all counts: the chance of a
successor that is new to its context, each place left out in turn, equals the share of
n-grams that stand once.

No automaton of the whole corpus is held anywhere. Texts are cut into blocks; each block
sends its distinct n-grams, with their counts in its training texts, to parts by hash; a
part adds the counts up and answers each block in the block's own order. A block then has
every arc that its texts can take, with the corpus' counts. A part holds an n-gram once
a block, so that frequent ones weigh no more than rare ones, and the parts' number follows
the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cohortlab.llm.arrow import ship
from cohortlab.llm.common import materialize, text_or_empty

#: Tokens of a block (a longer text is a block of its own), n-grams of a part (counted once a
#: block), bits of an n-gram's hash inside its part, and most bits of a part's number.
BLOCK_TOKENS, PART_GRAMS, HASH_BITS, PART_BITS = 1 << 19, 1 << 20, 38, 24
#: Bytes that are hashed at once; cut at spaces only.
PIECE = 1 << 20
#: Kinds of n-grams: pairs that end a text are no contexts.
LAST_PAIR, WORD, PAIR, TRIPLE = range(4)

_rng = np.random.default_rng(11)
_odd = lambda n: _rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _odd(256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[[0x20, *range(0x09, 0x0E)]] = 0
_STEP = (int(_odd(1)[0]) & ~3) | 3
_MIX1, _MIX2, _PAIR, _TRIPLE, END, BEGIN = _odd(6)
_LOW = np.int64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX1
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2^64."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        steps = np.full(1 << bits, np.uint64(base))
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def _hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and hashes of the words in the bytes."""
    v = _BYTE[data]
    edges = np.flatnonzero(np.diff((v != 0).view(np.int8), prepend=0, append=0))
    up, down = _powers(max(PIECE, data.size + 1).bit_length())
    total = np.zeros(data.size + 1, np.uint64)
    np.cumsum(v * up[: data.size], out=total[1:])
    first = edges[::2]
    return first, _mix((total[edges[1::2]] - total[first]) * down[first])


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the text's words, a piece of the text at a time."""
    data, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < data.size:
        end = min(at + PIECE, data.size)
        while end < data.size and _BYTE[data[end]]:
            gap = np.flatnonzero(_BYTE[data[end : end + PIECE]] == 0)
            end = end + int(gap[0]) if gap.size else min(end + PIECE, data.size)
        out.append(_hash(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an END behind each text, and the number of tokens of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, sizes, at = [], [], 0
    while at < len(raw):
        if len(raw[at]) > PIECE:
            words.append(word_hashes(raw[at]))
            sizes.append(words[-1].size)
            at += 1
            continue
        some, held = [], 0
        while at < len(raw) and held + len(raw[at]) <= PIECE:
            some.append(raw[at])
            held += len(raw[at]) + 1
            at += 1
        first, h = _hash(np.frombuffer(b" ".join(some), np.uint8))
        limits = np.cumsum([len(t) + 1 for t in some])
        sizes += np.diff(np.searchsorted(first, limits), prepend=0).tolist()
        words.append(h)
    sizes = np.array(sizes, np.int64) + 1
    out = np.full(int(sizes.sum()), END, np.uint64)
    inner = np.ones(out.size, bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return out, sizes


class Grams:
    """The distinct words, pairs and triples of a block, and which of them stands where.

    `words` are hashes; a text begins with the word numbered `words.size`.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray):
        self.words, self.tokens, self.sizes = words, tokens.astype(np.int64), sizes
        self.end = int(np.searchsorted(words, END))
        h, first = np.append(words, BEGIN), np.cumsum(sizes) - sizes
        before = np.roll(self.tokens, 1)
        before[first] = words.size
        self.pairs, self.pair_at = np.unique(before << 32 | self.tokens, return_inverse=True)
        context = np.roll(self.pair_at, 1)
        context[first] = -1
        inner = context >= 0
        self.triples, at = np.unique(context[inner] << 32 | self.tokens[inner], return_inverse=True)
        self.triple_at = np.full(self.tokens.size, -1, np.int64)
        self.triple_at[inner] = at
        self.last = np.zeros(self.triples.size, np.int64)  # the pair that ends each triple
        self.last[at] = self.pair_at[inner]
        pair = _mix(h[self.pairs >> 32] * _PAIR + h[self.pairs & _LOW])
        self.keys = np.concatenate([words, pair, _mix(pair[self.triples >> 32] * _TRIPLE + h[self.triples & _LOW])])
        self.kinds = np.repeat(np.array([WORD, PAIR, TRIPLE], np.uint64), [words.size, pair.size, self.triples.size])
        self.kinds[words.size : words.size + pair.size][(self.pairs & _LOW) == self.end] = LAST_PAIR

    def counts(self, texts: np.ndarray) -> np.ndarray:
        """How often each key stands in the marked texts."""
        on = np.repeat(texts, self.sizes).astype(bool)
        at = self.triple_at[on]
        return np.concatenate([np.bincount(self.tokens[on], minlength=self.words.size), np.bincount(self.pair_at[on], minlength=self.pairs.size), np.bincount(at[at >= 0], minlength=self.triples.size)])

    def dealt(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the keys by part, kind and hash, the keys in that order without their parts,
        and the limits of the parts."""
        low = np.uint64(HASH_BITS)
        inside = self.kinds << low | (self.keys >> np.uint64(bits)) & np.uint64((1 << HASH_BITS) - 1)
        part = self.keys & np.uint64((1 << bits) - 1)
        order = np.argsort(part << np.uint64(HASH_BITS + 2) | inside)
        return order, inside[order], np.append(0, np.cumsum(np.bincount(part.astype(np.int64), minlength=1 << bits)))


def _planes(x: np.ndarray) -> np.ndarray:
    """Rows of the bytes of each rank, so that small numbers compress to little."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(x.size, x.itemsize).T)


def _numbers(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(x: np.ndarray) -> bytes:
    return x.size.to_bytes(8, "little") + _ZSTD.compress(_planes(x), asbytes=True) if x.size else b""


def _unpack(raw: bytes, dtype) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype)
    return _numbers(_ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little") * np.dtype(dtype).itemsize, asbytes=True), dtype)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


def _blocks(docs: DataFrame, train: Column, keep: list[str], text_col: str) -> DataFrame:
    """One row a block of texts: block, n (tokens), learned (tokens of training texts), and the
    block's words, tokens (places in words), sizes, training marks and kept columns."""
    rows = docs.select(F.coalesce(train, F.lit(False)).alias("__train"), text_or_empty(text_col).alias("__text"), *keep)
    kept = StructType(rows.schema.fields[2:])
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, number = 0, TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            hashes, sizes, marks = (np.concatenate([h[i] for h in held]) for i in range(3))
            words, tokens = np.unique(hashes, return_inverse=True)
            own = pa.concat_arrays([h[3] for h in held])
            learned = int(sizes[marks].sum())
            cols = {"block": [number], "n": [hashes.size], "learned": [learned], "words": [_pack_sorted(words)], "tokens": [_pack(tokens.astype(np.uint32))], "sizes": [_pack(sizes)], "marks": [marks.tobytes()]}
            return pa.RecordBatch.from_arrays([*map(pa.array, cols.values()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], [*cols, "kept"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                hashes, sizes = token_hashes(part.column(1).to_pylist())
                marks = part.column(0).to_numpy(zero_copy_only=False)
                held.append((hashes, sizes, marks, pa.StructArray.from_arrays(part.columns[2:], part.schema.names[2:])))
                n += hashes.size
                if n >= BLOCK_TOKENS:
                    yield close()
                    held, n, number = [], 0, number + 1
        if held:
            yield close()

    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept.fields)
    return rows.mapInArrow(run, f"block long, n long, learned long, words binary, tokens binary, sizes binary, marks binary, kept array<struct<{inner}>>")


def _read(row: dict) -> tuple[Grams, np.ndarray]:
    marks = np.frombuffer(row["marks"], bool)
    return Grams(_unpack_sorted(row["words"]), _unpack(row["tokens"], np.uint32), _unpack(row["sizes"], np.int64)), marks


def _asked(blocks: DataFrame, bits: int) -> DataFrame:
    """(p, block, keys, counts): a block's n-grams of one part and their counts in its training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cells = {c: batch.column(c)[row].as_py() for c in ("block", "words", "tokens", "sizes", "marks")}
                grams, marks = _read(cells)
                order, keys, ends = grams.dealt(bits)
                counts = grams.counts(marks)[order].astype(np.uint32)
                del grams, order
                parts = np.flatnonzero(np.diff(ends))
                for some in np.array_split(parts, -(-parts.size // 256)):
                    raw = {"keys": [_pack_sorted(keys[ends[p] : ends[p + 1]]) for p in some], "counts": [_pack(counts[ends[p] : ends[p + 1]]) for p in some]}
                    yield pa.RecordBatch.from_pydict({"p": some.astype(np.int32), "block": np.full(some.size, cells["block"], np.int64)} | raw)

    return blocks.select("block", "words", "tokens", "sizes", "marks").mapInArrow(run, "p int, block long, keys binary, counts binary")


def rounded(c: np.ndarray) -> np.ndarray:
    """Counts with ten significant bits, so that the table of counts of counts stays small."""
    low = np.maximum(np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) - 9, 0)
    return c >> low << low


def _answered(asked: DataFrame) -> DataFrame:
    """(block, p, totals, kinds, c, times): the corpus' counts of a block's n-grams of a part, in the
    block's order; one row a part has the part's counts of counts."""

    def run(part: pa.Table) -> pa.Table:
        keys = [_unpack_sorted(x) for x in part.column("keys").to_pylist()]
        counts = [_unpack(x, np.uint32) for x in part.column("counts").to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, np.concatenate(counts), distinct.size).astype(np.int64)
        known = totals > 0
        pairs, times = np.unique(rounded(totals[known]) << 2 | (distinct[known] >> np.uint64(HASH_BITS)).astype(np.int64), return_counts=True)
        ends = np.append(0, np.cumsum([k.size for k in keys]))
        rest = [None] * (len(keys) - 1)
        return pa.table({
            "block": part.column("block"), "p": part.column("p"),
            "totals": pa.array([_pack(totals[at[a:b]]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
            "kinds": pa.array([pairs & 3, *rest], pa.list_(pa.int64())), "c": pa.array([pairs >> 2, *rest], pa.list_(pa.int64())), "times": pa.array([times, *rest], pa.list_(pa.int64())),
        })

    return asked.groupBy("p").applyInArrow(run, "block long, p int, totals binary, kinds array<long>, c array<long>, times array<long>")


@dataclass(frozen=True)
class Model:
    """What all texts share: training tokens and types, the root's discount, m of pairs and triples."""

    tokens: int
    types: int
    discount: float
    pair: float
    triple: float

    def log_root(self, c: np.ndarray) -> np.ndarray:
        n, d = max(self.tokens, 1), self.discount
        return np.log10(np.where(c > 0, (c - d) / n, d * self.types / n if self.tokens else 1.0))

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def strength(contexts: dict[int, int], once: int, places: int) -> float:
    """The m at which the chance of a new successor, each place left out in turn, is once / places.

    contexts: how many contexts stand c times, by c.
    """
    if not places:
        return 1.0
    c, n = np.array(list(contexts), float), np.array(list(contexts.values()), float)
    low, high = -3.0, 6.0
    for _ in range(60):
        mid = (low + high) / 2
        new = (c * n * 10**mid / (c - 1 + 10**mid)).sum() / (c * n).sum()
        low, high = (mid, high) if new < once / places else (low, mid)
    return 10 ** ((low + high) / 2)


def _model(tokens: int, answers: DataFrame) -> Model:
    of = answers.where(F.col("c").isNotNull()).select(F.explode(F.arrays_zip("kinds", "c", "times")).alias("x"))
    rows = of.groupBy("x.kinds", "x.c").agg(F.sum("x.times").alias("n")).collect()  # some 20,000 rows a kind at most
    has = {k: {r.c: r.n for r in rows if r.kinds == k} for k in range(4)}
    words, pairs = has[WORD], {c: has[PAIR].get(c, 0) + has[LAST_PAIR].get(c, 0) for c in {**has[PAIR], **has[LAST_PAIR]}}
    n1, n2 = words.get(1, 0), words.get(2, 0)
    places = lambda x: sum(c * n for c, n in x.items())
    # as often as a text ends, it begins: the words' counts are those of the contexts
    pair = strength(words, pairs.get(1, 0), places(pairs))
    triple = strength(has[PAIR], has[TRIPLE].get(1, 0), places(has[TRIPLE]))
    return Model(tokens, sum(words.values()), n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, pair, triple)


class Automaton:
    """The states and arcs that a block's texts can reach, with the corpus' counts.

    States are 0 (the root), 1 + w (the context of word w) and, above two more than the words,
    the pairs. An arc is a word, pair or triple that the training texts hold.
    """

    def __init__(self, grams: Grams, totals: np.ndarray, model: Model):
        w, b = grams.words.size, grams.pairs.size
        self.grams, self.above = grams, w + 2
        self.one, self.two, self.three = totals[:w], totals[w : w + b], totals[w + b :]
        context = np.append(self.one, self.one[grams.end])  # a text begins as often as it ends
        self.log1 = model.log_root(self.one)
        word = grams.pairs & _LOW
        p2 = (self.two + model.pair * 10 ** self.log1[word]) / (context[grams.pairs >> 32] + model.pair)
        p3 = (self.three + model.triple * p2[grams.last]) / (self.two[grams.triples >> 32] + model.triple)
        self.log2, self.log3 = np.log10(p2), np.log10(p3)
        back = [np.zeros(1), np.log10(model.pair / (context + model.pair)), np.log10(model.triple / (self.two + model.triple))]
        self.back, self.fail = np.concatenate(back), np.concatenate([np.zeros(w + 2, np.int64), 1 + word])
        self.begin = 1 + w if context[w] else 0

    def states(self) -> np.ndarray:
        """The state before each token: the longest context that ends there and is known."""
        g = self.grams
        after = np.where(self.two[g.pair_at] > 0, self.above + g.pair_at, np.where(self.one[g.tokens] > 0, 1 + g.tokens, 0))
        state = np.roll(after, 1)
        state[np.cumsum(g.sizes) - g.sizes] = self.begin
        return state

    def read(self) -> np.ndarray:
        """Sum of weights along each text: where a state has no arc for the token, its failure
        arc is taken, at most two of them a token."""
        g, state = self.grams, self.states()
        total, going = np.zeros(state.size), np.ones(state.size, bool)
        for least, at, count, weight in ((self.above, g.triple_at, self.three, self.log3), (1, g.pair_at, self.two, self.log2)):
            here = np.flatnonzero(going & (state >= least))
            on = count[at[here]] > 0
            total[here[on]] += weight[at[here[on]]]
            going[here[on]] = False
            here = here[~on]
            total[here] += self.back[state[here]]
            state[here] = self.fail[state[here]]
        total[going] += self.log1[g.tokens[going]]
        return np.add.reduceat(total, np.cumsum(g.sizes) - g.sizes)


def score(docs: DataFrame, train: Column, keep: list[str], text_col: str = "text") -> tuple[DataFrame, Model]:
    """Learn from the rows where `train` holds and score all rows: `keep` columns plus
    n_tokens, n_known, base_score, score; and the model's global numbers.

    A null text is empty: its only token is the end. A null `train` is false. Rows are scored
    on their own, so repeated rows get equal scores. With no training text every word is
    unknown, with weight 0; an empty table gives an empty result. Words and n-grams are told
    apart by 64-bit hashes, n-grams inside a part by 38 bits (of n-grams of one part, one in
    260,000 meets another). A block holds some 200 bytes a token, so the longest single text
    bounds a task's memory.
    """
    blocks = materialize(_blocks(docs, train, keep, text_col), compression="zstd")
    tokens, learned = blocks.agg(F.sum("n"), F.sum("learned")).first()
    bits = min(PART_BITS, int(np.ceil(np.log2(max(1, 2 * (tokens or 0) / PART_GRAMS)))))
    answers = materialize(_answered(_asked(blocks, bits)), compression="zstd")
    model = _model(learned or 0, answers)
    schema = f"{', '.join(f'`{c}` {docs.schema[c].dataType.simpleString()}' for c in keep)}, n_tokens long, n_known long, base_score double, score double"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(answer: pa.Table, block: pa.Table) -> pa.Table:
        row = block.drop(["kept", "n", "learned"]).to_pylist()[0]
        grams, _ = _read(row)
        order, _, _ = grams.dealt(bits)
        totals = np.empty(order.size, np.int64)
        by_part = answer.sort_by("p").column("totals").to_pylist()
        totals[order] = np.concatenate([_unpack(x, np.int64) for x in by_part])
        sizes, c = grams.sizes, totals[: grams.words.size]
        first = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x[grams.tokens], first)
        kept = block.column("kept").combine_chunks().flatten().flatten()
        mine = [sizes, add((c > 0).astype(np.int64)), add(model.log_base(c)), Automaton(grams, totals, model).read()]
        return pa.Table.from_arrays([*kept, *map(pa.array, mine)], schema=out)

    asked = answers.select("block", "p", "totals").groupBy("block")
    return asked.cogroup(blocks.groupBy("block")).applyInArrow(run, schema), model
