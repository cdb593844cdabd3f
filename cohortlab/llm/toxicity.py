"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its hashed word vector and the mean vector of its hashed character
3-grams, so that unseen forms of a learned word still speak. Windows of WINDOW words, each
overlapping the next by half, are read in both directions; attention weighs the states of a
window, and the text's score is that of its worst window. Labels belong to texts, not to
windows: after a first pass over all windows, a toxic text teaches by the windows that the
network itself finds worst.

The recurrent inputs are projected once a distinct word of a batch, and all windows of a
batch step together.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.arrow import map_batches
from cohortlab.llm.common import id_crc, materialize

WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM = 24, 12, 8, 8, 8
WORD_BITS, CHAR_BITS = 14, 12
#: Words; a run of more than 24 letters and digits is read as several, so that all its characters count.
WORD = re.compile(r"\w{1,24}")
#: Windows that step together.
LANES = 8192


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def starts(n: int) -> range:
    """First words of the windows over n words: every STRIDE, the last one reaching the end."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE) if n else range(0)


def word_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, character 3-gram buckets in one run, and where each word's begin."""
    buckets = np.fromiter((zlib.crc32(w.encode()) & ((1 << WORD_BITS) - 1) for w in words), np.int64, len(words))
    c = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    h = c[:-2] * np.uint32(2654435761)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) + c[1:-1]
    h = (h ^ (h >> np.uint32(13))) * np.uint32(3266489917) + c[2:]
    h = ((h ^ (h >> np.uint32(16))) * np.uint32(668265263)) >> np.uint32(32 - CHAR_BITS)
    inside = np.ones(c.size, bool)
    inside[ends - 1] = inside[ends - 2] = False
    grams = np.append(h, [0, 0])[inside].astype(np.int64)
    return buckets, grams, np.concatenate([[0], np.cumsum(size - 2)])[:-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, seed: int = 3) -> Network:
        rng, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        p = {"word": rng.normal(0, 0.05, (1 << WORD_BITS, WORD_DIM)), "char": rng.normal(0, 0.05, (1 << CHAR_BITS, CHAR_DIM)), "v": rng.normal(0, 0.1, 2 * HIDDEN), "w": rng.normal(0, 0.3, 2 * HIDDEN), "b": np.zeros(1)}
        for way in "fb":
            p |= {f"W{way}": rng.normal(0, d**-0.5, (d, 3 * HIDDEN)), f"U{way}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"c{way}": np.zeros(3 * HIDDEN)}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, words: list[str]) -> np.ndarray:
        buckets, grams, at = word_rows(words)
        chars = np.add.reduceat(self.p["char"][grams], at, axis=0) / np.diff(np.append(at, grams.size))[:, None]
        return np.concatenate([self.p["word"][buckets], chars], 1).astype(np.float32)

    def window_logits(self, words: list[str], windows: np.ndarray) -> np.ndarray:
        """Logits of windows (rows of places in `words`, -1 behind the end)."""
        x, p = self.inputs(words), self.p
        rows = {}
        for way in "fb":
            a = x @ p[f"W{way}"] + p[f"c{way}"]
            pad = np.zeros((1, 3 * HIDDEN), np.float32)
            pad[0, :HIDDEN] = 30.0  # an update gate of 1: behind the end the state stays
            rows[way] = np.concatenate([a, pad])
        out = [self._lanes(rows, windows[i : i + LANES]) for i in range(0, len(windows), LANES)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def _lanes(self, rows: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
        p, n = self.p, len(windows)
        steps = np.ascontiguousarray(windows.T)
        score = np.zeros((WINDOW, n), np.float32)
        value = np.zeros((WINDOW, n), np.float32)
        for way, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            u = p[f"U{way}"]
            part = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, None)
            out = np.stack([p["v"][part], p["w"][part]], 1)
            h = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                a, g = rows[way][steps[t]], h @ u
                zr = a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                m = g[:, 2 * HIDDEN :]
                m *= r
                m += a[:, 2 * HIDDEN :]
                np.tanh(m, out=m)
                h -= m
                h *= z
                h += m
                s = h @ out
                score[t] += s[:, 0]
                value[t] += s[:, 1]
        # pooling is linear in the states: the pooled value is the weighted mean of values
        score[steps < 0] = -np.inf
        e = np.exp(score - score.max(0))
        return (e * value).sum(0) / e.sum(0) + p["b"][0]

    def text_logits(self, texts: list[str | None]) -> np.ndarray:
        """The worst window's logit of each text; -inf for a text without words."""
        known: dict[str, int] = {}
        windows, owner = [], []
        for i, text in enumerate(texts):
            ids = np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.int64)
            if ids.size:
                first = np.array(starts(ids.size))
                at = first[:, None] + np.arange(WINDOW)
                windows.append(np.where(at < ids.size, ids[np.minimum(at, ids.size - 1)], -1))
                owner.append(np.full(first.size, i))
        out = np.full(len(texts), -np.inf)
        if windows:
            logits = self.window_logits(list(known), np.concatenate(windows))
            np.maximum.at(out, np.concatenate(owner), logits)
        return out

    def suspect_windows(self, text: str | None, least: float = -1.0) -> list[str]:
        """The windows whose logit is above `least`."""
        words = words_of(text)
        known: dict[str, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        if not ids.size:
            return []
        first = np.array(starts(ids.size))
        at = first[:, None] + np.arange(WINDOW)
        x = self.window_logits(list(known), np.where(at < ids.size, ids[np.minimum(at, ids.size - 1)], -1))
        return [" ".join(words[first[i] : first[i] + WINDOW]) for i in np.flatnonzero(x > least)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.text_logits(texts)
        return np.where(np.isfinite(x), sigmoid(np.clip(np.where(np.isfinite(x), x, 0) * self.slope + self.shift, -40, 40)), 0.0)


def loss_and_grads(p: dict[str, np.ndarray], word: np.ndarray, grams: np.ndarray, counts: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, drop: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
    """Weighted cross-entropy of windows and its gradient by backpropagation through time.

    word (n, T), grams (n, T, G) with counts (n, T) valid, mask (n, T) 1 for words, drop
    (n, T) 0 where the word vector is left out.
    """
    n, steps = word.shape
    live = (np.arange(grams.shape[2]) < counts[..., None]).astype(np.float32)
    share = live / np.maximum(counts, 1)[..., None]
    x = np.concatenate([p["word"][word] * drop[..., None], np.einsum("ntgd,ntg->ntd", p["char"][grams], share)], 2).astype(np.float32)
    states, kept = {}, {}
    for way in "fb":
        a = x @ p[f"W{way}"] + p[f"c{way}"]
        a[..., :HIDDEN] += 30.0 * (1 - mask)[..., None]
        u, h, hs, kept[way] = p[f"U{way}"], np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32), {}
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g = h @ u
            zr = sigmoid(a[:, t, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            m = np.tanh(a[:, t, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            kept[way][t] = h, z, r, m, g[:, 2 * HIDDEN :]
            h = m + z * (h - m)
            hs[:, t] = h
        states[way] = hs
    hs = np.concatenate([states["f"], states["b"]], 2)
    s = np.where(mask > 0, hs @ p["v"], -np.inf)
    e = np.exp(s - s.max(1, keepdims=True))
    att = e / e.sum(1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", att, hs)
    logit = pooled @ p["w"] + p["b"][0]
    prob = sigmoid(np.clip(logit, -30, 30))
    loss = float((weight * -(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / weight.sum())
    d = (weight * (prob - y) / weight.sum()).astype(np.float32)
    grad = {"w": d @ pooled, "b": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p["w"]
    datt = np.einsum("nh,nth->nt", dp, hs)
    ds = att * (datt - (att * datt).sum(1, keepdims=True))
    grad["v"] = np.einsum("nt,nth->h", ds, hs)
    dhs = att[..., None] * dp[:, None] + ds[..., None] * p["v"]
    dx = np.zeros_like(x)
    for way in "fb":
        part = dhs[..., :HIDDEN] if way == "f" else dhs[..., HIDDEN:]
        u, du = p[f"U{way}"], np.zeros_like(p[f"U{way}"])
        da, dh = np.zeros((n, steps, 3 * HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
            h, z, r, m, gn = kept[way][t]
            dh = dh + part[:, t]
            dm = dh * (1 - z) * (1 - m * m)
            dg = np.concatenate([dh * (h - m) * z * (1 - z), dm * gn * r * (1 - r), dm * r], 1)
            da[:, t, : 2 * HIDDEN], da[:, t, 2 * HIDDEN :] = dg[:, : 2 * HIDDEN], dm
            du += h.T @ dg
            dh = dh * z + dg @ u.T
        grad[f"U{way}"], grad[f"c{way}"] = du, da.sum((0, 1))
        grad[f"W{way}"] = np.einsum("ntd,ntk->dk", x, da)
        dx += da @ p[f"W{way}"].T
    grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(grad["word"], word.ravel(), (dx[..., :WORD_DIM] * (drop * mask)[..., None]).reshape(-1, WORD_DIM))
    on = live > 0
    np.add.at(grad["char"], grams[on], (dx[:, :, None, WORD_DIM:] * (share * mask[..., None])[..., None])[on])
    return loss, logit, grad


def beyond_chance(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Signed root of the likelihood ratio of `toxic` out of toxic + clean against `share`,
    less what one would see by chance."""
    n = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(toxic > 0, toxic * np.log(toxic / (n * share)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - share))), 0)
    root = np.sqrt(np.maximum(2 * part, 0))
    return np.sign(toxic - n * share) * np.maximum(root - 3, 0)


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (0.1 if k == "word" else 1.0) * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def fit(bags: list[tuple[list[str], int]], *, start: Network | None = None, epochs: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 3) -> Network | None:
    """Fit on texts given as (windows of space-joined words, label), going on from `start`;
    None without both labels."""
    if len({y for windows, y in bags if windows}) < 2:
        return None
    rng, net = np.random.default_rng(seed), start or Network.fresh(seed)
    known: dict[str, int] = {}
    places, owner, label = [], [], []
    for i, (windows, y) in enumerate(bags):
        for w in windows:
            ids = [known.setdefault(x, len(known)) for x in w.split(" ")][:WINDOW]
            places.append(ids + [-1] * (WINDOW - len(ids)))
            owner.append(i)
            label.append(y)
    places, owner, label = np.array(places), np.array(owner), np.array(label, np.float32)
    vocab = list(known)
    buckets, run, at = word_rows(vocab)
    size = np.diff(np.append(at, run.size))
    wide = int(size.max())
    table = run[np.minimum(at[:, None] + np.arange(wide), run.size - 1)]
    # evidence of a bucket: root of its likelihood ratio of standing in toxic texts, beyond chance
    evidence = np.zeros(len(vocab))
    for name, of in (("word", buckets[:, None]), ("char", np.where(np.arange(wide) < size[:, None], table, -1))):
        seen, texts = [], []
        for y in (1, 0):
            mine = np.flatnonzero(label == y)
            pairs = [np.zeros(0, np.int64)]
            for some in np.array_split(mine, max(1, mine.size // 1000)):
                rows = places[some]
                b = np.where((rows >= 0)[..., None], of[rows], -1)
                pairs.append(np.unique((owner[some].astype(np.int64)[:, None, None] << 20 | b)[b >= 0]))
            pairs = np.unique(np.concatenate(pairs)) & ((1 << 20) - 1)
            seen.append(np.bincount(pairs, minlength=net.p[name].shape[0]).astype(float))
            texts.append(np.unique(owner[label == y]).size)
        own = beyond_chance(*seen, texts[0] / sum(texts))
        net.p[name][:, 0] += 0 if start else 0.3 * np.clip(own, -4, 4).astype(np.float32)
        evidence = np.maximum(evidence, np.where(of >= 0, own[of], 0).max(1))
    opt = Adam(net.p, rate)
    logits = np.where(places >= 0, evidence[places], 0).max(1) - 1e-3
    for epoch in range(epochs):
        # toxic texts teach by their worst windows: first by evidence, then by the network
        if epoch or start:
            logits = net.window_logits(vocab, places)
        worst = np.full(len(bags), -np.inf)
        np.maximum.at(worst, owner, logits)
        top = (logits >= worst[owner] - 1e-6) | (logits > 0)
        target = np.where((label > 0) & top, 1.0, 0.0).astype(np.float32)
        weight = np.where((label > 0) & ~top, 0.3, 1.0).astype(np.float32)
        share = max(1e-3, float((weight * target).sum() / weight.sum()))
        balance = np.where(target > 0, min(4.0, 0.5 / share), min(4.0, 0.5 / max(1e-3, 1 - share))).astype(np.float32)
        order = rng.permutation(len(places))
        size_of_batch = min(batch, max(16, len(places) // 40))  # small samples still get enough steps
        opt.rate = rate * (0.5 ** max(0, epoch - epochs // 2))
        for i in range(0, len(order), size_of_batch):
            rows = order[i : i + size_of_batch]
            ids = places[rows]
            mask = (ids >= 0).astype(np.float32)
            drop = (rng.random(ids.shape) > 0.5).astype(np.float32) * mask
            _, _, grad = loss_and_grads(net.p, buckets[ids], table[ids], size[ids] * (ids >= 0), mask, target[rows], (weight * balance)[rows], drop)
            opt.step(grad)
    return net


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, prior: float) -> None:
    """Logistic fit of text logits to labels, weighted to the share of toxic texts."""
    ok = np.isfinite(logits)
    x, y = logits[ok].astype(np.float64), labels[ok].astype(np.float64)
    pos = max(1.0, y.sum())
    w = np.where(y > 0, prior / pos, (1 - prior) / max(1.0, y.size - pos)) * y.size
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(np.clip(a * x + b, -30, 30))
        g = np.array([(w * (p - y) * x).sum() + 0.02 * a, (w * (p - y)).sum()])
        s = w * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 0.02, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0] * min(1.0, 5 / (np.abs(step).max() + 1e-9)), b - step[1] * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    net.slope, net.shift = float(max(a, 1e-3)), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, clean: int, toxic_texts: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, float, int]:
    """So many ids of each label at most, in order of a hash of the id, with their texts; the share
    of toxic labels and their number. An id counts once, and not at all if its labels differ."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where(F.col("y") == F.col("z")).drop("z")
    toxic, total = known.agg(F.sum("y"), F.count("*")).first()
    picked = None
    for y, most in ((0, clean), (1, toxic_texts)):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = one if picked is None else picked.union(one)
    # at most clean + toxic_texts rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    return rows, (toxic or 0) / max(1, total), toxic or 0


def train(docs: DataFrame, labels: DataFrame, *, per_label: int = 800, mined: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Fit on a bounded sample of whole texts: those of `per_label` toxic ids and of `mined` times
    as many clean ones.

    The first fit reads all windows of five in six toxic texts and of every fourth clean text.
    Then all windows of another quarter of the clean texts that the network takes for toxic
    are added, and it is fitted on; and so for a third quarter. The other texts calibrate the score (with fewer than 100 toxic
    labels, all toxic texts both teach and calibrate). Which text does what is told by hashes
    of its id. Labels of one id that differ teach nothing.
    """
    rows, prior, toxic = labelled_sample(docs, labels, clean=mined * per_label, toxic_texts=per_label, id_col=id_col, text_col=text_col, label_col=label_col)
    many = toxic >= 100
    h = F.pmod(F.crc32(F.concat(F.lit("f|"), F.col("id").cast("string")).cast("binary")), F.lit(12))
    rows = materialize(rows.withColumn("h", F.when((F.col("y") == 1) & F.lit(not many), -1).otherwise(h).cast("int")))
    first = rows.where("y = 1 AND (h < 0 OR h > 1) OR y = 0 AND h < 3")

    def cut(cols: dict[str, list]) -> dict[str, object]:
        words = [words_of(text) for text in cols["text"]]
        return {"id": cols["id"], "y": cols["y"], "windows": [[" ".join(w[s : s + WINDOW]) for s in starts(len(w))] for w in words]}

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, y int, windows array<string>"
    order = lambda r: (str(r.id), r.y, r.windows)
    bags = [(r.windows, r.y) for r in sorted(map_batches(first, cut, schema, slice_rows=256).collect(), key=order)]
    net = fit(bags, epochs=5)
    if net is None:
        return None
    for some in ("h BETWEEN 3 AND 5", "h BETWEEN 6 AND 8"):
        held = docs.sparkSession.sparkContext.broadcast(net)

        def mine(cols: dict[str, list]) -> dict[str, object]:
            return {"id": cols["id"], "y": cols["y"], "windows": [held.value.suspect_windows(t) for t in cols["text"]]}  # noqa: B023

        hard = map_batches(rows.where(f"y = 0 AND {some}"), mine, schema, slice_rows=256).where(F.size("windows") > 0).collect()
        bags += [(r.windows, 0) for r in sorted(hard, key=order)]
        net = fit(bags, start=net, epochs=3, rate=0.005)
    held = docs.sparkSession.sparkContext.broadcast(net)
    rest = rows.where("y = 1 AND h <= 1 OR y = 0 AND h > 8")
    scored = map_batches(rest, lambda cols: {"x": held.value.text_logits(cols["text"]), "y": cols["y"]}, "x double, y int", slice_rows=256).collect()
    calibrate(net, np.array([r.x for r in scored]), np.array([r.y for r in scored]), min(0.9, max(0.01, prior)))
    return net


def score(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns plus score (0 to 1) for every whole text.

    Null texts and texts without words score 0; without a trained network all score 0.
    Equal texts have equal scores.
    """
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(net)  # bounded: two hashed tables

    def run(cols: dict[str, list]) -> dict[str, object]:
        texts = cols.pop("__text")
        return cols | {"score": held.value.scores(texts) if held.value else [0.0] * len(texts)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, run, f"{schema}, score double", slice_rows=256)


def train_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels whose crc32 of the id as text is not 2 modulo 4."""
    return labels.where(id_crc(id_col) % 4 != 2)
