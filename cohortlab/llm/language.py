"""Language identification in two steps: family first, then the languages inside it.

Texts are bags of hashed character 1-, 2- and 3-grams. Linear support vector machines
(dual coordinate descent, no bias: a bag's decision does not depend on its length) tell
families from one another; inside a family one machine a pair of languages votes. All
machines are columns of one table, so that a text is scored in a single pass over it.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.arrow import code_points, map_batches, ship
from cohortlab.llm.common import id_crc

#: Family of ISO 639-1 codes; any other label is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky tt",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

ORDERS, BITS = 3, 14
#: Characters whose n-grams are looked up at once.
BLOCK = 1 << 16
#: Lengths of the pieces in which a text teaches.
PIECES = (40, 160, 600)
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    return _letters


def normalised(text: str) -> np.ndarray | None:
    """Code points of the lower-case letters, a gap before the first and for each run of others;
    None without letters."""
    c = code_points(text.lower())
    keep = letters()[c]
    if not keep.any():
        return None
    c = np.where(keep, c, np.uint32(32))
    c = c[keep | np.append(True, keep[:-1])]
    return c if c[0] == 32 else np.append(np.uint32(32), c)


def grams(c: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Table rows of the 1-, 2- and 3-grams that begin at the places lo .. hi."""
    out, h = [], np.zeros(1, np.uint32)
    for k in range(ORDERS):
        end = min(c.size if hi is None else hi, c.size - k)
        if end <= lo:
            break
        h = h[: end - lo] * np.uint32(2654435761) + (c[lo + k : end + k] + np.uint32(1)) * np.uint32(0x9E3779B1 + 2 * k)
        out.append((h >> np.uint32(32 - BITS)).astype(np.int32) + (k << BITS))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def train_svm(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, c: float = 4.0, epochs: int = 6, seed: int = 7) -> np.ndarray:
    """L2-loss linear SVM by dual coordinate descent over sparse unit vectors."""
    w, alpha, rng = np.zeros(ORDERS << BITS), np.zeros(len(bags)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, x = bags[i]
            old = alpha[i]
            alpha[i] = max(0.0, old - (y[i] * w[at].dot(x) - 1 + old / (2 * c)) / (1 + 1 / (2 * c)))
            if alpha[i] != old:
                w[at] += (alpha[i] - old) * y[i] * x
    return w


@dataclass
class LanguageModel:
    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[int, int, int]]  # family, language, language (places in members)
    table: np.ndarray  # (ORDERS << BITS, machines)
    slope: np.ndarray  # of each machine's margin, for a confidence

    def margins(self, text: str) -> np.ndarray | None:
        """Sum of the machines' weights over all n-grams, over the root of their number."""
        c = normalised(text)
        if c is None:
            return None
        total, n = np.zeros(self.table.shape[1]), 0
        for at in range(0, c.size, BLOCK):
            rows = grams(c, at, at + BLOCK)
            total += self.table[rows].sum(0, dtype=np.float64)
            n += rows.size
        return total / np.sqrt(n)

    def predict(self, text: str | None) -> tuple[str, str | None, float]:
        m = self.margins(text) if text else None
        if m is None:
            return UNKNOWN, None, 0.0
        p = 1 / (1 + np.exp(-np.clip(m * self.slope, -30, 30)))
        k = len(self.families) if len(self.families) > 1 else 0
        f = int(np.argmax(m[:k])) if k else 0
        sure = float(p[f] / p[:k].sum()) if k else 1.0
        votes, support = np.zeros(len(self.members[f])), np.zeros(len(self.members[f]))
        low = np.ones(len(self.members[f]))
        for j, (g, a, b) in enumerate(self.pairs, k):
            if g == f:
                votes[a if m[j] >= 0 else b] += 1
                support[a] += m[j]
                support[b] -= m[j]
                low[a], low[b] = min(low[a], p[j]), min(low[b], 1 - p[j])
        best = max(range(len(votes)), key=lambda i: (votes[i], support[i], -i))
        return self.members[f][best], self.families[f], min(1.0, max(0.0, sure * float(low[best])))


def fit(snippets: list[tuple[str, str]]) -> LanguageModel:
    """Fit on (text, language) pairs; texts without letters are left out."""
    bags, langs = [], []
    for text, lang in snippets:
        c = normalised(text)
        if c is not None:
            g = grams(c)
            at, n = np.unique(g, return_counts=True)
            bags.append((at, n / np.sqrt((n * n).sum()), n / np.sqrt(g.size)))
            langs.append(lang)
    known = sorted(set(langs))
    families = sorted({FAMILY_OF.get(x, x) for x in known})
    members = [[x for x in known if FAMILY_OF.get(x, x) == f] for f in families]
    fam = np.array([families.index(FAMILY_OF.get(x, x)) for x in langs], int)
    lang = np.array(langs, object)
    tasks = [(np.arange(len(bags)), np.where(fam == k, 1.0, -1.0)) for k in range(len(families))] if len(families) > 1 else []
    pairs = []
    for f, names in enumerate(members):
        for a, b in itertools.combinations(range(len(names)), 2):
            rows = np.flatnonzero((lang == names[a]) | (lang == names[b]))
            tasks.append((rows, np.where(lang[rows] == names[a], 1.0, -1.0)))
            pairs.append((f, a, b))
    columns, slopes = [], []
    for rows, y in tasks:
        w = train_svm([bags[i][:2] for i in rows], y)
        m = np.array([w[bags[i][0]].dot(bags[i][2]) for i in rows]) * y
        slope = 1.0 / max(float(np.quantile(m, 0.1)) if m.size else 1.0, 1e-3)
        columns.append(w)
        slopes.append(min(slope * 3, 1e3))
    table = np.stack(columns, 1).astype(np.float32) if columns else np.zeros((ORDERS << BITS, 0), np.float32)
    return LanguageModel(families or [UNKNOWN], members or [[UNKNOWN]], pairs, table, np.array(slopes))


def pieces(text: str) -> list[str]:
    """The whole text in pieces of changing length, which share the characters of an n-gram."""
    out, at = [], 0
    while at < len(text):
        size = PIECES[len(out) % len(PIECES)]
        out.append(text[at : at + size + ORDERS - 1])
        at += size
    return out


def training_texts(docs: DataFrame, *, per_language: int = 300, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """About `per_language` labelled texts of each language (chosen by hash of id and text), whole,
    in pieces: the bounded sample that is fitted."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    h = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), 1) / float(1 << 63)
    picked = labelled.where(h < F.element_at(share, F.col(lang_col))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return sorted((piece, r.lang) for r in picked.collect() for piece in pieces(r.text))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns plus lang_pred, family, score for every whole text.

    Null texts and texts without a letter are `und` with score 0. Texts of any length are
    read whole; equal texts, and so repeated rows, get equal results; an empty table gives
    an empty result. Only the named columns are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 3 x 2^14 rows a machine

    def run(cols: dict[str, list]) -> dict[str, object]:
        found = [held.value.predict(t) for t in cols.pop("__text")]
        return cols | {"lang_pred": [x[0] for x in found], "family": [x[1] for x in found], "score": [x[2] for x in found]}

    kept = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return map_batches(kept, run, f"{schema}, lang_pred string, family string, score double", slice_rows=500)


def train_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose crc32 of the id as text is not 2 modulo 4."""
    return docs.where(id_crc(id_col) % 4 != 2)


def identified(docs: DataFrame, model: LanguageModel, *, least: float = 0.0, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose language is told with a confidence of `least` or more.

    Rows without a letter have none and go, repeated rows share their fate, an empty table
    stays empty. A null language becomes the predicted one; all else is kept as it is.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def told(texts: pa.Array) -> pa.Array:
        found = [held.value.predict(t) for at in range(0, len(texts), 500) for t in texts.slice(at, 500).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[2] if x[0] != UNKNOWN else -1.0 for x in found], pa.float64())], ["lang", "score"])

    rows = docs.select(F.struct("*").alias("row"), told.asNondeterministic()(F.col(text_col)).alias("told"))  # else a filter would read the texts twice
    row = F.col("row")
    if lang_col in docs.columns:
        row = row.withField(lang_col, F.coalesce(row[lang_col], F.col("told.lang")))
    return rows.where(F.col("told.score") >= least).select(row.alias("row")).select("row.*")
