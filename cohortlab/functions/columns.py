"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two classes, the positive one first, and the regimes in report order.
FLIP, NOTFLIP = "flip", "notflip"
REGIMES = ("O", "S", "T", "ST")
THRESHOLD = 0.5


def hash_number(*parts: Column | str) -> Column:
    """The first eight hex digits of md5 over the parts joined by |, as a number."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def share_of(fraction: float, n: str) -> Column:
    """max(1, fraction x n), rounded half to even."""
    return F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.col(n), 0).cast("long"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def prediction(threshold: float = THRESHOLD) -> Column:
    return (F.col("prob_flip") >= threshold).cast("int")


def confidence() -> Column:
    return F.when(F.col("prediction") == 1, F.col("prob_flip")).otherwise(1 - F.col("prob_flip"))




def cells() -> list[Column]:
    """Confusion counts of rows with target and prediction."""
    def count(t: int, p: int) -> Column:
        return F.count_if((F.col("target") == t) & (F.col("prediction") == p))

    return [count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp")]


def f1(hit: str) -> Column:
    """F1 of the class whose hits are in column `hit`; 0 without predictions and rows of it."""
    return or_zero(ratio(2 * F.col(hit), 2 * F.col(hit) + F.col("fp") + F.col("fn")))


def macro_f1() -> Column:
    return (f1("tp") + f1("tn")) / 2


def accuracy() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def recall(hit: str, miss: str) -> Column:
    return ratio(F.col(hit), F.col(hit) + F.col(miss))


def balanced_accuracy() -> Column:
    """Mean recall over the classes that are present."""
    pos, neg = recall("tp", "fn"), recall("tn", "fp")
    return F.coalesce((pos + neg) / 2, pos, neg)


def mcc() -> Column:
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    return ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def log_loss(logit: Column, target: Column) -> Column:
    """Binary cross-entropy of a logit, stable for large ones."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))
