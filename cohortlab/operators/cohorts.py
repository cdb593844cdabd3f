"""Evaluation cohorts: supplied (O), source-disjoint (S), chronological (T), both (ST)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import REGIMES, share_of
from cohortlab.operators.constraints import LEAST
from cohortlab.operators.ranking import in_hash_order, in_source_order

ROLES = ("train", "validation", "test", "context_unseen_early")


def refused(condition: Column, value: Column | str, *message: Column | str) -> Column:
    """`value`, but the query fails with the message on rows that meet the condition."""
    text = F.concat(*[F.lit(m) if isinstance(m, str) else m.cast("string") for m in message])
    return F.when(condition, F.raise_error(text).cast("string")).otherwise(value)


def long_enough(role: Column, regime: str) -> Column:
    """`role`, refused in sources with fewer rows (column n) than the regime can split."""
    return refused(F.col("n") < LEAST[regime], role, f"{regime}: source ", F.col("source_key"), " has ", F.col("n"), f" rows of {LEAST[regime]}")


def supplied(role: Column) -> Column:
    """`role`, refused on rows whose supplied split is neither of the two."""
    known = F.coalesce(F.col("supplied_split").isin("training", "testing"), F.lit(False))
    return refused(~known, role, "O: supplied split of ", F.col("sample_id"))


def shares(counts: DataFrame, fraction: float, stratum: str) -> DataFrame:
    """(stratum, c, take): ceil(fraction x rows) shared over strata of c rows by largest remainder."""
    every = Window.partitionBy()
    sized = counts.withColumn("all", F.sum("c").over(every)).withColumn("total", F.ceil(F.lit(fraction) * F.col("all")))
    parts = sized.withColumn("base", F.expr("total * c div all")).withColumn("rem", F.expr("total * c % all"))
    rank = F.row_number().over(Window.orderBy(F.col("rem").desc(), stratum))
    return parts.select(stratum, "c", (F.col("base") + (rank <= F.col("total") - F.sum("base").over(every)).cast("long")).alias("take"))


def holdout(df: DataFrame, key: str, fraction: float, seed: int, stratum: str = "label") -> DataFrame:
    """The rows held out: ceil(fraction x rows) in all, shared over strata by largest remainder,
    in each stratum the rows of least hash."""
    take = shares(df.groupBy(stratum).agg(F.count("*").alias("c")), fraction, stratum)
    return in_hash_order(df, stratum, key, seed).join(take, stratum).where(F.col("r") <= F.col("take")).select(key)


def _flagged(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    return df.join(keys.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def sources(frames: DataFrame) -> DataFrame:
    return frames.select("source_key", "label").distinct()


def split_o(frames: DataFrame, seed: int = 42) -> DataFrame:
    """Supplied test rows; a tenth of the supplied training rows validates. Rows of another
    supplied split are refused."""
    held = holdout(frames.where(F.col("supplied_split") == "training").select("sample_id", "label"), "sample_id", 0.1, seed)
    role = F.when(F.col("supplied_split") == "testing", "test").when(F.col("held"), "validation").otherwise("train")
    return _flagged(frames, held, "sample_id", "held").withColumn("role", supplied(role)).drop("held")


def source_roles(frames: DataFrame, seed: int = 42) -> DataFrame:
    """(source_key, label, role): a fifth of the sources tests, a tenth of the rest validates."""
    known = sources(frames)
    counts = known.groupBy("label").agg(F.count("*").alias("c"))
    unseen = shares(counts, 0.2, "label").withColumnRenamed("take", "_unseen")
    rest = unseen.where(F.col("c") > F.col("_unseen")).select("label", (F.col("c") - F.col("_unseen")).alias("c"))
    taken = unseen.join(shares(rest, 0.1, "label").select("label", F.col("take").alias("_held")), "label", "left")
    # one order of the hash for both: what validates comes right behind what tests
    role = F.when(F.col("r") <= F.col("_unseen"), "test").when(F.col("r") <= F.col("_unseen") + F.col("_held"), "validation").otherwise("train")
    return in_hash_order(known, "label", "source_key", seed).join(taken, "label").select("source_key", "label", role.alias("role"))


def split_s(frames: DataFrame, seed: int = 42) -> DataFrame:
    return frames.join(source_roles(frames, seed).select("source_key", "role"), "source_key")


def split_t(frames: DataFrame) -> DataFrame:
    """80 / 10 / 10 percent of every source, in order; sources of fewer than three rows are refused."""
    k = share_of(0.1, "n")
    role = F.when(F.col("rn") <= F.col("n") - 2 * k, "train").when(F.col("rn") <= F.col("n") - k, "validation").otherwise("test")
    return in_source_order(frames).withColumn("role", long_enough(role, "T")).drop("rn", "n")


def unseen_sources(frames: DataFrame, seed: int = 42) -> DataFrame:
    """The sources that S and ST both withhold."""
    return holdout(sources(frames), "source_key", 0.2, seed)


def split_st(frames: DataFrame, seed: int = 42) -> DataFrame:
    """Early and late parts of every source; withheld sources are context and test. Sources of
    one row are refused."""
    early = F.col("rn") <= F.col("n") - share_of(0.2, "n")
    role = F.when(F.col("unseen"), F.when(early, "context_unseen_early").otherwise("test")).otherwise(F.when(early, "train").otherwise("validation"))
    return _flagged(in_source_order(frames), unseen_sources(frames, seed), "source_key", "unseen").withColumn("role", long_enough(role, "ST")).drop("rn", "n", "unseen")


def all_splits(frames: DataFrame, seed: int = 42) -> DataFrame:
    """The four cohorts, one below the other, with a regime column.

    One pass: order and withheld sources are found once (S and ST withhold the same), every
    row gets its four roles and is then laid out once a regime.
    """
    k, late = share_of(0.1, "n"), share_of(0.2, "n")
    early = F.col("rn") <= F.col("n") - late
    held = holdout(frames.where(F.col("supplied_split") == "training").select("sample_id", "label"), "sample_id", 0.1, seed)
    rows = in_source_order(frames).join(source_roles(frames, seed).select("source_key", F.col("role").alias("_s")), "source_key")
    rows = _flagged(rows, held, "sample_id", "_held")
    roles = {
        "O": F.when(F.col("supplied_split") == "testing", "test").when(F.col("_held"), "validation").otherwise("train"),
        "S": F.col("_s"),
        "T": F.when(F.col("rn") <= F.col("n") - 2 * k, "train").when(F.col("rn") <= F.col("n") - k, "validation").otherwise("test"),
        "ST": F.when(F.col("_s") == "test", F.when(early, "context_unseen_early").otherwise("test")).otherwise(F.when(early, "train").otherwise("validation")),
    }
    roles |= {"O": supplied(roles["O"]), "T": long_enough(roles["T"], "T"), "ST": long_enough(roles["ST"], "ST")}
    laid = F.array(*[F.struct(F.lit(r).alias("regime"), role.alias("role")) for r, role in roles.items()])
    return rows.select(*frames.columns, F.inline(laid))


def summary(splits: DataFrame) -> DataFrame:
    wide = [F.count_if(F.col("role") == r).alias(r) for r in ROLES]
    return splits.groupBy("regime").agg(*wide, F.count("*").alias("total"))


def crosstab(splits: DataFrame) -> DataFrame:
    return splits.groupBy("regime", "role").agg(F.count_if(F.col("label") == "flip").alias("flip"), F.count_if(F.col("label") == "notflip").alias("notflip"))


def test_rows(splits: DataFrame) -> DataFrame:
    return splits.where(F.col("role") == "test")


def regime_order(c: str = "regime"):
    return F.array_position(F.array(*[F.lit(r) for r in REGIMES]), F.col(c))
