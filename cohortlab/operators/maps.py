"""Statistics of two-dimensional activation maps held as flat arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(df: DataFrame, values: str, keys: list[str], epsilon: float = 1e-8) -> DataFrame:
    """(keys.., m, n): absolute values, shifted to 0 and scaled by the maximum plus epsilon.

    Each array is computed once a row: the generators keep the optimizer from writing its
    expression into the lambda that reads it.
    """
    held = df.select(*keys, F.inline(F.array(F.struct(F.transform(F.col(values), lambda v: F.abs(v.cast("double"))).alias("a")))))
    held = held.select(*keys, F.inline(F.array(F.struct("a", F.array_min("a").alias("lo"), F.array_max("a").alias("hi")))))
    return held.select(*keys, F.transform("a", lambda v: (v - F.col("lo")) / (F.col("hi") - F.col("lo") + epsilon)).alias("m"), F.size("a").alias("n"))


def activation_stats(df: DataFrame, values: str, keys: list[str], width: int = 8, levels: tuple[float, ...] = (0.5, 0.75, 0.9)) -> DataFrame:
    """One row a map: mean, shares at or above each level, centre of mass (0 .. 1), degenerate."""
    cells = normalised(df, values, keys).select(*keys, "n", F.posexplode("m").alias("i", "v"))
    x, y = F.col("i") % width, F.floor(F.col("i") / width)
    shares = [F.round(F.avg((F.col("v") >= level).cast("double")), 6).alias(f"fraction_ge_{int(level * 100)}") for level in levels]
    rows = F.max("n") / width
    return cells.groupBy(*keys).agg(
        F.round(F.avg("v"), 6).alias("mean_normalized_activation"), *shares,
        F.round(F.try_divide(F.sum(x * F.col("v")), F.sum("v")) / (width - 1), 6).alias("center_x"),
        F.round(F.try_divide(F.sum(y * F.col("v")), F.sum("v")) / (rows - 1), 6).alias("center_y"),
        (F.max("v") <= 0).alias("degenerate"),
    )


def class_activation(df: DataFrame, maps: str, gradients: str, keys: list[str], width: int, size: int, epsilon: float = 1e-8) -> DataFrame:
    """(keys.., heat): heat maps of size x size cells from channels of feature maps.

    maps, gradients: a flat array a channel, `width` cells a row. Each channel weighs the mean
    of its gradients; the weighted sum of the channels, negatives set to 0, is brought to
    `size` by bilinear interpolation between cell centres and scaled to 0 .. 1. A map
    without channels has no heat.
    """
    held = df.select(*keys, F.transform(F.col(gradients), lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / F.size(g)).alias("w"), F.col(maps).alias("m"))
    # a generator holds each array once a row
    held = held.select(*keys, F.inline(F.array(F.struct("w", "m", F.size(F.get("m", F.lit(0))).alias("n")))))
    cell = lambda i: F.aggregate(F.zip_with("w", "m", lambda w, m: w * F.get(m, i)), F.lit(0.0), lambda a, x: a + x)
    held = held.where(F.size("m") > 0).select(*keys, F.inline(F.array(F.struct(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.greatest(cell(i), F.lit(0.0))).alias("s"), (F.col("n") / width).cast("int").alias("rows")))))
    heat = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: _bilinear("s", F.floor(i / size), i % size, F.col("rows"), width, size))
    held = held.select(*keys, F.inline(F.array(F.struct(heat.alias("h")))))
    held = held.select(*keys, F.inline(F.array(F.struct("h", F.array_min("h").alias("lo"), F.array_max("h").alias("hi")))))
    return held.select(*keys, F.transform("h", lambda v: (v - F.col("lo")) / (F.col("hi") - F.col("lo") + epsilon)).alias("heat"))


def _bilinear(cells: str, y: Column, x: Column, rows: Column, width: int, size: int) -> Column:
    """The value of a grid of rows x width cells at cell (y, x) of a grid of size x size."""
    at = lambda k, n: F.greatest((k + 0.5) * n / size - 0.5, F.lit(0.0))
    v, u = at(y, rows), at(x, F.lit(width))
    top, left = F.floor(v).cast("int"), F.floor(u).cast("int")
    low, right = F.least(top + 1, rows - 1), F.least(left + 1, F.lit(width - 1))
    value = lambda r, c: F.get(cells, r * width + c)
    upper = value(top, left) * (1 - (u - left)) + value(top, right) * (u - left)
    lower = value(low, left) * (1 - (u - left)) + value(low, right) * (u - left)
    return upper * (1 - (v - top)) + lower * (v - top)


def overlay(df: DataFrame, image: str, colours: str, share: float = 0.45) -> DataFrame:
    """Adds `overlay`: an image (0 .. 255) and a coloured heat map (0 .. 1) laid over one another,
    cut to 0 .. 1."""
    mixed = F.zip_with(image, colours, lambda a, b: F.greatest(F.least(share * a / 255.0 + (1 - share) * b, F.lit(1.0)), F.lit(0.0)))
    return df.withColumn("overlay", mixed)
