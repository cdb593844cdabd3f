"""An extension: running confusion counts of predictions that arrive as a stream.

The batch operators say what is counted; this keeps the same counts up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.columns import cells, macro_f1


def running_metrics(stream: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and macro F1 per group, for output mode complete or update."""
    return stream.groupBy(*by).agg(*cells()).withColumn("macro_f1", F.round(macro_f1(), 6))


def windowed_metrics(stream: DataFrame, time_col: str, length: str, late: str) -> DataFrame:
    """The same per event-time window; rows later than the watermark are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, length)).agg(*cells())
