"""A distributed stand-in for the frame classifier: logistic regression on feature arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortlab.functions.columns import THRESHOLD, prediction


def with_features(df: DataFrame, array_col: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))


def fit(df: DataFrame, array_col: str, target_col: str = "target", epochs: int = 20, decay: float = 0.01) -> LogisticRegressionModel:
    """Fit on the rows with a target; statistics and gradients are computed on the executors."""
    rows = with_features(df.where(F.col(target_col).isNotNull()), array_col)
    return LogisticRegression(featuresCol="features", labelCol=target_col, maxIter=epochs, regParam=decay).fit(rows)


def score(df: DataFrame, model: LogisticRegressionModel, array_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """Adds prob_flip and prediction."""
    rows = model.transform(with_features(df, array_col))
    scored = rows.withColumn("prob_flip", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    return scored.withColumn("prediction", prediction(threshold))


def save(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def parameters(model: LogisticRegressionModel) -> int:
    """Fitted numbers of the model."""
    return model.coefficients.size + 1


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], threshold: float = THRESHOLD, batch: int = 1024) -> DataFrame:
    """Adds prob_flip and prediction by a function of one's own: it gets the columns of a batch of
    rows and returns a probability for each. Rows stream through in Arrow batches of at most
    `batch` rows; a wrong number of values, or one outside 0 .. 1, fails the query."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                p = pd.Series(scorer(part)).astype(float)
                if len(p) != len(part) or not p.between(0, 1).all():
                    raise ValueError("a scorer gives one probability a row")
                yield part.assign(prob_flip=p.to_numpy())

    rows = df.drop("prob_flip", "prediction")
    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("prob_flip", DoubleType())])).withColumn("prediction", prediction(threshold))
