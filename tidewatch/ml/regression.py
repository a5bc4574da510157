"""Standardised linear regression as one Spark ML pipeline."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame


def fit_regression(df: DataFrame, inputs: list[str], target: str) -> PipelineModel:
    """Scale the inputs and fit a linear model by least squares."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=inputs, outputCol="inputs"),
        StandardScaler(inputCol="inputs", outputCol="scaled", withMean=True, withStd=True),
        LinearRegression(featuresCol="scaled", labelCol=target, predictionCol="prediction"),
    ]).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction``; the pipeline's helper columns are dropped."""
    return model.transform(df).drop("inputs", "scaled")


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
