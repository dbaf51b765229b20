"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clean import nan_as_null


def read_delimited(spark: SparkSession, path: str, sep: str = ";",
                   schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text with a header. Without a schema every column is read as text.

    Types come from the cleaning functions afterwards, so the files are read once.
    """
    reader = spark.read.option("sep", sep).option("header", True)
    return nan_as_null((reader.schema(schema) if schema is not None else reader).csv(path))


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of a directory; NaN is read as missing.

    Column choice reaches the scan, and so do filters, but those on columns of floating point.
    """
    return nan_as_null(spark.read.parquet(f"{directory}/{name}.parquet"))


def try_load(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The data set at ``path``, NaN read as missing, or None when there is none."""
    try:
        return nan_as_null(spark.read.format(fmt).load(path))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """CSV with header, one file per task, optionally one folder per key value."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_attribution(by_feature: DataFrame, periods: DataFrame, path: str, key: str = "product") -> None:
    """Attribution report: one folder per product, columns Feature, SHAP_Importance, Test_Period.

    ``by_feature`` has (key, feature, importance), ``periods`` (key, first_label, last_label).
    """
    report = by_feature.join(periods, key).select(
        F.col(key).alias("ProductDesignation"), F.col("feature").alias("Feature"),
        F.col("importance").alias("SHAP_Importance"),
        F.concat("first_label", F.lit(" to "), "last_label").alias("Test_Period"))
    write_csv(report, path, ["ProductDesignation"])


def write_predictions(df: DataFrame, path: str, keys: Sequence[str] = (), label: str = "year_week") -> None:
    """Report of week, actual and predicted, one folder per key value."""
    write_csv(df.select(*keys, F.col(label).alias("week"), "actual", "predicted"), path, keys)


def write_best_params(best: DataFrame, path: str) -> None:
    """Best parameters as JSON lines."""
    best.write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
