"""Principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.columns import vector_to_columns


@dataclass(frozen=True)
class Components:
    """A fitted projection: the model, the sign of each component, and the scaler if any."""

    model: PCAModel
    signs: tuple[float, ...]
    scaler: object | None = None

    def transform(self, df: DataFrame, out: str = "components") -> DataFrame:
        """Add the projected vector; rows are not centred unless fitted so."""
        if self.scaler is not None:
            df = self.scaler.transform(df)
        raw = self.model.transform(df)
        signs = F.array(*[F.lit(v) for v in self.signs])
        signed = F.zip_with(vector_to_array("_pca"), signs, lambda v, sign: v * sign)
        return raw.withColumn(out, array_to_vector(signed)).drop("_pca", "_scaled")

    def explained(self, spark: SparkSession) -> DataFrame:
        """Share of variance per component: ``(component, ratio)``."""
        ratios = self.model.explainedVariance.toArray().tolist()
        return spark.createDataFrame(
            [(f"PC{i + 1}", float(v)) for i, v in enumerate(ratios)], "component string, ratio double")


def pca(df: DataFrame, vector: str, k: int, center: bool = False, scale: bool = False) -> Components:
    """Fit ``k`` components; the largest loading of each is made positive."""
    scaler, inputs = None, vector
    if center or scale:
        scaler = StandardScaler(inputCol=vector, outputCol="_scaled", withMean=center, withStd=scale).fit(df)
        df, inputs = scaler.transform(df), "_scaled"
    model = PCA(k=k, inputCol=inputs, outputCol="_pca").fit(df)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.argmax(np.abs(loadings), axis=0), np.arange(k)])
    return Components(model, tuple(float(v) or 1.0 for v in signs), scaler)


def pca_scores(df: DataFrame, components: Components, keep: Sequence[str], k: int = 3) -> DataFrame:
    """Columns ``PC1..PCk`` beside ``keep``."""
    return vector_to_columns(components.transform(df), "components", k, keep=keep)
