"""Choosing, stacking, encoding and aligning columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import Series, attach, keyed, positions

NUMERIC = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (),
                    exclude_prefix: Sequence[str] = ()) -> list[str]:
    """Names of int, bigint, float and double columns; reads the schema only."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude
            and not f.name.startswith(tuple(exclude_prefix))]


def keep_numeric(df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The numeric columns (and ``keep``), and the names of the columns dropped."""
    wanted = {*numeric_columns(df), *keep}
    return (df.select(*[c for c in df.columns if c in wanted]),
            [c for c in df.columns if c not in wanted])


def split_xy(df: DataFrame, features: Sequence[str], target: str,
             ids: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Feature columns and target column as two frames, both with the ids."""
    return df.select(*ids, *features), df.select(*ids, target)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features",
             missing: str = "skip") -> DataFrame:
    """Stack columns into a feature vector; rows with a missing value are skipped by default."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=missing).transform(df)


def vector_to_columns(df: DataFrame, vector: str, k: int, prefix: str = "PC",
                      keep: Sequence[str] = ()) -> DataFrame:
    """First ``k`` vector elements as columns ``<prefix>1..k`` beside ``keep``."""
    values = df.select(*keep, vector_to_array(vector).alias("_v"))
    return values.select(*keep, *[F.col("_v")[i].alias(f"{prefix}{i + 1}") for i in range(k)])


def label_codes(df: DataFrame, col: str, block_rows: int | None = None) -> DataFrame:
    """Distinct values of ``col`` with their code 0..n-1 in sorted order.

    Class labels are few, so one window numbers them; ``block_rows`` numbers any
    count of distinct values in blocks.
    """
    values, keys = keyed(df.select(col).filter(F.col(col).isNotNull()).distinct(), [])
    ranked = positions(values, Series(tuple(keys), (col,), block_rows))
    return ranked.select(col, (F.col("rn") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, codes: DataFrame, col: str, spread: Sequence[str],
                 strict: bool = True) -> DataFrame:
    """Add ``code`` from :func:`label_codes`; an unseen value raises, or gets null."""
    out = attach(df, codes, [col], spread)
    if not strict:
        return out
    return out.withColumn("code", F.when(
        F.col(col).isNotNull() & F.col("code").isNull(),
        F.raise_error(F.concat(F.lit("unseen label "), F.col(col).cast("string"))).cast("int")
    ).otherwise(F.col("code")))


def encode_target(df: DataFrame, col: str, fit_on: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Label-encode a class target unless it is an integer column already."""
    if isinstance(df.schema[col].dataType, T.IntegralType):
        return df.withColumn("code", F.col(col).cast("int"))
    return label_encode(df, label_codes(fit_on, col), col, spread)


def attach_columns(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Columns of two frames side by side, matched by key and time instead of by position."""
    return df.join(other, list(on), "inner")


def align_predictions(predicted: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Prediction beside the actual value and label of the same step."""
    return actual.join(predicted, list(on), "inner")


def flatten_steps(df: DataFrame, features: Sequence[str], steps: str = "steps",
                  out: str = "features") -> DataFrame:
    """A sequence of step structs as one vector, oldest step first, features in order."""
    flat = F.flatten(F.transform(steps, lambda x: F.array(*[x[c].cast("double") for c in features])))
    return df.withColumn(out, array_to_vector(flat))


def restore_steps(df: DataFrame, features: Sequence[str], length: int, vector: str = "features",
                  out: str = "steps") -> DataFrame:
    """Inverse of :func:`flatten_steps`."""
    width = len(features)
    values = vector_to_array(vector)
    rebuilt = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.struct(*[
        F.element_at(values, (i * width + j + 1).cast("int")).alias(c)
        for j, c in enumerate(features)]))
    return df.withColumn(out, rebuilt)


def long_steps(df: DataFrame, features: Sequence[str], length: int, keep: Sequence[str],
               steps: str = "steps", value: str = "value") -> DataFrame:
    """One row per ``(feature, lag)`` of a sequence; lag 0 is the latest step."""
    each = df.select(*keep, F.posexplode(steps).alias("_i", "_s"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_s.{c}").cast("double").alias(value))
                      for c in features])
    return each.select(*keep, (F.lit(length - 1) - F.col("_i")).alias("lag"),
                       F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "lag", f"_p.{value}")


def step_labels(df: DataFrame) -> DataFrame:
    """Add ``name`` = ``<feature>_t-<lag>``."""
    return df.withColumn("name", F.concat("feature", F.lit("_t-"), F.col("lag").cast("string")))
