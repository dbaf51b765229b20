"""Repairs of text columns: dates, decimal commas, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_dmy(col: Column | str, strict: bool = True) -> Column:
    """Day.month.year text to a date; one- and two-digit parts are taken."""
    return F.to_date(col, "d.M.yyyy") if strict else F.try_to_date(col, "d.M.yyyy")


def parse_ts(col: Column | str, strict: bool = True) -> Column:
    """ISO-like text to a timestamp."""
    return F.to_timestamp(col) if strict else F.try_to_timestamp(col)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def missing(df: DataFrame, col: str) -> Column:
    """Whether a column has no value: null, or NaN in a column of floating point."""
    floating = isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType))
    return F.col(f"`{col}`").isNull() | F.isnan(f"`{col}`") if floating else F.col(f"`{col}`").isNull()


def nan_as_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN to null in those of ``cols`` (by default all) that hold floating point; other columns pass."""
    wanted = df.columns if cols is None else [c for c in cols if c in df.columns]
    made = {c: nan_to_null(F.col(f"`{c}`")) for c in wanted
            if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(made) if made else df


def decimal_comma(df: DataFrame, cols: Sequence[str], strict: bool = False) -> DataFrame:
    """Text with a decimal comma to double, for those of ``cols`` that exist.

    Empty text and ``nan`` are missing. Malformed text raises when ``strict``.
    """
    made = {}
    for c in [c for c in cols if c in df.columns]:
        text = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        dotted = F.replace(text, F.lit(","), F.lit("."))
        made[c] = nan_to_null(dotted.cast("double") if strict else dotted.try_cast("double"))
    return df.withColumns(made) if made else df


def map_flag(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``True``/``False`` text or booleans to 1/0, anything else missing; absent columns pass."""
    made = {}
    for c in [c for c in cols if c in df.columns]:
        if isinstance(df.schema[c].dataType, T.BooleanType):
            made[c] = F.col(c).cast("int")
        else:
            made[c] = F.when(F.col(c) == "True", 1).when(F.col(c) == "False", 0)
    return df.withColumns(made) if made else df


def map_yes_no(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``yes``/``no`` to 1/0, anything else missing; the columns are required."""
    return df.withColumns({c: F.when(F.col(c) == "yes", 1).when(F.col(c) == "no", 0)
                           for c in cols})
