"""Calendar columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Add day_of_year, month, day_of_week (Monday 0) and the ISO week_of_year."""
    return df.withColumns({
        "day_of_year": F.dayofyear(ts),
        "month": F.month(ts),
        "day_of_week": F.weekday(ts),
        "week_of_year": F.weekofyear(ts),
    })


def cyclic_features(df: DataFrame) -> DataFrame:
    """Add sine and cosine of the day of the year (365.25 days) and of the week (52)."""
    day = F.col("day_of_year") * (2 * math.pi) / 365.25
    week = F.col("week_of_year") * (2 * math.pi) / 52
    return df.withColumns({
        "sin_day_of_year": F.sin(day), "cos_day_of_year": F.cos(day),
        "sin_week": F.sin(week), "cos_week": F.cos(week),
    })


def week_year(ts: Column | str, mode: str = "calendar_year") -> Column:
    """The year that goes with the ISO week: the calendar year, or the ISO week year.

    With ``calendar_year`` the days around New Year fall in a week of the wrong year
    (2021-01-01 is in ``2021-W53``); ``iso_year`` puts them right.
    """
    if mode == "calendar_year":
        return F.year(ts)
    if mode == "iso_year":
        return F.extract(F.lit("YEAROFWEEK"), F.col(ts) if isinstance(ts, str) else ts).cast("int")
    raise ValueError(f"unknown mode {mode!r}")


def year_week(ts: Column | str, mode: str = "calendar_year") -> Column:
    """Label ``YYYY-Www``."""
    return F.concat(week_year(ts, mode).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
