"""Fixed-length windows over ordered rows as model samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.ordered import Series, framed


def sequences(df: DataFrame, s: Series, features: Sequence[str], target: str, length: int,
              label: str = "next", trim: int = 1) -> DataFrame:
    """Add ``steps`` (array of feature structs, oldest first), ``label`` and ``sample`` (1-based).

    ``next``: the row itself is the label step and ``steps`` are the ``length`` rows
    before it, n - length samples. ``same_window``: ``steps`` end at the row and the
    label is the target over the same steps; there are n - length windows, of which
    the last ``trim`` are left out. ``df`` has ``rn`` and ``n``.
    """
    cols = list(dict.fromkeys([*features, target])) if label == "same_window" else list(features)
    if label == "next":
        def made(w: WindowSpec) -> dict:
            return {"steps": F.collect_list(F.struct(*cols)).over(w.rowsBetween(-length, -1))}

        out = framed(df, s, length, 0, made).filter(F.col("rn") > length)
        return out.withColumns({"label": F.col(target), "sample": F.col("rn") - length})
    if label == "same_window":
        def made(w: WindowSpec) -> dict:
            return {"steps": F.collect_list(F.struct(*cols)).over(w.rowsBetween(-(length - 1), 0))}

        out = framed(df, s, length - 1, 0, made).filter(
            (F.col("rn") >= length) & (F.col("rn") <= F.col("n") - 1 - trim))
        return out.withColumns({
            "label": F.transform("steps", lambda x: x[target]), "sample": F.col("rn") - length + 1})
    raise ValueError(f"unknown label {label!r}")


def last_step(seq: DataFrame, forecast: str, label: str = "label", windows: str = "n_windows") -> DataFrame:
    """Last forecast and actual of each window, without the last window."""
    return seq.filter(F.col("sample") < F.col(windows)).withColumns({
        "actual": F.element_at(label, -1), "predicted": F.element_at(forecast, -1)})
