"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under new names; further columns of any name stay behind.

    ``pick(df, doc_id="id bigint", text="body string")``: new name = "column type".
    """
    out = []
    for name, source in wanted.items():
        column, kind = source.rsplit(" ", 1)
        out.append(F.col(f"`{column}`").cast(kind).alias(name))
    return df.select(*out)


def strings(column: pa.Array, step: int = 256) -> Iterator[str]:
    """Texts of an Arrow column, null as empty; few at a time are held as Python objects."""
    for at in range(0, len(column), step):
        for t in column.slice(at, step).to_pylist():
            yield t or ""


def some(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """Texts of an Arrow column with their nulls."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def utf8(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """Texts of an Arrow column as UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for at in range(0, len(column), step):
        for t in column.slice(at, step).cast(kind).to_pylist():
            yield t or b""


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row; maps are hashed by their JSON text."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString()
                        else F.col(f"`{f.name}`") for f in df.schema.fields])


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
