"""What both vector searches share: which rows take part, and vectors as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str, *, nonzero: bool = False) -> DataFrame:
    """(id, v) of the rows whose id isn't null and whose vector is there, without null or non-finite components (nor zero)."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("v", bad))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def width(rows: DataFrame) -> int:
    """The longest vector's length; shorter ones count as padded with zeros."""
    return rows.agg(F.max(F.size("v"))).first()[0] or 0


def padded(v: Column, d: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0).cast("double"), F.lit(d) - F.size(v)))


def matrix(column, d: int, dtype="f8"):
    """A list or binary Arrow column as a matrix."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), d)
    return np.asarray(column.flatten()).reshape(len(column), d)


def as_bytes(m) -> list[bytes]:
    return [row.tobytes() for row in m]
