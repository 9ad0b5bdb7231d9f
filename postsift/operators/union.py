"""Union, fill and cast."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(frames: Sequence[DataFrame], sort_columns: bool = False) -> DataFrame:
    """UNION ALL by column name; a column missing in a frame is NULL there.
    ``sort_columns`` (L3) orders the result columns by code point."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return sort_columns_by_name(out) if sort_columns else out


def sort_columns_by_name(df: DataFrame) -> DataFrame:
    """L3: columns in code-point order of their names."""
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL -> 0 on the listed columns (those present)."""
    present = [c for c in cols if c in df.columns]
    return df.na.fill(0, subset=present) if present else df


def cast_columns(df: DataFrame, types: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Cast columns (ANSI mode: malformed text raises).  ``strict`` also fails on
    NULL, as the reference's integer cast does."""
    out = df
    for c, t in types.items():
        if c not in out.columns:
            continue
        col = F.col(c).cast(t)
        if strict:
            col = F.when(F.col(c).isNull(), F.raise_error(F.lit(f"NULL in {c}"))).otherwise(col).cast(t)
        out = out.withColumn(c, col)
    return out
