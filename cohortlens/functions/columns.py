"""Projection helpers: casting, positional renames, suffixes, row arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cast_all(df: DataFrame, dtype: str = "double") -> DataFrame:
    """Cast every column in one projection; junk cells become null (try_cast)."""
    return df.select([F.col(f"`{c}`").try_cast(dtype).alias(c) for c in df.columns])


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename columns by position; a wrong arity is an error, not a silent cut."""
    if len(names) != len(df.columns):
        raise ValueError(f"expected {len(df.columns)} names, got {len(names)}: {list(names)}")
    return df.toDF(*names)


def suffix_columns(df: DataFrame, suffix: str, sep: str = "_") -> DataFrame:
    """``c`` -> ``c<sep><suffix>`` for every column."""
    return df.toDF(*[f"{c}{sep}{suffix}" for c in df.columns])


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column-subset projection (pruned down to the scan by Catalyst)."""
    return df.select([F.col(f"`{c}`") for c in cols])


def valid_rows(df: DataFrame, age: str = "Age", labs: Sequence[str] = ("PT", "PTT", "Platelets")) -> DataFrame:
    """Keep rows with a positive age and measured (non-negative) labs."""
    cond = reduce(lambda a, b: a & b, [F.col(c) >= 0 for c in labs], F.col(age) > 0)
    return df.where(cond)


def row_sum(cols: Sequence[str]) -> Column:
    """Sum over columns in the given order (summation order fixed: left to right)."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])


def mean_abs_distance(left: Sequence[str], right: Sequence[str]) -> Column:
    """Mean absolute difference between two aligned column lists."""
    if len(left) != len(right):
        raise ValueError("column lists differ in length")
    total = reduce(lambda a, b: a + b, [F.abs(F.col(a) - F.col(b)) for a, b in zip(left, right)])
    return total / F.lit(float(len(left)))


def minmax_scale(value: Column, lo: Column, hi: Column) -> Column:
    """(v - lo) / (hi - lo); a zero range maps to 0 instead of NaN/Infinity, a null value stays null."""
    return F.when(value.isNull(), F.lit(None).cast("double")).when(hi == lo, F.lit(0.0)).otherwise((value - lo) / (hi - lo))
