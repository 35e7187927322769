"""Missing-value survey and null policies (profile, impute, drop), shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One pass: ``(column, nulls, non_nulls, any_null)`` per column."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_cl_rows")] + [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_cl_n{i}")
                                                    for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    args = ", ".join(f"'{c}', `_cl_n{i}`" for i, c in enumerate(cols))
    stacked = F.expr(f"stack({len(cols)}, {args}) as (`column`, nulls)")
    return (wide.select(F.col("_cl_rows"), stacked)
            .select("column", "nulls", (F.col("_cl_rows") - F.col("nulls")).alias("non_nulls"),
                    (F.col("nulls") > 0).alias("any_null")))


def impute_constant(df: DataFrame, value: float = -1, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls of numeric columns with a constant (the reference uses -1)."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    targets = cols or [c for c, t in df.dtypes if t in numeric or t.startswith("decimal")]
    return df.na.fill(value, subset=list(targets))


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows having a null in any (given) column."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def shape(df: DataFrame) -> DataFrame:
    """One row ``(rows, cols)``."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)).cast("long"))
