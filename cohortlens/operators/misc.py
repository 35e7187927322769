"""Small relational helpers the reference uses inline: top-n, views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows in a total order (Spark plans this as a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def register_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> list[str]:
    """Register DataFrames as temp views so SQL text can run over them."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
