"""Table sinks (fold metrics, pair distances, correlation matrices, cohorts).

The reference writes these through a driver-local file writer; here every
result is a DataFrame written by the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True,
                partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", str(header).lower())
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    return path
