"""CSV cohort directories: many headerless files read as one table.

The reference stores one dataset per headerless CSV file (cells such as
``1.000000000000000000e+00``) and reads a whole directory at once. Here the
directory is scanned once with an explicit all-string schema (no inference
pass), cells are ``try_cast`` to double (junk -> null under ANSI), and the
source file becomes a ``dataset_id`` column, so per-dataset work is a
``groupBy`` instead of a re-read per file pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources.testdata import COHORT_COLUMNS

# Fixed format: dataset_<seed digits>_<gender OR>_<PT OR>_<PTT OR>_<platelet OR>_<yyyymmdd_HHMMSS>.csv
PROVENANCE_PATTERN = r"dataset_(\d+)_([0-9.]+)_([0-9.]+)_([0-9.]+)_([0-9.]+)_(\d{8}_\d{6})"


def read_cohorts(spark: SparkSession, path: str, names: Sequence[str] = COHORT_COLUMNS,
                 dataset_col: str | None = "dataset_id", mode: str = "FAILFAST",
                 dataset_from: str = "file_path") -> DataFrame:
    """Scan every headerless CSV below ``path`` as one cohort table.

    ``mode="FAILFAST"`` turns a row with the wrong number of cells (a 7- vs
    8-column mix-up) into an error instead of a silent shift.
    """
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType(), True) for i in range(len(names))])
    raw = (spark.read.schema(schema)
           .option("header", "false").option("mode", mode)
           .csv(path))
    cells = [F.col(f"_c{i}").try_cast("double").alias(n) for i, n in enumerate(names)]
    # Partition directories (k=v) are discovered as extra columns; the dataset
    # key is taken from the file's path instead, so they are not selected.
    if dataset_col:
        return raw.select(F.col(f"_metadata.{dataset_from}").alias(dataset_col), *cells)
    return raw.select(*cells)


def read_clinical(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV (column names with units and spaces). Pass a schema on big inputs."""
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path)


def parse_provenance(df: DataFrame, path_col: str = "dataset_id") -> DataFrame:
    """Split the provenance encoded in a dataset's file name into columns.

    The seed digits are joined without separators, so they stay one string.
    """
    src = F.col(path_col)
    parts = {
        "seeds": 1, "gender_or": 2, "pt_or": 3, "ptt_or": 4, "platelet_or": 5, "created": 6,
    }
    cols = []
    for name, idx in parts.items():
        v = F.regexp_extract(src, PROVENANCE_PATTERN, idx)
        v = F.when(v == "", F.lit(None)).otherwise(v)
        if name.endswith("_or"):
            v = v.try_cast("double")
        cols.append(v.alias(name))
    return df.select("*", *cols)


def write_cohort_csv(df: DataFrame, path: str, names: Sequence[str] = COHORT_COLUMNS,
                     partition_col: str | None = None, mode: str = "overwrite") -> None:
    """Write cohort rows as headerless CSV, one directory per dataset (``partitionBy``)."""
    cols = [F.col(c) for c in names]
    out = df.select(*cols, F.col(partition_col)) if partition_col else df.select(*cols)
    writer = out.write.mode(mode).option("header", "false")
    if partition_col:
        writer = writer.partitionBy(partition_col)
    writer.csv(path)
