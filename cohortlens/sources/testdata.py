"""Adapters from the driver's parquet tables onto the cohort data model.

cohort (from ``lineitem``): one dataset per ``l_linenumber``; binary findings
coded 0 = low/abnormal (exposed), 1 = high/normal; ``DOA`` 0 = dead, 1 = alive.
clinical (from ``documents`` left join ``labels``): a nullable numeric table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.ranking import global_index
from cohortlens.session import derived_once

# The cohort schema of the reference (names and order).
COHORT_COLUMNS = ["id", "Age", "Gender", "PT", "PTT", "Platelets", "DOA"]
COHORT_COLUMNS_HF = ["id", "Age", "Gender", "PT", "PTT", "Platelets", "HF", "DOA"]
COHORT_FEATURES = ["Gender", "PT", "PTT", "Platelets"]
FEATURES_WITH_HF = ["Gender", "PT", "PTT", "Platelets", "HF"]
MODEL_FEATURES = ["Age", "Gender", "PT", "PTT", "Platelets"]
CORR_COLUMNS = ["Age", "Gender", "PT", "PTT", "Platelets", "DOA"]

# Ordering of lineitem rows that is unique at every scale factor.
COHORT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                "l_quantity", "l_extendedprice", "l_shipdate"]
# Further columns that the cohort is derived from.
COHORT_SOURCES = ["l_linestatus", "l_discount", "l_tax", "l_returnflag"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _flag(cond) -> F.Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def cohort(spark: SparkSession, sf_dir: str, with_index: bool = False, with_hf: bool = True) -> DataFrame:
    """Cohort rows: dataset_id, [id, index,] Age, Gender, PT, PTT, Platelets, [HF,] DOA.

    The index is stored: the table is sorted once a session, and every query with an index reads the columns that it
    needs from the written rows.
    """
    li = load_table(spark, sf_dir, "lineitem")
    cols = [
        F.col("l_linenumber").alias("dataset_id"),
        F.col("l_quantity").cast("double").alias("Age"),
        _flag(F.col("l_linestatus") == "O").alias("Gender"),
        _flag(F.col("l_discount") >= 0.03).alias("PT"),
        _flag(F.col("l_tax") >= 0.02).alias("PTT"),
        _flag(F.col("l_extendedprice") >= 30000).alias("Platelets"),
    ]
    if with_hf:
        cols.append(_flag(F.col("l_suppkey") % 5 != 0).alias("HF"))
    cols.append(_flag(F.col("l_returnflag") != "R").alias("DOA"))
    if not with_index:
        return li.select(*cols)
    indexed = derived_once(spark, table_path(sf_dir, "lineitem"), "cohort_index",
                           lambda: global_index(li.select(*COHORT_ORDER, *COHORT_SOURCES), COHORT_ORDER, "index"))
    return indexed.select(cols[0], F.col("index").alias("id"), "index", *cols[1:])


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, quality, toxic (nullable), lang, source, outcome (1 = 'en')."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return (docs.join(labels, "doc_id", "left")
            .select("doc_id", "n_chars", "quality", "toxic", "lang", "source",
                    (F.col("lang") == "en").cast("int").alias("outcome")))
