"""Contiguous blocks of k rows, leave-one-block-out folds, stratified folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.hashing import hash_order
from cohortlens.operators.ranking import group_index
from cohortlens.session import stored


def contiguous_blocks(df: DataFrame, k: int, index_col: str = "index", block_col: str = "block") -> DataFrame:
    """``block = floor((index - 1) / k)`` (0-based) and ``is_tail``.

    There are floor(n / k) full blocks; the last ``n mod k`` rows form the
    tail, which is never a test block but always part of training data.
    ``n`` comes from a scalar subquery (the index is dense, so n = max).
    """
    n = df.select(F.max(index_col)).scalar()
    full = F.floor(n / F.lit(k))
    block = F.floor((F.col(index_col) - F.lit(1)) / F.lit(k)).cast("long")
    return df.withColumn(block_col, block).withColumn("is_tail", F.col(block_col) >= full)


def block_summary(blocked: DataFrame, block_col: str = "block", index_col: str = "index",
                  outcome: str = "DOA", dead: float = 0.0) -> DataFrame:
    """One row per block: size, index range, deaths, tail flag."""
    return (blocked.groupBy(block_col, "is_tail")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.min(index_col).alias("first_index"),
                 F.max(index_col).alias("last_index"),
                 F.count_if(F.col(outcome) == F.lit(dead)).alias("n_dead")))


def fold_summary(blocked: DataFrame, block_col: str = "block", outcome: str = "DOA",
                 dead: float = 0.0) -> DataFrame:
    """Per fold: test and train sizes and deaths, without materialising any fold.

    train = table totals - test block. The blocks are counted once and stored;
    the totals are sums over them.
    """
    per = stored(blocked.groupBy(block_col, "is_tail")
                 .agg(F.count(F.lit(1)).alias("test_rows"),
                      F.count_if(F.col(outcome) == F.lit(dead)).alias("test_dead")), "folds")
    total, total_dead = per.select(F.sum("test_rows")).scalar(), per.select(F.sum("test_dead")).scalar()
    return per.where(~F.col("is_tail")).select(F.col(block_col).alias("fold"), "test_rows", "test_dead",
                      (total - F.col("test_rows")).alias("train_rows"),
                      (total_dead - F.col("test_dead")).alias("train_dead"))


def stratified_folds(df: DataFrame, label: str, key: str, n_folds: int = 3, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """Round-robin fold numbers inside each class, in seeded hash order.

    Every class is spread evenly over the folds (sizes differ by at most one).
    The within-class numbering is a distributed group index, so a dominant
    class is not numbered by one task.
    """
    keyed = df.withColumn("_cl_h", hash_order(key, seed))
    numbered = group_index(keyed, [label], ["_cl_h", key], "_cl_rn")
    return numbered.withColumn(fold_col, ((F.col("_cl_rn") - F.lit(1)) % F.lit(n_folds)).cast("int")) \
                   .drop("_cl_h", "_cl_rn")
