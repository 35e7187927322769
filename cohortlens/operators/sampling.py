"""Seeded sampling and splitting keyed by md5 of a row key.

Row membership depends only on (key, seed): re-running a lost task, changing
the partition layout or checking in another engine gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.hashing import hash_order, hash_uniform
from cohortlens.operators.quotas import inside, quota_cuts


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample without replacement: keep rows with u(key, seed) < fraction.

    The fraction is capped at 1 (the reference's fraction can exceed it).
    """
    return df.where(hash_uniform(key, seed) < F.lit(min(float(fraction), 1.0)))


def exact_sample(df: DataFrame, n: int | str | Column, key: str, by: Sequence[str] = (), seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows per stratum (all rows if fewer), the first in seeded hash order.

    ``n`` may be a constant or a column (per-stratum quota, the same in all of
    a stratum's rows). Strata are compared by equality: rows with a null
    stratum are in no sample. See :mod:`quotas` for why no row is sorted.
    """
    quota = F.lit(n) if isinstance(n, int) else (F.col(n) if isinstance(n, str) else n)
    strata = list(by) or ["_cl_all_rows"]
    base = df if by else df.withColumn("_cl_all_rows", F.lit(0))
    digest = F.coalesce(hash_order(key, seed), F.lit(""))
    quotas = base.groupBy(*strata).agg(F.first(quota).cast("long").alias("_cl_quota")).select(
        *strata, F.lit("row").alias("_cl_item"), F.lit(0).alias("_cl_slot"), "_cl_quota")
    cuts = quota_cuts(base.select(*strata, F.lit("row").alias("_cl_item"), digest.alias("_cl_h"), key), strata, key, quotas)
    return base.join(cuts, strata).where(inside("row", 0, digest, key)).select(*df.columns)


def holdout_split(df: DataFrame, key: str, train_fraction: float = 0.7, seed: int = 5043,
                  split_col: str = "split") -> DataFrame:
    """Label rows ``train`` / ``test`` by u(key, seed) < train_fraction."""
    return df.withColumn(split_col, F.when(hash_uniform(key, seed) < F.lit(train_fraction), F.lit("train"))
                         .otherwise(F.lit("test")))


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right`` (anti join, no literal lists)."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def poisson_copies(key: str, seed: int, ratio: float) -> Column:
    """A Poisson(``ratio``) number drawn from u(key, seed): how often a row is drawn with replacement."""
    bounds, p, total, k = [], math.exp(-ratio), 0.0, 0
    while total < 1.0 - 1e-15 and p > 0 and k < 64 + 4 * ratio:
        total += p
        bounds.append(total)
        k += 1
        p *= ratio / k
    u = hash_uniform(key, seed)
    return reduce(lambda a, b: a + b, [F.when(u >= F.lit(b), F.lit(1)).otherwise(F.lit(0)) for b in bounds])


def rebalance(df: DataFrame, label: str, ratio: float, seed: int, key: str,
              keep_class: float = 0.0, sample_class: float = 1.0) -> DataFrame:
    """Keep ``keep_class``; draw ``sample_class`` with replacement at ``ratio``; union.

    Each row of the sampled class appears a Poisson(``ratio``) number of times,
    keyed by md5, as sampling with replacement does in a large table. Adds a
    ``copy`` column (1-based) to tell replicas apart.
    """
    kept = df.where(F.col(label) == F.lit(keep_class)).withColumn("copy", F.lit(1))
    drawn = (df.where(F.col(label) == F.lit(sample_class)).withColumn("_cl_t", poisson_copies(key, seed, ratio))
             .where(F.col("_cl_t") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_cl_t")))).drop("_cl_t"))
    return kept.unionByName(drawn)
