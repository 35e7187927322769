"""The all-pairs driver: one summary row per pair of datasets, by the method asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.matching import match_exact, match_sampled
from cohortlens.operators.similarity import match_rank_aligned, nearest_neighbor

METHODS = {"sampled": match_sampled, "exact": match_exact, "rank": match_rank_aligned, "nearest": nearest_neighbor}


def pairwise_similarity(df: DataFrame, method: str = "sampled", pairs: Sequence[tuple] | None = None) -> DataFrame:
    """File1, File2, avgDistance, minDistance, maxDistance, zeroDistPercent of all pairs, or of ``pairs``."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, not one of {sorted(METHODS)}")
    s = METHODS[method](df, pairs=pairs)
    return s.select(F.col("ds_a").alias("File1"), F.col("ds_b").alias("File2"),
                    F.col("avg_distance").alias("avgDistance"), F.col("min_distance").alias("minDistance"),
                    F.col("max_distance").alias("maxDistance"), F.col("zero_dist_percent").alias("zeroDistPercent"))
