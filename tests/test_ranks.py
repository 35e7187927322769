"""Ranks for all pairs at once, and as-of scans of crowded values."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators.similarity import DIST_COLS, asof_both, dataset_ranks, rank_aligned_matches

SCHEMA = "dataset_id int, id long, Age double, Gender double, PT double, PTT double, Platelets double, DOA double"


def cohort(seed, ages):
    """``ages``: per dataset the values to draw from; ids repeat across datasets and are not in order of age."""
    rng = np.random.default_rng(seed)
    rows = []
    for ds, values in enumerate(ages, 1):
        for i in rng.permutation(60 + 7 * ds).tolist():
            rows.append((ds, i, float(rng.choice(values)), *[float(x) for x in rng.integers(0, 2, 5)]))
    return rows


def by_pair(rows):
    out = set()
    for a, b in itertools.combinations(sorted({r[0] for r in rows}), 2):
        both = [r for r in rows if r[0] in (a, b)]
        lo, hi = min(r[2] for r in both), max(r[2] for r in both)
        scale = lambda x: (x - lo) / (hi - lo) if hi > lo else 0.0
        sides = [sorted((r for r in rows if r[0] == d), key=lambda r: (round(sum(r[3:]) + scale(r[2]), 9), r[1])) for d in (a, b)]
        for k, (x, y) in enumerate(zip(*sides), 1):
            d = (sum(abs(p - q) for p, q in zip(x[3:], y[3:])) + abs(scale(x[2]) - scale(y[2]))) / 6
            out.add((a, b, k, x[1], y[1], round(d, 9)))
    return out


@pytest.mark.parametrize("ages", [[[0, 1, 2], [0, 1, 2], [1, 2], [0, 5]], [[3], [3], [4]], [[0, 1], [0, 1], [0, 1]], [list(range(40)), list(range(0, 80, 2)), [39, 40]]])
def test_one_rank_a_dataset_equals_a_rank_a_pair(spark, ages):
    rows = cohort(len(ages[0]), ages)
    got = rank_aligned_matches(spark.createDataFrame(rows, SCHEMA)).withColumn("distance", F.round("distance", 9))
    assert {tuple(r) for r in got.select("ds_a", "ds_b", "rank", "l_id", "r_id", "distance").collect()} == by_pair(rows)


def test_ranks_are_dense_and_parts_whole(spark):
    df = spark.createDataFrame(cohort(1, [[0, 1, 2], [5, 6]]), SCHEMA)
    for c in ("rank", "full_rank"):
        got = dataset_ranks(df).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("d"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect()
        assert all(r.n == r.d == r.hi and r.lo == 1 for r in got) and len(got) == 2
    with pytest.raises(Exception, match="must be whole"):
        dataset_ranks(df.withColumn("PT", F.lit(0.25)))
    assert rank_aligned_matches(df.where("dataset_id = 1")).count() == 0
    assert "l_Age" not in rank_aligned_matches(df).columns and DIST_COLS[-1] == "Age"


def test_asof_spreads_crowded_values(spark):
    """One value far off and all others close together: the rows still go to many partitions, and the answers are right."""
    items = spark.range(4000).select(F.lit(1).alias("g"), F.when(F.col("id") == 0, 1.0).otherwise(F.col("id") * 1e-9).alias("v"), "id")
    items = items.withColumn("rv", F.when(F.col("id") % 7 == 3, F.col("v")))
    got = {r.id: (r._prev, r._next) for r in asof_both(items, ["g"], buckets=16).collect()}
    values = {r.id: (r.v, r.rv) for r in items.collect()}
    offers = sorted(rv for _, rv in values.values() if rv is not None)
    for i, (v, _) in values.items():
        assert got[i] == (max((o for o in offers if o <= v), default=None), min((o for o in offers if o >= v), default=None))
    parts = items.repartitionByRange(16, "g", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 12 and max(r["count"] for r in parts) < 1000
