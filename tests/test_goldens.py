"""Closed-form goldens (expected cells, threshold scan) and cohort-adapter goldens."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.odds import threshold_odds_scan
from cohortlens.operators.synthesis import blocked_outcomes, expected_cells, marginals
from tests.conftest import SF01

# (feature, n, dead, low, high, OR) -> (dead_low, dead_high, alive_low, alive_high)
CELL_GOLDENS = [
    # v2 configuration
    ("Gender", 10000, 2000, 2500, 7500, 6.0, (1114, 886, 1386, 6614)),
    ("PT", 10000, 2000, 2801, 7199, 3.3, (985, 1015, 1816, 6184)),
    ("PTT", 10000, 2000, 2000, 8000, 7.8, (1035, 965, 965, 7035)),
    ("Platelets", 10000, 2000, 1000, 9000, 4.84, (494, 1506, 506, 7494)),
    ("HF", 10000, 2000, 1800, 8200, 3.3, (693, 1307, 1107, 6893)),
    # v1 configuration
    ("Gender", 10000, 5000, 5000, 5000, 10.0, (3799, 1201, 1201, 3799)),
    ("PT", 10000, 5000, 4000, 6000, 6.0, (3000, 2000, 1000, 4000)),
    ("PTT", 10000, 5000, 3000, 7000, 10.0, (2535, 2465, 465, 4535)),
    # fixed-rate configuration (low + high = n - 1 after flooring)
    ("PT", 11290, 1117, 3127, 8162, 5.5, (706, 411, 2421, 7751)),
    ("PTT", 11290, 1162, 891, 10398, 8.8, (374, 788, 517, 9610)),
    ("Platelets", 11290, 1016, 383, 10906, 4.8, (116, 900, 267, 10006)),
]


def test_expected_cells_goldens(spark):
    rows = [(i, f, n, d, n - d, lo, hi, o) for i, (f, n, d, lo, hi, o, _) in enumerate(CELL_GOLDENS)]
    cfg = spark.createDataFrame(rows, "i int, feature string, n long, dead long, alive long, low long, high long, "
                                      "odds_ratio double")
    got = {r["i"]: (r["dead_low"], r["dead_high"], r["alive_low"], r["alive_high"])
           for r in expected_cells(cfg).collect()}
    for i, g in enumerate(CELL_GOLDENS):
        assert got[i] == g[-1], (g, got[i])


def test_marginals_ceil_float_artefact(spark):
    # 10000 * 0.28 is 2800.0000000000005 in doubles, so ceil gives 2801.
    cfg = spark.createDataFrame([(10000, 0.2, 0.28)], "n long, dead_rate double, low_rate double")
    r = marginals(cfg, "ceil").first()
    assert (r["dead"], r["alive"], r["low"], r["high"]) == (2000, 8000, 2801, 7199)
    r = marginals(cfg.withColumn("high_rate", F.lit(0.72)), "floor").first()
    assert (r["low"], r["high"]) == (2800, 7200)


def test_expected_cells_or_one_and_complex(spark):
    cfg = spark.createDataFrame([(1, 100, 20, 80, 30, 70, 1.0), (2, 100, 50, 50, 1, 99, 0.0001)],
                                "i int, n long, dead long, alive long, low long, high long, odds_ratio double")
    got = {r["i"]: r for r in expected_cells(cfg).collect()}
    assert got[1]["dead_low"] == 6  # ceil(30 * 20 / 100)
    assert got[2]["dead_low"] is not None  # a real root exists; clamped into range
    assert 0 <= got[2]["dead_low"] <= 1


def test_expected_cells_without_a_solution(spark):
    rows = [(1, 100, 20, 80, 30, 70, None, "no odds ratio"), (2, 100, 20, 80, 50, 50, -1.0, "negative odds ratio"),
            (3, 100, 20, 80, None, 70, 2.0, "missing marginal"), (4, 100, 90, 10, 5, 20, 2.0, "infeasible marginals"),
            # The discriminant is negative only where more rows are dead than there are.
            (5, 30, 50, -20, 50, 50, 2.0, "complex roots")]
    cfg = spark.createDataFrame([r[:-1] for r in rows], "i int, n long, dead long, alive long, low long, high long, odds_ratio double")
    assert (50 + 20 - 2 * 50 - 2 * 50) ** 2 - 4 * 1 * 2 * 50 * 50 < 0
    for r in expected_cells(cfg).collect():
        assert r["reason"] == rows[r["i"] - 1][-1]
        assert r["dead_low"] is r["dead_high"] is r["alive_low"] is r["alive_high"] is r["realised_or"] is None


def test_threshold_scan_golden(spark):
    """Blocks of 1,000 with death rates .1 ... .99: the odds ratios are exact whatever the seed."""
    skel = spark.range(1, 10001).select(F.col("id"), F.col("id").alias("index"))
    scan = threshold_odds_scan(blocked_outcomes(skel, "index", 1000), "index", "DOA", 1000)
    got = [(r["threshold"], r["alive_below"], r["dead_above"], r["dead_below"], r["alive_above"], r["odds_ratio"])
           for r in scan.orderBy("threshold").collect()]
    assert got == [
        (1000, 900, 5390, 100, 3610, 13.44), (2000, 1700, 5190, 300, 2810, 10.47),
        (3000, 2400, 4890, 600, 2110, 9.27), (4000, 3000, 4490, 1000, 1510, 8.92),
        (5000, 3500, 3990, 1500, 1010, 9.22), (6000, 3900, 3390, 2100, 610, 10.32),
        (7000, 4200, 2690, 2800, 310, 13.02), (8000, 4400, 1890, 3600, 110, 21.0),
        (9000, 4500, 990, 4500, 10, 99.0)]


def test_cohort_adapter_goldens(spark):
    import __spark_entry__ as E
    got = {r["feature"]: r for r in E.queries()["odds_ratios"](spark, SF01).collect()}
    want = {
        "Gender": (10009, 10037, 19927, 20027, 1.002215),
        "PT": (5001, 15045, 9972, 29982, 0.999408),
        "PTT": (3779, 16267, 7580, 32374, 0.992194),
        "Platelets": (5611, 14435, 11168, 28786, 1.001912),
        "HF": (4058, 15988, 7972, 31982, 1.018254),
    }
    for f, w in want.items():
        r = got[f]
        assert (r["dead_low"], r["dead_high"], r["alive_low"], r["alive_high"]) == w[:4]
        assert r["odds_ratio"] == pytest.approx(w[4], abs=1e-6)


def test_rows_per_dataset(spark):
    from cohortlens.sources.testdata import cohort
    got = {r["dataset_id"]: r["count"] for r in cohort(spark, SF01).groupBy("dataset_id").count().collect()}
    assert got == {1: 8590, 2: 8583, 3: 8489, 4: 8456, 5: 8622, 6: 8662, 7: 8598}
