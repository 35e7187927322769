"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as E
from tests.conftest import SF001, SF01
from tools.check_oracles import TABLES, digest

ORACLES = E.oracle_sql()


#: Folds of 10,000 rows need more than the smallest tables have.
LARGER = {"evaluate_folds_forest", "fold_cells"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    def connect(sf_dir):
        con = duckdb.connect()
        for t in TABLES:
            p = f"{sf_dir}/{t}.parquet"
            if os.path.exists(p):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
        return con
    return connect


def test_every_query_registered_with_callable():
    qs = E.queries()
    assert "odds_ratios" in qs
    assert set(ORACLES) <= set(qs)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["feature", "dead_low", "dead_high", "alive_low", "alive_high", "odds_ratio"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sf_dir = SF01 if name in LARGER else SF001
    df = E.queries()[name](spark, sf_dir)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck(sf_dir).execute(ORACLES[name])
    o_cols, o_rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert len(s_rows) == len(o_rows) > 0
    assert digest(s_cols, s_rows)[0] == digest(o_cols, o_rows)[0]


def test_whole_job_checks_leave_no_fold_or_pair_out(spark):
    pairs = {tuple(r) for r in E.queries()["match_sampled_all"](spark, SF001).select("ds_a", "ds_b").collect()}
    assert pairs == {(a, b) for a in range(1, 8) for b in range(a + 1, 8)}
    near = E.queries()["pairwise_similarity_nearest_all"](spark, SF001)
    assert {tuple(r) for r in near.select("File1", "File2").collect()} == pairs
    rows = spark.read.parquet(f"{SF01}/lineitem.parquet").count()
    folds = [r.num for r in E.queries()["fold_evaluation_all"](spark, SF01).select("num").collect()]
    assert sorted(folds) == list(range(rows // 2500)) and len(folds) > 6
