"""Trees on weighted cells: tasks against jobs, MLlib and SQL over the written split table."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import models, trees
from cohortlens.sources.testdata import MODEL_FEATURES
from tests.conftest import SF001


def toy_cells(spark, folds=2, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f, int(a), int(b), int(c), int(rng.poisson(9 + 4 * a)), int(rng.poisson(3 + 5 * (b > 1) + 6 * c * (a > 3))), int(rng.integers(3)), int(rng.integers(3)))
            for f in range(folds) for a in range(7) for b in range(4) for c in range(2)]
    return spark.createDataFrame(rows, "fold int, b0 int, b1 int, b2 int, n0 long, n1 long, t0 long, t1 long")


def as_rows(df):
    return sorted(map(tuple, df.collect()))


def test_trees_in_tasks_equal_trees_by_jobs(spark):
    cells = toy_cells(spark)
    order = ["fold", "tree", "node", "feature", "bin", "l0", "l1", "r0", "r1", "gain"]
    one = trees.grow_forest(cells, 3, 6, 5).select(order)
    many = trees.grow_forest(cells, 3, 6, 5, task_cells=0).select(order)
    key = lambda r: (r[0], r[1], r[2])
    a, b = sorted(map(tuple, one.collect()), key=key), sorted(map(tuple, many.collect()), key=key)
    assert [r[:-1] for r in a] == [r[:-1] for r in b] and np.allclose([r[-1] for r in a], [r[-1] for r in b])
    assert len({r[2] for r in a}) > 8
    cols = ["fold", "b0", "b1", "b2", "votes", "prediction"]
    votes = as_rows(trees.forest_votes(one, cells, 3, 5).select(cols))
    assert votes == as_rows(trees.forest_votes(one, cells, 3, 5, task_cells=0).select(cols))
    assert len({v[-1] for v in votes}) == 2


def test_small_folds_grow_and_vote_together(spark, monkeypatch):
    """Folds share a task where there are many; their trees and votes are those that jobs over all cells give."""
    cells = toy_cells(spark, 9).where("NOT (fold = 4 AND b0 > 0)")
    monkeypatch.setattr(trees, "TREE_GROUPS", 2)
    group, tasks = trees._group_of(*trees.fold_sizes(cells))
    assert trees.fold_sizes(cells) == (56, 9) and tasks == 2 and cells.select(group).distinct().count() == 3
    order = ["fold", "tree", "node", "feature", "bin", "l0", "l1", "r0", "r1"]
    one, many = (trees.grow_forest(cells, 3, 4, 4, task_cells=n) for n in (trees.TASK_CELLS, 0))
    key = lambda r: r[:3]
    assert sorted(map(tuple, one.select(order).collect()), key=key) == sorted(map(tuple, many.select(order).collect()), key=key)
    cols = ["fold", "b0", "b1", "b2", "votes", "prediction"]
    votes = as_rows(trees.forest_votes(one, cells, 3, 4).select(cols))
    assert votes == as_rows(trees.forest_votes(one, cells, 3, 4, task_cells=0).select(cols)) and len(votes) == 8 * 56 + 8


def test_folds_are_a_table_and_their_cells_are_made_in_tasks(spark):
    """No list of the folds is part of a plan, and no single task makes the cells of all folds."""
    cells = spark.range(40 * 6).selectExpr("id div 6 AS block", "cast(id % 3 AS int) AS b0", "cast(id % 2 AS int) AS b1", "id % 5 AS n0", "id % 4 AS n1").where("id % 7 > 0")
    for n in (5, 30):
        folds = models.stored(spark.range(n).selectExpr("cast(id AS int) AS fold", "true AS flip"), "folds")
        each = trees.leave_one_out(cells, 2, "block", folds)
        plan = each._jdf.queryExecution().analyzed().toString()
        assert "Repartition" in plan and "array(" not in plan and "IN (" not in plan
        rows = each.collect()
        counts = {(r.block, r.b0, r.b1): (r.n0, r.n1) for r in cells.collect()}
        total = lambda b0, b1, i: sum(v[i] for k, v in counts.items() if k[1:] == (b0, b1))
        assert each.columns == ["fold", "flip", "b0", "b1", "n0", "n1", "t0", "t1"] and len(rows) == n * 6
        for r in rows:
            own = counts.get((r.fold, r.b0, r.b1), (0, 0))
            assert (r.t0, r.t1, r.n0 + r.t0, r.n1 + r.t1) == (*own, total(r.b0, r.b1, 0), total(r.b0, r.b1, 1))


def test_splits_are_consistent_and_scored_by_sql(spark, tmp_path):
    """The written table alone gives the predictions and importances, in another engine."""
    import duckdb

    cells, depth, n_trees = toy_cells(spark, 1), 4, 5
    splits = trees.grow_forest(cells, 3, n_trees, depth)
    splits.write.parquet(str(tmp_path / "splits"))
    cells.write.parquet(str(tmp_path / "cells"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW s AS SELECT * FROM read_parquet('{tmp_path}/splits/*.parquet')")
    con.execute(f"CREATE VIEW c AS SELECT * FROM read_parquet('{tmp_path}/cells/*.parquet')")
    assert con.execute("SELECT count(*) FROM s p JOIN s q ON p.tree = q.tree AND q.node IN (2 * p.node, 2 * p.node + 1) WHERE p.node > 0 AND "
                       "(q.l0 + q.r0, q.l1 + q.r1) IS DISTINCT FROM (CASE WHEN q.node % 2 = 0 THEN p.l0 ELSE p.r0 END, CASE WHEN q.node % 2 = 0 THEN p.l1 ELSE p.r1 END)").fetchone()[0] == 0
    votes = con.execute(f"""
        WITH RECURSIVE w AS (SELECT b0, b1, b2, tree, 1 AS node, r1 * 1000000 // (r0 + r1) AS p FROM c, s WHERE s.node = 0
          UNION ALL SELECT b0, b1, b2, w.tree, 2 * w.node + CAST(v > bin AS INTEGER), CASE WHEN v > bin THEN r1 * 1000000 // (r0 + r1) ELSE l1 * 1000000 // (l0 + l1) END
          FROM (SELECT w.*, s.bin, s.l0, s.l1, s.r0, s.r1, [b0, b1, b2][s.feature + 1] AS v FROM w JOIN s ON s.tree = w.tree AND s.node = w.node) w)
        SELECT b0, b1, b2, sum(p) FROM (SELECT b0, b1, b2, tree, arg_max(p, node) AS p FROM w GROUP BY ALL) GROUP BY ALL""").fetchall()
    assert sorted((*r[:3], int(r[3])) for r in votes) == as_rows(trees.forest_votes(splits, cells, 3, depth).select("b0", "b1", "b2", "votes"))
    shares = dict(con.execute("SELECT feature, sum(g / whole) FROM (SELECT tree, feature, sum(gain) AS g, sum(sum(gain)) OVER (PARTITION BY tree) AS whole FROM s WHERE node > 0 "
                              "GROUP BY tree, feature) GROUP BY feature").fetchall())
    got = {r.feature: r.importance for r in trees.forest_importances(splits, ["x", "y", "z"]).collect()}
    total = sum(shares.values())
    assert {"xyz".index(k): pytest.approx(v) for k, v in got.items()} == {i: shares.get(i, 0.0) / total for i in range(3)}


def test_boosted_trees_equal_mllib(spark):
    cells = toy_cells(spark)
    params = dict(maxIter=8, maxDepth=3, seed=5043)
    mine = as_rows(models._boosted_predictions(cells, 3, params, [0, 1], 2).select("fold", "b0", "b1", "b2", "prediction"))
    theirs = as_rows(models._boosted_predictions(cells, 3, params, [0, 1], 2, task_cells=0).select("fold", "b0", "b1", "b2", "prediction"))
    assert mine == theirs and {r[-1] for r in mine} == {0.0, 1.0}


def test_small_folds_are_boosted_together(spark, monkeypatch):
    """Folds share a task where there are many; each has the predictions that it has alone, however its cells arrive."""
    cells = toy_cells(spark, 9).where("NOT (fold = 4 AND b0 > 0)")
    params = dict(maxIter=6, maxDepth=4, seed=5043)
    cols = ["fold", "b0", "b1", "b2", "n0", "n1", "t0", "t1", "prediction"]
    alone = [r for i in range(9) for r in as_rows(models._boosted_predictions(cells.where(F.col("fold") == i), 3, params, [i], 1).select(cols))]
    monkeypatch.setattr(trees, "TREE_GROUPS", 2)
    group = trees._group_of(*trees.fold_sizes(cells))[0]
    together = models._boosted_predictions(cells.orderBy(F.desc("b1"), "fold"), 3, params, list(range(9)), 1)
    assert cells.select(group).distinct().count() == 3 and as_rows(together.select(cols)) == sorted(alone) and together.columns == [*cells.columns, "prediction"]


def test_boosted_margins_of_several_models_are_those_of_each(spark):
    from cohortlens.operators.tree_growth import boosted_margins

    rng = np.random.default_rng(5)
    parts = [(rng.integers(0, [9, 2, 2], (size, 3)), rng.poisson(4, size) * 1.0, rng.poisson(2, size) * 1.0) for size in (60, 1, 35)]
    parts.append((parts[0][0], np.zeros(60), np.zeros(60)))
    whole = boosted_margins(*(np.concatenate(x) for x in zip(*parts)), 7, 5, 0.1, np.repeat(np.arange(4), [60, 1, 35, 60]))
    each = [boosted_margins(*p, 7, 5, 0.1, np.zeros(len(p[0]), int)) for p in parts]
    assert whole.tolist() == np.concatenate(each).tolist() and (whole[-60:] == 0).all() and len(set(whole.tolist())) > 20


def test_poisson_draws(spark):
    for n in (1, 5, 16, 200):
        draws = [r[0] for r in spark.range(20_000).select(trees.poisson_draw(F.lit(n).cast("long"), F.md5(F.concat_ws(":", "id", F.lit(n))))).collect()]
        assert abs(np.mean(draws) - n) < 5 * math.sqrt(n / 20_000) and abs(np.var(draws) - n) < 0.06 * n
        if n == 1:
            share = Counter(draws)[0] / 20_000
            assert abs(share - math.exp(-1)) < 0.02
    assert spark.range(1).select(trees.poisson_draw(F.lit(0).cast("long"), F.md5(F.lit("x")))).first()[0] == 0


def test_draws_in_tasks_equal_draws_of_spark(spark):
    """A fold's trees draw in the task that grows them; the rows of a cell and tree are not made before."""
    counts = [0, 1, 2, 15, 16, 17, 40, 5000] * 50
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "id int, n long")
    drawn = rows.select("id", trees.poisson_draw(F.col("n"), F.md5(F.concat(F.concat_ws(":", "id", F.lit(3)), F.lit(":0:7")))).alias("w"))
    want = [r.w for r in drawn.orderBy("id").collect()]
    assert trees.poisson_draws(np.array(counts), [f"{i}:3".encode() for i in range(len(counts))], b":0:7").tolist() == want


def test_bins_of_few_and_many_values_and_nulls(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.lit(None).cast("double").alias("z"))
    ends = trees.feature_thresholds(df, ["x", "y", "z"], 8)
    assert len(ends[0]) == 7 and ends[1] == [0.0, 1.0] and ends[2] == []
    binned = trees.binned(df, ["x", "y", "z"], ends)
    assert sorted(r["count"] for r in binned.groupBy("b0").count().collect()) == [125] * 8
    assert {tuple(r) for r in binned.select("y", "b1", "b2").distinct().collect()} == {(0.0, 0, 0), (1.0, 1, 0), (2.0, 2, 0)}


def test_fold_cells_are_all_rows_less_the_fold(spark):
    from cohortlens.plans.catalog import _blocked

    blocked = _blocked(spark, SF001, 1500).cache()
    cells, folds = models.fold_training_cells(blocked, MODEL_FEATURES)
    n = blocked.count()
    got = {r.fold: (r.train, r.test) for r in cells.groupBy("fold").agg(F.sum(F.expr("n0 + n1")).alias("train"), F.sum(F.expr("t0 + t1")).alias("test")).collect()}
    assert folds == list(range(n // 1500)) and got == {f: (n - 1500, 1500) for f in folds}
    assert cells.groupBy("fold").agg(F.min(F.lit(0)).alias("z"), (F.sum("n0") >= F.sum("n1")).alias("more")).where("not more").count() == 0
    one_block = blocked.where("block = 0").withColumn("is_tail", F.lit(False))
    assert models.evaluate_folds(one_block, MODEL_FEATURES).count() == 0
    on_train = models.evaluate_folds(blocked, MODEL_FEATURES, params=dict(numTrees=2, maxDepth=2, seed=1), evaluate_on="train")
    assert {r.n for r in on_train.collect()} == {n - 1500}


def test_forest_learns_and_every_row_is_predicted_once(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("noise"))
    rows = rows.withColumn("y", ((F.col("x") > 20) & (F.col("x") < 40)).cast("int"))
    for kind in ("forest", "gbt"):
        pred = models.cross_val_predictions(rows, ["x", "noise"], "y", "fold", kind, dict(maxDepth=4, seed=1))
        got = pred.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("acc")).first()
        assert got.n == got.ids == 3000 and got.acc > 0.99
    with pytest.raises(ValueError):
        models.evaluate_folds(rows.withColumn("block", F.col("fold")).withColumn("is_tail", F.lit(False)).withColumn("y", F.col("noise")), ["x"], "y")
