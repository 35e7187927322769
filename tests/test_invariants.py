"""Invariants of the distributed operators, cross-checked on small fixtures."""

import itertools

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators.ranking import global_index, group_index, running_total
from tests.conftest import SF01


def test_global_index_equals_single_task_row_number(spark):
    from cohortlens.sources.testdata import COHORT_ORDER
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").select(*COHORT_ORDER)
    g = global_index(li, COHORT_ORDER, "gi")
    r = li.withColumn("rn", F.row_number().over(Window.orderBy(*COHORT_ORDER)))
    j = g.join(r, COHORT_ORDER)
    assert j.count() == 60000
    assert j.where("gi != rn").count() == 0


def test_global_index_hot_leading_key(spark):
    # A third of the rows share the leading key: numbering stays dense and ordered.
    df = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
                                      F.col("id").alias("t"))
    g = global_index(df, ["k", "t"], "i", num_partitions=6).toPandas().sort_values("i")
    assert list(g["i"]) == list(range(1, 30001))
    assert list(zip(g["k"], g["t"])) == sorted(zip(g["k"], g["t"]))


def test_group_index_dense_per_group_with_nulls(spark):
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("g"),
        (F.col("id") * 7919 % 5003).alias("o"))
    pdf = group_index(df, ["g"], ["o"], "r", num_partitions=5).toPandas()
    for _, grp in pdf.groupby(pdf["g"].fillna(-1)):
        grp = grp.sort_values("o")
        assert list(grp["r"]) == list(range(1, len(grp) + 1))


def test_running_total_matches_cumsum(spark):
    df = spark.range(1, 5001).select(F.col("id").alias("b"), (F.col("id") % 7).alias("v"))
    pdf = running_total(df, "b", ["v"], fanout=64).toPandas().sort_values("b")
    assert list(pdf["v_cum"]) == list(pdf["v"].cumsum())


def test_synthesis_round_trip_hits_expected_cells(spark):
    import __spark_entry__ as E
    from cohortlens.operators.odds import contingency
    from cohortlens.plans.catalog import _expected
    from cohortlens.sources.testdata import FEATURES_WITH_HF, cohort
    syn = E.queries()["synthesize_cohorts"](spark, SF01)
    cells = {(r["dataset_id"], r["feature"]): (r["dead_low"], r["dead_high"], r["alive_low"], r["alive_high"])
             for r in contingency(syn, FEATURES_WITH_HF, "DOA", ["dataset_id"]).collect()}
    want = {(r["dataset_id"], r["feature"]): (r["dead_low"], r["dead_high"], r["alive_low"], r["alive_high"])
            for r in _expected(cohort(spark, SF01)).collect()}
    assert cells == want


def test_rank_aligned_is_one_to_one(spark):
    from cohortlens.operators.similarity import rank_aligned_matches
    from cohortlens.plans.catalog import _sim_cohort
    c = _sim_cohort(spark, SF01)
    m = rank_aligned_matches(c)
    sizes = {r["dataset_id"]: r["count"] for r in c.groupBy("dataset_id").count().collect()}
    per = m.groupBy("ds_a", "ds_b").agg(F.count("*").alias("n"), F.countDistinct("l_id").alias("nl"),
                                        F.countDistinct("r_id").alias("nr"), F.min("distance").alias("lo"),
                                        F.max("distance").alias("hi")).collect()
    assert len(per) == 21
    for r in per:
        assert r["n"] == r["nl"] == r["nr"] == min(sizes[r["ds_a"]], sizes[r["ds_b"]])
        assert 0.0 <= r["lo"] <= r["hi"] <= 1.0


def test_nearest_neighbor_brute_force_small(spark):
    from cohortlens.operators.similarity import nearest_neighbor
    rows = []
    for ds, n in [(1, 40), (2, 35), (3, 30)]:
        for i in range(n):
            bits = [(i * (ds + 3) >> b) & 1 for b in range(5)]
            rows.append((ds, ds * 1000 + i, float((i * 13 + ds * 5) % 23), *map(float, bits)))
    df = spark.createDataFrame(rows, "dataset_id int, id long, Age double, Gender double, PT double, PTT double, "
                                     "Platelets double, DOA double")
    got = {(r["ds_a"], r["ds_b"]): r for r in nearest_neighbor(df).collect()}
    for a, b in itertools.combinations([1, 2, 3], 2):
        la = [r for r in rows if r[0] == a]
        lb = [r for r in rows if r[0] == b]
        lo = min(r[2] for r in la + lb)
        hi = max(r[2] for r in la + lb)
        norm = lambda v: (v - lo) / (hi - lo)
        ds = [min((sum(abs(x[k] - y[k]) for k in range(3, 8)) + abs(norm(x[2]) - norm(y[2]))) / 6.0 for y in lb)
              for x in la]
        assert got[(a, b)]["n_matched"] == len(la)
        assert got[(a, b)]["avg_distance"] == pytest.approx(sum(ds) / len(ds), abs=1e-6)
        assert got[(a, b)]["max_distance"] == pytest.approx(max(ds), abs=1e-6)


def test_pearson_matches_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    from cohortlens.operators.stats import corr_matrix
    from cohortlens.plans.catalog import _full_blocks
    from cohortlens.sources.testdata import CORR_COLUMNS
    blocks = _full_blocks(spark, SF01)
    ours = {(r["feature_a"], r["feature_b"]): r["value"]
            for r in corr_matrix(blocks.where("block = 2"), CORR_COLUMNS, ["block"], "pearson", None).collect()}
    for method in ["pearson"]:
        vec = VectorAssembler(inputCols=CORR_COLUMNS, outputCol="f").transform(blocks.where("block = 2"))
        m = Correlation.corr(vec, "f", method).head()[0].toArray()
        for i, a in enumerate(CORR_COLUMNS):
            for j, b in enumerate(CORR_COLUMNS):
                assert ours[(a, b)] == pytest.approx(m[i][j], abs=1e-9)


def test_spearman_matches_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    from cohortlens.operators.stats import corr_matrix
    from cohortlens.plans.catalog import _full_blocks
    from cohortlens.sources.testdata import CORR_COLUMNS
    blk = _full_blocks(spark, SF01).where("block = 4")
    ours = {(r["feature_a"], r["feature_b"]): r["value"]
            for r in corr_matrix(blk, CORR_COLUMNS, ["block"], "spearman", None).collect()}
    vec = VectorAssembler(inputCols=CORR_COLUMNS, outputCol="f").transform(blk)
    m = Correlation.corr(vec, "f", "spearman").head()[0].toArray()
    for i, a in enumerate(CORR_COLUMNS):
        for j, b in enumerate(CORR_COLUMNS):
            assert ours[(a, b)] == pytest.approx(m[i][j], abs=1e-9)


def test_exact_sample_sizes_and_determinism(spark):
    from cohortlens.operators.sampling import exact_sample
    df = spark.range(0, 3000).select(F.col("id"), (F.col("id") % 4).alias("s"))
    a = exact_sample(df, 100, "id", ["s"], seed=3)
    sizes = {r["s"]: r["count"] for r in a.groupBy("s").count().collect()}
    assert sizes == {0: 100, 1: 100, 2: 100, 3: 100}
    b = exact_sample(df.repartition(7), 100, "id", ["s"], seed=3)
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())


def test_rebalance_draws_with_replacement(spark):
    import math
    from collections import Counter

    from cohortlens.operators.sampling import rebalance
    df = spark.range(0, 20000).select("id", (F.col("id") % 2 != 0).cast("double").alias("DOA"))
    for ratio in (0.3, 1.5):
        got = rebalance(df, "DOA", ratio, 1, "id")
        assert got.where("DOA = 0").count() == 10000
        times = Counter(r["id"] for r in got.where("DOA = 1").collect())
        # Poisson counts: mean, and the share of rows drawn more than once.
        assert sum(times.values()) / 10000 == pytest.approx(ratio, rel=0.06)
        many = 1 - math.exp(-ratio) * (1 + ratio)
        assert sum(n > 1 for n in times.values()) / 10000 == pytest.approx(many, rel=0.2)


def test_quota_cuts_equal_ranks(spark):
    from cohortlens.operators.synthesis import assign_outcome, quota_assign
    from cohortlens.functions.hashing import hash_order
    df = spark.range(0, 4000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.lit(2)).alias("s"), "id")
    quotas = spark.createDataFrame([(1, 0), (2, 10 ** 9)], "s int, dead long")
    got = {r["s"]: (r["d"], r["n"]) for r in assign_outcome(df, quotas, ["s"]).groupBy("s").agg(
        F.count_if(F.col("DOA") == 0).alias("d"), F.count("*").alias("n")).collect()}
    assert got == {1: (0, 1334), 2: (2666, 2666)}
    quotas = spark.createDataFrame([(1, 7), (2, 100)], "s int, dead long")
    dead = {r["id"] for r in assign_outcome(df, quotas, ["s"], seed=5).where("DOA = 0").collect()}
    w = Window.partitionBy("s").orderBy(hash_order("id", 5), "id")
    ranked = df.withColumn("r", F.row_number().over(w)).join(quotas, "s").where("r <= dead")
    assert dead == {r["id"] for r in ranked.collect()}
    cells = spark.createDataFrame([(1, "f", 2, 3, 10, 20), (2, "f", None, None, None, None)],
                                  "s int, feature string, dead_low long, dead_high long, alive_low long, alive_high long")
    out = quota_assign(assign_outcome(df, quotas, ["s"], seed=5), cells, ["f"], ["s"])
    got = {(r["s"], r["DOA"], r["f"]): r["count"] for r in out.groupBy("s", "DOA", "f").count().collect()}
    assert got == {(1, 0.0, 0.0): 2, (1, 0.0, 1.0): 3, (1, 0.0, None): 2, (1, 1.0, 0.0): 10, (1, 1.0, 1.0): 20,
                   (1, 1.0, None): 1297, (2, 0.0, None): 100, (2, 1.0, None): 2566}


def test_spearman_on_counts_with_gaps_and_without_blocks(spark):
    from cohortlens.operators.ranking import average_rank
    from cohortlens.operators.stats import corr_matrix
    df = spark.range(0, 3000).selectExpr("cast(if(id % 3 = 0, null, id % 2) as int) as g", "if(id % 11 = 0, null, cast(pmod(hash(id), 40) as double)) as a",
                                         "pmod(hash(id, 1), 7) as b", "1.0D as constant", "if(id % 5 = 0, 'NaN', cast(id as double) / 7) as c")
    df = df.withColumn("c", F.col("c").cast("double"))
    cols, varied = ["a", "b", "constant", "c"], ["a", "b", "c"]
    for by, most in ((["g"], 10_000), (["g"], 0), ([], 0)):
        got = {(r[0] if by else None, r.feature_a, r.feature_b): r.value for r in corr_matrix(df, cols, by, "spearman", None, most).collect()}
        ranked = average_rank(df.withColumn("p", F.lit(1)), cols, by or ["p"])
        means = ranked.groupBy(*by).agg(*[F.corr(f"{a}_rank", f"{b}_rank").alias(f"{a}.{b}") for a in varied for b in varied])
        for r in means.collect():
            for a in cols:
                for b in cols:
                    value = got[r[0] if by else None, a, b]
                    want = 1.0 if a == b else None if "constant" in (a, b) else pytest.approx(r[f"{a}.{b}"], abs=1e-9)
                    assert value == want, (a, b)
    assert corr_matrix(df.limit(0), cols, ["g"], "spearman").count() == 0


def test_index_is_kept_and_read_by_columns(spark):
    df = spark.range(0, 20_000).selectExpr("pmod(hash(id), 1000) as k", "id as t", "cast(id as string) as wide")
    g = global_index(df, ["k", "t"], "i", num_partitions=7)
    assert sum("/sorted-" in f for f in g.inputFiles()) == 7
    want = df.toPandas().sort_values(["k", "t"])["t"].tolist()
    for n in ("8k", "1m"):  # however the files are split over tasks
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        try:
            got = g.orderBy("i").toPandas()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got["t"].tolist() == want and got["i"].tolist() == list(range(1, 20_001))
    plan = g.select("i", "t")._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan and "Sort" not in plan


def test_cohort_index_is_sorted_once_a_table(spark, tmp_path):
    import time

    from cohortlens.session import drop_scratch
    from cohortlens.sources.testdata import cohort, load_table
    rows = load_table(spark, "/root/testdata/sf0.001", "lineitem")
    rows.limit(100).write.parquet(f"{tmp_path}/lineitem.parquet")
    once = cohort(spark, str(tmp_path), with_index=True)
    again = cohort(spark, f"{tmp_path}/", with_index=True)
    assert sorted(once.inputFiles()) == sorted(again.inputFiles())
    time.sleep(0.01)
    rows.limit(150).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert cohort(spark, str(tmp_path), with_index=True).count() == 150  # a table written anew is sorted anew
    drop_scratch(spark)
    after = cohort(spark, str(tmp_path), with_index=True)
    assert [r.id for r in after.orderBy("id").collect()] == list(range(1, 151))


def test_average_rank_without_partitions(spark):
    from cohortlens.operators.ranking import average_rank
    df = spark.range(0, 500).select("id", F.when(F.col("id") % 9 != 0, F.col("id") % 7).alias("v"))
    got = {r["id"]: r["v_rank"] for r in average_rank(df, ["v"]).collect()}
    want = average_rank(df.withColumn("p", F.lit(1)), ["v"], ["p"])
    assert got == {r["id"]: r["v_rank"] for r in want.collect()}


def test_read_cohorts_arity_and_junk(spark, tmp_path):
    from cohortlens.sources.csv import read_cohorts
    d = tmp_path / "train"
    d.mkdir()
    (d / "a.csv").write_text("1.000000000000000000e+00,3.6e+01,1,0,1,1,junk\n2,40,0,0,0,1,1\n")
    df = read_cohorts(spark, str(d))
    rows = df.orderBy("id").collect()
    assert rows[0]["Age"] == 36.0 and rows[0]["DOA"] is None
    assert rows[1]["Platelets"] == 1.0
    assert rows[0]["dataset_id"].endswith("a.csv")
    (d / "b.csv").write_text("1,2,3,4,5,6,7,8\n")
    with pytest.raises(Exception):
        read_cohorts(spark, str(d)).collect()


def test_rename_positional_wrong_arity(spark):
    from cohortlens.functions.columns import rename_positional
    with pytest.raises(ValueError):
        rename_positional(spark.range(3), ["a", "b"])


def _toy_cohort(spark, sizes):
    rows = []
    for ds, n in sizes:
        for i in range(n):
            bits = [(i * (ds + 3) >> b) & 1 for b in range(5)]
            rows.append((ds, ds * 1000 + i, float((i * 13 + ds * 5) % 23), *map(float, bits)))
    return spark.createDataFrame(rows, "dataset_id int, id long, Age double, Gender double, PT double, PTT double, "
                                       "Platelets double, DOA double")


def test_match_sampled_one_to_one(spark):
    from cohortlens.operators.matching import match_sampled
    from cohortlens.operators.similarity import nearest_neighbor
    df = _toy_cohort(spark, [(1, 40), (2, 35), (3, 30)])
    got = {(r["ds_a"], r["ds_b"]): r for r in match_sampled(df, m=3).collect()}
    nn = {(r["ds_a"], r["ds_b"]): r for r in nearest_neighbor(df).collect()}
    sizes = {1: 40, 2: 35, 3: 30}
    for (a, b), r in got.items():
        assert r["n_matched"] == min(sizes[a], sizes[b])
        assert r["n_unmatched"] == sizes[a] - r["n_matched"]
        # one-to-one matching can never beat nearest neighbour with replacement on average
        assert r["min_distance"] >= nn[(a, b)]["min_distance"] - 1e-9


def _greedy_by_rows(la, lb):
    """Sorted-edge greedy over rows: edges by distance, then left pattern and value, then right."""
    lo = min(r[2] for r in la + lb)
    hi = max(r[2] for r in la + lb)
    norm = lambda r: (r[2] - lo) / (hi - lo)
    pat = lambda r: sum(int(r[k]) << (7 - k) for k in range(3, 8))
    edges = sorted(((bin(pat(x) ^ pat(y)).count("1") + abs(norm(x) - norm(y))) / 6.0, pat(x), norm(x), pat(y), norm(y), i, j)
                   for i, x in enumerate(la) for j, y in enumerate(lb))
    used_l, used_r, out = set(), set(), []
    for d, *_, i, j in edges:
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            out.append(d)
    return out


@pytest.mark.parametrize("task_edges", [4_000_000, 0])
def test_match_exact_against_brute_force(spark, task_edges):
    """Down the sorted edges in one task, and in mutual-best rounds: both are the greedy matching."""
    from cohortlens.operators.matching import match_exact
    sizes = [(1, 25), (2, 20), (3, 14)]
    df = _toy_cohort(spark, sizes)
    rows = [tuple(r) for r in df.collect()]
    got = {(r["ds_a"], r["ds_b"]): r for r in match_exact(df, max_task_edges=task_edges).collect()}
    for a, b in itertools.combinations([1, 2, 3], 2):
        want = _greedy_by_rows([r for r in rows if r[0] == a], [r for r in rows if r[0] == b])
        r = got[(a, b)]
        assert r["n_matched"] == len(want) and r["n_unmatched"] == dict(sizes)[a] - len(want)
        assert r["distance_sum"] == pytest.approx(sum(want), abs=1e-6)
        assert r["max_distance"] == pytest.approx(max(want), abs=1e-6)


def test_missing_values_in_every_method(spark):
    from cohortlens.operators.pairwise import METHODS
    df = _toy_cohort(spark, [(1, 12), (2, 10)])
    gaps = (df.withColumn("PT", F.when(F.col("id") != 2003, F.col("PT"))).withColumn("Age", F.when(~F.col("id").isin(1001, 1002), F.col("Age"))))
    whole = df.where(~F.col("id").isin(2003, 1001, 1002))
    for name, fn in METHODS.items():
        a, b = fn(gaps).first().asDict(), fn(whole).first().asDict()
        assert a.pop("n_incomplete") == 3 and b.pop("n_incomplete") == 0, name
        if name != "sampled":
            assert a == b, name
        assert a["n_matched"] == (10 if name == "nearest" else 9) and a["avg_distance"] is not None
    empty = df.where("dataset_id = 1")
    assert all(fn(empty).count() == 0 for fn in METHODS.values())


def test_distance_summary_leaves_nulls_out(spark):
    from cohortlens.operators.similarity import distance_summary
    df = spark.createDataFrame([(1, 2, 0.2), (1, 2, None), (1, 2, 0.4), (1, 2, 0.0)], "ds_a int, ds_b int, distance double")
    r = distance_summary(df).first()
    assert (r["n_matched"], r["n_null"], r["avg_distance"], r["n_nonzero"]) == (3, 1, 0.2, 2)


def test_minmax_and_pattern(spark):
    from cohortlens.functions.columns import minmax_scale
    from cohortlens.operators.similarity import collapse_cells
    c = lambda v: F.lit(v).cast("double")
    r = spark.range(1).select(minmax_scale(c(None), c(1), c(9)), minmax_scale(c(3), c(3), c(3)), minmax_scale(c(5), c(1), c(9))).first()
    assert tuple(r) == (None, 0.0, 0.5)
    df = _toy_cohort(spark, [(1, 3)]).withColumn("PT", F.lit(-1.0))
    with pytest.raises(Exception, match="PT must be 0 or 1"):
        collapse_cells(df).collect()


def test_asof_crosses_buckets(spark):
    from cohortlens.operators.similarity import asof_both
    offers = [0.1, 0.1001, 0.5, 0.93]
    asks = [i / 97 for i in range(98)]
    rows = [(1, v, v) for v in offers] + [(1, v, None) for v in asks] + [(2, 0.3, None)]
    got = asof_both(spark.createDataFrame(rows, "g int, v double, rv double"), ["g"]).where("rv is null").collect()
    for r in got:
        mine = offers if r["g"] == 1 else []
        assert r["_prev"] == max((o for o in mine if o <= r["v"]), default=None)
        assert r["_next"] == min((o for o in mine if o >= r["v"]), default=None)


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from cohortlens import session

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Conf)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session)


def test_parse_provenance_names(spark):
    from cohortlens.sources.csv import parse_provenance
    df = spark.createDataFrame([("file:/d/dataset_1234567_6_3.3_7.8_4.84_20260101_120000.csv",), ("file:/d/x.csv",)],
                               "p string")
    rows = parse_provenance(df, "p").orderBy("p").collect()
    a, b = rows[0], rows[1]
    assert (a["seeds"], a["gender_or"], a["pt_or"], a["ptt_or"], a["platelet_or"], a["created"]) == \
        ("1234567", 6.0, 3.3, 7.8, 4.84, "20260101_120000")
    assert b["seeds"] is None and b["pt_or"] is None


def test_provenance_labels_are_not_shuffled_with_the_rows(spark, monkeypatch):
    """A shuffle by dataset would leave all rows of a dataset to one task."""
    from cohortlens.plans import catalog

    plans = []
    write = catalog.write_cohort_csv

    def keep(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, *args, **kwargs)

    monkeypatch.setattr(catalog, "write_cohort_csv", keep)
    assert catalog.q_parse_provenance(spark, SF01).count() > 0
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_spearman_tasks_grow_with_the_rows(spark):
    from cohortlens.operators import stats

    rows = spark.range(4000).select((F.col("id") % 100).alias("block"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    ranked = stats._cells_ranked_in_tasks(rows, ["x", "y"], ["block"], 4000, task_rows=100)
    assert ranked.rdd.getNumPartitions() == 40
    assert ranked.agg(F.sum("_cl_n")).first()[0] == 4000
