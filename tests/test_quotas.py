"""Exact quotas for many strata, and for a prefix that has to be split again."""

import hashlib

from pyspark.sql import functions as F

from cohortlens.operators import quotas
from cohortlens.operators.sampling import exact_sample


def test_many_strata(spark):
    df = spark.range(600_000).select("id", F.floor(F.col("id") / 3).alias("stratum"))
    got = exact_sample(df, 2, "id", ["stratum"], seed=5)
    assert got.groupBy("stratum").count().agg(F.count("*"), F.min("count"), F.max("count")).first() == (200_000, 2, 2)
    first = {r.id for r in got.where("stratum < 50").collect()}
    for s in range(50):
        want = sorted(range(3 * s, 3 * s + 3), key=lambda i: hashlib.md5(f"{i}:5".encode()).hexdigest())[:2]
        assert set(want) == first & set(range(3 * s, 3 * s + 3))


def test_prefixes_are_split_until_few_rows_are_left(spark, monkeypatch):
    """One stratum, one digit a level and three rows a prefix: several levels, the same rows."""
    df = spark.range(3000).select("id", F.lit("all").alias("s"))
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"{i}:9".encode()).hexdigest(), i))
    rows = df.select("s", F.lit("row").alias("_cl_item"), F.md5(F.concat(F.col("id").cast("string"), F.lit(":9"))).alias("_cl_h"), "id")
    asked = spark.createDataFrame([("all", "row", k, q) for k, q in enumerate((1, 1500, 2999, 3000, 9999, 0, None))], "s string, _cl_item string, _cl_slot int, _cl_quota long")
    levels = []
    keep = quotas.stored
    monkeypatch.setattr(quotas, "stored", lambda d, name: levels.append(name) or keep(d, name))
    cuts = quotas.quota_cuts(rows, ["s"], "id", asked, digits=1, max_ranked=3).first()["_cl_cuts"]
    assert levels.count("edges") >= 3
    assert {k: v["k"] for k, v in cuts.items()} == {"row:0": order[0], "row:1": order[1499], "row:2": order[2998], "row:3": order[2999], "row:4": order[2999]}
    # Equal hashes cannot be split: they are ranked by key.
    same = rows.where("id < 40").withColumn("_cl_h", F.lit("0" * 32))
    cuts = quotas.quota_cuts(same, ["s"], "id", asked.where("_cl_slot = 0"), max_ranked=3).first()["_cl_cuts"]
    assert cuts["row:0"]["k"] == 0
