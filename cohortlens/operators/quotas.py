"""Exact quotas per stratum without sorting rows.

A stratum's rows are ordered by a hash. For each quota q the hash of the q-th
row, the cut, is found by descent: rows are counted by hash prefix, the
prefix holding the q-th row is taken from the running count, and where it holds
too many rows they alone are counted by a longer one. Only the rows of the last
prefix are ranked. A row is inside the quota iff (hash, key) <= cut, so that
labelling all rows is one join with a row a stratum, which the planner broadcasts
or not by its stored size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import stored

PREFIX_DIGITS = 4
HASH_DIGITS = 32
#: Rows of a prefix that are ranked together; a larger prefix is split again.
MAX_RANKED = 100_000


def quota_cuts(rows: DataFrame, strata: Sequence[str], key: str, quotas: DataFrame,
               digits: int = PREFIX_DIGITS, max_ranked: int = MAX_RANKED) -> DataFrame:
    """One row per stratum: ``(*strata, _cl_cuts)``, a map from "item:slot" to the cut (hash, key); stored.

    ``rows`` has the strata, ``_cl_item``, ``_cl_h`` (hex digest) and the key;
    ``quotas`` the strata, ``_cl_item``, ``_cl_slot`` and ``_cl_quota``. A quota
    of zero (or null) has no cut; one above the stratum's size cuts at its last row.
    There may be any number of strata: no table is broadcast unless its stored size allows it.
    Rows of equal hashes (of one key) are ranked together, whatever their number.
    """
    group = [*strata, "_cl_item"]
    open_, left, length = None, rows, 0
    while True:
        length += digits
        counts = (left.withColumn("_cl_p", F.substring("_cl_h", 1, length)).withColumn("_cl_up", F.substring("_cl_h", 1, length - digits))
                  .groupBy(*group, "_cl_up", "_cl_p").agg(F.count(F.lit(1)).alias("_cl_n")))
        within = Window.partitionBy(*group, "_cl_up")
        cum = (counts.withColumn("_cl_to", F.sum("_cl_n").over(within.orderBy("_cl_p").rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("_cl_all", F.sum("_cl_n").over(within)))
        if open_ is None:
            asked = quotas.select(*group, "_cl_slot", F.lit("").alias("_cl_up"), F.col("_cl_quota").alias("_cl_r"))
        else:
            asked = open_.select(*group, "_cl_slot", F.col("_cl_p").alias("_cl_up"), "_cl_r")
        q = F.when(F.col("_cl_r").isNotNull(), F.least("_cl_r", "_cl_all"))  # least alone would skip a null
        open_ = stored(cum.join(asked, [*group, "_cl_up"])
                       .where((q > F.col("_cl_to") - F.col("_cl_n")) & (q <= F.col("_cl_to")))
                       .select(*group, "_cl_p", "_cl_slot", (q - F.col("_cl_to") + F.col("_cl_n")).alias("_cl_r"), "_cl_n"), "edges")
        left = left.withColumn("_cl_p", F.substring("_cl_h", 1, length)).join(open_.select(*group, "_cl_p").distinct(), [*group, "_cl_p"], "left_semi").drop("_cl_p")
        largest = open_.agg(F.max("_cl_n")).first()[0]
        if largest is None or largest <= max_ranked or length >= HASH_DIGITS:
            break
        left = stored(left, "edge-rows")
    rank = F.row_number().over(Window.partitionBy(*group, "_cl_slot").orderBy("_cl_h", key))
    cut = (left.withColumn("_cl_p", F.substring("_cl_h", 1, length)).join(open_.drop("_cl_n"), [*group, "_cl_p"]).withColumn("_cl_rank", rank)
           .where(F.col("_cl_rank") == F.col("_cl_r")))
    entry = F.struct(F.concat_ws(":", "_cl_item", "_cl_slot"), F.struct(F.col("_cl_h").alias("h"), F.col(key).alias("k")))
    return stored(cut.groupBy(*strata).agg(F.map_from_entries(F.collect_list(entry)).alias("_cl_cuts")), "cuts")


def inside(item: str, slot: int, digest: Column, key: str) -> Column:
    """Whether a row lies inside the quota ``slot`` of ``item`` (false without a cut)."""
    cut = F.col("_cl_cuts")[F.lit(f"{item}:{slot}")]
    return F.coalesce(F.struct(digest.alias("h"), F.col(key).alias("k")) <= cut, F.lit(False))
