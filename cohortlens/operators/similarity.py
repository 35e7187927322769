"""How alike are two datasets? Pairwise matching scores for every dataset pair.

The reference loops over file pairs on the driver and, per left row, runs a
Spark job (filter, cross join, UDF, sort, head). Here one plan covers all
pairs:

* :func:`dataset_pairs` - unordered pairs of distinct dataset ids (i < j);
* :func:`joint_minmax` - Age min/max over both datasets of each pair;
* :func:`pair_rows` - each row tagged with every pair it belongs to (side 0
  = first dataset, side 1 = second) and its pair-normalised Age;
* :func:`match_rank_aligned` - rank every dataset by (row sum, id) with one
  distributed group index for all pairs and join equal ranks;
* :func:`nearest_neighbor` - nearest right row for every left row (with
  replacement) on *collapsed cells*: rows with equal features are one cell
  with a count, the five binary findings form a 5-bit pattern, and the
  nearest Age inside each right pattern is an as-of lookup (windows over one
  range of values of one pattern), so no cross product of rows or cells is formed;
* :func:`distance_summary` - avg / min / max distance and zero-distance share.

Rows with a missing value in a compared column cannot be matched. Every method
leaves them out and reports their number as ``n_incomplete``.

Distance between two rows = mean absolute difference over
Gender, PT, PTT, Platelets, DOA and normalised Age (Age last, as in the
reference after normalisation).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import mean_abs_distance, minmax_scale, row_sum
from cohortlens.operators.ranking import group_index
from cohortlens.session import default_partitions, stored

# The binary columns and the distance column order of the reference.
BINARY = ["Gender", "PT", "PTT", "Platelets", "DOA"]
DIST_COLS = BINARY + ["Age"]
PAIR = ["ds_a", "ds_b"]


def complete_rows(df: DataFrame, cols: Sequence[str] = DIST_COLS) -> DataFrame:
    """Rows with a value in every compared column: only these can be matched, by any method."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def with_incomplete(summary: DataFrame, df: DataFrame, cols: Sequence[str] = DIST_COLS,
                    dataset_col: str = "dataset_id") -> DataFrame:
    """Add ``n_incomplete``: rows of either dataset that a missing value keeps out of the matching."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    per = stored(df.groupBy(dataset_col).agg(F.count_if(missing).alias("_mis")), "incomplete")
    pa = per.select(F.col(dataset_col).alias("ds_a"), F.col("_mis").alias("_mis_a"))
    pb = per.select(F.col(dataset_col).alias("ds_b"), F.col("_mis").alias("_mis_b"))
    return (summary.join(pa, "ds_a").join(pb, "ds_b").withColumn("n_incomplete", F.col("_mis_a") + F.col("_mis_b"))
            .select(*summary.columns, "n_incomplete"))


def dataset_pairs(df: DataFrame, dataset_col: str = "dataset_id", pairs: Sequence[tuple] | None = None) -> DataFrame:
    """All unordered pairs (ds_a < ds_b) of distinct dataset ids, or those of ``pairs``; empty when < 2."""
    ids = stored(df.select(dataset_col).where(F.col(dataset_col).isNotNull()).distinct(), "datasets")
    a = ids.select(F.col(dataset_col).alias("ds_a"))
    b = ids.select(F.col(dataset_col).alias("ds_b"))
    out = a.join(b, F.col("ds_a") < F.col("ds_b"))
    if pairs is None:
        return out
    wanted = df.sparkSession.createDataFrame([tuple(sorted(p)) for p in pairs], out.schema)
    return out.join(F.broadcast(wanted), PAIR, "left_semi")


def joint_minmax(df: DataFrame, pairs: DataFrame, value: str = "Age", dataset_col: str = "dataset_id") -> DataFrame:
    """Per pair: lo = min over both datasets, hi = max over both (pre-aggregated per dataset)."""
    ext = df.groupBy(dataset_col).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    ea = ext.select(F.col(dataset_col).alias("ds_a"), F.col("_mn").alias("_mn_a"), F.col("_mx").alias("_mx_a"))
    eb = ext.select(F.col(dataset_col).alias("ds_b"), F.col("_mn").alias("_mn_b"), F.col("_mx").alias("_mx_b"))
    return (pairs.join(ea, "ds_a").join(eb, "ds_b")
            .select("ds_a", "ds_b", F.least("_mn_a", "_mn_b").alias("lo"), F.greatest("_mx_a", "_mx_b").alias("hi")))


def pair_sides(df: DataFrame, dataset_col: str = "dataset_id", value: str = "Age", pairs: Sequence[tuple] | None = None) -> DataFrame:
    """(ds_a, ds_b, lo, hi, dataset, side): both datasets of every pair and the pair's range of ``value``."""
    mm = joint_minmax(df, dataset_pairs(df, dataset_col, pairs), value, dataset_col)
    sides = mm.select("ds_a", "ds_b", "lo", "hi",
                      F.explode(F.array(F.struct(F.col("ds_a").alias("ds"), F.lit(0).alias("side")),
                                        F.struct(F.col("ds_b").alias("ds"), F.lit(1).alias("side")))).alias("_s"))
    return sides.select("ds_a", "ds_b", "lo", "hi", F.col("_s.ds").alias(dataset_col), F.col("_s.side").alias("side"))


def pair_rows(df: DataFrame, dataset_col: str = "dataset_id", value: str = "Age",
              pairs: Sequence[tuple] | None = None, sides: DataFrame | None = None) -> DataFrame:
    """Rows tagged with (ds_a, ds_b, side) for every pair, plus pair-normalised ``value``.

    The pair/side table has 2 x pairs rows. It is stored, so that the planner
    knows its size and broadcasts it only if that is small. ``sides`` is such a table, of some pairs, and
    may have further columns.
    """
    if sides is None:
        sides = stored(pair_sides(df, dataset_col, value, pairs), "sides")
    out = df.join(sides, dataset_col)
    return out.withColumn(value, minmax_scale(F.col(value), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def distance_summary(matches: DataFrame, by: Sequence[str] = PAIR, distance: str = "distance",
                     weight: str | None = None, digits: int = 6) -> DataFrame:
    """avg / min / max distance, percent of zero distances, matched count, per pair.

    ``weight`` (a count column) lets collapsed cells stand for their rows.
    Matches without a distance are counted in ``n_null`` and in nothing else.
    """
    w = F.col(weight) if weight else F.lit(1)
    d = F.col(distance)
    known = F.when(d.isNotNull(), w).otherwise(F.lit(0))
    agg = matches.groupBy(*by).agg(
        F.sum(known).cast("long").alias("n_matched"),
        F.sum(w - known).cast("long").alias("n_null"),
        F.sum(d * w).alias("_sum"),
        F.min(d).alias("min_distance"),
        F.max(d).alias("max_distance"),
        F.sum(F.when(d <= 0, w).otherwise(F.lit(0))).alias("_zero"))
    return agg.select(
        *by, "n_matched", "n_null",
        F.round(F.try_divide(F.col("_sum"), F.col("n_matched").cast("double")), digits).alias("avg_distance"),
        F.round("min_distance", digits).alias("min_distance"),
        F.round("max_distance", digits).alias("max_distance"),
        F.round(F.try_divide(F.col("_zero").cast("double") * F.lit(100.0), F.col("n_matched").cast("double")),
                digits).alias("zero_dist_percent"),
        F.round("_sum", digits).alias("distance_sum"),
        (F.col("n_matched") - F.col("_zero")).cast("long").alias("n_nonzero"))


def dataset_ranks(df: DataFrame, key: str = "id", dataset_col: str = "dataset_id", cols: Sequence[str] = DIST_COLS,
                  value: str = "Age") -> DataFrame:
    """Rows with ``rank`` and ``full_rank``: their places in their dataset by row sum, whatever the pair.

    A row's sum in a pair is its part, the sum of the other columns, which must be whole, and its value scaled to [0, 1].
    So the order inside a dataset is (part, value, key) in all pairs, but for one tie: where the pair's range is the
    dataset's own, the highest value of one part has the sum of the lowest of the next, and these rows, a block of
    consecutive ranks, are in order of key. ``rank`` leaves that tie out and ``full_rank`` has it in. The rows are
    sorted once; those of the lowest and highest values are numbered again inside their blocks.
    """
    rest = [c for c in cols if c != value]
    total = row_sum(rest)
    part = F.when(total == F.floor(total), total).otherwise(F.raise_error(F.concat(F.lit("row sums must be whole, not "), total.cast("string"))).cast("double"))
    rows = complete_rows(df.select(dataset_col, key, *cols), cols).where(F.col(dataset_col).isNotNull()).withColumn("_part", part)
    ranked = group_index(rows, [dataset_col], ["_part", value, key], "rank")
    ends = stored(ranked.groupBy(F.col(dataset_col).alias("_ds")).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx")), "ends")
    ranked = ranked.join(ends, F.col(dataset_col) == F.col("_ds")).drop("_ds")
    at_end = (F.col(value) == F.col("_mn")) | (F.col(value) == F.col("_mx"))
    blocks = ranked.where(at_end).withColumn("_block", F.when((F.col(value) == F.col("_mx")) & (F.col("_mx") > F.col("_mn")), F.col("_part") + 1).otherwise(F.col("_part")))
    again = group_index(blocks, [dataset_col, "_block"], [key, "rank"], "_pos")
    first = stored(blocks.groupBy(dataset_col, "_block").agg(F.min("rank").alias("_first")), "blocks")
    again = again.join(first, [dataset_col, "_block"]).withColumn("full_rank", F.col("_first") + F.col("_pos") - 1)
    keep = [dataset_col, key, *cols, "rank", "full_rank"]
    return ranked.where(~at_end).withColumn("full_rank", F.col("rank")).select(*keep).unionByName(again.select(*keep))


def rank_aligned_matches(df: DataFrame, key: str = "id", dataset_col: str = "dataset_id",
                         cols: Sequence[str] = DIST_COLS, pairs: Sequence[tuple] | None = None, value: str = "Age") -> DataFrame:
    """Matched row pairs of the rank-aligned method: (ds_a, ds_b, rank, l_id, r_id, distance).

    Both sides are ranked by (row sum, id); ranks are unique, so that min(n_a, n_b) complete rows of every pair meet; rows
    with a missing value take no part. Ranks come from :func:`dataset_ranks`, once for all pairs, and
    the join is by rank alone: a row is shuffled once (twice where its two ranks differ), not once a pair, and a
    rank has one row a dataset.
    """
    ranked = stored(dataset_ranks(df, key, dataset_col, cols, value), "ranks")
    every = dataset_pairs(ranked, dataset_col, pairs)
    mm = joint_minmax(ranked, every, value, dataset_col)
    ext = stored(ranked.groupBy(dataset_col).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx")), "ends")
    of = lambda ds: ext.select(F.col(dataset_col).alias(ds), F.col("_mn").alias(f"_mn_{ds}"), F.col("_mx").alias(f"_mx_{ds}"))
    mm = mm.join(of("ds_a"), "ds_a").join(of("ds_b"), "ds_b")
    whole = lambda ds: ((F.col(f"_mn_{ds}") == F.col("lo")) & (F.col(f"_mx_{ds}") == F.col("hi")))
    mm = stored(mm.select(*PAIR, "lo", "hi", whole("ds_a").alias("_full_a"), whole("ds_b").alias("_full_b")), "pairs")
    same = F.col("rank") == F.col("full_rank")
    uses = F.explode(F.when(same, F.array(F.struct(F.col("rank").alias("at"), F.lit(True).alias("plain"), F.lit(True).alias("full"))))
                     .otherwise(F.array(F.struct(F.col("rank").alias("at"), F.lit(True).alias("plain"), F.lit(False).alias("full")),
                                        F.struct(F.col("full_rank").alias("at"), F.lit(False).alias("plain"), F.lit(True).alias("full")))))
    placed = ranked.withColumn("_u", uses)
    side = lambda ds, s: placed.select(F.col(dataset_col).alias(ds), F.col("_u.at").alias(f"{s}_at"), F.col("_u.plain").alias(f"{s}_plain"),
                                       F.col("_u.full").alias(f"{s}_full"), F.col(key).alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    left, right = side("ds_a", "l"), side("ds_b", "r")
    met = left.join(right, (F.col("l_at") == F.col("r_at")) & (F.col("ds_a") < F.col("ds_b"))).join(mm, PAIR)
    fits = (F.when(F.col("_full_a"), F.col("l_full")).otherwise(F.col("l_plain")) & F.when(F.col("_full_b"), F.col("r_full")).otherwise(F.col("r_plain")))
    scaled = met.where(fits).withColumns({f"{s}_{value}": minmax_scale(F.col(f"{s}_{value}"), F.col("lo"), F.col("hi")) for s in "lr"})
    return scaled.select(*PAIR, F.col("l_at").alias("rank"), "l_id", "r_id",
                         mean_abs_distance([f"l_{c}" for c in cols], [f"r_{c}" for c in cols]).alias("distance"))


def match_rank_aligned(df: DataFrame, key: str = "id", dataset_col: str = "dataset_id",
                       pairs: Sequence[tuple] | None = None) -> DataFrame:
    s = distance_summary(rank_aligned_matches(df, key, dataset_col, pairs=pairs))
    return with_incomplete(s.drop("distance_sum", "n_nonzero", "n_null"), df, dataset_col=dataset_col)


def _pattern(prefix: str = "") -> F.Column:
    """The findings as bits; a finding other than 0 or 1 is an error, not another pattern."""
    code = F.lit(0)
    for i, c in enumerate(BINARY):
        v = F.col(f"{prefix}{c}")
        bit = (F.when(v == 1, F.lit(1)).when(v == 0, F.lit(0))
               .otherwise(F.raise_error(F.concat(F.lit(f"{c} must be 0 or 1, not "), v.cast("string"))).cast("int")))
        code = code + bit * F.lit(1 << (len(BINARY) - 1 - i))
    return code


def collapse_cells(df: DataFrame, dataset_col: str = "dataset_id", value: str = "Age") -> DataFrame:
    """(dataset, pattern, value, n): complete rows with identical features become one weighted cell."""
    return (complete_rows(df, [*BINARY, value])
            .groupBy(dataset_col, _pattern().alias("pattern"), F.col(value).alias("v"))
            .agg(F.count(F.lit(1)).alias("n")))


def pair_cells(df: DataFrame, dataset_col: str = "dataset_id", value: str = "Age",
               pairs: Sequence[tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """Left and right cells (pair, pattern, v, n) of every pair, values scaled to the pair's range."""
    cells = stored(collapse_cells(df, dataset_col, value), "cells")
    mm = stored(joint_minmax(cells, dataset_pairs(cells, dataset_col, pairs), "v", dataset_col), "ranges")
    return tuple(cells.join(mm, cells[dataset_col] == mm[ds])
                 .select(*PAIR, "pattern", minmax_scale(F.col("v"), F.col("lo"), F.col("hi")).alias("v"), "n")
                 for ds in PAIR)


def asof_both(items: DataFrame, by: Sequence[str], value: str = "v", found: str = "rv",
              buckets: int | None = None) -> DataFrame:
    """Add ``_prev`` and ``_next``: the nearest ``found`` (null where a row offers none) at or below, and at or above.

    The rows are dealt by ranges of (by, value) into ``buckets`` partitions (as many as shuffles have), whose ends
    follow the rows: values that crowd in one place are spread as well as others. Inside a partition two running windows, one
    each way, are linear; what lies beyond comes from the partitions' lowest and highest offers, a row
    for each partition of a group, carried from one to the next. The dealing is checkpointed, since the
    windows and the ends must come from the same one.
    """
    n = buckets or default_partitions(items.sparkSession)
    keyed = items.repartitionByRange(n, *by, value).withColumn("_b", F.spark_partition_id()).checkpoint(eager=True)
    offers = F.col(found).isNotNull()
    up = Window.partitionBy(*by, "_b").orderBy(F.col(value).asc(), offers.desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "_b").orderBy(F.col(value).desc(), offers.desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = keyed.select("*", F.last(found, ignorenulls=True).over(up).alias("_p"), F.last(found, ignorenulls=True).over(down).alias("_n"))
    ends = keyed.groupBy(*by, "_b").agg(F.min(found).alias("_lo"), F.max(found).alias("_hi"))
    below = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = ends.select(*by, "_b", F.max("_hi").over(below).alias("_below"), F.min("_lo").over(above).alias("_above"))
    return (inside.join(stored(beyond, "ends"), [*by, "_b"])
            .withColumn("_prev", F.coalesce("_p", "_below")).withColumn("_next", F.coalesce("_n", "_above"))
            .drop("_b", "_p", "_n", "_below", "_above"))


def nearest_cells(left: DataFrame, right: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """For each left cell (by, pattern, v, n) the distance to its nearest right cell.

    Left cells are expanded over the 2^5 right patterns; inside each
    (by, right pattern) the nearest right value is found by an as-of scan.
    Distance = (hamming(patterns) + |v_left - v_right|) / 6, minimised over patterns.
    """
    n_pat = 1 << len(BINARY)
    lx = left.select(*by, F.col("pattern").alias("lp"), F.col("v").alias("lv"), "n",
                     F.explode(F.sequence(F.lit(0), F.lit(n_pat - 1))).alias("p"))
    items = (lx.select(*by, "p", F.col("lv").alias("v"), "lp", "lv", "n", F.lit(None).cast("double").alias("rv"))
             .unionByName(right.select(*by, F.col("pattern").alias("p"), "v", F.lit(None).cast("int").alias("lp"),
                                       F.lit(None).cast("double").alias("lv"), F.lit(None).cast("long").alias("n"),
                                       F.col("v").alias("rv"))))
    scanned = asof_both(items, [*by, "p"]).where(F.col("lp").isNotNull())
    dv = F.least(F.col("lv") - F.col("_prev"), F.col("_next") - F.col("lv"))
    ham = F.bit_count(F.col("lp").bitwiseXOR(F.col("p"))).cast("double")
    cand = scanned.where(dv.isNotNull()).select(*by, "lp", "lv", "n", ((ham + dv) / F.lit(6.0)).alias("distance"))
    return cand.groupBy(*by, "lp", "lv").agg(F.min("distance").alias("distance"), F.first("n").alias("n"))


def nearest_neighbor(df: DataFrame, dataset_col: str = "dataset_id", value: str = "Age",
                     pairs: Sequence[tuple] | None = None) -> DataFrame:
    """Per pair: nearest-row distance of every first-dataset row to the second (with replacement)."""
    left, right = pair_cells(df, dataset_col, value, pairs)
    s = distance_summary(nearest_cells(left, right), weight="n").drop("n_null")
    return with_incomplete(s, df, [*BINARY, value], dataset_col)
