"""Distributed numbering, prefix sums and average ranks.

``row_number()`` over an unpartitioned window moves every row to one task.
Here a global index is built from a range-partitioned sort instead:

1. ``repartitionByRange`` + ``sortWithinPartitions`` on the ordering keys
   (Spark samples the full compound key, so a hot leading value is split);
2. the sorted partitions are written once as Parquet, one file each (shared
   ``spark.checkpoint.dir``), and a row's position is its number in its file.
   Positions and per-partition counts must come from one realisation of the
   sort: the range partitioner's sample is seeded by RDD id, so two branches
   over the same logical plan may cut the key space differently. Readers
   prune the columns that they do not need;
3. per-partition row counts (one row per partition: a proven size bound,
   safe to broadcast) turned into prefix offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import DROP_SHUFFLES, default_partitions, scratch_path, settings, stored


def _sort_col(c: str | Column) -> Column:
    return F.col(c).asc_nulls_first() if isinstance(c, str) else c


def _positions(df: DataFrame, keys: Sequence[Column], n: int) -> DataFrame:
    """Range-partitioned, sorted rows with (partition id, position), written once and read back."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_cl_pid", F.spark_partition_id())
    path = scratch_path(spark, "sorted")
    # One file a partition, so that the row's number in its file is its position.
    with settings(spark, DROP_SHUFFLES):
        ranged.write.option("maxRecordsPerFile", 0).parquet(path)
    return spark.read.schema(ranged.schema).parquet(path).select("*", F.col("_metadata.row_index").alias("_cl_pos"))


def group_index(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                index_col: str = "index", num_partitions: int | None = None, start: int = 1) -> DataFrame:
    """1-based row number inside each group (or over the whole frame), in ``order_cols`` order.

    One range-partitioned sort over (group, order) keys, so a hot group is
    spread over many partitions. A summary with one row per (partition,
    group) - at most partitions + groups - 1 rows - gives each group's rows
    in earlier partitions and its first position in this one:
    index = rows before + (position - first position) + start.
    The result reads the written table: it can be kept and queried again
    without another sort, until ``session.drop_scratch``. Without groups the
    summary has one row per partition (a proven bound) and is broadcast; with
    groups the planner chooses the join by the stored summary's real size.
    """
    spark = df.sparkSession
    n = num_partitions or default_partitions(spark)
    group_cols = list(group_cols)
    keys = [_sort_col(c) for c in [*group_cols, *order_cols]]
    ranked = _positions(df, keys, n)
    summary = ranked.groupBy("_cl_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cl_n"),
                                                        F.min("_cl_pos").alias("_cl_first"))
    spec = Window.partitionBy(*group_cols) if group_cols else Window
    before = spec.orderBy("_cl_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = (F.coalesce(F.sum("_cl_n").over(before), F.lit(0)) - F.col("_cl_first")).alias("_cl_base")
    offsets = summary.select("_cl_pid", *[F.col(c).alias(f"_cl_k_{c}") for c in group_cols], base)
    offsets = stored(offsets, "offsets")
    offsets = offsets if group_cols else F.broadcast(offsets)
    cond = ranked["_cl_pid"] == offsets["_cl_pid"]
    for c in group_cols:
        cond = cond & ranked[c].eqNullSafe(offsets[f"_cl_k_{c}"])
    out = ranked.join(offsets, cond)
    return (out.withColumn(index_col, (F.col("_cl_base") + F.col("_cl_pos") + F.lit(start)).cast("long"))
            .drop("_cl_pid", "_cl_pos", "_cl_base", *[f"_cl_k_{c}" for c in group_cols]))


def global_index(df: DataFrame, order_cols: Sequence[str | Column], index_col: str = "index",
                 num_partitions: int | None = None, start: int = 1) -> DataFrame:
    """Add a dense row number in ``order_cols`` order, without a one-task window.

    Deterministic when ``order_cols`` are unique (as the reference's
    all-column ordering is); ties are numbered in an arbitrary order.
    """
    return group_index(df, [], order_cols, index_col, num_partitions, start)


def running_total(df: DataFrame, order_col: str, value_cols: Sequence[str], fanout: int = 1024,
                  suffix: str = "_cum", levels: int = 3) -> DataFrame:
    """Inclusive prefix sums of ``value_cols`` along an integer ``order_col``.

    A running sum inside super-blocks of ``fanout`` consecutive keys, plus the
    prefix of super-block totals, which is found the same way ``levels`` times.
    Only the last level, of rows / fanout^levels totals, is one window.
    """
    base = df.withColumn("_cl_sb", F.floor(F.col(order_col) / F.lit(fanout)).cast("long"))
    inner = Window.partitionBy("_cl_sb").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    within = base.select("*", *[F.sum(v).over(inner).alias(f"_cl_in_{v}") for v in value_cols])
    totals = base.groupBy("_cl_sb").agg(*[F.sum(v).alias(v) for v in value_cols])
    if levels > 1:
        upto = running_total(totals.withColumnRenamed("_cl_sb", "_cl_key"), "_cl_key", value_cols, fanout, "_cl_c", levels - 1)
        offsets = upto.select(F.col("_cl_key").alias("_cl_sb"), *[(F.col(f"{v}_cl_c") - F.col(v)).alias(f"_cl_o_{v}") for v in value_cols])
    else:
        prior = Window.orderBy("_cl_sb").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("_cl_sb", *[F.coalesce(F.sum(v).over(prior), F.lit(0)).alias(f"_cl_o_{v}") for v in value_cols])
    out = within.join(offsets, "_cl_sb")
    for v in value_cols:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_cl_o_{v}") + F.col(f"_cl_in_{v}"))
    return out.drop("_cl_sb", *[f"_cl_in_{v}" for v in value_cols], *[f"_cl_o_{v}" for v in value_cols])


def value_ranks(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(*by, column, value, rank) of every value of numeric ``cols`` within each group: average rank with ties.

    Rows are counted by value first (``weight`` holds a row's multiplicity), so only distinct values are ordered. A null
    is a value, the smallest. Without groups the values get a distributed index and prefix sums, with groups one window
    over a group's distinct values.
    """
    by = list(by)
    entries = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    long = df.select(*by, (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"), F.expr(f"stack({len(cols)}, {entries}) as (column, value)"))
    counts = long.groupBy(*by, "column", "value").agg(F.sum("n").alias("n"))
    if by:
        w = Window.partitionBy(*by, "column").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn("rank", F.sum("n").over(w) - (F.col("n") - 1) / 2.0).drop("n")
    upto = running_total(global_index(counts, ["column", "value"], "_cl_at"), "_cl_at", ["n"])
    # All columns have as many rows: the rows of the columns before are a multiple of that number.
    first = stored(upto.groupBy(F.col("column").alias("_cl_c")).agg(F.min(F.col("n_cum") - F.col("n")).alias("_cl_first")), "firsts")
    return (upto.join(first, F.col("column") == F.col("_cl_c"))
            .select("column", "value", (F.col("n_cum") - F.col("_cl_first") - (F.col("n") - 1) / 2.0).alias("rank")))


def average_rank(df: DataFrame, cols: Sequence[str], partition_cols: Sequence[str] = (),
                 suffix: str = "_rank") -> DataFrame:
    """Average rank with ties of each column within each partition (Spearman's ranks).

    avg rank = (first position + last position of the tie group) / 2 =
    (rank() + count() over the default RANGE frame) / 2: one window spec, so
    one sort per column. Partitions here are bounded blocks (k rows), and one
    hash exchange on the partition key serves every column's sort. Without
    partition columns the positions come from the distributed global index.
    """
    out = df
    for c in cols:
        if partition_cols:
            w = Window.partitionBy(*partition_cols).orderBy(F.col(c).asc_nulls_first())
            out = out.withColumn(f"{c}{suffix}", (F.rank().over(w) + F.count(F.lit(1)).over(w)) / F.lit(2.0))
        else:
            places = (global_index(out.select(c), [c], "_cl_at").groupBy(F.col(c).alias("_cl_v"))
                      .agg(F.avg("_cl_at").alias(f"{c}{suffix}")))
            out = out.join(places, F.col(c).eqNullSafe(F.col("_cl_v"))).drop("_cl_v")
    return out
