"""Correlation matrices per block, frequency tables, marginal reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.ranking import value_ranks
from cohortlens.session import default_partitions, stored


def _pair_name(a: str, b: str) -> str:
    return f"_cl_cov__{a}__{b}"


MAX_GROUP_ROWS = 1_000_000
#: Rows of all groups that one task ranks, about; each of its windows sorts their cells.
TASK_ROWS = 200_000


def _spearman_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str], max_group_rows: int) -> DataFrame:
    """Per group: sums of products of the ranks' deviations, as covariances, and their roots, as deviations.

    Rows are collapsed to weighted cells, and cells get average ranks. A group of n rows has the mean rank (n + 1) / 2
    whatever its ties, so one pass over deviations is enough: they are halves of whole numbers.
    """
    largest, rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first() if by else (None, None)
    in_tasks = by and (largest or 0) <= max_group_rows
    ranked = _cells_ranked_in_tasks(df, cols, by, rows or 0) if in_tasks else _cells_ranked_by_joins(df, cols, by)
    dev = {c: F.col(f"_cl_r_{c}") - F.col("_cl_mean") for c in cols}
    aggs = [F.sqrt(F.sum(F.col("_cl_n") * dev[c] * dev[c])).alias(f"_cl_sd__{c}") for c in cols]
    aggs += [F.sum(F.col("_cl_n") * dev[a] * dev[b]).alias(_pair_name(a, b)) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return ranked.groupBy(*by).agg(*aggs)


def _cells_ranked_in_tasks(df: DataFrame, cols: Sequence[str], by: Sequence[str], rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """(*by, *cols, _cl_n, _cl_mean, _cl_r_<col>) of groups that fit a task: one exchange, windows over cells.

    There are as many tasks as ``rows`` in all need, so that a task's memory does not grow with the table.
    """
    tasks = max(default_partitions(df.sparkSession), -(-rows // task_rows))
    cells = df.select(*by, *cols).repartition(tasks, *by).groupBy(*by, *cols).agg(F.count(F.lit(1)).alias("_cl_n"))
    ranks = []
    for c in cols:
        upto = F.sum("_cl_n").over(Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_first()))
        ties = F.sum("_cl_n").over(Window.partitionBy(*by, c))
        ranks.append((upto - (ties - 1) / 2.0).alias(f"_cl_r_{c}"))
    return cells.select("*", ((F.sum("_cl_n").over(Window.partitionBy(*by)) + 1) / 2.0).alias("_cl_mean"), *ranks)


def _cells_ranked_by_joins(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The same for groups of any size: ranks come from counts of values and are joined to the cells."""
    cells = stored(df.groupBy(*by, *cols).agg(F.count(F.lit(1)).alias("_cl_n")), "cells")
    ranks = stored(value_ranks(cells, cols, by, "_cl_n"), "ranks")
    sizes = stored(cells.groupBy(*by).agg(((F.sum("_cl_n") + 1) / 2.0).alias("_cl_mean")), "sizes")

    def on(right: DataFrame):
        cond = F.lit(True)
        for k in by:
            cond = cond & cells[k].eqNullSafe(right[f"_cl_k_{k}"])
        return cond

    def keyed(right: DataFrame, *values):
        return right.select(*[F.col(k).alias(f"_cl_k_{k}") for k in by], *values)

    keys = [f"_cl_k_{k}" for k in by]
    means = keyed(sizes, "_cl_mean")
    # Without groups there is one mean.
    out = cells.join(means, on(means)).drop(*keys) if by else cells.crossJoin(F.broadcast(means))
    for c in cols:
        mine = keyed(ranks.where(F.col("column") == c), F.col("value").alias("_cl_v"), F.col("rank").alias(f"_cl_r_{c}"))
        out = out.join(mine, on(mine) & cells[c].cast("double").eqNullSafe(mine["_cl_v"])).drop(*keys, "_cl_v")
    return out


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("block",),
                method: str = "pearson", digits: int | None = 6, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Long correlation table ``(*by, method, feature_a, feature_b, value)``.

    One grouped aggregate computes every block's matrix at once: population
    covariance per pair and standard deviation per column (numerically stable
    built-ins), then r = cov / (sd_a * sd_b) with ``try_divide`` so a constant
    column gives null instead of an ANSI divide-by-zero. The diagonal is 1 and
    the matrix symmetric. ``method="spearman"`` takes average ranks within the
    block in place of the values, on cells weighted by their rows; a null ranks
    as the smallest value. While no group has more than ``max_group_rows`` rows,
    each is ranked in a task; beyond it all are ranked by counts of values.
    """
    cols, by = list(cols), list(by)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if method == "spearman":
        wide = _spearman_moments(df, cols, by, max_group_rows)
    elif method == "pearson":
        aggs = [F.stddev_pop(c).alias(f"_cl_sd__{c}") for c in cols]
        aggs += [F.covar_pop(a, b).alias(_pair_name(a, b)) for a, b in pairs]
        wide = df.groupBy(*by).agg(*aggs)
    else:
        raise ValueError(f"unknown method {method!r}")
    entries = []
    for a in cols:
        for b in cols:
            if a == b:
                v = "CAST(1.0 AS DOUBLE)"
            else:
                x, y = (a, b) if cols.index(a) < cols.index(b) else (b, a)
                v = f"try_divide(`{_pair_name(x, y)}`, `_cl_sd__{x}` * `_cl_sd__{y}`)"
            entries.append(f"'{a}', '{b}', {v}")
    stacked = F.expr(f"stack({len(entries)}, {', '.join(entries)}) as (feature_a, feature_b, value)")
    out = wide.select(*by, F.lit(method).alias("method"), stacked)
    if digits is not None:
        out = out.withColumn("value", F.round("value", digits))
    return out


def corr_pivot(long: DataFrame, cols: Sequence[str], by: Sequence[str] = ("block",)) -> DataFrame:
    """Matrix layout: one row per (block, method, feature), one column per feature.

    Pivot values are given explicitly, so no extra distinct-values job runs.
    """
    return (long.groupBy(*by, "method", F.col("feature_a").alias("feature"))
            .pivot("feature_b", list(cols)).agg(F.first("value")))


def value_counts(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    """Class frequencies, most frequent first (ties by value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(count_col)).orderBy(F.desc(count_col), F.asc(col))


def marginal_report(df: DataFrame, features: Sequence[str], low: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Per feature: rows, measured (non-null), low (== ``low``), high (other measured), missing."""
    aggs = [F.count(F.lit(1)).alias("_cl_rows")]
    for f in features:
        aggs += [F.count(f).alias(f"{f}__measured"),
                 F.count_if(F.col(f) == F.lit(low)).alias(f"{f}__low"),
                 F.count_if(F.col(f) != F.lit(low)).alias(f"{f}__high")]
    wide = df.groupBy(*by).agg(*aggs)
    args = ", ".join(f"'{f}', `{f}__measured`, `{f}__low`, `{f}__high`" for f in features)
    stacked = F.expr(f"stack({len(features)}, {args}) as (feature, measured, low, high)")
    return (wide.select(*by, F.col("_cl_rows").alias("rows"), stacked)
            .withColumn("missing", F.col("rows") - F.col("measured")))
