"""2x2 contingency tables, odds ratios and the threshold odds-ratio scan.

Coding (fixed by the reference): outcome 0 = dead, 1 = alive; a finding
0 = low/abnormal (the exposed class), 1 = high/normal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ranking import running_total
from cohortlens.session import stored

CELLS = ["dead_low", "dead_high", "alive_low", "alive_high"]


def _cell_exprs(feature: str, outcome: str, exposed: float, dead: float) -> list[Column]:
    f, o = F.col(f"`{feature}`"), F.col(f"`{outcome}`")
    is_dead, is_alive = o == F.lit(dead), o != F.lit(dead)
    is_low, is_high = f == F.lit(exposed), f != F.lit(exposed)
    return [
        F.count_if(is_dead & is_low).alias(f"{feature}__dead_low"),
        F.count_if(is_dead & is_high).alias(f"{feature}__dead_high"),
        F.count_if(is_alive & is_low).alias(f"{feature}__alive_low"),
        F.count_if(is_alive & is_high).alias(f"{feature}__alive_high"),
    ]


def contingency(df: DataFrame, features: Sequence[str], outcome: str = "DOA", by: Sequence[str] = (),
                exposed: float = 0.0, dead: float = 0.0) -> DataFrame:
    """Long table ``(*by, feature, dead_low, dead_high, alive_low, alive_high)``.

    One pass: all features' cells are conditional counts of a single
    aggregate (partial aggregation map-side, one row per group shuffled),
    then the wide row is unpivoted with ``stack``. Rows with a null outcome
    or finding fall in no cell.
    """
    aggs = [e for f in features for e in _cell_exprs(f, outcome, exposed, dead)]
    wide = df.groupBy(*by).agg(*aggs)
    args = ", ".join(
        f"'{f}', " + ", ".join(f"`{f}__{c}`" for c in CELLS) for f in features)
    stacked = f"stack({len(features)}, {args}) as (feature, {', '.join(CELLS)})"
    return wide.select(*[F.col(b) for b in by], F.expr(stacked))


def odds_ratio_expr(dead_low: str = "dead_low", dead_high: str = "dead_high",
                    alive_low: str = "alive_low", alive_high: str = "alive_high") -> Column:
    """(dead_low * alive_high) / (dead_high * alive_low) in doubles; x/0 -> null."""
    num = F.col(dead_low).cast("double") * F.col(alive_high).cast("double")
    den = F.col(dead_high).cast("double") * F.col(alive_low).cast("double")
    return F.try_divide(num, den)


def odds_ratios(cells: DataFrame, digits: int | None = 6) -> DataFrame:
    """Add ``odds_ratio`` to a contingency table."""
    e = odds_ratio_expr()
    return cells.withColumn("odds_ratio", F.round(e, digits) if digits is not None else e)


def threshold_odds_scan(df: DataFrame, order_col: str = "index", outcome: str = "DOA", step: int = 1000,
                        alive: float = 1.0, digits: int = 2) -> DataFrame:
    """Odds ratio of outcome vs. "row lies below threshold t" for t = step, 2*step, ... < n.

    ``order_col`` must be a dense 1-based row number. Rows are aggregated per
    step-block first (map-side) and stored, block counts are prefix-summed by
    levels, and the totals are sums of the blocks: the input is read once.
    Output: threshold, alive_below, dead_above, dead_below, alive_above, odds_ratio.
    """
    blocks = stored(df.select(
        (F.floor((F.col(order_col) - F.lit(1)) / F.lit(step)) + F.lit(1)).cast("long").alias("block"),
        F.when(F.col(outcome) == F.lit(alive), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("alive"))
        .groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum("alive").alias("alive")), "scan-blocks")
    total_rows = blocks.select(F.sum("rows")).scalar()
    total_alive = blocks.select(F.sum("alive")).scalar()
    cum = running_total(blocks, "block", ["rows", "alive"])
    t = (F.col("block") * F.lit(step)).cast("long")
    alive_below = F.col("alive_cum")
    dead_below = t - alive_below
    alive_above = total_alive - alive_below
    dead_above = (total_rows - total_alive) - dead_below
    out = cum.where(t < total_rows).select(
        t.alias("threshold"),
        alive_below.cast("long").alias("alive_below"),
        dead_above.cast("long").alias("dead_above"),
        dead_below.cast("long").alias("dead_below"),
        alive_above.cast("long").alias("alive_above"),
    )
    ratio = F.try_divide(F.col("alive_below").cast("double") * F.col("dead_above").cast("double"),
                         F.col("dead_below").cast("double") * F.col("alive_above").cast("double"))
    return out.withColumn("odds_ratio", F.round(ratio, digits))
