"""Cohort construction with exact marginals and prescribed odds ratios.

The reference builds numpy tables row by row; here every step is a Spark
job over a row skeleton ``(dataset, id)``:

* :func:`marginals` - counts from rates (ceil / floor rules) per config row;
* :func:`expected_cells` - the 2x2 cells hitting a target odds ratio, from
  the quadratic (OR-1)s^2 + (L-A-OR*L-OR*D)s + OR*L*D = 0, as column math;
* :func:`assign_outcome` / :func:`quota_assign` - exact quotas per stratum in
  the order of md5(id:seed), by hash cuts (:mod:`quotas`);
* :func:`normal_attribute` - abs(round_half_even(mu + sigma*z)), z by
  Box-Muller on md5 uniforms;
* :func:`independent_marginals` and :func:`blocked_outcomes` - the other two
  generators of the reference.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.quotas import inside, quota_cuts

# Fixed values of the reference's generators.
# Fixed-rate variant (floor rounding): per lab the death rate, the low and the high rate and the odds ratio.
FIXED_RATES = {
    "PT": (0.099, 0.277, 0.723, 5.5),
    "PTT": (0.103, 0.079, 0.921, 8.8),
    "Platelets": (0.09, 0.034, 0.966, 4.8),
}
# Per-dataset seeds: age j, gender j+1, PT j+2, PTT j+3, platelets j+4, HF j+5, DOA j+6.
SEED_OFFSETS = {"Age": 0, "Gender": 1, "PT": 2, "PTT": 3, "Platelets": 4, "HF": 5, "DOA": 6}
# Independent-marginals cohort: 14,397 rows, 10,921 male; measured / low per lab.
INDEPENDENT_COUNTS = {
    "n": 14397, "male": 10921,
    "labs": {"PT": (10790, 2994), "PTT": (10453, 826), "Platelets": (11290, 381)},
}
# Blocked outcomes: blocks of 1,000 rows with these death rates, in order.
BLOCK_DEATH_RATES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99]
AGE_MU, AGE_SIGMA = 36.0, 19.0


def _round(c: Column, rule: str) -> Column:
    return (F.ceil(c) if rule == "ceil" else F.floor(c)).cast("long")


def marginals(config: DataFrame, rounding: str = "ceil") -> DataFrame:
    """Counts from rates, one config row per (…, feature).

    Input columns: ``n``, ``dead_rate``, ``low_rate`` (exposed share),
    optional ``high_rate``. dead = R(n*dead_rate); low = R(n*low_rate);
    high = R(n*high_rate) when given, else n - low. R is ceil (v1/v2) or
    floor (fixed-rate variant).
    """
    n = F.col("n")
    dead = _round(n * F.col("dead_rate"), rounding)
    low = _round(n * F.col("low_rate"), rounding)
    has_high = "high_rate" in config.columns
    high = (F.when(F.col("high_rate").isNotNull(), _round(n * F.col("high_rate"), rounding))
            .otherwise(n - low)) if has_high else (n - low)
    return (config.withColumn("dead", dead).withColumn("alive", n - F.col("dead"))
            .withColumn("low", low).withColumn("high", high.cast("long")))


def fixed_rate_config(sizes: DataFrame, n: str = "n") -> DataFrame:
    """The fixed-rate variant's configuration for every row of ``sizes``: one row per lab."""
    labs = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(d).alias("dead_rate"), F.lit(lo).alias("low_rate"),
                              F.lit(hi).alias("high_rate"), F.lit(o).alias("odds_ratio"))
                     for k, (d, lo, hi, o) in FIXED_RATES.items()])
    keys = [c for c in sizes.columns if c != n]
    return sizes.select(*keys, F.col(n).alias("n"), F.explode(labs).alias("_cl_l")).select(*keys, "n", "_cl_l.*")


def expected_cells(marg: DataFrame, odds_ratio: str = "odds_ratio") -> DataFrame:
    """Cells (dead_low, dead_high, alive_low, alive_high) for a target odds ratio.

    s = the smaller admissible root, dead_low = ceil(s), clamped to the
    feasible range [max(0, D - H), min(L, D)]. OR = 1 gives ceil(L*D/N). The
    cells are null, and ``reason`` says why, when a marginal or the odds ratio
    is null, the odds ratio is negative, the roots are complex or no cell fits
    the marginals.
    """
    o = F.col(odds_ratio).cast("double")
    L, H, D, A, N = (F.col(c).cast("double") for c in ("low", "high", "dead", "alive", "n"))
    p = o - F.lit(1.0)
    q = L - A - o * L - o * D
    r = o * L * D
    disc = q * q - F.lit(4.0) * p * r
    root = F.sqrt(disc)
    r1 = F.try_divide(-q + root, F.lit(2.0) * p)
    r2 = F.try_divide(-q - root, F.lit(2.0) * p)
    lo_b = F.greatest(F.lit(0.0), D - H)
    hi_b = F.least(L, D)
    small, big = F.least(r1, r2), F.greatest(r1, r2)
    reason = (F.when(L.isNull() | H.isNull() | D.isNull() | A.isNull() | N.isNull(), F.lit("missing marginal"))
              .when(o.isNull(), F.lit("no odds ratio"))
              .when(o < 0, F.lit("negative odds ratio"))
              .when((lo_b > hi_b) | (L < 0) | (D < 0), F.lit("infeasible marginals"))
              .when((p != 0) & (disc < 0), F.lit("complex roots")))
    s = (F.when(reason.isNotNull(), F.lit(None).cast("double"))
         .when(p == 0, F.try_divide(L * D, N))
         .when((small >= lo_b - F.lit(1.0)) & (small <= hi_b), small)
         .otherwise(big))
    # greatest and least skip nulls: without a root there must be no cell.
    dl = F.when(s.isNotNull(), F.least(F.greatest(F.ceil(s).cast("double"), lo_b), hi_b)).cast("long")
    out = (marg.withColumn("dead_low", dl)
           .withColumn("dead_high", F.col("dead") - F.col("dead_low"))
           .withColumn("alive_low", F.col("low") - F.col("dead_low"))
           .withColumn("alive_high", F.col("high") - F.col("dead_high")))
    realised = F.try_divide(F.col("dead_low").cast("double") * F.col("alive_high").cast("double"),
                            F.col("dead_high").cast("double") * F.col("alive_low").cast("double"))
    return out.withColumn("realised_or", F.round(realised, 6)).withColumn("reason", reason)


def _seeded_hash(key: str, seed: Column) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), seed.cast("string")))


def assign_outcome(skeleton: DataFrame, quotas: DataFrame, by: Sequence[str] = ("dataset_id",),
                   key: str = "id", seed: Column | int = 0, outcome: str = "DOA",
                   dead_col: str = "dead") -> DataFrame:
    """Exactly ``dead`` rows per stratum get outcome 0 (dead), the rest 1.

    ``quotas`` has one row per stratum (configuration). The rows with the
    lowest md5(id:seed) are the dead ones. A stratum without a quota has none.
    """
    seed_c = seed if isinstance(seed, Column) else F.lit(seed)
    digest = F.coalesce(_seeded_hash(key, seed_c), F.lit(""))
    rows = skeleton.select(*by, F.lit(outcome).alias("_cl_item"), digest.alias("_cl_h"), key)
    slots = quotas.select(*by, F.lit(outcome).alias("_cl_item"), F.lit(0).alias("_cl_slot"), F.col(dead_col).alias("_cl_quota"))
    cuts = quota_cuts(rows, list(by), key, slots)
    return (skeleton.join(cuts, list(by), "left")
            .withColumn(outcome, F.when(inside(outcome, 0, digest, key), F.lit(0.0)).otherwise(F.lit(1.0))).drop("_cl_cuts"))


def quota_assign(df: DataFrame, cells: DataFrame, features: Sequence[str], by: Sequence[str] = ("dataset_id",),
                 key: str = "id", outcome: str = "DOA", seeds: Mapping[str, Column | int] | None = None,
                 dead: float = 0.0) -> DataFrame:
    """Give every feature exact cell counts inside each outcome stratum.

    Within dead rows the first ``dead_low`` (md5 order) get 0 and the next
    ``dead_high`` get 1; within alive rows likewise with ``alive_low`` /
    ``alive_high``; rows beyond both quotas, and all rows where the cells are
    null, stay null (unassigned). Columns of ``df`` named like a feature are replaced.
    """
    seeds = seeds or {f: F.lit(SEED_OFFSETS.get(f, i)) for i, f in enumerate(features)}
    base = df.select(*[c for c in df.columns if c not in features])
    digests = {f: F.coalesce(_seeded_hash(key, seeds[f] if isinstance(seeds[f], Column) else F.lit(seeds[f])), F.lit(""))
               for f in features}
    strata = [*by, "_cl_dead"]
    flagged = base.withColumn("_cl_dead", F.col(outcome) == F.lit(dead))
    long = (flagged.select(*strata, key, F.explode(F.array(*[F.struct(F.lit(f).alias("item"), d.alias("h")) for f, d in digests.items()])).alias("_cl_x"))
            .select(*strata, key, F.col("_cl_x.item").alias("_cl_item"), F.col("_cl_x.h").alias("_cl_h")))
    side = F.explode(F.array(F.struct(F.lit(True).alias("d"), F.col("dead_low").alias("lo"), F.col("dead_high").alias("hi")),
                             F.struct(F.lit(False).alias("d"), F.col("alive_low").alias("lo"), F.col("alive_high").alias("hi"))))
    quota = F.explode(F.array(F.struct(F.lit(0).alias("slot"), F.col("_cl_s.lo").alias("q")),
                              F.struct(F.lit(1).alias("slot"), (F.col("_cl_s.lo") + F.col("_cl_s.hi")).alias("q"))))
    slots = (cells.where(F.col("feature").isin(list(features))).select(*by, F.col("feature").alias("_cl_item"), side.alias("_cl_s"))
             .select(*by, F.col("_cl_s.d").alias("_cl_dead"), "_cl_item", quota.alias("_cl_q"))
             .select(*strata, "_cl_item", F.col("_cl_q.slot").alias("_cl_slot"), F.col("_cl_q.q").alias("_cl_quota")))
    cuts = quota_cuts(long, strata, key, slots)
    labelled = flagged.join(cuts, strata, "left")
    values = [F.when(inside(f, 0, d, key), F.lit(0.0)).when(inside(f, 1, d, key), F.lit(1.0)).alias(f) for f, d in digests.items()]
    return labelled.select(*base.columns, *values)


def normal_attribute(df: DataFrame, key: str, seed: Column | int | str, mu: float = AGE_MU,
                     sigma: float = AGE_SIGMA, out: str = "Age") -> DataFrame:
    """abs(round_half_even(mu + sigma * z)), z standard normal by Box-Muller.

    The two uniforms are md5-derived from (key, seed), so the attribute is a
    pure function of the row: reproducible across retries and engines.
    """
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    u1 = _uniform(key, F.concat(s.cast("string"), F.lit("a")))
    u2 = _uniform(key, F.concat(s.cast("string"), F.lit("b")))
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return df.withColumn(out, F.abs(F.bround(F.lit(mu) + F.lit(sigma) * z, 0)))


def _uniform(key: str, seed: Column) -> Column:
    digits = F.substring(_seeded_hash(key, seed), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16 ** 13))


def synthesize_cohorts(skeleton: DataFrame, dead_quota: DataFrame, cells: DataFrame, features: Sequence[str],
                       by: Sequence[str] = ("dataset_id",), key: str = "id") -> DataFrame:
    """Outcome (exact deaths), age (normal draw) and features (exact cells) for every dataset at once.

    Seeds follow the reference's per-dataset scheme (j = dataset number):
    age j, gender j+1, PT j+2, PTT j+3, platelets j+4, HF j+5, DOA j+6.
    """
    ds = F.col(by[0]).cast("long")
    with_outcome = assign_outcome(skeleton.select(*by, key), dead_quota, by, key,
                                  seed=ds + F.lit(SEED_OFFSETS["DOA"]))
    with_age = normal_attribute(with_outcome, key, ds + F.lit(SEED_OFFSETS["Age"]))
    seeds = {f: ds + F.lit(SEED_OFFSETS.get(f, 10 + i)) for i, f in enumerate(features)}
    return quota_assign(with_age, cells, features, by, key, "DOA", seeds)


def independent_marginals(skeleton: DataFrame, by: Sequence[str] = ("dataset_id",), key: str = "id",
                          counts: Mapping = INDEPENDENT_COUNTS, seed: int = 11) -> DataFrame:
    """Gender and labs drawn independently with exact counts, labs partly missing.

    Per stratum of size n the reference counts are scaled as floor(n * c / N):
    ``male`` rows get gender 1 (the rest 0); for each lab ``measured`` rows get
    a value, of which ``low`` get 0 and the rest 1; unmeasured rows stay null.
    """
    total = float(counts["n"])
    sizes = skeleton.groupBy(*by).agg(F.count(F.lit(1)).alias("_cl_n"))

    def scaled(c: int) -> Column:
        return F.floor(F.col("_cl_n") * F.lit(float(c)) / F.lit(total)).cast("long")

    labs = list(counts["labs"])
    items = ["Gender", *labs]

    def slots(counted: Mapping[str, int]) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("item"), scaled(c).alias("q")) for x, c in counted.items()]))
        return (sizes.select(*by, pairs.alias("_cl_p"))
                .select(*by, F.col("_cl_p.item").alias("_cl_item"), F.lit(0).alias("_cl_slot"), F.col("_cl_p.q").alias("_cl_quota")))

    def digest(item: str, draw: str) -> Column:
        return F.coalesce(_seeded_hash(key, F.lit(f"{seed}:{draw}{item}")), F.lit(""))

    def long(df: DataFrame, names: Sequence[str], draw: str, when: Mapping[str, Column]) -> DataFrame:
        cells = F.array(*[F.when(when.get(x, F.lit(True)), F.struct(F.lit(x).alias("item"), digest(x, draw).alias("h"))) for x in names])
        return (df.select(*by, key, F.explode(cells).alias("_cl_x")).where(F.col("_cl_x").isNotNull())
                .select(*by, key, F.col("_cl_x.item").alias("_cl_item"), F.col("_cl_x.h").alias("_cl_h")))

    base = skeleton.select(*by, key)
    first = quota_cuts(long(base, items, "", {}), list(by), key,
                       slots({"Gender": counts["male"], **{x: counts["labs"][x][0] for x in labs}}))
    drawn = base.join(first, list(by), "left").select(
        *by, key, *[inside(x, 0, digest(x, ""), key).alias(f"_cl_in_{x}") for x in items])
    second = quota_cuts(long(drawn, labs, "low:", {x: F.col(f"_cl_in_{x}") for x in labs}), list(by), key,
                        slots({x: counts["labs"][x][1] for x in labs}))
    low = lambda x: F.when(inside(x, 0, digest(x, "low:"), key), F.lit(0.0)).otherwise(F.lit(1.0))
    return drawn.join(second, list(by), "left").select(
        *by, key, F.when(F.col("_cl_in_Gender"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("Gender"),
        *[F.when(F.col(f"_cl_in_{x}"), low(x)).alias(x) for x in labs])


def blocked_outcomes(indexed: DataFrame, index_col: str = "index", block: int = 1000,
                     rates: Sequence[float] = BLOCK_DEATH_RATES, seed: int = 10, outcome: str = "DOA",
                     key: str = "id") -> DataFrame:
    """Consecutive blocks of ``block`` rows with exact deaths per block.

    Block b (0-based) uses death rate ``rates[b mod len(rates)]``; deaths =
    floor(rate * rows in block), chosen by md5 rank inside the block (the
    reference seeds block b with 10*(b+1)).
    """
    b = F.floor((F.col(index_col) - F.lit(1)) / F.lit(block)).cast("long")
    with_b = indexed.withColumn("_cl_b", b)
    rate = F.element_at(F.array(*[F.lit(float(r)) for r in rates]),
                        (F.col("_cl_b") % F.lit(len(rates)) + F.lit(1)).cast("int"))
    # A block is a window of bounded size, so its rows are ranked directly.
    digest = _seeded_hash(key, (F.col("_cl_b") + F.lit(1)) * F.lit(seed))
    ranked = (with_b.withColumn("_cl_rows", F.count(F.lit(1)).over(Window.partitionBy("_cl_b")))
              .withColumn("_cl_rank", F.row_number().over(Window.partitionBy("_cl_b").orderBy(digest, key))))
    dead = F.floor(rate * F.col("_cl_rows")).cast("long")
    return (ranked.withColumn(outcome, F.when(F.col("_cl_rank") <= dead, F.lit(0.0)).otherwise(F.lit(1.0)))
            .drop("_cl_rows", "_cl_rank").withColumnRenamed("_cl_b", "block"))
