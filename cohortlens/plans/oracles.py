"""DuckDB SQL twins of the registered queries (the correctness oracle).

Every query reads the pre-registered driver views (lineitem, documents,
labels, ...). Column names and types match the Spark results.
"""

from __future__ import annotations

import math

# The cohort adapter (see cohortlens.sources.testdata), written once as SQL.
COHORT_CTE = """cohort AS (
  SELECT l_linenumber AS dataset_id,
         CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                          l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS id,
         CAST(l_quantity AS DOUBLE) AS Age,
         CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS Gender,
         CASE WHEN l_discount >= 0.03 THEN 1.0 ELSE 0.0 END::DOUBLE AS PT,
         CASE WHEN l_tax >= 0.02 THEN 1.0 ELSE 0.0 END::DOUBLE AS PTT,
         CASE WHEN l_extendedprice >= 30000 THEN 1.0 ELSE 0.0 END::DOUBLE AS Platelets,
         CASE WHEN l_suppkey % 5 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS HF,
         CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS DOA
  FROM lineitem)"""

CLINICAL_CTE = """clinical AS (
  SELECT d.doc_id, d.n_chars, l.quality, l.toxic, d.lang, d.source,
         CAST(d.lang = 'en' AS INTEGER) AS outcome
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

FEATURES = ["Gender", "PT", "PTT", "Platelets", "HF"]


def _cells_union(features, by: str = "") -> str:
    sel_by = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    parts = []
    for f in features:
        parts.append(
            f"SELECT {sel_by}'{f}' AS feature, "
            f"CAST(count(*) FILTER (WHERE DOA = 0 AND {f} = 0) AS BIGINT) AS dead_low, "
            f"CAST(count(*) FILTER (WHERE DOA = 0 AND {f} <> 0) AS BIGINT) AS dead_high, "
            f"CAST(count(*) FILTER (WHERE DOA <> 0 AND {f} = 0) AS BIGINT) AS alive_low, "
            f"CAST(count(*) FILTER (WHERE DOA <> 0 AND {f} <> 0) AS BIGINT) AS alive_high "
            f"FROM cohort{grp}")
    return "\nUNION ALL\n".join(parts)


_OR = ("round(CAST(dead_low AS DOUBLE) * alive_high / "
       "NULLIF(CAST(dead_high AS DOUBLE) * alive_low, 0), 6)")


CORR_COLS = ["Age", "Gender", "PT", "PTT", "Platelets", "DOA"]


def _blocks_cte(k: int) -> str:
    return f"""blocked AS (
  SELECT c.*, CAST(floor((id - 1) / {k}) AS BIGINT) AS block,
         floor((id - 1) / {k}) >= floor((SELECT count(*) FROM cohort) / {k}) AS is_tail
  FROM cohort c)"""


BLOCKS_CTE = _blocks_cte(2300)


def _corr_sql(src: str, method: str) -> str:
    cols = CORR_COLS
    aggs = [f"stddev_pop({c}) AS sd_{c}" for c in cols]
    aggs += [f"covar_pop({a}, {b}) AS cv_{a}_{b}" for i, a in enumerate(cols) for b in cols[i + 1:]]
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                v = "CAST(1.0 AS DOUBLE)"
            else:
                x, y = (a, b) if cols.index(a) < cols.index(b) else (b, a)
                v = f"round(cv_{x}_{y} / NULLIF(sd_{x} * sd_{y}, 0), 6)"
            parts.append(f"SELECT block, '{method}' AS method, '{a}' AS feature_a, '{b}' AS feature_b, {v} AS value FROM w")
    return f"w AS (SELECT block, {', '.join(aggs)} FROM {src} GROUP BY block)\n" + "\nUNION ALL\n".join(parts)


def _ranked_cte(cols) -> str:
    rk = ", ".join(
        f"rank() OVER (PARTITION BY block ORDER BY {c}) + (count(*) OVER (PARTITION BY block, {c}) - 1) / 2.0 AS {c}"
        for c in cols)
    return f"ranked AS (SELECT block, {rk} FROM blocked WHERE NOT is_tail)"


def _u(key: str, seed) -> str:
    return (f"((('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 13))::BIGINT + 0.5) "
            f"/ 4503599627370496.0)")


SCORED_CTE = """mapping AS (
  SELECT DOA, CAST(row_number() OVER (ORDER BY n DESC, CAST(DOA AS VARCHAR)) - 1 AS DOUBLE) AS label
  FROM (SELECT DOA, count(*) AS n FROM cohort GROUP BY DOA)),
scored AS (
  SELECT c.*, m.label,
         CASE WHEN (PT = 0 AND Platelets = 0) OR Age > 45 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction
  FROM cohort c LEFT JOIN mapping m ON c.DOA = m.DOA)"""

CONF = """count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn,
  count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn,
  count(*) AS n"""


SEEDS = {"Age": 0, "Gender": 1, "PT": 2, "PTT": 3, "Platelets": 4, "HF": 5, "DOA": 6}


def _config_cte(src: str = "cohort") -> str:
    return f"""cells AS ({_cells_union(FEATURES, 'dataset_id').replace('FROM cohort', 'FROM ' + src)}),
sizes AS (SELECT dataset_id, count(*) AS n, count(*) FILTER (WHERE DOA = 0) AS dead FROM {src} GROUP BY dataset_id),
cfg AS (SELECT c.dataset_id, c.feature, s.n, s.dead, s.n - s.dead AS alive,
               c.dead_low + c.alive_low AS low, c.dead_high + c.alive_high AS high,
               CAST(c.dead_low AS DOUBLE) * c.alive_high / NULLIF(CAST(c.dead_high AS DOUBLE) * c.alive_low, 0)
                 AS odds_ratio
        FROM cells c JOIN sizes s USING (dataset_id)),
pq AS (SELECT *, odds_ratio - 1.0 AS p,
              CAST(low AS DOUBLE) - CAST(alive AS DOUBLE) - odds_ratio * low - odds_ratio * dead AS q,
              odds_ratio * low * dead AS r,
              greatest(0.0, CAST(dead AS DOUBLE) - high) AS lo_b, least(CAST(low AS DOUBLE), dead) AS hi_b
       FROM cfg),
roots AS (SELECT *, q * q - 4.0 * p * r AS disc,
                 (-q + sqrt(CASE WHEN q * q - 4.0 * p * r >= 0 THEN q * q - 4.0 * p * r END)) / NULLIF(2.0 * p, 0) AS r1,
                 (-q - sqrt(CASE WHEN q * q - 4.0 * p * r >= 0 THEN q * q - 4.0 * p * r END)) / NULLIF(2.0 * p, 0) AS r2
          FROM pq),
sel AS (SELECT *, CASE WHEN odds_ratio IS NULL OR odds_ratio < 0 OR lo_b > hi_b OR (p <> 0 AND disc < 0) THEN NULL
                       WHEN p = 0 THEN CAST(low AS DOUBLE) * dead / n
                       WHEN least(r1, r2) >= lo_b - 1.0 AND least(r1, r2) <= hi_b THEN least(r1, r2)
                       ELSE greatest(r1, r2) END AS s
        FROM roots),
ec0 AS (SELECT dataset_id, feature, n, dead, alive, low, high, odds_ratio, p, disc, lo_b, hi_b,
               CASE WHEN s IS NOT NULL THEN CAST(least(greatest(ceil(s), lo_b), hi_b) AS BIGINT) END AS dead_low FROM sel),
ec AS (SELECT dataset_id, feature, n, dead, alive, low, high, round(odds_ratio, 6) AS odds_ratio, dead_low,
              dead - dead_low AS dead_high, low - dead_low AS alive_low, high - (dead - dead_low) AS alive_high,
              round(CAST(dead_low AS DOUBLE) * (high - (dead - dead_low))
                    / NULLIF(CAST(dead - dead_low AS DOUBLE) * (low - dead_low), 0), 6) AS realised_or,
              CASE WHEN odds_ratio IS NULL THEN 'no odds ratio' WHEN odds_ratio < 0 THEN 'negative odds ratio'
                   WHEN lo_b > hi_b THEN 'infeasible marginals'
                   WHEN p <> 0 AND disc < 0 THEN 'complex roots' END AS reason
       FROM ec0)"""


def _quota_sql(src: str, seed_sql) -> str:
    """Rows of ``src`` (dataset_id, id, DOA, ...) with exact per-feature quotas from ``ec``."""
    vals = ", ".join(f"('{f}', {seed_sql(f)})" for f in FEATURES)
    piv = ", ".join(f"max(value) FILTER (WHERE feature = '{f}') AS {f}" for f in FEATURES)
    return f"""lng AS (
  SELECT x.dataset_id, x.id, x.DOA, f.feature,
         row_number() OVER (PARTITION BY x.dataset_id, x.DOA, f.feature
                            ORDER BY md5(CAST(x.id AS VARCHAR) || ':' || CAST(f.seed AS VARCHAR)), x.id) AS rk
  FROM {src} x CROSS JOIN LATERAL (SELECT * FROM (VALUES {vals}) v(feature, seed)) f),
val AS (
  SELECT l.dataset_id, l.id, l.feature,
         CASE WHEN rk <= (CASE WHEN l.DOA = 0 THEN e.dead_low ELSE e.alive_low END) THEN 0.0
              WHEN rk <= (CASE WHEN l.DOA = 0 THEN e.dead_low + e.dead_high ELSE e.alive_low + e.alive_high END)
              THEN 1.0 END::DOUBLE AS value
  FROM lng l LEFT JOIN ec e ON l.dataset_id = e.dataset_id AND l.feature = e.feature),
wide AS (SELECT dataset_id, id, {piv} FROM val GROUP BY dataset_id, id)"""


def _uniform_sql(key: str, seed_sql: str) -> str:
    return (f"((('0x' || substr(md5(CAST({key} AS VARCHAR) || ':' || {seed_sql}), 1, 13))::BIGINT + 0.5) "
            f"/ 4503599627370496.0)")


def _age_sql(key: str, seed_sql: str) -> str:
    u1 = _uniform_sql(key, f"{seed_sql} || 'a'")
    u2 = _uniform_sql(key, f"{seed_sql} || 'b'")
    return f"CAST(abs(round_even(36.0 + 19.0 * (sqrt(-2.0 * ln({u1})) * cos(2 * pi() * {u2})), 0)) AS DOUBLE)"


DIST = ["Gender", "PT", "PTT", "Platelets", "DOA", "Age"]
PAIRS_CTE = """pairs AS (
  SELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b
  FROM (SELECT DISTINCT dataset_id FROM cohort) a JOIN (SELECT DISTINCT dataset_id FROM cohort) b
    ON a.dataset_id < b.dataset_id),
ext AS (SELECT dataset_id, min(Age) AS mn, max(Age) AS mx FROM cohort GROUP BY dataset_id),
pm AS (SELECT p.ds_a, p.ds_b, least(ea.mn, eb.mn) AS lo, greatest(ea.mx, eb.mx) AS hi
       FROM pairs p JOIN ext ea ON ea.dataset_id = p.ds_a JOIN ext eb ON eb.dataset_id = p.ds_b),
prow AS (
  SELECT pm.ds_a, pm.ds_b, CASE WHEN c.dataset_id = pm.ds_a THEN 0 ELSE 1 END AS side, c.id,
         c.Gender, c.PT, c.PTT, c.Platelets, c.DOA,
         CASE WHEN pm.hi = pm.lo THEN 0.0 ELSE (c.Age - pm.lo) / (pm.hi - pm.lo) END AS Age
  FROM pm JOIN cohort c ON c.dataset_id = pm.ds_a OR c.dataset_id = pm.ds_b)"""
ROWSUM = "round(Gender + PT + PTT + Platelets + DOA + Age, 9)"
RANKED_CTE = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ds_a, ds_b, side ORDER BY {ROWSUM}, id) AS rank FROM prow),
matched AS (
  SELECT l.ds_a, l.ds_b, l.rank, l.id AS l_id, r.id AS r_id,
         (abs(l.Gender - r.Gender) + abs(l.PT - r.PT) + abs(l.PTT - r.PTT) + abs(l.Platelets - r.Platelets)
          + abs(l.DOA - r.DOA) + abs(l.Age - r.Age)) / 6.0 AS distance
  FROM ranked l JOIN ranked r ON l.ds_a = r.ds_a AND l.ds_b = r.ds_b AND l.rank = r.rank
  WHERE l.side = 0 AND r.side = 1)"""


def _summary_sql(src: str, weight: str = "1", extra: bool = True, nulls: bool = False, incomplete: str = "0") -> str:
    cols = [f"CAST(sum({weight}) AS BIGINT) AS n_matched",
            f"round(sum(distance * {weight}) / sum({weight}), 6) AS avg_distance",
            "round(min(distance), 6) AS min_distance", "round(max(distance), 6) AS max_distance",
            f"round(CAST(sum(CASE WHEN distance <= 0 THEN {weight} ELSE 0 END) AS DOUBLE) * 100.0 / sum({weight}), 6)"
            " AS zero_dist_percent"]
    if nulls:
        cols.append("CAST(0 AS BIGINT) AS n_null")
    if extra:
        cols += [f"round(sum(distance * {weight}), 6) AS distance_sum",
                 f"CAST(sum({weight}) - sum(CASE WHEN distance <= 0 THEN {weight} ELSE 0 END) AS BIGINT) AS n_nonzero"]
    if not nulls:
        cols.append(f"CAST({incomplete} AS BIGINT) AS n_incomplete")
    return f"SELECT ds_a, ds_b, {', '.join(cols)} FROM {src} GROUP BY ds_a, ds_b"


#: The cohort with every 7th Age and 11th PT missing, the rows without gaps, and the numbers of the others by dataset.
GAPPY_CTE = """gappy AS (SELECT * REPLACE (CASE WHEN id % 7 <> 0 THEN Age END AS Age, CASE WHEN id % 11 <> 0 THEN PT END AS PT) FROM whole),
cohort AS (SELECT * FROM gappy WHERE Age IS NOT NULL AND PT IS NOT NULL),
gaps AS (SELECT dataset_id, count(*) FILTER (WHERE Age IS NULL OR PT IS NULL) AS g, count(*) FILTER (WHERE Age IS NOT NULL AND PT IS NOT NULL) AS c
         FROM gappy GROUP BY dataset_id)"""


def _greedy_state(name: str, start: str, which: str) -> str:
    """Cells by (pair, side, p, a) with their free rows, after one class of edges an iteration; side 2 has the rows matched by
    class, side 9 the class reached. No two edges of a class (mask, difference) share a cell."""
    return f"""{name}(ds_a, ds_b, side, p, a, n) USING KEY (ds_a, ds_b, side, p, a) AS (
  {start} UNION ALL SELECT 0, 0, 9, 0, 0, (SELECT min(idx) - 1 FROM classes WHERE {which})
  UNION
  (WITH c AS (SELECT classes.* FROM classes JOIN recurring.{name} s ON s.side = 9 AND classes.idx = s.n + 1 WHERE {which}),
   hit AS (SELECT l.ds_a, l.ds_b, l.p AS lp, l.a AS la, r.p AS rp, r.a AS ra, l.n AS ln, r.n AS rn, least(l.n, r.n) AS m, l.idx
           FROM (SELECT s.*, c.idx, xor(s.p, c.mask) AS tp, s.a + c.delta AS ta FROM recurring.{name} s, c WHERE s.side = 0 AND s.n > 0) l
           JOIN (SELECT * FROM recurring.{name} WHERE side = 1 AND n > 0) r ON r.ds_a = l.ds_a AND r.ds_b = l.ds_b AND r.p = l.tp AND r.a = l.ta)
   SELECT ds_a, ds_b, 0, lp, la, ln - m FROM hit UNION ALL SELECT ds_a, ds_b, 1, rp, ra, rn - m FROM hit
   UNION ALL SELECT ds_a, ds_b, 2, 0, idx, sum(m)::BIGINT FROM hit GROUP BY ds_a, ds_b, idx UNION ALL SELECT 0, 0, 9, 0, 0, idx FROM c))"""


def _draw(n: str, tag: int, seed: int, keys: str) -> str:
    """A Poisson number of copies of a cell's ``n`` rows, by the md5 of its place."""
    digest = f"md5(concat_ws(':', fold, tree, {keys}) || ':{tag}:{seed}')"
    unit = lambda at: f"((('0x' || substr({digest}, {at}, 13))::BIGINT + 0.5) / 4503599627370496.0)"
    return (f"CASE WHEN {n} <= 0 THEN 0 WHEN {n} <= 16 THEN len(list_filter((SELECT list(ends ORDER BY k) FROM poisson)[{n}], lambda x: {unit(1)} >= x)) "
            f"ELSE greatest(0, {n} + CAST(round(sqrt({n}::DOUBLE) * (sqrt(-2.0 * ln({unit(1)})) * cos({2.0 * math.pi!r} * {unit(14)}))) AS BIGINT)) END")


def _poisson_rows() -> str:
    rows = []
    for n in range(1, 17):
        ends, k, total = [], 0, 0.0
        while total < 1.0 - 1e-13 and k < 100:
            total += math.exp(-n + k * math.log(n) - math.lgamma(k + 1))
            ends.append(total)
            k += 1
        rows.append(f"({n}, [{', '.join(map(repr, ends))}])")
    return ", ".join(rows)


def _forest_ctes(d: int, trees: int, depth: int, chosen: int, seed: int) -> str:
    """CTEs ``splits`` and ``voted`` of a forest per fold, grown from ``cells(fold, b0, ..., n0, n1, t0, t1)`` level by level."""
    b = [f"b{i}" for i in range(d)]
    keys = ", ".join(b)
    value = lambda f: "CASE " + f + " " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(b)) + " END"
    square = lambda s: f"(({s}0::DOUBLE * {s}0 + {s}1::DOUBLE * {s}1) / ({s}0 + {s}1)::DOUBLE)"
    share = lambda s: f"CASE WHEN {s}0 + {s}1 > 0 THEN {s}1 * 1000000 // ({s}0 + {s}1) ELSE 0 END"
    out = [f"poisson(k, ends) AS (VALUES {_poisson_rows()})",
           f"""g0 AS MATERIALIZED (SELECT * FROM (SELECT fold, tree, {keys}, {_draw('n0', 0, seed, keys)}::BIGINT AS w0, {_draw('n1', 1, seed, keys)}::BIGINT AS w1, 1 AS node
  FROM cells, range({trees}) r(tree) WHERE n0 + n1 > 0) WHERE w0 + w1 > 0)""",
           "roots AS MATERIALIZED (SELECT fold, tree, sum(w0)::BIGINT AS r0, sum(w1)::BIGINT AS r1 FROM g0 GROUP BY ALL)",
           f"v0 AS MATERIALIZED (SELECT fold, tree, {keys}, 1 AS node, {share('r')} AS p FROM cells JOIN roots USING (fold))"]
    for i in range(depth):
        hist = " UNION ALL ".join(f"SELECT fold, tree, node, {f} AS f, {c} AS bin, w0, w1 FROM g{i}" for f, c in enumerate(b))
        out += [f"h{i} AS MATERIALIZED (SELECT fold, tree, node, f, bin, sum(w0)::BIGINT AS w0, sum(w1)::BIGINT AS w1 FROM ({hist}) GROUP BY ALL)",
                f"""s{i} AS MATERIALIZED (
  SELECT fold, tree, node, f, bin, l0, l1, r0, r1, score - parent AS gain FROM (
    SELECT *, {square('l')} + {square('r')} AS score, {square('a')} AS parent FROM (
      SELECT *, a0 - l0 AS r0, a1 - l1 AS r1 FROM (
        SELECT *, sum(w0) OVER up AS l0, sum(w1) OVER up AS l1, sum(w0) OVER whole AS a0, sum(w1) OVER whole AS a1 FROM h{i}
        WINDOW up AS (PARTITION BY fold, tree, node, f ORDER BY bin), whole AS (PARTITION BY fold, tree, node, f)))
    WHERE r0 + r1 > 0 AND a0 > 0 AND a1 > 0)
  JOIN (SELECT fold, tree, node, f FROM (SELECT DISTINCT fold, tree, node, f FROM h{i})
        QUALIFY row_number() OVER (PARTITION BY fold, tree, node ORDER BY md5(concat_ws(':', fold, tree, node, f, {seed}))) <= {chosen}) USING (fold, tree, node, f)
  WHERE score > parent * {1.0 + 1e-12!r}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY fold, tree, node ORDER BY score DESC, f, bin) = 1)""",
                f"""g{i + 1} AS MATERIALIZED (SELECT fold, tree, {keys}, w0, w1, 2 * node + CAST({value('f')} > bin AS INTEGER) AS node
  FROM g{i} JOIN (SELECT fold, tree, node, f, bin FROM s{i}) USING (fold, tree, node))""",
                f"""v{i + 1} AS MATERIALIZED (SELECT fold, tree, {keys}, CASE WHEN f IS NULL THEN -1 ELSE 2 * node + CAST({value('f')} > bin AS INTEGER) END AS node,
  CASE WHEN f IS NULL THEN p WHEN {value('f')} > bin THEN {share('r')} ELSE {share('l')} END AS p FROM v{i} LEFT JOIN s{i} USING (fold, tree, node))"""]
    out.append("splits AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(depth)) + ")")
    out.append(f"""voted AS (SELECT cells.*, CAST(2 * votes > {trees} * 1000000 AS INTEGER) AS prediction
  FROM cells JOIN (SELECT fold, {keys}, sum(p) AS votes FROM v{depth} GROUP BY ALL) USING (fold, {keys}))""")
    return ",\n".join(out)


def _bin_ctes(source: str, features, max_bins: int) -> str:
    """CTEs ``bin_<i>`` (v, b): a bin for each value, or for about equal shares of the rows where there are too many values."""
    return ",\n".join(f"""bin_{i} AS MATERIALIZED (SELECT v, dense_rank() OVER (ORDER BY o) - 1 AS b FROM (
  SELECT v, CASE WHEN count(*) OVER () <= {max_bins} THEN v ELSE floor((sum(n) OVER (ORDER BY v) - n) * {max_bins} / (sum(n) OVER ())) END AS o
  FROM (SELECT {f}::DOUBLE AS v, count(*) AS n FROM {source} GROUP BY ALL)))""" for i, f in enumerate(features))


def _binned(source: str, features) -> str:
    bins = ", ".join(f"bin_{i}.b AS b{i}" for i in range(len(features)))
    return f"SELECT {source}.*, {bins} FROM {source} " + " ".join(f"JOIN bin_{i} ON bin_{i}.v = {f}" for i, f in enumerate(features))


def _leave_one_out(d: int, by_frequency: bool) -> str:
    """CTE ``cells`` from ``own(fold, tail, bins, c0, c1)``: every fold's training counts are all counts less its own."""
    keys = ", ".join(f"b{i}" for i in range(d))
    pick = "CASE WHEN flip THEN {} ELSE {} END" if by_frequency else "{1}"
    p = lambda a, b: pick.format(b, a)
    return f"""per_fold AS (
  SELECT f.fold, {keys}, a0 - coalesce(c0, 0) AS x0, a1 - coalesce(c1, 0) AS x1, coalesce(c0, 0) AS y0, coalesce(c1, 0) AS y1
  FROM (SELECT {keys}, sum(c0) AS a0, sum(c1) AS a1 FROM own GROUP BY ALL) CROSS JOIN (SELECT DISTINCT fold FROM own WHERE NOT tail) f
  LEFT JOIN own USING (fold, {keys})),
cells AS MATERIALIZED (SELECT fold, {keys}, {p('x0', 'x1')}::BIGINT AS n0, {p('x1', 'x0')}::BIGINT AS n1, {p('y0', 'y1')}::BIGINT AS t0, {p('y1', 'y0')}::BIGINT AS t1
  FROM per_fold JOIN (SELECT fold, sum(x1) > sum(x0) AS flip FROM per_fold GROUP BY fold) USING (fold))"""


MODEL = ["Age", "Gender", "PT", "PTT", "Platelets"]
MODEL_BINS = ", ".join(f"b{i}" for i in range(5))


def fold_cells_sql(k: int) -> str:
    return f"""WITH {COHORT_CTE}, {_blocks_cte(k)},
{_bin_ctes('cohort', MODEL, 100)},
own AS MATERIALIZED (SELECT block::INTEGER AS fold, is_tail AS tail, {MODEL_BINS}, count(*) FILTER (WHERE DOA = 0) AS c0, count(*) FILTER (WHERE DOA = 1) AS c1
  FROM ({_binned('blocked', MODEL)}) GROUP BY ALL),
{_leave_one_out(5, True)}"""


def folds_forest_sql(k: int, trees: int, depth: int) -> str:
    ratio = lambda a, b: f"round(({a})::DOUBLE / NULLIF(({b})::DOUBLE, 0), 6)"
    return f"""{fold_cells_sql(k)},
{_forest_ctes(5, trees, depth, 3, 5043)},
counts AS (SELECT fold::BIGINT AS num, (sum(t1) FILTER (WHERE prediction = 1)) AS p1, (sum(t0) FILTER (WHERE prediction = 0)) AS p2,
                  (sum(t0) FILTER (WHERE prediction = 1)) AS p3, (sum(t1) FILTER (WHERE prediction = 0)) AS p4, sum(t0 + t1)::BIGINT AS n FROM voted GROUP BY fold),
whole AS (SELECT num, coalesce(p1, 0)::BIGINT AS tp, coalesce(p2, 0)::BIGINT AS tn, coalesce(p3, 0)::BIGINT AS fp, coalesce(p4, 0)::BIGINT AS fn, n FROM counts)
SELECT *, {ratio('tp + tn', 'n')} AS accuracy, {ratio('tp', 'tp + fp')} AS "precision", {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM whole"""


def holdout_forest_sql() -> str:
    return f"""WITH {COHORT_CTE},
{_bin_ctes('cohort', MODEL, 100)},
cells AS MATERIALIZED (SELECT 0 AS fold, {MODEL_BINS}, count(*) FILTER (WHERE train AND DOA = 0) AS n0, count(*) FILTER (WHERE train AND DOA = 1) AS n1,
    count(*) FILTER (WHERE NOT train AND DOA = 0) AS t0, count(*) FILTER (WHERE NOT train AND DOA = 1) AS t1
  FROM (SELECT *, {_u('id', 5043)} < 0.7 AS train FROM ({_binned('cohort', MODEL)})) GROUP BY ALL),
{_forest_ctes(5, 20, 8, 3, 5043)}
SELECT 'forest' AS model, sum(t0 + t1)::BIGINT AS n, sum(CASE WHEN prediction = 1 THEN t1 ELSE t0 END)::BIGINT AS correct,
       round(sum(CASE WHEN prediction = 1 THEN t1 ELSE t0 END)::DOUBLE / sum(t0 + t1)::DOUBLE, 6) AS accuracy FROM voted"""


def importance_sql(trees: int, digits: int = 6) -> str:
    return f"""WITH {COHORT_CTE},
{_bin_ctes('cohort', MODEL, 100)},
dead AS (SELECT count(*) FILTER (WHERE DOA = 1) > count(*) FILTER (WHERE DOA = 0) AS fewer FROM cohort),
cells AS MATERIALIZED (SELECT 0 AS fold, {MODEL_BINS}, count(*) FILTER (WHERE (DOA = 1) = fewer) AS n0, count(*) FILTER (WHERE (DOA = 0) = fewer) AS n1, 0 AS t0, 0 AS t1
  FROM ({_binned('cohort', MODEL)}), dead GROUP BY ALL),
{_forest_ctes(5, trees, 8, 3, 5043)},
shares AS (SELECT fold, f, sum(g / whole) AS s FROM (SELECT fold, tree, f, sum(gain) AS g, sum(sum(gain)) OVER (PARTITION BY fold, tree) AS whole FROM splits GROUP BY fold, tree, f) GROUP BY ALL),
named(f, feature) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(MODEL))})
SELECT 0 AS fold, feature, round(coalesce(s / sum(s) OVER (), 0), {digits}) AS importance FROM named LEFT JOIN shares USING (f)"""


def clinical_cv_sql(folded: str) -> str:
    features = ["n_chars", "quality", "toxic"]
    return f"""WITH {CLINICAL_CTE},
folded AS MATERIALIZED (SELECT f.fold, f.outcome, n_chars::DOUBLE AS n_chars, coalesce(quality, -1)::DOUBLE AS quality, coalesce(toxic, -1)::DOUBLE AS toxic
  FROM ({folded}) f JOIN clinical USING (doc_id)),
{_bin_ctes('folded', features, 32)},
own AS MATERIALIZED (SELECT fold, false AS tail, b0, b1, b2, count(*) FILTER (WHERE outcome = 0) AS c0, count(*) FILTER (WHERE outcome = 1) AS c1
  FROM ({_binned('folded', features)}) GROUP BY ALL),
{_leave_one_out(3, False)},
{_forest_ctes(3, 10, 8, 2, 42)},
t AS (SELECT prediction AS p, sum(t0)::BIGINT AS c0, sum(t1)::BIGINT AS c1 FROM voted GROUP BY ALL),
m AS (SELECT c.c AS class, coalesce(sum(CASE WHEN c.c = 1 THEN c1 ELSE c0 END) FILTER (WHERE p = c.c), 0)::BIGINT AS tp, sum(CASE WHEN c.c = 1 THEN c1 ELSE c0 END)::BIGINT AS actual,
             coalesce(sum(c0 + c1) FILTER (WHERE p = c.c), 0)::BIGINT AS predicted FROM t, (VALUES (0), (1)) c(c) GROUP BY c.c)
SELECT class::DOUBLE AS class, tp, actual, predicted, round(tp::DOUBLE / NULLIF(predicted, 0), 6) AS "precision", round(tp::DOUBLE / NULLIF(actual, 0), 6) AS recall FROM m"""


def match_exact_sql() -> str:
    """The sorted-edge greedy matching by its rule, for whole-number ages: first equal findings, then the rest of the cells."""
    return f"""WITH RECURSIVE {COHORT_CTE.replace('cohort AS (', 'cohort AS MATERIALIZED (', 1)},
cells AS MATERIALIZED (SELECT dataset_id AS ds, CAST(16 * Gender + 8 * PT + 4 * PTT + 2 * Platelets + DOA AS INTEGER) AS p, CAST(Age AS INTEGER) AS a,
                              count(*) AS n FROM cohort GROUP BY ALL),
totals AS (SELECT ds, min(a) AS lo, max(a) AS hi, sum(n)::BIGINT AS n FROM cells GROUP BY ds),
sides AS MATERIALIZED (SELECT x.ds AS ds_a, y.ds AS ds_b, greatest(x.hi, y.hi) - least(x.lo, y.lo) AS width, x.n AS n_left FROM totals x JOIN totals y ON x.ds < y.ds),
classes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY bit_count(mask), k, mask, down) AS idx, mask, k, CASE WHEN down THEN -k ELSE k END AS delta
                         FROM (SELECT unnest(range(32))::INTEGER AS mask), (SELECT unnest(range((SELECT max(width) + 1 FROM sides)))::INTEGER AS k),
                              (VALUES (false), (true)) d(down) WHERE k > 0 OR NOT down),
{_greedy_state('same', "SELECT ds_a, ds_b, 0, p, a, n::BIGINT FROM sides JOIN cells ON ds = ds_a UNION ALL SELECT ds_a, ds_b, 1, p, a, n::BIGINT FROM sides JOIN cells ON ds = ds_b", 'mask = 0')},
{_greedy_state('rest', 'SELECT ds_a, ds_b, side, p, a, n FROM same WHERE side < 2 AND n > 0', 'mask > 0')},
d AS (SELECT ds_a, ds_b, m, (bit_count(mask) + k / width::DOUBLE) / 6 AS distance
      FROM (SELECT ds_a, ds_b, a AS idx, n AS m FROM same WHERE side = 2 UNION ALL SELECT ds_a, ds_b, a, n FROM rest WHERE side = 2) JOIN classes USING (idx) JOIN sides USING (ds_a, ds_b))
SELECT ds_a, ds_b, sum(m)::BIGINT AS n_matched, round(sum(m * distance) / sum(m), 6) AS avg_distance, round(min(distance), 6) AS min_distance,
       round(max(distance), 6) AS max_distance, round(coalesce(sum(m) FILTER (WHERE distance = 0), 0) * 100.0::DOUBLE / sum(m), 6) AS zero_dist_percent,
       round(sum(m * distance), 6) AS distance_sum, coalesce(sum(m) FILTER (WHERE distance > 0), 0)::BIGINT AS n_nonzero,
       (any_value(n_left) - sum(m))::BIGINT AS n_unmatched, 0::BIGINT AS n_incomplete
FROM d JOIN sides USING (ds_a, ds_b) GROUP BY ds_a, ds_b"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["contingency"] = f"WITH {COHORT_CTE}\n{_cells_union(FEATURES)}"
    q["odds_ratios"] = (f"WITH {COHORT_CTE}, cells AS ({_cells_union(FEATURES)})\n"
                        f"SELECT *, {_OR} AS odds_ratio FROM cells")
    q["odds_ratios_by_dataset"] = (f"WITH {COHORT_CTE}, cells AS ({_cells_union(FEATURES, 'dataset_id')})\n"
                                   f"SELECT *, {_OR} AS odds_ratio FROM cells")
    q["global_index"] = (f"WITH {COHORT_CTE}\nSELECT dataset_id, id AS \"index\", Age, Gender, PT, PTT, "
                         f"Platelets, HF, DOA FROM cohort")
    q["threshold_odds_scan"] = f"""WITH {COHORT_CTE},
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE DOA = 1) AS alive FROM cohort),
th AS (SELECT CAST(t AS BIGINT) AS threshold FROM tot, range(1000, (SELECT n FROM tot), 1000) r(t)),
below AS (
  SELECT th.threshold, CAST(count(*) FILTER (WHERE c.DOA = 1) AS BIGINT) AS alive_below
  FROM th JOIN cohort c ON c.id <= th.threshold GROUP BY th.threshold)
SELECT threshold, alive_below,
       CAST((n - alive) - (threshold - alive_below) AS BIGINT) AS dead_above,
       CAST(threshold - alive_below AS BIGINT) AS dead_below,
       CAST(alive - alive_below AS BIGINT) AS alive_above,
       round(CAST(alive_below AS DOUBLE) * ((n - alive) - (threshold - alive_below))
             / NULLIF(CAST(threshold - alive_below AS DOUBLE) * (alive - alive_below), 0), 2) AS odds_ratio
FROM below, tot"""
    q["contiguous_blocks"] = f"""WITH {COHORT_CTE}, {BLOCKS_CTE}
SELECT block, is_tail, count(*) AS n_rows, min(id) AS first_index, max(id) AS last_index,
       count(*) FILTER (WHERE DOA = 0) AS n_dead
FROM blocked GROUP BY block, is_tail"""
    q["block_folds"] = f"""WITH {COHORT_CTE}, {BLOCKS_CTE},
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE DOA = 0) AS d FROM blocked)
SELECT block AS fold, count(*) AS test_rows, count(*) FILTER (WHERE DOA = 0) AS test_dead,
       CAST(any_value(tot.n) - count(*) AS BIGINT) AS train_rows,
       CAST(any_value(tot.d) - count(*) FILTER (WHERE DOA = 0) AS BIGINT) AS train_dead
FROM blocked, tot WHERE NOT is_tail GROUP BY block"""
    q["stratified_folds"] = f"""WITH {CLINICAL_CTE}
SELECT doc_id, outcome,
       CAST((row_number() OVER (PARTITION BY outcome ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1) % 3
            AS INTEGER) AS fold
FROM clinical"""
    q["corr_pearson"] = f"WITH {COHORT_CTE}, {BLOCKS_CTE}, full_blocks AS (SELECT * FROM blocked WHERE NOT is_tail),\n" \
        + _corr_sql("full_blocks", "pearson")
    q["corr_spearman"] = f"WITH {COHORT_CTE}, {BLOCKS_CTE}, {_ranked_cte(CORR_COLS)},\n" + _corr_sql("ranked", "spearman")
    piv = ", ".join(f"first(value) FILTER (WHERE feature_b = '{c}') AS {c}" for c in CORR_COLS)
    q["corr_pivot"] = (f"WITH {COHORT_CTE}, {BLOCKS_CTE}, full_blocks AS (SELECT * FROM blocked WHERE NOT is_tail), "
                       f"{_ranked_cte(CORR_COLS)},\n"
                       f"pe AS (WITH {_corr_sql('full_blocks', 'pearson')}),\n"
                       f"sp AS (WITH {_corr_sql('ranked', 'spearman')}),\n"
                       f"lng AS (SELECT * FROM pe UNION ALL SELECT * FROM sp)\n"
                       f"SELECT block, method, feature_a AS feature, {piv} FROM lng GROUP BY block, method, feature_a")
    q["average_rank"] = f"""WITH {COHORT_CTE}, {BLOCKS_CTE}
SELECT id AS "index", block,
       rank() OVER (PARTITION BY block ORDER BY Age) + (count(*) OVER (PARTITION BY block, Age) - 1) / 2.0 AS Age_rank,
       rank() OVER (PARTITION BY block ORDER BY Platelets)
         + (count(*) OVER (PARTITION BY block, Platelets) - 1) / 2.0 AS Platelets_rank
FROM blocked"""
    q["value_counts"] = f"WITH {CLINICAL_CTE}\nSELECT outcome, count(*) AS n FROM clinical GROUP BY outcome"
    q["marginal_report"] = f"""WITH {CLINICAL_CTE}
SELECT count(*) AS "rows", 'quality' AS feature, count(quality) AS measured,
       count(*) FILTER (WHERE quality = 0) AS low, count(*) FILTER (WHERE quality <> 0) AS high,
       count(*) - count(quality) AS missing FROM clinical
UNION ALL
SELECT count(*), 'toxic', count(toxic), count(*) FILTER (WHERE toxic = 0), count(*) FILTER (WHERE toxic <> 0),
       count(*) - count(toxic) FROM clinical"""
    cl_cols = ["doc_id", "n_chars", "quality", "toxic", "lang", "source", "outcome"]
    q["null_profile"] = f"WITH {CLINICAL_CTE}\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count({c}) AS non_nulls, "
        f"count(*) - count({c}) > 0 AS any_null FROM clinical" for c in cl_cols)
    q["impute_constant"] = f"""WITH {CLINICAL_CTE}
SELECT coalesce(doc_id, -1) AS doc_id, coalesce(n_chars, -1) AS n_chars, coalesce(quality, -1) AS quality,
       coalesce(toxic, -1) AS toxic, lang, source, coalesce(outcome, -1) AS outcome FROM clinical"""
    q["complete_cases"] = f"""WITH {CLINICAL_CTE}
SELECT * FROM clinical WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL
  AND toxic IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND outcome IS NOT NULL"""
    q["shape"] = f"WITH {CLINICAL_CTE}\nSELECT count(*) AS \"rows\", CAST(7 AS BIGINT) AS cols FROM clinical"
    q["index_label"] = f"""WITH {COHORT_CTE}
SELECT DOA, n, CAST(row_number() OVER (ORDER BY n DESC, CAST(DOA AS VARCHAR)) - 1 AS DOUBLE) AS label
FROM (SELECT DOA, count(*) AS n FROM cohort GROUP BY DOA)"""
    q["confusion_counts"] = f"WITH {COHORT_CTE}, {SCORED_CTE}\nSELECT dataset_id, {CONF} FROM scored GROUP BY dataset_id"
    r6 = lambda a, b: f"round(CAST({a} AS DOUBLE) / NULLIF({b}, 0), 6)"
    q["binary_metrics"] = f"""WITH {COHORT_CTE}, {SCORED_CTE},
cc AS (SELECT dataset_id, {CONF} FROM scored GROUP BY dataset_id)
SELECT *, {r6('tp + tn', 'n')} AS accuracy, {r6('tp', 'tp + fp')} AS precision,
       {r6('tp', 'tp + fn')} AS recall, {r6('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cc"""
    q["per_class_metrics"] = f"""WITH {COHORT_CTE}, {SCORED_CTE},
cls AS (SELECT label AS class FROM scored UNION SELECT prediction FROM scored),
pc AS (SELECT cls.class,
              (SELECT count(*) FROM scored s WHERE s.label = cls.class AND s.prediction = cls.class) AS tp,
              (SELECT count(*) FROM scored s WHERE s.label = cls.class) AS actual,
              (SELECT count(*) FROM scored s WHERE s.prediction = cls.class) AS predicted
       FROM cls)
SELECT class, tp, actual, predicted, {r6('tp', 'predicted')} AS precision, {r6('tp', 'actual')} AS recall FROM pc"""
    q["holdout_accuracy"] = f"""WITH {COHORT_CTE}, {SCORED_CTE}
SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS correct,
       {r6('count(*) FILTER (WHERE label = prediction)', 'count(*)')} AS accuracy
FROM scored WHERE NOT ({_u('id', 5043)} < 0.7)"""
    q["hash_sample"] = f"WITH {COHORT_CTE}\nSELECT id, dataset_id, DOA FROM cohort WHERE {_u('id', 100)} < 0.2"
    q["exact_sample"] = f"""WITH {COHORT_CTE}
SELECT dataset_id, id FROM (
  SELECT dataset_id, id, row_number() OVER (PARTITION BY dataset_id
                                             ORDER BY md5(CAST(id AS VARCHAR) || ':7'), id) AS rk
  FROM cohort) WHERE rk <= 500"""
    q["holdout_split"] = f"""WITH {COHORT_CTE}
SELECT CASE WHEN {_u('id', 5043)} < 0.7 THEN 'train' ELSE 'test' END AS split,
       count(*) AS n, count(*) FILTER (WHERE DOA = 0) AS n_dead
FROM cohort GROUP BY 1"""
    q["id_difference"] = f"""WITH {COHORT_CTE}
SELECT id, dataset_id FROM cohort c WHERE NOT EXISTS (SELECT 1 FROM cohort d WHERE d.DOA = 0 AND d.id = c.id)"""
    # Poisson(0.3) by its distribution function: the number of bounds that u reaches.
    bounds, p, total = [], math.exp(-(0.1 + 0.1 * 2)), 0.0
    for k in range(1, 14):
        total += p
        bounds.append(total)
        p *= (0.1 + 0.1 * 2) / k
    drawn = " + ".join(f"CAST({_u('id', 2)} >= {b!r} AS INTEGER)" for b in bounds)
    q["rebalance"] = f"""WITH {COHORT_CTE}
SELECT id, DOA, 1 AS copy FROM cohort WHERE DOA = 0
UNION ALL
SELECT id, DOA, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM (SELECT id, DOA, {drawn} AS n FROM cohort WHERE DOA = 1) WHERE n > 0"""
    q["marginals"] = f"""WITH {COHORT_CTE}, {_config_cte()}
SELECT dataset_id, feature, n, CAST(ceil(n * (CAST(dead AS DOUBLE) / n)) AS BIGINT) AS dead,
       CAST(n - ceil(n * (CAST(dead AS DOUBLE) / n)) AS BIGINT) AS alive,
       CAST(ceil(n * (CAST(low AS DOUBLE) / n)) AS BIGINT) AS low,
       CAST(n - ceil(n * (CAST(low AS DOUBLE) / n)) AS BIGINT) AS high
FROM cfg"""
    q["expected_cells"] = f"WITH {COHORT_CTE}, {_config_cte()}\nSELECT * FROM ec"
    q["quota_assign"] = f"""WITH {COHORT_CTE}, {_config_cte()}, {_quota_sql('cohort', lambda f: SEEDS[f])}
SELECT c.dataset_id, c.id, c.DOA, w.Gender, w.PT, w.PTT, w.Platelets, w.HF
FROM cohort c LEFT JOIN wide w ON c.dataset_id = w.dataset_id AND c.id = w.id"""
    q["synthesize_cohorts"] = f"""WITH {COHORT_CTE}, {_config_cte()},
dq AS (SELECT DISTINCT dataset_id, dead FROM cfg),
outc AS (
  SELECT c.dataset_id, c.id,
         CASE WHEN row_number() OVER (PARTITION BY c.dataset_id
                                      ORDER BY md5(CAST(c.id AS VARCHAR) || ':' || CAST(c.dataset_id + 6 AS VARCHAR)),
                                               c.id) <= d.dead THEN 0.0 ELSE 1.0 END::DOUBLE AS DOA
  FROM cohort c LEFT JOIN dq d ON c.dataset_id = d.dataset_id),
aged AS (SELECT *, {_age_sql('id', "CAST(dataset_id + 0 AS VARCHAR)")} AS Age FROM outc),
{_quota_sql('aged', lambda f: f"x.dataset_id + {SEEDS[f]}")}
SELECT a.dataset_id, a.id, a.DOA, a.Age, w.Gender, w.PT, w.PTT, w.Platelets, w.HF
FROM aged a LEFT JOIN wide w ON a.dataset_id = w.dataset_id AND a.id = w.id"""
    age1 = _age_sql("id", "'1'")
    q["normal_attribute"] = f"WITH {COHORT_CTE}\nSELECT id, {age1} AS Age FROM cohort"
    ind = {"Gender": (10921, None), "PT": (10790, 2994), "PTT": (10453, 826), "Platelets": (11290, 381)}
    scale = lambda c: f"floor(CAST(s.n AS DOUBLE) * CAST({c} AS DOUBLE) / CAST(14397 AS DOUBLE))"
    q1 = " ".join(f"WHEN '{k}' THEN {scale(v[0])}" for k, v in ind.items())
    q2 = " ".join(f"WHEN '{k}' THEN {scale(v[1])}" for k, v in ind.items() if v[1] is not None)
    items = ", ".join(f"('{k}')" for k in ind)
    piv = ", ".join(f"max(value) FILTER (WHERE feature = '{k}') AS {k}" for k in ind)
    ind_cte = f"""sizes AS (SELECT dataset_id, count(*) AS n FROM cohort GROUP BY dataset_id),
r1 AS (
  SELECT c.dataset_id, c.id, f.feature,
         row_number() OVER (PARTITION BY c.dataset_id, f.feature
                            ORDER BY md5(CAST(c.id AS VARCHAR) || ':11:' || f.feature), c.id) AS rk
  FROM cohort c CROSS JOIN (VALUES {items}) f(feature)),
ch AS (SELECT r1.*, rk <= CASE feature {q1} END AS chosen,
              CASE feature {q2} END AS low_q
       FROM r1 JOIN sizes s USING (dataset_id)),
r2 AS (
  SELECT dataset_id, id, feature, low_q,
         row_number() OVER (PARTITION BY dataset_id, feature
                            ORDER BY md5(CAST(id AS VARCHAR) || ':11:low:' || feature), id) AS rk2
  FROM ch WHERE chosen AND feature <> 'Gender'),
val AS (
  SELECT dataset_id, id, feature, CASE WHEN chosen THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM ch WHERE feature = 'Gender'
  UNION ALL
  SELECT dataset_id, id, feature, CASE WHEN rk2 <= low_q THEN 0.0 ELSE 1.0 END::DOUBLE FROM r2),
im AS (SELECT c.dataset_id, c.id, {', '.join('w.' + k for k in ind)}
FROM cohort c LEFT JOIN (SELECT dataset_id, id, {piv} FROM val GROUP BY dataset_id, id) w
  ON c.dataset_id = w.dataset_id AND c.id = w.id)"""
    q["independent_marginals"] = f"WITH {COHORT_CTE}, {ind_cte}\nSELECT * FROM im"
    q["valid_rows"] = f"""WITH {COHORT_CTE}, {ind_cte}
SELECT im.id, im.dataset_id, c.Age, im.PT, im.PTT, im.Platelets
FROM im JOIN cohort c ON im.id = c.id
WHERE c.Age > 0 AND im.PT >= 0 AND im.PTT >= 0 AND im.Platelets >= 0"""

    q["blocked_threshold_scan"] = f"""WITH {COHORT_CTE},
b AS (SELECT id, CAST(floor((id - 1) / 1000) AS BIGINT) AS blk FROM cohort),
bs AS (SELECT blk, count(*) AS rows_in FROM b GROUP BY blk),
bq AS (SELECT blk, CAST(floor(CAST([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99] AS DOUBLE[])[blk % 10 + 1]
                                * rows_in) AS BIGINT) AS dead FROM bs),
syn AS (
  SELECT b.id,
         CASE WHEN row_number() OVER (PARTITION BY b.blk
                                      ORDER BY md5(CAST(b.id AS VARCHAR) || ':' || CAST((b.blk + 1) * 10 AS VARCHAR)),
                                               b.id) <= bq.dead THEN 0 ELSE 1 END AS DOA
  FROM b JOIN bq USING (blk)),
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE DOA = 1) AS alive FROM syn),
th AS (SELECT CAST(t AS BIGINT) AS threshold FROM tot, range(1000, (SELECT n FROM tot), 1000) r(t)),
below AS (
  SELECT th.threshold, CAST(count(*) FILTER (WHERE s.DOA = 1) AS BIGINT) AS alive_below
  FROM th JOIN syn s ON s.id <= th.threshold GROUP BY th.threshold)
SELECT threshold, alive_below,
       CAST((n - alive) - (threshold - alive_below) AS BIGINT) AS dead_above,
       CAST(threshold - alive_below AS BIGINT) AS dead_below,
       CAST(alive - alive_below AS BIGINT) AS alive_above,
       round(CAST(alive_below AS DOUBLE) * ((n - alive) - (threshold - alive_below))
             / NULLIF(CAST(threshold - alive_below AS DOUBLE) * (alive - alive_below), 0), 2) AS odds_ratio
FROM below, tot"""
    q["dataset_pairs"] = f"WITH {COHORT_CTE}, {PAIRS_CTE}\nSELECT ds_a, ds_b FROM pairs"
    q["joint_minmax"] = f"WITH {COHORT_CTE}, {PAIRS_CTE}\nSELECT ds_a, ds_b, lo, hi FROM pm"
    q["row_sum"] = f"WITH {COHORT_CTE}, {PAIRS_CTE}\nSELECT ds_a, ds_b, side, id, {ROWSUM} AS row_sum FROM prow"
    q["mean_abs_distance"] = (f"WITH {COHORT_CTE}, {PAIRS_CTE}, {RANKED_CTE}\n"
                              "SELECT ds_a, ds_b, rank, l_id, r_id, round(distance, 9) AS distance FROM matched")
    q["match_rank_aligned"] = f"WITH {COHORT_CTE}, {PAIRS_CTE}, {RANKED_CTE}\n" + _summary_sql("matched", extra=False)
    q["distance_summary"] = f"WITH {COHORT_CTE}, {PAIRS_CTE}, {RANKED_CTE}\n" + _summary_sql("matched", nulls=True)
    q["nearest_neighbor"] = f"""WITH {COHORT_CTE}, {PAIRS_CTE},
cells AS (SELECT dataset_id, Gender, PT, PTT, Platelets, DOA, Age, count(*) AS n FROM cohort
          GROUP BY dataset_id, Gender, PT, PTT, Platelets, DOA, Age),
lc AS (SELECT pm.ds_a, pm.ds_b, c.Gender, c.PT, c.PTT, c.Platelets, c.DOA, c.n,
              coalesce((c.Age - pm.lo) / NULLIF(pm.hi - pm.lo, 0), 0.0) AS Age
       FROM pm JOIN cells c ON c.dataset_id = pm.ds_a),
rc AS (SELECT pm.ds_a, pm.ds_b, c.Gender, c.PT, c.PTT, c.Platelets, c.DOA,
              coalesce((c.Age - pm.lo) / NULLIF(pm.hi - pm.lo, 0), 0.0) AS Age
       FROM pm JOIN cells c ON c.dataset_id = pm.ds_b),
near AS (
  SELECT l.ds_a, l.ds_b, l.Gender, l.PT, l.PTT, l.Platelets, l.DOA, l.Age, any_value(l.n) AS n,
         min((abs(l.Gender - r.Gender) + abs(l.PT - r.PT) + abs(l.PTT - r.PTT) + abs(l.Platelets - r.Platelets)
              + abs(l.DOA - r.DOA) + abs(l.Age - r.Age)) / 6.0) AS distance
  FROM lc l JOIN rc r ON l.ds_a = r.ds_a AND l.ds_b = r.ds_b
  GROUP BY l.ds_a, l.ds_b, l.Gender, l.PT, l.PTT, l.Platelets, l.DOA, l.Age)
{_summary_sql("near", "n")}"""
    whole = COHORT_CTE.replace("cohort AS (", "whole AS (", 1)
    gap_of = "(SELECT sum(g) FROM gaps WHERE dataset_id IN (ds_a, ds_b))"
    q["match_with_gaps"] = (f"WITH {whole}, {GAPPY_CTE}, {PAIRS_CTE}, {RANKED_CTE}\n"
                            f"SELECT * REPLACE (CAST({gap_of} AS BIGINT) AS n_incomplete) FROM ({_summary_sql('matched', extra=False)})")
    counts = """FROM gaps a JOIN gaps b ON a.dataset_id < b.dataset_id"""
    q["nearest_with_gaps"] = (f"WITH {whole}, {GAPPY_CTE}\nSELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, a.c AS n_matched, "
                              f"a.g + b.g AS n_incomplete {counts}")
    q["match_exact_check"] = (f"WITH {whole}, {GAPPY_CTE}\nSELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, least(a.c, b.c) AS n_matched, "
                              f"a.c - least(a.c, b.c) AS n_unmatched, a.g + b.g AS n_incomplete, true AS in_bounds {counts}")
    q["match_exact"] = q["match_exact_levels"] = match_exact_sql()
    sink = """ds_a AS File1, ds_b AS File2, avg_distance AS avgDistance, min_distance AS minDistance, max_distance AS maxDistance,
       zero_dist_percent AS zeroDistPercent"""
    q["pairwise_similarity"] = f"SELECT {sink} FROM ({q['match_rank_aligned']})"
    q["restore_label"] = f"""WITH {COHORT_CTE}, {SCORED_CTE}
SELECT s.dataset_id, s.DOA, m.DOA AS predicted_value, count(*) AS n FROM scored s LEFT JOIN mapping m ON m.label = s.prediction GROUP BY ALL"""
    q["mean_fold_accuracy"] = f"""WITH folded AS ({q['stratified_folds']}),
acc AS (SELECT fold, round(avg(CASE WHEN CAST(d.n_chars > 1000 AS INTEGER) = outcome THEN 1.0 ELSE 0.0 END), 6) AS accuracy
        FROM folded JOIN documents d USING (doc_id) GROUP BY fold)
SELECT count(*) AS folds, round(avg(accuracy), 6) AS mean_accuracy, min(accuracy) AS min_accuracy, max(accuracy) AS max_accuracy FROM acc"""
    # The fixed-rate cells from the rule itself: the smaller root of the quadratic, rounded up.
    q["fixed_rate_cells"] = f"""WITH {COHORT_CTE},
cfg AS (SELECT dataset_id, n, feature, o, CAST(floor(n * d) AS BIGINT) AS dead, CAST(floor(n * lo) AS BIGINT) AS low, CAST(floor(n * hi) AS BIGINT) AS high
        FROM (SELECT dataset_id, count(*) AS n FROM cohort GROUP BY dataset_id),
             (VALUES ('PT', 0.099::DOUBLE, 0.277::DOUBLE, 0.723::DOUBLE, 5.5::DOUBLE), ('PTT', 0.103, 0.079, 0.921, 8.8), ('Platelets', 0.09, 0.034, 0.966, 4.8)) v(feature, d, lo, hi, o)),
pqr AS (SELECT *, o - 1 AS p, low - (n - dead) - o * low - o * dead AS q, o * low * dead AS r FROM cfg),
cut AS (SELECT *, CAST(ceil((-q - sqrt(q * q - 4 * p * r)) / (2 * p)) AS BIGINT) AS s FROM pqr)
SELECT dataset_id, feature, n, dead, n - dead AS alive, low, high, o AS odds_ratio, s AS dead_low, dead - s AS dead_high, low - s AS alive_low,
       high - (dead - s) AS alive_high, round(CAST(s AS DOUBLE) * (high - (dead - s)) / (CAST(dead - s AS DOUBLE) * (low - s)), 6) AS realised_or,
       CAST(NULL AS VARCHAR) AS reason FROM cut"""
    q["missing_cells"] = f"""WITH {COHORT_CTE}, {_config_cte()}
SELECT dataset_id, feature, CASE WHEN bad IS NULL THEN dead_low END AS dead_low, CASE WHEN bad IS NULL THEN dead_high END AS dead_high,
       CASE WHEN bad IS NULL THEN alive_low END AS alive_low, CASE WHEN bad IS NULL THEN alive_high END AS alive_high, bad AS reason
FROM (SELECT *, CASE feature WHEN 'PT' THEN 'no odds ratio' WHEN 'PTT' THEN 'negative odds ratio' WHEN 'HF' THEN 'infeasible marginals' END AS bad FROM ec)"""
    q["evaluate_folds_forest"] = folds_forest_sql(10_000, 50, 8)
    q["fold_cells"] = fold_cells_sql(10_000) + f" SELECT fold, {MODEL_BINS}, n0, n1, t0, t1 FROM cells"
    q["holdout_forest"] = holdout_forest_sql()
    q["importance_table"] = importance_sql(50)
    q["clinical_cv"] = clinical_cv_sql(q["stratified_folds"])
    q["fold_evaluation_all"] = f"""WITH {COHORT_CTE}, {_blocks_cte(2500)}
SELECT block AS num, count(*) AS n, count(*) FILTER (WHERE DOA = 0) AS positives, true AS consistent
FROM blocked WHERE NOT is_tail GROUP BY block"""
    q["match_sampled_all"] = (f"WITH {whole}, {GAPPY_CTE}\nSELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, least(a.c, b.c) AS n_matched, "
                              f"least(a.c, b.c) AS n_left, least(a.c, b.c) AS n_right, true AS in_bounds, a.g + b.g AS n_incomplete {counts}")
    q["pairwise_similarity_nearest_all"] = f"SELECT {sink} FROM ({q['nearest_neighbor']})"
    q["holdout_check"] = f"""WITH {COHORT_CTE}
SELECT model, count(*) AS n, true AS consistent FROM cohort, (VALUES ('forest'), ('gbt')) v(model) WHERE NOT ({_u('id', 5043)} < 0.7) GROUP BY model"""
    q["importance_check"] = f"""SELECT count(DISTINCT feature) AS features, round(sum(importance), 6) AS total, bool_and(importance >= 0) AS no_negative
FROM ({importance_sql(5, 12)})"""
    q["clinical_cv_check"] = f"""SELECT fold, outcome, count(*) AS "rows", count(*) AS predictions FROM ({q['stratified_folds']}) GROUP BY ALL"""
    sim_cols = "dataset_id, id, Age, Gender, PT, PTT, Platelets, DOA"
    q["csv_round_trip"] = f"WITH {COHORT_CTE}\nSELECT {sim_cols} FROM cohort"
    seeds = " || ".join(f"CAST(dataset_id + {i} AS VARCHAR)" for i in range(7))
    orx = lambda f: f"max(round(odds_ratio, 2)) FILTER (WHERE feature = '{f}')"
    q["parse_provenance"] = f"""WITH {COHORT_CTE}, {_config_cte()},
lab AS (SELECT dataset_id, {seeds} AS seeds, {orx('Gender')} AS gender_or, {orx('PT')} AS pt_or,
               {orx('PTT')} AS ptt_or, {orx('Platelets')} AS platelet_or, '20260101_000000' AS created
        FROM cfg GROUP BY dataset_id)
SELECT seeds, gender_or, pt_or, ptt_or, platelet_or, created, count(*) AS "rows"
FROM cohort JOIN lab USING (dataset_id) GROUP BY ALL"""
    q["read_clinical"] = f"WITH {CLINICAL_CTE}\nSELECT * FROM clinical"
    q["cast_rename"] = ("SELECT TRY_CAST(CAST(l_orderkey AS VARCHAR) AS DOUBLE) AS id, CAST(l_quantity AS DOUBLE) AS Age, "
                        "TRY_CAST(l_returnflag AS DOUBLE) AS flag, CAST(l_discount AS DOUBLE) AS PT FROM lineitem")
    q["suffix_columns"] = f"WITH {COHORT_CTE}\nSELECT id AS id_df1, Age AS Age_df1, DOA AS DOA_df1 FROM cohort"
    q["top_n"] = f"WITH {COHORT_CTE}\nSELECT id, dataset_id, Age, DOA FROM cohort ORDER BY Age DESC, id LIMIT 10"
    q["project"] = f"WITH {COHORT_CTE}\nSELECT dataset_id, Age, DOA FROM cohort"
    q["register_views"] = f"""WITH {COHORT_CTE}, {BLOCKS_CTE}
SELECT block, count(*) AS n, count(*) FILTER (WHERE DOA = 0) AS n_dead, min(id) AS low, max(id) AS high
FROM blocked GROUP BY block"""
    return q
