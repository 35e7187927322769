"""Greedy matching by levels and ranges against all sorted edges, and on workers that lack the package."""

import os
import random
import subprocess
import sys
import textwrap

import pytest

from cohortlens.operators.greedy import LEVELS, match_pair

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def down_the_edges(side, p, v, free):
    free = list(free)
    left, right = ([i for i, s in enumerate(side) if s == which] for which in (0, 1))
    out = {}
    for h, d, _, _, i, j in sorted((bin(p[i] ^ p[j]).count("1"), abs(v[i] - v[j]), p[i] ^ p[j], v[i] > v[j], i, j) for i in left for j in right):
        m = min(free[i], free[j])
        free[i] -= m
        free[j] -= m
        if m:
            out[h, d] = out.get((h, d), 0) + m
    return out, free


def random_cells(rng, mode):
    cells = {}
    for _ in range(rng.randrange(1, 120)):
        s, p = rng.randrange(2), rng.randrange([1, 2, 8, 32][rng.randrange(4)])
        x = [float(rng.randrange(30)), rng.random(), rng.random() * 0.3 + 0.6 * s, float(rng.randrange(8)) + 4 * (s and p % 2)][mode]
        cells[s, p, x] = rng.randrange(1, 5)
    return cells


@pytest.mark.parametrize("mode", range(4))
def test_neighbours_and_ranges_give_the_sorted_edges(mode):
    """Whole whole numbers with ties, continuous values, sides that lie apart, and sides that overlap in part."""
    rng = random.Random(mode)
    for _ in range(150):
        cells = random_cells(rng, mode)
        keys = sorted(cells)
        columns = [list(c) for c in zip(*keys)]
        want, rest = down_the_edges(*columns, [cells[k] for k in keys])
        free = [cells[k] for k in keys]
        assert {(h, d): m for h, d, m in match_pair(*columns, free)} == want and free == rest
        left, got = dict(cells), {}
        for level in range(LEVELS):
            for parts in (5, 3, 2, 1):
                values = sorted({k[2] for k in left})
                cuts = [float("-inf"), *sorted(rng.sample(values, min(len(values), parts - 1))), float("inf")]
                after = {}
                for c, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    part = sorted(k for k in left if lo <= k[2] < hi)
                    if part:
                        free = [left[k] for k in part]
                        for h, d, m in match_pair(*[list(x) for x in zip(*part)], free, [level], c > 0, c < len(cuts) - 2):
                            got[h, d] = got.get((h, d), 0) + m
                        after |= {k: n for k, n in zip(part, free) if n}
                left = after
        assert got == want and left == {k: n for k, n in zip(keys, rest) if n}


def test_levels_equal_tasks_on_the_cohort(spark):
    from cohortlens.operators.matching import match_exact
    from cohortlens.plans.catalog import _sim_cohort
    from tests.conftest import SF001

    c = _sim_cohort(spark, SF001)
    want = sorted(map(tuple, match_exact(c).collect()))
    assert want == sorted(map(tuple, match_exact(c, max_task_edges=0, chunk_cells=500).collect())) and len(want) == 21


def test_ranges_settle_most_cells(spark):
    """Continuous values, no two alike: rounds stay few while the edges are some nine million."""
    from pyspark.sql import functions as F

    from cohortlens.operators import matching
    from cohortlens.operators.similarity import BINARY

    df = spark.range(6000).select((F.col("id") % 2 + 1).cast("int").alias("dataset_id"), "id", F.rand(7).alias("Age"),
                                  *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(2))).cast("double").alias(c) for c in BINARY])
    df = spark.createDataFrame(df.collect(), df.schema)
    cells, _ = matching.exact_cells(df)
    rounds = matching._match_in_levels(cells, 800)
    assert len(rounds) <= 5 * LEVELS
    assert sum(r.agg(F.sum("m")).first()[0] or 0 for r in rounds) == 3000


def test_exact_matching_on_workers_without_the_package(tmp_path):
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from cohortlens.operators.matching import match_exact
        def missing(frames):
            for f in frames:
                try:
                    import cohortlens
                    f["id"] = -1
                except ModuleNotFoundError:
                    pass
                yield f
        assert spark.range(1).mapInPandas(missing, "id long").first()[0] == 0, "workers can import the package"
        rows = [(ds, float(i * 7 % 11), *[float(i >> b & 1) for b in range(5)]) for ds in (1, 2) for i in range(ds * 9)]
        df = spark.createDataFrame(rows, "dataset_id int, Age double, Gender double, PT double, PTT double, Platelets double, DOA double")
        a, b = match_exact(df).collect(), match_exact(df, max_task_edges=0, chunk_cells=5).collect()
        assert a == b and a[0].n_matched == 9, (a, b)
        print("fine")
    """)
    path = tmp_path / "job.py"
    path.write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-2000:]


def test_sampled_rounds_are_few_and_distances_right(spark, monkeypatch):
    """One to one and complete, each distance that of its two rows; buckets far smaller than the table leave little over."""
    from pyspark.sql import functions as F

    from cohortlens.operators import matching
    from cohortlens.operators.similarity import BINARY

    n = {1: 1500, 2: 1300, 3: 40}
    rows = [(ds, ds * 10_000 + i, float((i * 37 + ds) % 71), *[float((i * (ds + 2) >> b) & 1) for b in range(5)]) for ds, k in n.items() for i in range(k)]
    df = spark.createDataFrame(rows, f"dataset_id int, id long, Age double, {', '.join(f'{c} double' for c in BINARY)}")
    rounds = []
    keep = matching.stored
    monkeypatch.setattr(matching, "stored", lambda d, name: rounds.append(name) or keep(d, name))
    matched, totals = matching.sampled_matches(df, bucket_rows=60)
    got = matched.collect()
    assert rounds.count("round") <= 5
    by_id = {r[1]: r for r in rows}
    for (a, b) in ((1, 2), (1, 3), (2, 3)):
        mine = [r for r in got if (r.ds_a, r.ds_b) == (a, b)]
        assert len(mine) == min(n[a], n[b]) == len({r.l_id for r in mine}) == len({r.r_id for r in mine})
        ages = [r[2] for r in rows if r[0] in (a, b)]
        width = max(ages) - min(ages)
        for r in mine:
            x, y = by_id[r.l_id], by_id[r.r_id]
            assert (x[0], y[0]) == (a, b)
            assert r.distance == pytest.approx((sum(abs(p - q) for p, q in zip(x[3:], y[3:])) + abs(x[2] - y[2]) / width) / 6)
    assert sorted(map(tuple, got)) == sorted(map(tuple, matching.sampled_matches(df.repartition(3), bucket_rows=60)[0].collect()))
    # Ten candidates beat one, and one bucket takes all.
    far = lambda m: matching.sampled_matches(df, m=m)[0].agg(F.avg("distance")).first()[0]
    assert far(10) < 0.7 * far(1)


def test_sampled_matching_of_many_buckets_equals_row_by_row():
    """All buckets in step take what each left row in turn would take from a list of its bucket's free rows."""
    import numpy as np

    from cohortlens.operators.greedy import match_samples

    rng = np.random.default_rng(2)
    for buckets, most, m in ((60, 90, 10), (7, 3, 10), (3, 400, 4), (1, 0, 10)):
        n_left, n_right = rng.integers(0, most + 1, buckets), rng.integers(0, most + 1, buckets)
        left, right = (np.round(rng.random((n.sum(), 6)) * 3) / 3 for n in (n_left, n_right))
        left_of, right_of = (np.repeat(np.arange(buckets), n) for n in (n_left, n_right))
        starts = rng.random(len(left))
        want = []
        for b in range(buckets):
            free = np.flatnonzero(right_of == b).tolist()
            for i in np.flatnonzero(left_of == b).tolist():
                if free:
                    near = [(int(starts[i] * len(free)) + j) % len(free) for j in range(min(m, len(free)))]
                    distances = [float(np.abs(right[free[k]] - left[i]).sum() / 6) for k in near]
                    best = distances.index(min(distances))
                    want.append((i, free.pop(near[best]), distances[best]))
        got = match_samples(left, left_of, right, right_of, starts, m)
        assert sorted(zip(*(x.tolist() for x in got))) == want


def _cohort_of(spark, n, id_type="long", make_id=int):
    from cohortlens.operators.similarity import BINARY

    rows = [(ds, make_id(ds * 10_000 + i), float((i * 37 + ds) % 71), *[float((i * (ds + 2) >> b) & 1) for b in range(5)]) for ds, k in n.items() for i in range(k)]
    return rows, spark.createDataFrame(rows, f"dataset_id int, id {id_type}, Age double, {', '.join(f'{c} double' for c in BINARY)}")


def test_numbers_of_md5_are_those_of_hashlib():
    import hashlib

    import numpy as np
    import pyarrow as pa

    from cohortlens.operators.greedy import md5_numbers

    texts = ["", "a", "é" * 20, *("x" * n for n in (43, 52, 53, 54, 55, 56, 64, 300)), *(f"1:2:0:{i}" for i in range(500))]
    want = np.frombuffer(b"".join(hashlib.md5(f"{x}:s".encode()).digest() for x in texts), ">u8").reshape(-1, 2)
    for first in (7, 8192):
        assert (md5_numbers(pa.array(texts), b":s", first) == want).all()
        assert (md5_numbers(pa.array(["q", *texts])[1:], b":s", first) == want).all()
    assert md5_numbers(pa.array([], pa.string()), b":s").shape == (0, 2)


@pytest.mark.parametrize("id_type,make_id", [("long", int), ("string", lambda i: f"row {i} of a table with long names, é"), ("double", lambda i: i + 0.5)])
def test_sampled_draws_are_md5s_of_names(spark, id_type, make_id):
    """Every round, pair and side by hashlib and row by row gives the same matches."""
    from hashlib import md5

    from cohortlens.operators import matching

    rows, df = _cohort_of(spark, {1: 150, 2: 120, 3: 60}, id_type, make_id)
    got = {(r.ds_a, r.ds_b, r.l_id): (r.r_id, r.distance) for r in matching.sampled_matches(df, bucket_rows=20, wave_rows=200)[0].collect()}
    want = {}
    for a, b in ((1, 2), (1, 3), (2, 3)):
        ages = [r[2] for r in rows if r[0] in (a, b)]
        lo, width = min(ages), max(ages) - min(ages)
        free, rnd = [{r[1]: (*r[3:], (r[2] - lo) / width) for r in rows if r[0] == ds} for ds in (a, b)], 0
        while all(free):
            digest = lambda side, i, what: md5(f"{a}:{b}:{side}:{i}:{what}100:{rnd}".encode()).hexdigest()
            uniform = lambda side, i, what: (int(digest(side, i, what)[:13], 16) + 0.5) / 2.0 ** 52
            n = -(-max(map(len, free)) // 20)
            for k in range(n):
                mine = [sorted((i for i in free[s] if int(uniform(s, i, "bucket:") * n) == k), key=lambda i: digest(s, i, "")) for s in (0, 1)]  # noqa: B023
                for i in mine[0]:
                    if mine[1]:
                        start = int(uniform(0, i, "start:") * len(mine[1]))
                        near = [mine[1][(start + j) % len(mine[1])] for j in range(min(10, len(mine[1])))]
                        far = [sum(abs(x - y) for x, y in zip(free[1][j], free[0][i])) / 6 for j in near]
                        j = near[far.index(min(far))]
                        mine[1].remove(j)
                        want[a, b, i] = j, pytest.approx(min(far))
                        del free[0][i], free[1][j]
            rnd += 1
    assert got == want


def _on_disk(spark):
    from cohortlens.session import checkpoint_dir

    scratch = f"{checkpoint_dir(spark).removeprefix('file:')}/cohortlens-scratch"
    local = {os.path.join(d, f) for top in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
             for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    return set(os.listdir(scratch)) if os.path.isdir(scratch) else set(), local


def test_sampled_matching_holds_a_wave_of_pairs_at_a_time(spark, monkeypatch):
    """No table or shuffle has the rows of all pairs, and what a wave wrote goes with it."""
    from cohortlens.operators import matching
    from cohortlens.operators.similarity import distance_summary

    n = {ds: 60 + ds for ds in range(1, 6)}
    rows, df = _cohort_of(spark, n)
    keep, tables, asked, deal = matching.stored, [], [], matching._match_dealt
    monkeypatch.setattr(matching, "stored", lambda d, name: tables.append((name, (x := keep(d, name)).count())) or x)
    monkeypatch.setattr(matching, "_match_dealt", lambda free, *a: asked.append(free.count()) or deal(free, *a))
    whole = matching.sampled_matches(df, summary=distance_summary)[0].orderBy("ds_a", "ds_b").collect()
    assert max(asked) == 4 * len(rows)
    tables.clear(), asked.clear()
    before = _on_disk(spark)
    waves, totals = matching.sampled_matches(df, wave_rows=400, summary=distance_summary)
    assert sum(name == "summary" for name, _ in tables) == 3
    assert max(asked) < 400 + 2 * max(n.values()) < 2 * len(rows)
    assert max(k for _, k in tables) <= max(asked)
    left = {x.rsplit("-", 1)[0] for x in _on_disk(spark)[0] - before[0]}
    assert not left & {"rows", "round", "pair-rows"}
    assert waves.orderBy("ds_a", "ds_b").collect() == whole and len(whole) == 10
    assert {(r.ds_a, r.ds_b): r.n_left for r in totals.collect()} == {(a, b): n[a] for a in n for b in n if a < b}


def test_settings_hold_inside_and_shuffles_go_with_a_write(spark):
    import time

    from cohortlens.session import DROP_SHUFFLES, settings, stored

    name, = DROP_SHUFFLES
    was, before = spark.conf.get(name), _on_disk(spark)[1]
    with pytest.raises(KeyError), settings(spark, {**DROP_SHUFFLES, "cohortlens.test": "1"}):
        assert spark.conf.get(name) == "true" and spark.conf.get("cohortlens.test") == "1"
        kept = stored(spark.range(20_000).repartition(4, "id"), "dealt")
        assert kept.count() == 20_000
        raise KeyError
    assert spark.conf.get(name) == was and spark.conf.get("cohortlens.test", None) is None
    until = time.time() + 20
    while (new := {x for x in _on_disk(spark)[1] - before if os.path.getsize(x) > 10_000}) and time.time() < until:
        time.sleep(0.2)
    assert not new
