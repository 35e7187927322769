"""One-to-one matching between the two datasets of every pair.

The reference matches left rows one at a time, in collection order, each
step a Spark job that excludes the right ids used so far (exact greedy), or
looks only at ~10 randomly sampled remaining right rows (sampled greedy).
Both are rebuilt as set-based steps over all pairs at once:

* :func:`match_exact` - sorted-edge greedy matching on collapsed cells: edges
  between left and right cells are taken by (findings that differ, difference
  in value, mask of those findings, direction, left cell), that is by distance,
  each for min(count left, count right) of the rows that are left. The order
  is total, so the result is unique (order-free, unlike the reference's
  collection order; see README). Pairs with few enough edges are matched by
  one task each. The cells of larger ones are dealt by ranges of values and
  matched level by level (:mod:`greedy`): a task decides the edges that no
  cell outside its range can touch, and what is left is dealt anew. The
  result is the same, and a round settles all but the cells near the ranges'
  ends, so that their number does not grow with the edges.
* :func:`match_sampled` - the free rows of a pair are dealt by md5 into buckets,
  and in its bucket each left row in turn takes the nearest of ``m`` random
  rows still free, as in the reference. What uneven buckets leave is dealt
  anew, so that two or three rounds do. Only a wave of pairs is on disk at a time.

Rounds end when a pair has no free rows on one side: a pair that fits one bucket,
or one task, is finished in its round, so there is no cap. Tables are stored
every round (shared folder), so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import hash_uniform
from cohortlens.operators.greedy import LEVELS, match_pair, match_samples, md5_numbers
from cohortlens.operators.similarity import (
    BINARY, DIST_COLS, PAIR, collapse_cells, complete_rows, dataset_pairs, distance_summary, joint_minmax, pair_rows, pair_sides, with_incomplete,
)
from cohortlens.session import DROP_SHUFFLES, default_partitions, drop_stored, settings, stored

#: Edges between the cells of a pair up to which one task matches it: some 30,000 cells a side.
MAX_TASK_EDGES = 1_000_000_000
#: Cells that one task of a larger pair holds.
CHUNK_CELLS = 50_000
#: Rows of either side in a bucket of the sampled matching, about.
BUCKET_ROWS = 1000
#: Rows of a task of the sampled matching, whose buckets take a row's step at a time.
TASK_ROWS = 400_000
#: Rows of the pairs that the sampled matching has on disk at a time.
WAVE_ROWS = 100_000_000
#: Bytes of rows that a task of the sampled matching reads, to tag them with their pairs: a row there becomes many.
SPLIT_BYTES = "4m"
#: Rows that such a task is handed at a time.
BATCH_ROWS = 50_000


def exact_cells(df: DataFrame, dataset_col: str = "dataset_id", value: str = "Age",
                pairs: Sequence[tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pair, side, p, v, n) of every pair's cells, with their values as they are, and (pair, width) of the values' ranges."""
    cells = stored(collapse_cells(df, dataset_col, value).withColumnRenamed("pattern", "p"), "cells")
    mm = stored(joint_minmax(cells, dataset_pairs(cells, dataset_col, pairs), "v", dataset_col), "ranges")
    left, right = (cells.join(mm, cells[dataset_col] == mm[ds]).select(*PAIR, F.lit(side).alias("side"), "p", F.col("v").cast("double").alias("v"), "n")
                   for side, ds in enumerate(PAIR))
    return left.unionByName(right), mm.select(*PAIR, (F.col("hi") - F.col("lo")).cast("double").alias("width"))


def _pair_type(df: DataFrame) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in PAIR)


def _match_in_tasks(cells: DataFrame) -> DataFrame:
    """(pair, level, delta, m) of pairs that fit a task, each in one."""

    def one(key, frame):
        import pandas as pd

        frame = frame.sort_values(["side", "p", "v"])
        rows = match_pair(*(frame[c].tolist() for c in ("side", "p", "v", "n")))
        out = pd.DataFrame(rows, columns=["level", "delta", "m"])
        for name, k in zip(PAIR, key):
            out.insert(0, name, k)
        return out[[*PAIR, "level", "delta", "m"]]

    return cells.groupBy(*PAIR).applyInPandas(one, f"{_pair_type(cells)}, level int, delta double, m long")


def _match_chunks(cells: DataFrame, level: int, chunks: int) -> DataFrame:
    """One round of a level: matches (``m`` rows at ``delta``) and, where ``m`` is null, the cells that are left.

    The cells are dealt by ranges of (pair, value), so that a pair with most of them is spread. A task's first and last
    pair may go on in its neighbours.
    """
    names = [*PAIR, "side", "p", "v", "n", "delta", "m"]
    schema = f"{_pair_type(cells)}, side int, p int, v double, n long, delta double, m long"

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        frames = [f for f in frames if len(f)]
        if not frames:
            return
        part = TaskContext.get().partitionId()
        groups = list(pd.concat(frames).groupby(PAIR, sort=True))
        for i, (key, frame) in enumerate(groups):
            frame = frame.sort_values(["side", "p", "v"])
            side, p, v, free = (frame[c].tolist() for c in ("side", "p", "v", "n"))
            rows = match_pair(side, p, v, free, [level], chunks > 1 and i == 0 and part > 0, chunks > 1 and i == len(groups) - 1 and part < chunks - 1)
            out = pd.DataFrame([(None, None, None, None, d, m) for _, d, m in rows] + [(*c, None, None) for c in zip(side, p, v, free) if c[3]],
                               columns=names[2:])
            for name, k in zip(reversed(PAIR), reversed(key)):
                out.insert(0, name, k)
            yield out.astype({c: "Int64" for c in ("side", "p", "n", "m")})

    keys = [*PAIR, "v"]
    dealt = cells.repartitionByRange(chunks, *keys) if chunks > 1 else cells.coalesce(1)
    return dealt.select(*PAIR, "side", "p", "v", "n").mapInPandas(run, schema)


def _facing(cells: DataFrame, level: int) -> DataFrame:
    """The cells that have one of the other side, of any value, at ``level``."""
    kinds = stored(cells.select(*PAIR, "side", "p").distinct(), "kinds")  # at most 64 a pair
    other = kinds.select(*[F.col(c).alias(f"_{c}") for c in (*PAIR, "side", "p")])
    near = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in PAIR])
    met = kinds.join(other, near & (F.col("side") != F.col("_side")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("_p"))) == level), "left_semi")
    return cells.join(met, [*PAIR, "side", "p"], "left_semi")


def _match_in_levels(cells: DataFrame, chunk_cells: int) -> list[DataFrame]:
    """(pair, level, delta, m) of each round; stored. Rounds of a level go on, with ranges of other cells, until one task
    holds all that is left of it. A round that settles less than a quarter of its cells makes the ranges larger."""
    rounds: list[DataFrame] = []
    left = stored(cells, "left")
    for level in range(LEVELS):
        size = chunk_cells
        while True:
            active = stored(_facing(left, level), "active")
            count = active.count()
            if not count:
                drop_stored(active)
                break
            chunks = -(-count // size)
            out = stored(_match_chunks(active, level, chunks), "round")
            rounds.append(out.where("m is not null").select(*PAIR, F.lit(level).alias("level"), "delta", "m"))
            rest = out.where("m is null").select(*PAIR, "side", "p", "v", "n")
            idle = left.join(active.select(*PAIR, "side", "p").distinct(), [*PAIR, "side", "p"], "left_anti")
            done = left
            left = stored(idle.unionByName(rest), "left")
            drop_stored(done)
            drop_stored(active)
            if chunks == 1:
                break
            if rest.count() > 0.75 * count:
                size *= 2
    return rounds


def _with_unmatched(summary: DataFrame, totals: DataFrame) -> DataFrame:
    return (totals.join(summary, PAIR, "left")
            .select(*PAIR, F.coalesce("n_matched", F.lit(0)).alias("n_matched"), "avg_distance", "min_distance",
                    "max_distance", "zero_dist_percent", "distance_sum", F.coalesce("n_nonzero", F.lit(0)).alias("n_nonzero"),
                    (F.col("n_left") - F.coalesce("n_matched", F.lit(0))).cast("long").alias("n_unmatched")))


def match_exact(df: DataFrame, dataset_col: str = "dataset_id", value: str = "Age",
                pairs: Sequence[tuple] | None = None, max_task_edges: int = MAX_TASK_EDGES,
                chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """Exact greedy one-to-one matching per pair; summary with ``n_unmatched`` left rows and ``n_incomplete`` rows.

    Matches min(n_left, n_right) rows of every pair. Pairs of up to ``max_task_edges`` edges between cells are matched by
    one task each, larger ones in rounds over ranges of about ``chunk_cells`` cells, with the same result.
    """
    cells, widths = exact_cells(df, dataset_col, value, pairs)
    cells = stored(cells, "pair-cells")
    count = lambda side, what: F.sum(F.when(F.col("side") == side, what).otherwise(0))
    sizes = stored(cells.groupBy(*PAIR).agg(count(0, 1).alias("cl"), count(1, 1).alias("cr"), count(0, F.col("n")).alias("n_left"))
                   .where("cl > 0"), "sizes")
    small = sizes.where(F.col("cl") * F.col("cr") <= max_task_edges).select(*PAIR)
    large = sizes.where(F.col("cl") * F.col("cr") > max_task_edges).select(*PAIR)
    matched = stored(_match_in_tasks(cells.join(small, PAIR, "left_semi")), "matched")
    if not large.isEmpty():
        for part in _match_in_levels(cells.join(large, PAIR, "left_semi"), chunk_cells):
            matched = matched.unionByName(part)
    apart = F.when(F.col("width") > 0, F.col("delta") / F.col("width")).otherwise(F.lit(0.0))
    matched = matched.join(widths, PAIR).select(*PAIR, ((F.col("level") + apart) / F.lit(6.0)).alias("distance"), "m")
    out = _with_unmatched(distance_summary(matched, weight="m"), sizes.select(*PAIR, "n_left"))
    return with_incomplete(out, df, [*BINARY, value], dataset_col)


def _pair_waves(sizes: DataFrame, wave_rows: int) -> DataFrame:
    """Add ``_wave``: pairs in their order, those of a wave with about ``wave_rows`` rows together, the last one's beyond that."""
    n = F.col("nl") + F.col("nr")
    upto = Window.partitionBy("ds_a").orderBy("ds_b").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each first dataset.
    before = Window.orderBy("ds_a").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.groupBy("ds_a").agg(F.sum(n).alias("_n")).select("ds_a", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    start = F.col("_before") + F.coalesce(F.sum(n).over(upto), F.lit(0))
    return sizes.join(first, "ds_a").withColumn("_wave", F.floor(start / F.lit(wave_rows)).cast("int")).drop("_before")


def _match_dealt(free: DataFrame, m: int, tag: str, tasks: int) -> DataFrame:
    """One round over rows with ``_at``, their pair's number, names and side, and ``_bucket``: matches with ``r_id`` and
    ``distance``, and the free rows, with neither.

    A task gets whole buckets and takes a step of all of them at a time, so that rows need no sorting before. They
    draw after the shuffle, which has nothing but the rows. Most of the time goes to handing columns over, so there are few.
    """
    kind = dict(free.dtypes)["_id"]
    plain = kind in ("tinyint", "smallint", "int", "bigint", "string")  # whose texts Arrow writes as Spark does
    schema = f"_pair long, side int, _id {kind}, _found string, Age double, r_id {kind}, distance double"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        column = lambda c: pa.concat_arrays(rows[c].chunks)
        at, found, ids = column("_at").dictionary_encode(), column("_found").dictionary_encode(), column("_id")
        number, names = zip(*(x.split("|", 1) for x in at.dictionary.to_pylist()))
        number, sides, at = np.array(number, np.int64), np.array([int(x[-1]) for x in names]), at.indices
        pair, side = number[at], sides[at]
        bucket = column("_bucket").to_numpy().astype(np.int64)
        bucket += np.unique(number, return_inverse=True)[1][at] * (bucket.max() + 1)
        texts = pc.binary_join_element_wise(pa.array(names).take(at), ids.cast(pa.string()) if plain else column("_text"), ":", null_handling="skip")
        order = md5_numbers(texts, f":{tag}".encode())
        order = np.lexsort((order[:, 1], order[:, 0], bucket, side))
        left, right = np.split(order, [int((side == 0).sum())])
        starts = md5_numbers(texts.take(pa.array(left)), f":start:{tag}".encode())[:, 0]
        starts = ((starts >> np.uint64(12)).astype(float) + 0.5) / 2.0 ** 52  # as hash_uniform
        values = np.array([[float(x) for x in text.split(",")] for text in found.dictionary.to_pylist()])[found.indices]
        values = np.column_stack([values, rows["Age"].to_numpy()])
        i, j, distance = match_samples(values[left], bucket[left], values[right], bucket[right], starts, m)
        i, j = left[i], right[j]
        free = np.ones(len(rows), bool)
        free[i] = free[j] = False
        k = np.flatnonzero(free)
        none = lambda n, kind: pa.nulls(n, kind)
        taken = [pair[i], none(len(i), pa.int32()), ids.take(pa.array(i)), none(len(i), pa.string()), none(len(i), pa.float64()), ids.take(pa.array(j)), distance]
        rest = [pair[k], side[k].astype(np.int32), ids.take(pa.array(k)), column("_found").take(pa.array(k)), values[k, -1], none(len(k), ids.type), none(len(k), pa.float64())]
        for columns in (taken, rest):
            yield from pa.table(columns, [c.split()[0] for c in schema.split(", ")]).to_batches(max_chunksize=20_000)

    shuffled = free.select("_pair", "_at", "_id", "_found", "Age", "_bucket").repartition(tasks, "_pair", "_bucket")
    return shuffled.select("_at", "_id", "_found", "Age", "_bucket", *([] if plain else [F.col("_id").cast("string").alias("_text")])).mapInArrow(run, schema)


def sampled_matches(df: DataFrame, key: str = "id", dataset_col: str = "dataset_id", m: int = 10, seed: int = 100,
                    pairs: Sequence[tuple] | None = None, bucket_rows: int = BUCKET_ROWS, wave_rows: int = WAVE_ROWS,
                    summary: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Matched rows (ds_a, ds_b, l_id, r_id, distance) of the sampled method, and left rows per pair.

    A round deals the free rows of both sides of a pair by md5 into buckets of about ``bucket_rows``; in its
    bucket each left row in turn, in the order of its md5, takes the nearest of ``m`` rows still free. A
    bucket is a random part of the pair, so that the candidates are a random sample of its free rows. Only what the buckets'
    uneven sizes leave goes on to the next round: some 1 / sqrt(bucket_rows) of it.

    Every row is in as many pairs as there are other datasets. Only the rows of pairs with about ``wave_rows`` rows together
    are written and shuffled at a time, so that disk grows with the rows, not with the rows of all pairs. ``summary`` makes a table
    by pair of matched rows of some whole pairs; then its rows come back, and those of a wave are deleted before the next.
    """
    few = {"spark.sql.files.maxPartitionBytes": SPLIT_BYTES, "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    with settings(df.sparkSession, {**DROP_SHUFFLES, **few}):
        return _sampled_in_waves(df, key, dataset_col, m, seed, pairs, bucket_rows, wave_rows, summary)


def _sampled_in_waves(df, key, dataset_col, m, seed, pairs, bucket_rows, wave_rows, summary) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    *findings, value = DIST_COLS
    text = lambda c: F.coalesce(F.col(c).cast("double").cast("string"), F.lit("NaN"))
    rows = stored(complete_rows(df.select(dataset_col, key, *DIST_COLS))
                  .select(dataset_col, F.col(key).alias("_id"), F.concat_ws(",", *map(text, findings)).alias("_found"), value), "rows")
    sides = stored(pair_sides(rows, dataset_col, value, pairs), "sides")
    counts = stored(rows.groupBy(dataset_col).agg(F.count(F.lit(1)).alias("_n")), "counts")
    of = lambda ds, n: counts.select(F.col(dataset_col).alias(ds), F.col("_n").alias(n))
    buckets = F.ceil(F.greatest("nl", "nr") / F.lit(bucket_rows)).cast("int").alias("_n")
    sizes = stored(_pair_waves(sides.where("side = 0").select(*PAIR).join(of("ds_a", "nl"), "ds_a").join(of("ds_b", "nr"), "ds_b"), wave_rows)
                   .withColumn("_pair", F.monotonically_increasing_id()), "sizes")
    sides = stored(sides.join(sizes.select(*PAIR, "_pair", "_wave", buckets), PAIR)
                   .withColumn("_name", F.concat_ws(":", *PAIR, "side")).withColumn("_at", F.concat_ws("|", "_pair", "_name")), "wave-sides")
    count = lambda s: F.count_if(F.col("side") == s)
    found: list[DataFrame] = []
    for wave, n in sizes.groupBy("_wave").agg(F.sum(F.col("nl") + F.col("nr"))).orderBy("_wave").collect():
        mine = sides.where(F.col("_wave") == wave)
        free = pair_rows(rows, dataset_col, value, sides=mine).withColumn(value, F.col(value).cast("double"))
        rounds: list[DataFrame] = []
        while n:
            tag = f"{seed}:{len(rounds)}"
            tasks = max(-(-n // TASK_ROWS), min(default_partitions(spark), -(-n // (TASK_ROWS // 8))))
            draw = hash_uniform(F.concat_ws(":", "_name", "_id"), f"bucket:{tag}")
            rounds.append(stored(_match_dealt(free.withColumn("_bucket", F.floor(draw * F.col("_n")).cast("int")), m, tag, tasks), "round"))
            rest = rounds[-1].where("distance is null")
            left = stored(rest.groupBy("_pair").agg(count(0).alias("nl"), count(1).alias("nr")).where("nl > 0 and nr > 0")
                          .select("_pair", buckets, (F.col("nl") + F.col("nr")).alias("_rows")), "sizes")
            n = left.agg(F.sum("_rows")).first()[0]
            free = rest.join(left, "_pair").join(mine.select("_pair", "side", "_name", "_at"), ["_pair", "side"])
        matched = reduce(DataFrame.unionByName, [r.where("distance is not null") for r in rounds]).join(sizes.select("_pair", *PAIR), "_pair")
        matched = matched.select(*PAIR, F.col("_id").alias("l_id"), "r_id", "distance")
        if summary:
            matched = stored(summary(matched), "summary")
            for r in rounds:
                drop_stored(r)
        found.append(matched)
    if not found:
        kind = dict(rows.dtypes)["_id"]
        empty = spark.createDataFrame([], f"{_pair_type(sides)}, l_id {kind}, r_id {kind}, distance double")
        found = [summary(empty) if summary else empty]
    drop_stored(rows)
    return reduce(DataFrame.unionByName, found), sizes.select(*PAIR, F.col("nl").alias("n_left"))


def match_sampled(df: DataFrame, key: str = "id", dataset_col: str = "dataset_id", m: int = 10,
                  seed: int = 100, pairs: Sequence[tuple] | None = None) -> DataFrame:
    """Sampled greedy one-to-one matching per pair (``m`` free candidates per left row per round)."""
    summaries, totals = sampled_matches(df, key, dataset_col, m, seed, pairs, summary=distance_summary)
    return with_incomplete(_with_unmatched(summaries, totals), df, dataset_col=dataset_col)
