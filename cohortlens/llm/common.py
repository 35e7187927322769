"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a
    recomputation, and so that several readers see one realisation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SLICE_ROWS = 1024
SLICE_BYTES = 4 << 20


def slices(batch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator:
    """An Arrow batch in order, in slices of up to ``rows`` rows and, but for single rows above it, ``size`` bytes of text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    upto = np.zeros(batch.num_rows + 1, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            upto[1:] += np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(upto, upto[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch as a dict of Python lists; rows in, rows out.

    ``fn`` may be a factory (``make(): fn``) when it has attribute ``per_task``:
    it is then called once a task, so that vocabularies are parsed once. A step may return None, and may have an
    attribute ``finish`` for the rows that follow the task's last batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    names = target.names
    factory = getattr(fn, "per_task", False)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def record(out):
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

        step = fn() if factory else fn
        for batch in batches:
            for part in slices(batch):
                out = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if out and len(out[names[0]]):
                    yield record(out)
        if hasattr(step, "finish"):
            yield record(step.finish())

    return df.mapInArrow(run, schema)


def per_task(make: Callable) -> Callable:
    make.per_task = True
    return make


def hash_fraction(key: Column, fraction: Column | float) -> Column:
    """True for about ``fraction`` of the key values, the same ones in every run."""
    unit = (F.xxhash64(key).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    return unit < fraction


def bounded_fraction(df: DataFrame, bound: int) -> float:
    """The share of rows that keeps about ``bound`` of them (1.0 below the bound)."""
    n = df.count()
    return 1.0 if n <= bound else bound / n


BITMAP_BITS = 1 << 25


def split_by_bitmap(df: DataFrame, key: Column, keys: DataFrame, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ``keys``, rows whose key is surely not): a filter that needs no shuffle.

    The keys' hashes set bits in a map of ``bits`` bits, broadcast as its non-zero words: at most ``bits`` / 64 rows,
    whatever the size of the tables. An exact join of the first part follows; the map only spares the rest the shuffle.
    A full map spares nothing and changes no result. A null key is surely not in ``keys``.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = place(F.col(keys.columns[0]))
    words = (keys.select(F.floor(at / 64).cast("long").alias("_word"), F.expr("1L").alias("_one"), (at % 64).cast("int").alias("_bit"))
             .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("_bits")))
    words = F.broadcast(materialise(words, "bitmap"))
    mine = place(key)
    hit = ((F.floor(mine / 64).cast("long") == F.col("_word"))
           & (F.col("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (mine % 64).cast("int"))) != 0) & key.isNotNull())
    return df.join(words, hit, "left_semi"), df.join(words, hit, "left_anti")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; component = smallest node.

    Each round takes the smallest label among a node's neighbours and then
    jumps to that label's label. Labels only fall, and the loop ends when none
    has changed. All state is in written tables; the driver sees one count a
    round. Nulls and self-links add nothing.
    """
    # One realisation of the edges: both directions must come from the same.
    links = materialise(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), f"{name}-edges")
    links = materialise(links.select("src", "dst").union(links.select("dst", "src")).distinct(), f"{name}-links")
    labels = materialise(links.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")),
                         f"{name}-labels")
    while True:
        near = (links.join(labels, links["dst"] == labels["node"])
                .groupBy("src").agg(F.min("component").alias("_near")))
        lower = materialise(labels.join(near, labels["node"] == near["src"])
                            .select("node", "component", F.least("component", "_near").alias("_low")), f"{name}-low")
        jump = lower.select(F.col("node").alias("_at"), F.col("_low").alias("_far"))
        after = materialise(lower.join(jump, lower["_low"] == jump["_at"])
                            .select("node", F.least("_low", "_far").alias("component"),
                                    (F.least("_low", "_far") < F.col("component")).alias("_moved")), f"{name}-labels")
        labels = after.select("node", "component")
        if after.where("_moved").limit(1).count() == 0:
            return labels
