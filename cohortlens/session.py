"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cohortlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster leave ``master`` unset so spark-submit decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a
    local master gets a private folder; any other master is an error, since
    executors would not see a folder of the driver's.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
        configured = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/cohortlens-scratch/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that this library has written below the shared folder; no DataFrame may still read them."""
    _DERIVED.clear()
    files, path = _file_system(spark, f"{checkpoint_dir(spark).rstrip('/')}/cohortlens-scratch")
    files.delete(path, True)


_DERIVED: dict[tuple, tuple] = {}


def derived_once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, a written table derived from the table at path ``source``; made once a session.

    It is made anew when ``source`` has another time of change or size (a folder changes when files come or go), or
    when its files are gone. ``drop_scratch`` forgets it.
    """
    files, path = _file_system(spark, source)
    status = files.getFileStatus(path)
    key = (id(spark), checkpoint_dir(spark), str(status.getPath()), name)
    version = (status.getModificationTime(), status.getLen())
    kept = _DERIVED.get(key)
    if kept is None or kept[0] != version or not all(_exists(spark, f) for f in kept[1].inputFiles()[:1]):
        kept = _DERIVED[key] = (version, make())
    return kept[1]


def _exists(spark: SparkSession, name: str) -> bool:
    files, path = _file_system(spark, name)
    return files.exists(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Computed once whatever reads it, and the planner then knows its real size:
    a join broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the tables below the scratch folder that ``df`` reads; no DataFrame may still read them."""
    for name in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/cohortlens-scratch/" in name:
            files, path = _file_system(df.sparkSession, name)
            files.delete(path, True)


#: With these, a table's shuffle files go when it is written, not when the driver's garbage is collected.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
