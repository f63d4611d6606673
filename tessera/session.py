"""Session helpers: building a session for tests/bench, the shared checkpoint
folder, and size-checked broadcasting.

Library functions never create sessions; they take the caller's session from
the DataFrames they are given.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest estimated size (bytes) of a data-derived side we broadcast after
# measuring it; anything larger goes through a shuffle join.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
#: Bytes of a method beyond which the JVM interprets it for ever instead of compiling it.
COMPILED_METHOD_BYTES = 8000
METHOD_SETTING = "spark.sql.codegen.hugeMethodLimit"
#: Settings of jobs that move many rows: shuffle files go with the execution that wrote them, tables are stored small.
SPARE_DISK = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
#: Paths that ``materialize`` has written inside ``spare_disk``, innermost last.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def build_session(master: str | None = None, app: str = "tessera", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session tuned the way the jobs expect (AQE on, UI off, UTC).

    On a cluster the same keys would come from spark-defaults; this helper
    is what tests and ``bench.py`` use.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or max(8, 2 * int(cpus))
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` (or already set on the
    SparkContext) is used as is.  Only when nothing is configured and the
    master is local (tests, a laptop) a folder under the system temp dir is
    created; on a cluster an unset folder is an error, since a machine-local
    path is not visible to the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder for tables a
    job writes for itself (landed files, stream sinks, intermediate tables)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plain scan reads, as the planner knows them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def sized_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES, growth: int = 4) -> DataFrame:
    """``df``, computed once, with a broadcast hint if it is small.

    The frame is written as a table and read back, so the decision rests on
    the bytes it really has (times ``growth``, for what Parquet has saved) and
    nothing stays cached: a later call sees what has landed since.  Beyond the
    limit the join stays a shuffle join, on the stored table.
    """
    table = materialize(df, "broadcast-side")
    return F.broadcast(table) if stored_bytes(table) * growth <= limit_bytes else table


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once and cut its lineage: the rows are written as a
    Parquet table under the shared checkpoint folder and read back, so several
    consumers (and a retried task after an executor loss) read columns of the
    stored table and never replay the upstream plan.  Nothing stays cached:
    a later call over changed input computes its own table."""
    path = scratch_path(df.sparkSession, name)
    for paths in _PASSING.get()[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def spare_disk(spark: SparkSession):
    """For jobs that write their result elsewhere: shuffle files are deleted as
    soon as the execution that wrote them has ended, not when the driver
    happens to collect its garbage, and the tables that ``materialize`` stores
    inside are deleted at the end of the block.  No frame that reads one of
    them may leave it."""
    paths: list[str] = []
    token = _PASSING.set((*_PASSING.get(), paths))
    try:
        with settings(spark, SPARE_DISK):
            yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            delete_path(spark, path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; nothing happens if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def compiled_methods(spark: SparkSession):
    """For jobs that convert many columns at once: a stage whose generated
    method is too long for the JVM's compiler runs operator by operator, in
    code that Spark splits into short methods.  Jobs have to run inside, since
    the setting is read when they start."""
    before = spark.conf.get(METHOD_SETTING)
    if int(before) > COMPILED_METHOD_BYTES:
        spark.conf.set(METHOD_SETTING, str(COMPILED_METHOD_BYTES))
    try:
        yield
    finally:
        spark.conf.set(METHOD_SETTING, before)
