"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.session import scratch_path


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only.  Every other column is left behind, also one
    whose name differs in case alone or equals a name used inside an operator;
    of several columns with one name the first counts."""
    at = [df.columns.index(n) for n in names]
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[flat[f"c{i}"].alias(n) for i, n in zip(at, names, strict=True)])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: a table that outlives the executors that computed it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted),
    else as it is.  For narrow tables that are cheap to count, such as stored
    ones."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows with the highest ``n`` (positive), at most ``limit`` of them.
    The bound is a step of a logarithmic scale, found from the number of rows
    on each step (a few hundred), so no task and no driver sorts the rows;
    rows on the same step stay or go together."""
    step = F.floor(F.log2(n) * 16)
    left, least = limit, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        left -= r["rows"]
        if left < 0:
            break
        least = r["step"]
    return counts.where(step >= least) if least is not None else counts.limit(0)


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker process, shared by
    the tasks that run in it one after the other."""
    home = sys.modules.setdefault("tessera_worker_cache", types.ModuleType("tessera_worker_cache"))
    return home.__dict__.setdefault(name, {})


def release_worker_memory() -> None:
    """Called where an operator's tasks begin and end: forget what an operator
    left in this Python worker and give unused memory back to the system, so
    that an idle worker holds little while other stages run."""
    home = sys.modules.get("tessera_worker_cache")
    for kept in [v for v in vars(home).values() if isinstance(v, dict)] if home else []:
        kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


#: Rows of an Arrow batch where whole texts travel; the default of 10,000 rows
#: is meant for narrow rows and makes batches of any number of bytes.
TEXT_BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches were made small, unless the
    session already asks for smaller ones.  The setting is read when a job
    starts, so it stays."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_SETTING)) > TEXT_BATCH_ROWS or int(conf.get(BATCH_SETTING)) <= 0:
        conf.set(BATCH_SETTING, str(TEXT_BATCH_ROWS))
    return df


def add_columns(df: DataFrame, inputs: list[str], new: list[tuple[str, str]], start) -> DataFrame:
    """``df`` with the columns ``new`` (name, type) computed by Python, batch
    by batch.  ``start()`` is called once a task and returns a function from
    the lists of the input columns to one list for each new column."""
    fields = [T.StructField(n, T._parse_datatype_string(t)) for n, t in new]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*df.columns, *(n for n, _ in new)]

    def run(batches):
        release_worker_memory()
        work = start()
        try:
            for b in batches:
                got = work(*[b.column(c).to_pylist() for c in inputs])
                arrays = [pa.array(v, type=k) for v, k in zip(got, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=names)
        finally:
            del work
            release_worker_memory()

    return text_batches(df).mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def map_lists(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` gets the batches as dictionaries of lists, so that integers stay
    exact beside nulls, and yields lists of result rows (tuples)."""
    fields = T._parse_datatype_string(schema).fields
    kinds, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]

    def work(batches):
        lists = ({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)} for b in batches)
        for rows in run(lists):
            cols = zip(*rows, strict=True) if rows else ([],) * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return text_batches(df).mapInArrow(work, schema)
