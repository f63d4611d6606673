"""S4, incremental, and P11-P13 in the same pass.

``Landing`` keeps a lake up to date with a folder of raw CSV files.  A ledger
holds path, modification time and length of every file that is in the lake;
only files it does not know are read.  The lake's rows carry the file they came
from, so a file that was replaced replaces its rows.  Only (year, month)
folders that gain or lose rows are written again; the ledger is written last,
so a run that was cut short is simply repeated and ends in the same lake.
Folders are written in batches of bounded rows, and a run's own tables and
shuffle files go with it: on disk are the files, their rows twice and one batch.

Records that do not parse go to a quarantine table with file, line and reason;
the pass that reads the files counts them (an ``Observation``), together with
rows per guard.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.schemas import KEEP_COLUMNS, OBSERVATION_SCHEMA
from tessera.session import compiled_methods, delete_path, materialize, settings, spare_disk
from tessera.sources.lake import PARTITION_COLUMNS, read_lake

SOURCE = "source_file"
LEDGER_SCHEMA = "path string, modificationTime timestamp, length bigint"
QUARANTINE_SCHEMA = "source_file string, line string, reason string"
Folder = tuple[int | None, int | None]
#: Bytes of text to a byte of a compressed file, as far as dealing files to tasks goes.
COMPRESSION = 8
#: Folder name of a NULL.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Rows that one shuffle into the lake's folders moves, unless one folder has more.
BATCH_ROWS = 16_000_000


def checked_observations(spark: SparkSession, paths, schema: T.StructType = OBSERVATION_SCHEMA, sep: str = ",") -> DataFrame:
    """The typed columns, ``source_file``, ``reason``: NULL for a good record,
    else what is wrong with it first, and ``line``: the raw record of a bad
    one, NULL for a good one."""
    texts = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField("_line", T.StringType())])
    raw = (spark.read.schema(texts).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("quote", '"')
           .option("escape", '"').option("columnNameOfCorruptRecord", "_line").csv(paths)
           .withColumn(SOURCE, F.col("_metadata.file_path")))
    values = {}
    for i, f in enumerate(schema.fields):
        if isinstance(f.dataType, T.StringType):
            continue
        text = F.trim(F.col(f"`{f.name}`"))
        value = text.try_cast(f.dataType)
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            value = F.coalesce(value, text.try_cast("double").try_cast(f.dataType))
        values[f.name] = value.alias(f"_v{i}")
    raw = raw.select("*", *values.values())  # a step of its own: each value is used twice, and found once
    reason = F.when(F.col("_line").isNotNull(), F.lit("wrong number of fields"))
    typed = []
    for i, f in enumerate(schema.fields):
        text = F.trim(F.col(f"`{f.name}`"))
        if f.name in values:
            typed.append(F.col(f"_v{i}").alias(f.name))
            reason = reason.when(F.col(f"_v{i}").isNull() & (text != ""), F.lit(f"bad value in column {f.name}"))
        else:
            typed.append(F.nullif(text, F.lit("")).alias(f.name))
    record = F.coalesce("_line", F.array_join(F.array(*[F.col(f"`{f.name}`") for f in schema.fields]), sep, ""))
    return raw.select(*typed, SOURCE, F.when(reason.isNotNull(), record).alias("line"), reason.alias("reason"))


@dataclasses.dataclass
class Increment:
    """What one run did.  ``folders``: the (year, month) folders it wrote."""

    files: int
    rows: int
    rejected: int
    without_date: int
    folders: list[tuple[int, int]]


class Landing:
    def __init__(self, spark: SparkSession, raw: str, root: str):
        self.spark, self.raw = spark, raw
        self.lake, self.ledger, self.quarantine = f"{root}/lake", f"{root}/ledger", f"{root}/quarantine"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _table(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def rejects(self) -> DataFrame:
        return self._table(self.quarantine, QUARANTINE_SCHEMA)

    def rows(self) -> DataFrame:
        return read_lake(self.spark, self.lake)

    def run(self) -> Increment:
        """Take in the files that are new or have changed."""
        with spare_disk(self.spark):
            return self._run()

    def _run(self) -> Increment:
        spark = self.spark
        # Listing only: the column with the bytes is not read.
        present = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,csv.gz}").load(
            self.raw).select("path", "modificationTime", "length")
        known = materialize(self._table(self.ledger, LEDGER_SCHEMA), "ledger")
        fresh = materialize(present.join(known, ["path", "modificationTime", "length"], "left_anti"), "ledger-new")
        files = [r["path"] for r in fresh.select("path").collect()]
        if not files:
            return Increment(0, 0, 0, 0, [])

        seen = Observation("landing")
        read = checked_observations(spark, files).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count("reason").alias("rejected"),
            F.count_if(F.col("reason").isNull() & F.col("eventDate").isNull()).alias("without_date"))
        with compiled_methods(spark), settings(spark, _packing(spark, files)):
            # In the order of the folders, so that a batch of folders reads its own pages only.
            read = materialize(read.sortWithinPartitions(*PARTITION_COLUMNS), "landing")
        counts = seen.get

        good = read.where(F.col("reason").isNull() & F.col("eventDate").isNotNull()).select(*[F.col(f"`{c}`") for c in KEEP_COLUMNS], SOURCE)
        changed = fresh.select(F.col("path").alias(SOURCE))
        folders = self._write_folders(good, changed)

        bad = read.where(F.col("reason").isNotNull()).select(SOURCE, "line", "reason")
        if self._exists(self.quarantine):  # read before it is written
            bad = materialize(self.rejects().join(changed, SOURCE, "left_anti").unionByName(bad), "quarantine")
        bad.write.mode("overwrite").parquet(self.quarantine)
        ledger = materialize(known.join(fresh.select("path"), "path", "left_anti").unionByName(fresh), "ledger-next")
        ledger.write.mode("overwrite").parquet(self.ledger)
        return Increment(len(files), counts["rows"], counts["rejected"], counts["without_date"], sorted(folders, key=str))

    def _write_folders(self, good: DataFrame, changed: DataFrame) -> list[Folder]:
        """Write the folders that gain rows of ``good`` or lose rows of the
        ``changed`` files, in batches of at most ``BATCH_ROWS`` rows (or one
        folder), so that disk for the shuffle does not grow with the delivery."""
        n_rows = _rows_by_folder(good)
        old = read_lake(self.spark, self.lake) if self._exists(self.lake) else None
        if old is not None:
            # The folders of replaced files, found by their footers' file names.
            lost = [tuple(r) for r in old.join(changed, SOURCE, "left_semi").select(*PARTITION_COLUMNS).distinct().collect()]
            held = _rows_by_folder(old.where(_in_folders([*n_rows, *lost])))
            n_rows = {f: n_rows.get(f, 0) + held.get(f, 0) for f in {*n_rows, *lost}}
        batches = _batches(n_rows)
        for batch in batches:
            here = _in_folders(batch)
            if old is None:
                self._write(good.where(here) if len(batches) > 1 else good)
                continue
            kept = old.where(here).join(changed, SOURCE, "left_anti").select(*[F.col(f"`{c}`") for c in good.columns])
            with spare_disk(self.spark):
                rows = materialize(good.where(here).unionByName(kept), "landing-folders")  # the lake is read before it is written
                self._write(rows)
                for f in {*batch} - {*_rows_by_folder(rows)}:
                    names = [f"{c}={NO_VALUE if v is None else v}" for c, v in zip(PARTITION_COLUMNS, f, strict=True)]
                    delete_path(self.spark, "/".join([self.lake, *names]))
        return list(n_rows)

    def _write(self, rows: DataFrame) -> None:
        (rows.hint("rebalance", *PARTITION_COLUMNS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*PARTITION_COLUMNS).parquet(self.lake))


def _packing(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """Files are dealt to tasks by their bytes; of compressed ones a task gets as many as hold about the usual text."""
    usual = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return {"spark.sql.files.maxPartitionBytes": str(usual // COMPRESSION)} if any(f.endswith(".gz") for f in files) else {}


def _rows_by_folder(rows: DataFrame) -> dict[Folder, int]:
    return {(r[0], r[1]): r[2] for r in rows.groupBy(*PARTITION_COLUMNS).agg(F.count(F.lit(1))).collect()}


def _in_folders(folders: list[Folder]) -> Column:
    """Rows of these folders; NULL is a folder of its own."""
    months = {}
    for y, m in folders:
        months.setdefault(y, []).append(m)
    here = F.lit(False)
    for y, ms in months.items():
        month = F.col("month").isin([m for m in ms if m is not None])
        here = here | (F.col("year").eqNullSafe(F.lit(y)) & (month | F.col("month").isNull() if None in ms else month))
    return here


def _batches(n_rows: dict[Folder, int]) -> list[list[Folder]]:
    """The folders in order, cut where the next one would make more than ``BATCH_ROWS`` rows."""
    batches, held = [], 0
    for f in sorted(n_rows, key=lambda f: [(v is not None, v or 0) for v in f]):
        if not batches or held + n_rows[f] > BATCH_ROWS:
            batches.append([])
            held = 0
        batches[-1].append(f)
        held += n_rows[f]
    return batches
