"""S1, sniffed: CSV files whose dialect and types nobody has declared.

The dialect (delimiter, quote, header) is found file by file from the first
lines of each file, in tasks; the driver sees only the distinct layouts.  The
types are found from all values, not from a sample: one aggregate counts, for
every column, how many values each type of the lattice can hold, with partial
results per split, and the narrowest type that holds them all is taken.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import compiled_methods

DELIMITERS = [",", "\t", ";", "|"]
QUOTES = ['"', "'"]
#: Lines of each file that the dialect is judged by, and characters of a line.
SAMPLE_LINES = 100
SAMPLE_CHARS = 100_000
#: The lattice, narrowest first; text holds every value.
LATTICE = ["boolean", "bigint", "double", "date", "timestamp_ntz"]
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
DATE = re.compile(r"\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d(\.\d+)?)?)?")
BOOLEAN = re.compile("true|false", re.IGNORECASE)


# ---- dialect ----


def kind_of(text: str) -> str:
    text = text.strip()
    for kind, pattern in (("number", NUMBER), ("date", DATE), ("boolean", BOOLEAN)):
        if pattern.fullmatch(text):
            return kind
    return "text" if text else "blank"


def dialect_of(lines: list[str]) -> tuple[str, str, bool, list[str]]:
    """Delimiter, quote, whether there is a header, and the column names.

    The dialect is the one by which most lines have the same number of fields,
    two or more, then the one whose quote encloses more fields, then the one
    with more fields.  The first line is a header if
    its fields are distinct texts and some column below it is of another kind,
    or if every value below differs from it in a file of texts only."""
    best = None
    for quote in QUOTES:
        for sep in DELIMITERS:
            rows = [r for r in csv.reader(lines, delimiter=sep, quotechar=quote) if r]
            sizes = Counter(map(len, rows))
            width, n = max(sizes.items(), key=lambda x: (x[1], x[0])) if sizes else (0, 0)
            enclosed = re.compile(f"(?:^|{re.escape(sep)}){quote}.*?{quote}(?={re.escape(sep)}|$)")
            rank = (width > 1, n / max(1, len(rows)), sum(len(enclosed.findall(x)) for x in lines), width)
            if best is None or rank > best[0]:
                best = (rank, sep, quote, rows, width)
    _, sep, quote, rows, width = best
    if not rows:
        return ",", '"', False, []
    first, below = rows[0], [r for r in rows[1:] if len(r) == width]
    named = len(set(first)) == len(first) and all(kind_of(f) == "text" for f in first)
    typed = any(kind_of(r[i]) not in ("text", "blank") for r in below for i in range(min(width, len(first))))
    header = named and (typed or (bool(below) and not any(set(first) & set(r) for r in below)))
    return sep, quote, header, first if header else [f"column{i}" for i in range(width)]


def sniff_dialects(spark: SparkSession, path: str) -> DataFrame:
    """file, sep, quote, header, names for every file below ``path``."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.substring("value", 1, SAMPLE_CHARS).alias("line")).where("start = 0").drop("start")

    def run(batches):
        file, held = None, []

        def told():
            sep, quote, header, names = dialect_of(held)
            return pa.RecordBatch.from_pydict({"file": [file], "sep": [sep], "quote": [quote], "header": [header], "names": [names]})

        for b in batches:
            # A file's lines follow each other: nothing new in a batch that lies behind the sample.
            files = b.column("file")
            if len(held) == SAMPLE_LINES and files[0].as_py() == file == files[-1].as_py():
                continue
            for f, line in zip(b.column("file").to_pylist(), b.column("line").to_pylist(), strict=True):
                if f != file:
                    if file is not None:
                        yield told()
                    file, held = f, []
                if len(held) < SAMPLE_LINES:
                    held.append(line)
        if file is not None:
            yield told()

    return lines.mapInArrow(run, "file string, sep string, quote string, header boolean, names array<string>")


# ---- types ----


def _blank_to_null(name: str):
    return F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))


def kinds_held(text):
    """Which types of the lattice the value of a text column can be of, as a
    sum of powers of two; NULL for NULL.  Strict forms only: a number is no
    date, a year no boolean.  Every number is a double and every day a time;
    the first character and the length rule most forms out."""
    bit = {k: 1 << i for i, k in enumerate(LATTICE)}

    def if_it_is(kind, *also):
        return F.when(text.try_cast(kind).isNotNull(), sum(bit[k] for k in (kind, *also))).otherwise(0)

    timed = r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d(\.\d+)?)?$"
    figures = (F.when(text.rlike(r"^[+-]?\d+$"), if_it_is("bigint") + bit["double"])
               .when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bit["double"])
               .when(text.rlike(r"^\d{4}-\d\d-\d\d$"), if_it_is("date", "timestamp_ntz"))
               .when(text.rlike(timed), if_it_is("timestamp_ntz")).otherwise(0))
    return (F.when(text.isNull(), F.lit(None).cast("int")).when((text >= "+") & (text < ":"), figures)
            .when(F.octet_length(text).between(4, 5) & text.rlike("^(?i)(true|false)$"), bit["boolean"]).otherwise(0))


def sniff_types(texts: DataFrame) -> dict[str, str]:
    """The narrowest type of each text column, over all rows in one aggregate:
    the types that every value can be of."""
    spark = texts.sparkSession
    with compiled_methods(spark):
        held = texts.select(*[_blank_to_null(c).alias(f"c{i}") for i, c in enumerate(texts.columns)])
        # A step of its own: the aggregate's code repeats what is inside it.
        kinds = held.select(*[kinds_held(F.col(c)).alias(c) for c in held.columns])
        got = kinds.agg(*[F.bit_and(c).alias(c) for c in kinds.columns]).first()
    return {c: next((k for j, k in enumerate(LATTICE) if (got[i] or 0) >> j & 1), "string") for i, c in enumerate(texts.columns)}


def read_sniffed_texts(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path`` as text columns, each read by its own dialect;
    columns meet by name."""
    parts = []
    layouts = sniff_dialects(spark, path).groupBy("sep", "quote", "header", "names").agg(F.collect_list("file").alias("files"))
    for r in layouts.orderBy("sep", "quote", "header", F.array_join("names", "\x00")).collect():
        if not r["names"]:
            continue
        schema = T.StructType([T.StructField(n.strip(), T.StringType()) for n in r["names"]])
        parts.append(spark.read.schema(schema).option("header", r["header"]).option("sep", r["sep"]).option("quote", r["quote"])
                     .option("escape", r["quote"]).option("mode", "FAILFAST").option("enforceSchema", True).csv(list(r["files"])))
    if not parts:
        raise ValueError(f"no rows below {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Dialect and types found from the files themselves.  Blank is NULL."""
    texts = read_sniffed_texts(spark, path)
    kinds = sniff_types(texts)
    return texts.select(*[_blank_to_null(c).cast(kinds[c]).alias(c) for c in texts.columns])
