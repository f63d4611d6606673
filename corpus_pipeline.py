"""A training corpus from ``documents``: five stages, each written as Parquet
and read again as the next one's input.

The mixing stage uses the budget at which the least repeated source is taken
exactly once, so it loses no document; others are repeated, at most
``MAX_EPOCHS`` times.  The last stage returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, packing, simhash, suffix
from tessera.llm.common import add_columns, load, pick, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The words a passage has at most to stay although another document holds it.
PASSAGE_WORDS = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have letters; goes: null texts and texts
    without letters.  A null lang becomes the predicted one, unless no language
    could be learned."""
    own = pick(docs, *COLUMNS)
    model = langid.fit(langid.train_rows(own))
    if not model.langs:
        lettered = add_columns(own, ["text"], [("lettered", "boolean")], lambda: lambda texts: ([bool(langid.words_of(t or "")) for t in texts],))
        return lettered.where("lettered").select(*COLUMNS)
    told = langid.identify(own, model).where(F.col("lang_pred") != langid.UNKNOWN)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each component; a null doc_id
    counts as larger than any other."""
    # Written with their ids: the ids depend on the scan's splits, which may differ from job to job.
    rows = stored(pick(docs, *COLUMNS).withColumn("row", F.monotonically_increasing_id()), "simhash-rows")
    found = simhash.components_of(rows.select("doc_id", "text", "row"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what op8 cuts out, and passages of more than ``PASSAGE_WORDS``
    words that another document holds, however few bytes they have; a character
    cut in two goes whole.  Documents of which no text is left go."""
    out = suffix.remove_repeats(pick(docs, *COLUMNS), words=PASSAGE_WORDS)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.decode(suffix.whole_characters(F.col("kept")), "UTF-8"))
    return (out.withColumn("text", text).where(F.trim("text") != "")
            .withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counted = mixing.count_tokens(pick(docs, *COLUMNS), "text", "lang", "n_chars")
    weights = stored(mixing.source_weights(counted.select("source", "n_tokens"), budget=None), "mix-weights")
    return mixing.mix(counted, weights).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(pick(docs, "doc_id", "text"), packing.tokenizer_path()).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(stored(pieces, "pack-pieces"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, XXH64 and byte-level repeats are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
