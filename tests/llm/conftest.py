import pytest

#: Table of documents with the awkward cases: nulls, empty and long texts, ties, repeated rows.
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT_ string, fp bigint, row string"


@pytest.fixture(scope="session")
def sample_docs(spark):
    """The documents of the smallest test tables."""
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def table(spark, rows):
    """rows: (doc_id, text, lang, source) as a table with extra columns that clash with names used inside."""
    full = [(*r, len(r[1]) if r[1] else 0, "x", 7, "y") for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def saved(spark, tmp_path, rows):
    """The same as a folder of test tables."""
    path = str(tmp_path)
    table(spark, rows).drop("TEXT_").withColumnRenamed("row", "ROW").write.parquet(f"{path}/documents.parquet")
    return path


AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "", None, None), (4, "one two", "en", "b"),
    (5, "12 34 !!", None, "b"), (6, "one two", "en", "b"), (6, "one two", "en", "b"), (None, "nobody knows", "en", "a"),
    (7, "the cat and the dog " * 3000, "en", "a"), (8, "x" * 5000, "de", "c"), (9, "é" * 300 + " ñ", "es", "c"),
]
