"""Language identification by word-first backoff.

Training counts words, and character n-grams of words (word ends marked), by
language.  A known word scores by its smoothed log frequency in each language.
A word that was not seen falls back to its longest character n-grams; when
none of those is known, to the next shorter ones, down to single letters.
The document's language has the highest total; its score is the share of
that language when the totals are taken as log weights.

The model is fit on a sample of labelled rows of bounded size: of each language
the ``fit_rows`` rows with the smallest hash of id and text, equal rows once.
It keeps a bounded number of entries of each kind, the most frequent ones when
every language has the same weight; its size is therefore fixed and it travels
to the tasks with their code.  Known words are kept as sorted 64-bit hashes.
Prediction reads every whole text.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
an empty training set makes every text ``und``; languages that tie resolve to
the first in alphabetical order; a null id counts as not held out; repeated
rows are predicted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, load, most_frequent, pick, release_worker_memory, small, stored, text_batches

#: Upper bound of labelled rows of a language that the model is fit on.
FIT_ROWS = 5_000
#: Entries kept of the words, and of the n-grams of each length.
MAX_WORDS = 200_000
MAX_GRAMS = 50_000
#: Unseen words whose scores a task remembers.
MEMO = 50_000
#: Counts a task gathers before it hands them on.
HELD_COUNTS = 100_000
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"

LETTERS = re.compile(r"[^\W\d_]+")
#: Numerals that the pattern takes for letters, such as a half or a circled one.
NUMERALS = {i: " " for i in range(0x20000) if chr(i).isalnum() and not chr(i).isalpha() and not chr(i).isdecimal()}
MAY_HAVE_NUMERALS = re.compile("[" + "".join(chr(i) for i in NUMERALS if i < 0x10000) + "\U00010000-\U0010ffff]")


def words_of(text: str) -> list[str]:
    if not text.isascii() and MAY_HAVE_NUMERALS.search(text):
        text = text.translate(NUMERALS)
    return LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between marks; n = 1: its letters."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def held_out(id_col: str, parts: int = 4, part: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def word_counts(labelled: DataFrame) -> DataFrame:
    """word, lang, n over the rows (text, lang)."""

    def run(batches):
        release_worker_memory()
        counts = Counter()

        def frame():
            return pd.DataFrame([(w, la, n) for (w, la), n in counts.items()], columns=["word", "lang", "n"])

        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                for w, c in Counter(words_of(text)).items():
                    counts[w, lang] += c
                if len(counts) > HELD_COUNTS:
                    yield frame()
                    counts.clear()
        yield frame()
        counts.clear()
        release_worker_memory()

    parts = text_batches(labelled).select("text", "lang").mapInPandas(run, "word string, lang string, n bigint")
    return parts.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """ord (0: whole word), gram, lang, n from counted words."""

    def run(batches):
        counts = Counter()

        def frame():
            return pd.DataFrame([(o, g, la, n) for (o, g, la), n in counts.items()], columns=["ord", "gram", "lang", "n"])

        for b in batches:
            for w, lang, n in zip(b["word"], b["lang"], b["n"], strict=True):
                counts[0, w, lang] += n
                for o in ORDERS:
                    for g in grams_of(w, o):
                        counts[o, g, lang] += n
                if len(counts) > HELD_COUNTS:
                    yield frame()
                    counts.clear()
        yield frame()

    parts = words.mapInPandas(run, "ord int, gram string, lang string, n bigint")
    return parts.groupBy("ord", "gram", "lang").agg(F.sum("n").alias("n"))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


class Model:
    """``known`` holds the sorted hashes of the known words, ``scores[0]``
    their rows; ``tables[o]`` maps a gram of order o to its row of
    ``scores[o]``."""

    def __init__(self, langs, tables, scores, known=np.zeros(0, dtype=np.uint64)):
        self.langs, self.tables, self.scores, self.known = langs, tables, scores, known

    def back_off(self, word: str) -> np.ndarray:
        """Log weights of a word that is not known as a whole."""
        for o in ORDERS:
            rows = [i for g in grams_of(word, o) if (i := self.tables[o].get(g)) is not None]
            if rows:
                return self.scores[o][rows].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None, memo: Memo) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        hashes = word_hashes(words)
        places = np.searchsorted(self.known, hashes)
        places[places == len(self.known)] = 0
        found = self.known[places] == hashes if len(self.known) else np.zeros(len(words), dtype=bool)
        total = self.scores[0][places[found]].sum(axis=0, dtype=np.float64)
        if not found.all():
            total = total + memo.total(self, [words[i] for i in np.flatnonzero(~found)])
        best = int(np.argmax(total))
        return self.langs[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())


class Memo:
    """Scores of unseen words, at most MEMO at a time."""

    def __init__(self):
        self.places, self.scores = {}, None

    def total(self, model: Model, words: list[str]) -> np.ndarray:
        out = np.zeros(len(model.langs))
        if self.scores is None:
            self.scores = np.zeros((MEMO, len(model.langs)))
        at = []
        for w in words:
            i = self.places.get(w)
            if i is None:
                if len(self.places) == MEMO:
                    out += self.scores[at].sum(axis=0)
                    at = []
                    self.places.clear()
                i = self.places[w] = len(self.places)
                self.scores[i] = model.back_off(w)
            at.append(i)
        return out + self.scores[at].sum(axis=0)


def fit_sample(labelled: DataFrame, fit_rows: int) -> DataFrame:
    """text, lang of the rows that the model is fit on."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    cuts = (rows.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= fit_rows)
            .groupBy("lang").agg(F.max("h").alias("cut")))
    return rows.join(small(stored(cuts, "langid-cuts")), "lang").where("h <= cut").dropDuplicates(["lang", "h"]).select("text", "lang")


def gathered(rows: DataFrame, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The grams of ``rows`` (gram, by_lang) in alphabetical order, and their
    counts in each language.  They come as Arrow columns: as rows with a map
    each, they would take the driver many times the memory."""
    counts = F.transform(F.array(*[F.lit(la) for la in langs]).cast("array<string>"), lambda la: F.coalesce(F.try_element_at("by_lang", la), F.lit(0)))
    got = rows.select("gram", counts.cast("array<double>").alias("n")).toArrow()
    grams = got["gram"].to_pylist()
    order = sorted(range(len(grams)), key=grams.__getitem__)
    n = got["n"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(grams), len(langs))
    return [grams[i] for i in order], n[order]


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on (doc_id, text, lang) rows that have a text and a language."""
    counts = stored(gram_counts(word_counts(fit_sample(labelled, fit_rows))), "langid-counts")
    # Every language has the same weight, however many rows it has.
    sums = counts.groupBy("ord", "lang").agg(F.sum("n").alias("all"))
    totals = stored(counts.join(F.broadcast(sums), ["ord", "lang"]).groupBy("ord", "gram").agg(
        F.sum(F.col("n") / F.col("all")).alias("weight"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")),
        "langid-grams")
    kept = {o: most_frequent(totals.where(F.col("ord") == o), "weight", max_grams if o else max_words) for o in (0, *ORDERS)}
    named = reduce(DataFrame.unionByName, [k.select(F.explode(F.map_keys("by_lang")).alias("lang")) for k in kept.values()])
    langs = sorted(r["lang"] for r in named.distinct().collect())
    tables, scores = {}, {}
    for o, own in kept.items():
        tables[o], n = gathered(own, langs)
        scores[o] = (np.log(n + 0.5) - np.log(n.sum(axis=0) + 0.5 * (len(n) + 1))).astype(np.float32)
    hashes = word_hashes(tables.pop(0))
    order = np.argsort(hashes, kind="stable")
    scores[0] = scores[0][order]
    return Model(langs, {o: {g: i for i, g in enumerate(t)} for o, t in tables.items()}, scores, hashes[order])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (must have ``text``) with lang_pred and score."""
    # In the task's code, not a broadcast variable: nothing of it outlives a task.
    parts = (model.langs, model.known, {o: list(t) for o, t in model.tables.items()}, model.scores)

    def start():
        langs, known, grams, scores = parts
        m, memo = Model(langs, {o: {g: i for i, g in enumerate(t)} for o, t in grams.items()}, scores, known), Memo()

        def work(texts):
            return tuple(zip(*[m.predict(t, memo) for t in texts], strict=True)) or ((), ())

        return work

    return add_columns(docs, ["text"], [("lang_pred", "string"), ("score", "double")], start)


def train_rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text", "lang").where(~held_out("doc_id"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(train_rows(docs))
    told = pick(docs, "doc_id", "text").withColumn("held_out", held_out("doc_id"))
    return identify(told, model).select("doc_id", "held_out", "lang_pred", "score")

