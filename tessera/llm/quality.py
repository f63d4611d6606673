"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on pieces of good and one on
pieces of bad labelled text.  A text is cut into pieces, every piece is
compressed with both, and the difference of the summed sizes divided by their
sum tells which kind it is more like.  A logistic model, fitted on labelled
documents that no dictionary has seen, turns that difference into a
probability; it is also given how far the text could be compressed at all and
the text's length, without which a small difference cannot be weighed.

What is learned is bounded by parameters: ``fit_pieces`` pieces a label for the
dictionaries and ``fit_rows`` documents for the calibration, those with the
smallest hash of id and text.  Scoring reads every whole text.

Defined cases: a null text is empty and is scored like any other; an id with
labels that disagree, a null label and a null id teach nothing; the features of
a text outside the range seen in calibration count as the range's end; without
both labels every score is the share of label 1 (0.5 without any); repeated
rows are scored one by one; an empty table gives no rows; columns of other
names are ignored.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, load, pick

#: Code points in a piece; pieces a label that a dictionary is trained on.
PIECE = 1000
FIT_PIECES = 4000
#: Labelled documents that the calibration is fitted on.
FIT_ROWS = 4000
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: One in so many labelled documents is kept for the calibration.
CALIBRATION_PART = 3
THRESHOLD = 0.3


def held_out(id_col: str, parts: int = 5, part: int = 0):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def pieces_of(text: str) -> list[bytes]:
    return [text[i:i + PIECE].encode() for i in range(0, len(text), PIECE)] or [b""]


# ---- what is learned from ----


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label, hash, pieces of the rows that may teach; no text moves."""
    told = (pick(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1)).groupBy("doc_id")
            .agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most").drop("most"))
    rows = pick(docs, "doc_id", "text").where(F.col("text").isNotNull() & (F.col("text") != "") & ~held_out("doc_id"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"),
                       F.ceil(F.length("text") / F.lit(PIECE)).cast("int").alias("pieces")).join(told, "doc_id")


def chosen_pieces(rows: DataFrame, fit_pieces: int) -> dict[int, list[bytes]]:
    """For each label the bytes of its pieces with the smallest hashes."""
    out = {}
    learn = rows["docs"].select("doc_id", "text", F.xxhash64("doc_id", "text").alias("hash"))
    for label in (0, 1):
        own = rows["told"].where((F.col("label") == label) & (F.pmod("hash", F.lit(CALIBRATION_PART)) != 0))
        at = own.select("doc_id", "hash", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        at = at.distinct().orderBy(F.xxhash64("hash", "piece"), "hash", "piece").limit(fit_pieces)
        spark = at.sparkSession
        wanted = spark.createDataFrame(at.collect(), at.schema)  # at most fit_pieces rows of three numbers
        found = (learn.join(F.broadcast(wanted), ["doc_id", "hash"])
                 .select("hash", "piece", F.substring("text", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("part")).distinct())
        out[label] = [r["part"].encode() for r in sorted(found.collect(), key=lambda r: (r["hash"], r["piece"]))]
    return out


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few
    to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes of a text by the two dictionaries, and its bytes."""

    def __init__(self, bad: bytes, good: bytes):
        self.coders = []
        for data in (bad, good):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(
                dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def of(self, text: str) -> tuple[int, int, int]:
        parts = pieces_of(text)
        bad, good = (sum([len(c.compress(p)) for p in parts]) for c in self.coders)
        return bad, good, sum(map(len, parts))


# ---- from sizes to a score ----


def base_features(sizes: np.ndarray) -> np.ndarray:
    """Normalised size difference, log share that remains, log length."""
    bad, good, n = np.asarray(sizes, dtype=float).reshape(-1, 3).T
    return np.c_[(bad - good) / (bad + good), np.log((bad + good + 2) / (2 * (n + 1))), np.log(n + 1)]


class Calibration:
    """Logistic model of the features, their squares and their products with
    the difference."""

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, penalty: float = 1e-3):
        x = base_features(sizes)
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        wide = self._wide(x)
        self.mean, self.scale = wide.mean(axis=0), wide.std(axis=0) + 1e-9
        z, y = self._standard(x), np.asarray(labels, dtype=float)
        w = np.zeros(z.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (p - y) / len(y) + penalty * w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty * np.eye(len(w)), slope)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w

    def _wide(self, x: np.ndarray) -> np.ndarray:
        d, r, n = np.clip(x, self.low, self.high).T
        return np.c_[d, r, n, r * r, n * n, d * r, d * n]

    def _standard(self, x: np.ndarray) -> np.ndarray:
        z = (self._wide(x) - self.mean) / self.scale
        return np.c_[z, np.ones(len(z))]

    def scores(self, sizes) -> list[float]:
        z = self._standard(base_features(sizes)) @ self.weights
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


class Model:
    """The two dictionaries and the calibration, or a constant score."""

    def __init__(self, constant: float, dictionaries=None, calibration=None):
        self.constant, self.dictionaries, self.calibration = constant, dictionaries, calibration


def with_sizes(rows: DataFrame, dictionaries: tuple[bytes, bytes]) -> DataFrame:
    def start():
        coder = Sizes(*dictionaries)
        return lambda texts: tuple(zip(*[coder.of(t or "") for t in texts], strict=True)) or ((), (), ())

    return add_columns(rows, ["text"], [("bad", "bigint"), ("good", "bigint"), ("bytes", "bigint")], start)


def fit(docs: DataFrame, labels: DataFrame, fit_pieces: int = FIT_PIECES, fit_rows: int = FIT_ROWS) -> Model:
    told = labelled_rows(docs, labels)
    own = pick(docs, "doc_id", "text")
    rows = {"docs": own.where(F.col("text").isNotNull()), "told": told}
    share = told.agg(F.avg("label")).first()[0]
    samples = chosen_pieces(rows, fit_pieces)
    if not samples[0] or not samples[1]:
        return Model(0.5 if share is None else float(share))
    dictionaries = (dictionary(samples[0]), dictionary(samples[1]))
    kept = told.where(F.pmod("hash", F.lit(CALIBRATION_PART)) == 0).select("doc_id", "hash", "label").distinct()
    kept = kept.orderBy("hash", "doc_id").limit(fit_rows)
    wanted = kept.sparkSession.createDataFrame(kept.collect(), kept.schema)  # at most fit_rows rows of three numbers
    texts = rows["docs"].withColumn("hash", F.xxhash64("doc_id", "text")).join(F.broadcast(wanted), ["doc_id", "hash"])
    sized = with_sizes(texts, dictionaries).select("hash", "doc_id", "label", "bad", "good", "bytes").distinct().collect()
    if len({r["label"] for r in sized}) < 2:
        return Model(float(share))
    sized.sort()
    sizes = np.array([(r["bad"], r["good"], r["bytes"]) for r in sized])
    return Model(float(share), dictionaries, Calibration(sizes, [r["label"] for r in sized]))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (must have ``text``) with score and predicted, without text."""
    if model.calibration is None:
        scored = docs.withColumn("score", F.lit(model.constant))
    else:
        shipped = docs.sparkSession.sparkContext.broadcast((model.dictionaries, model.calibration))

        def start():
            dictionaries, calibration = shipped.value
            coder = Sizes(*dictionaries)
            return lambda texts: (calibration.scores([coder.of(t or "") for t in texts]) if texts else [],)

        scored = add_columns(docs, ["text"], [("score", "double")], start)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("text")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels"))
    rows = pick(docs, "doc_id", "text").withColumn("held_out", held_out("doc_id"))
    return classify(rows, model).select("doc_id", "held_out", "score", "predicted")
