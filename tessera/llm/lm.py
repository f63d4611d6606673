"""Language-model scoring with a log-bilinear model.

The model is class-factored.  Every token belongs to a class: the most
frequent tokens have one each, the end mark has one, all others share classes
by the spelling of their last two bytes.  A log-bilinear neural model predicts
the class from the two classes before it,

    s(c | a, b) = (C1 * R[a] + C2 * R[b]) . Q[c] + bias[c],

and is trained in numpy by noise-contrastive estimation against the class
frequencies.  The score is a sum of a part of (a, c) and a part of (b, c), so
matrix products over all contexts give the normalised log-probabilities from
three tables of classes by classes.  Inside its class a token has its smoothed
frequency, so the probabilities of all tokens in any context, one unknown type
for each shared class included, add up to 1.

What is learned comes from every training text: token counts (a distributed
count, partly summed in the tasks) and counts of class triples.  The triples
are dealt by context into stored parts of about ``PART_TRIPLES``.  In each of
``ROUNDS`` rounds every part trains its own copy of the parameters on all of
its triples, each weighted with its count, with the exact expectation over the
noise; the copies are averaged, a context vector by how often its class stands
in the contexts of the part.  Tasks add their copies up and a shuffle adds the
sums slice by slice, so the driver holds one set of parameters and no triple.
The sums are of whole numbers (steps of 2**-36): their order does not matter.
Classes grow with the cube root of the training tokens, as far as there are
distinct tokens for them, up to the model's capacity of ``CAPACITY`` classes;
the dimension grows with the classes, the parts with the triples.

Scoring looks frequent tokens up in a table of at most ``HEAD`` entries that
travels to the tasks.  All other tokens are joined to the counts by a shuffle,
exactly; no token is dropped.

Defined cases: a null text is empty and consists of the end mark only; a null
id counts as training; with no training text all counts are 0; repeated rows
count and are scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import load, most_frequent, pick, release_worker_memory, stored

#: Token entries that travel to the tasks.
HEAD = 100_000
#: Classes: the end mark, frequent tokens one by one, and classes by spelling.
#: These are the smallest numbers, see ``class_numbers``.
FREQUENT, SPELLED = 63, 32
CLASSES = 1 + FREQUENT + SPELLED
END = 0
#: Training tokens for each possible class triple, from which the number of classes follows.
TOKENS_PER_TRIPLE = 4
#: Classes for each dimension; noise draws for each token.
CLASSES_PER_DIM, NOISE, RATE, SEED = 4, 20, 0.1, 11
#: Most classes: three tables of 4096 by 4096 float32 numbers travel to the tasks (201 MB).
#: Reached at about 4 * 4096**3 training tokens; token counts grow beyond it as before.
CAPACITY = 4096
#: Rounds of averaging; least batches of a part's pass and least steps of a part in all rounds; scores of a batch.
ROUNDS, BATCHES, STEPS, BATCH_SCORES = 10, 16, 600, 2**20
#: Triples of a part, about; numbers of a slice of the parameters; steps of 1 in the sums.
PART_TRIPLES, SLICE, UNIT = 500_000, 4096, 2.0**36
#: Tokens whose triples a task counts before it hands counts on.
COUNTED = 2_000_000
#: Distinct tokens a task holds before it hands counts on.
FLUSH = 400_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words; ASCII letters fold, ASCII white space splits.  The end mark is
    not among them."""
    return (text or "").encode().lower().split()


def class_numbers(tokens: int, distinct: int) -> tuple[int, int]:
    """Classes of frequent tokens and classes by spelling for a corpus."""
    grown = min(CAPACITY, round((tokens / TOKENS_PER_TRIPLE) ** (1 / 3)))
    spelled = max(SPELLED, min(grown // 3, distinct // 2))
    return max(FREQUENT, min(grown - 1 - spelled, distinct)), spelled


def spelled_class(word: bytes, frequent: int = FREQUENT, spelled: int = SPELLED) -> int:
    tail = word[-2:]
    return 1 + frequent + (tail[0] * 31 + tail[-1] * 7 + len(tail)) % spelled


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def token_counts(texts: DataFrame) -> DataFrame:
    """word (binary), n over the rows (text); without the end mark."""

    def run(batches):
        counts = Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                counts.update(tokens_of(text))
                if len(counts) > FLUSH:
                    yield batch()
                    counts = Counter()
        yield batch()

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def class_ids(words: list[bytes], classes: dict, frequent: int = FREQUENT, spelled: int = SPELLED) -> np.ndarray:
    """Classes of a text's tokens and of its end mark."""
    get = classes.get
    out = [c if (c := get(w)) is not None else spelled_class(w, frequent, spelled) for w in words]
    out.append(END)
    return np.array(out, dtype=np.int64)


def padded_ids(ids: np.ndarray) -> np.ndarray:
    """Texts begin after two end marks."""
    return np.concatenate([[END, END], ids])


def triple_codes(ids: np.ndarray, size: int = CLASSES) -> np.ndarray:
    """(class before last, class before, class) as one number."""
    padded = padded_ids(ids)
    return (padded[:-2] * size + padded[1:-1]) * size + padded[2:]


def triple_counts(texts: DataFrame, classes: dict, frequent: int = FREQUENT, spelled: int = SPELLED) -> DataFrame:
    """code, n over all texts: one row for each triple that occurs."""
    size = 1 + frequent + spelled

    def run(batches):
        codes, held = [], 0

        def counted():
            found, n = np.unique(np.concatenate(codes), return_counts=True)
            for i in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[i:i + 50_000]), pa.array(n[i:i + 50_000].astype(np.int64))],
                                                 names=["code", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                codes.append(triple_codes(class_ids(tokens_of(t), classes, frequent, spelled), size))
                held += len(codes[-1])
                if held > COUNTED:
                    yield from counted()
                    codes, held = [], 0
        if codes:
            yield from counted()

    return (texts.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")))


class Scores:
    """log10 P(c | a, b) from three tables of classes by classes."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        # exp in a matrix product: the largest of each row is taken out before.
        first, second = first - first.max(axis=1, keepdims=True), second - second.max(axis=1, keepdims=True)
        total = np.exp(first) @ np.exp(second).T
        self.norm = np.log10(np.maximum(total, np.finfo(float).tiny)).astype(np.float32)
        self.first, self.second = ((t / math.log(10)).astype(np.float32) for t in (first, second))

    def of(self, ids: np.ndarray) -> np.ndarray:
        """For each token of a text and its end mark."""
        padded = padded_ids(ids)
        a, b, c = padded[:-2], padded[1:-1], padded[2:]
        return self.first[a, c].astype(np.float64) + self.second[b, c] - self.norm[a, b]


def views(flat: np.ndarray, size: int) -> list[np.ndarray]:
    """The parameters in one vector: context vectors, class vectors, the
    weights of the two positions, biases."""
    dim = size // CLASSES_PER_DIM
    ctx, q, c1, c2, bias = np.split(flat, np.cumsum([size * dim, size * dim, dim, dim]))
    return [ctx.reshape(size, dim), q.reshape(size, dim), c1, c2, bias]


def noise_of(unigram: np.ndarray) -> np.ndarray:
    return (unigram + 0.5) / (unigram + 0.5).sum()


def first_state(unigram: np.ndarray) -> np.ndarray:
    """Two rows: the parameters before training, sums of squared gradients."""
    size = len(unigram)
    dim = size // CLASSES_PER_DIM
    rng = np.random.Generator(np.random.PCG64(SEED))
    state = np.zeros((2, 2 * size * dim + 2 * dim + size))
    ctx, q, c1, c2, bias = views(state[0], size)
    ctx[:], q[:] = rng.normal(0, 0.1, (size, dim)), rng.normal(0, 0.1, (size, dim))
    c1[:], c2[:], bias[:] = 0.5, 1.0, np.log(noise_of(unigram))
    return state


def train_part(state: np.ndarray, noise: np.ndarray, codes: np.ndarray, counts: np.ndarray, seed) -> None:
    """One round of a part: changes ``state`` by passes over all its triples."""
    size = len(noise)
    params, squares = views(state[0], size), views(state[1], size)
    ctx, q, c1, c2, bias = params
    rng = np.random.Generator(np.random.PCG64(seed))
    total = counts.sum()
    contexts, at = np.unique(codes // size, return_inverse=True)
    batches = max(BATCHES, -(-len(contexts) * size // BATCH_SCORES))
    log_kn = np.log(NOISE * noise)

    def step(a, b, at, c, counts):
        """One batch: the classes of its contexts, and of each triple the place
        of its context, its last class and its count."""
        hidden = (ctx[a] * c1 + ctx[b] * c2).astype(np.float32)
        # NCE: is the class from the data or one of NOISE draws from the noise?  Exact over data and noise.
        data = hidden @ q.T.astype(np.float32)
        data += (bias - log_kn).astype(np.float32)
        data = 1.0 / (1.0 + np.exp(np.negative(data, out=data), out=data))
        scale = batches / total
        missed = counts * scale * (data[at, c] - 1.0)
        mass = np.bincount(at, weights=counts, minlength=len(a)) * (scale * NOISE)
        err = data
        err *= mass.astype(np.float32)[:, None]
        err *= noise.astype(np.float32)
        err[at, c] += missed
        # Gradients gathered by class with one matrix product.
        g_hidden = err @ q.astype(np.float32)
        g_ctx = np.zeros_like(ctx)
        np.add.at(g_ctx, a, g_hidden * c1)
        np.add.at(g_ctx, b, g_hidden * c2)
        grads = [g_ctx, err.T @ hidden, (g_hidden * ctx[a]).sum(0), (g_hidden * ctx[b]).sum(0), err.sum(0)]
        for p, s, g in zip(params, squares, grads, strict=True):
            s += np.square(g, dtype=np.float64)
            p -= RATE * g / (np.sqrt(s) + 1e-10)

    # Batches of whole contexts, the contexts dealt by chance.
    place = rng.permutation(len(contexts)) % batches
    order = np.argsort(place[at], kind="stable")
    work = []
    for mine in np.split(order, np.searchsorted(place[at][order], np.arange(1, batches))):
        if len(mine):
            own, own_at = np.unique(at[mine], return_inverse=True)
            work.append((contexts[own] // size, contexts[own] % size, own_at, codes[mine] % size, counts[mine]))
    for _ in range(max(1, -(-STEPS // (ROUNDS * batches)))):
        for i in rng.permutation(len(work)).tolist():
            step(*work[i])


def context_mass(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """How often each class stands in the contexts of the triples."""
    return (np.bincount(codes // size**2, weights=counts, minlength=size)
            + np.bincount(codes // size % size, weights=counts, minlength=size))


def shares(mass: np.ndarray, tokens: float, length: int, all_mass: np.ndarray, all_tokens: float) -> np.ndarray:
    """The weight of a part's copy in the average, for each parameter."""
    size = len(all_mass)
    out = np.full(length, tokens / all_tokens)
    views(out, size)[0][:] = (mass / np.maximum(all_mass, 1.0))[:, None]
    return out


def scores_of(state: np.ndarray, size: int) -> Scores:
    ctx, q, c1, c2, bias = views(state[0], size)
    return Scores((ctx * c1) @ q.T, (ctx * c2) @ q.T + bias)


def train(codes: np.ndarray, counts: np.ndarray, size: int = CLASSES) -> np.ndarray:
    """log10 P(class | context) as an array of size**2 by size: the whole
    table, for few classes and triples of one part."""
    unigram = np.bincount(codes % size, weights=counts, minlength=size)
    state, noise = first_state(unigram), noise_of(unigram)
    for i in range(ROUNDS):
        train_part(state, noise, codes, counts, [SEED, i, 0])
    got = scores_of(state, size)
    return (got.first[:, None, :].astype(np.float64) + got.second[None, :, :] - got.norm[:, :, None]).reshape(size * size, size)


def averaged(parts: DataFrame, state: np.ndarray, unigram: np.ndarray, mass: np.ndarray, turn: int) -> np.ndarray:
    """The state after a round.  ``parts``: stored (part, code, n), each part
    in one piece and sorted."""
    size, shape = len(unigram), state.shape
    context = parts.sparkSession.sparkContext
    shipped = context.broadcast((state, unigram, mass))

    def copies(batches):
        begun, unigram, mass = shipped.value
        noise, tokens = noise_of(unigram), unigram.sum()
        sums = np.zeros(shape, dtype=np.int64)

        def add(part, held):
            codes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            own = begun.copy()
            train_part(own, noise, codes, counts, [SEED, turn, part])
            own *= shares(context_mass(codes, counts, size), counts.sum(), shape[1], mass, tokens)
            sums[:] += np.rint(own * UNIT).astype(np.int64)

        part, held = None, []
        for b in batches:
            numbers, codes, counts = (b.column(c).to_numpy() for c in ("part", "code", "n"))
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for p, c, n in zip(np.split(numbers, cuts), np.split(codes, cuts), np.split(counts, cuts), strict=True):
                if len(p) and p[0] != part:
                    if held:
                        add(part, held)
                    part, held = int(p[0]), []
                if len(p):
                    held.append((c, n))
        if held:
            add(part, held)
            yield from slices(sums)
        del sums
        release_worker_memory()

    def slices(sums):
        flat = sums.reshape(-1)
        for i in range(0, len(flat), SLICE * 100):
            cut = range(i, min(i + SLICE * 100, len(flat)), SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([j // SLICE for j in cut], pa.int32()),
                                              pa.array([flat[j:j + SLICE].tobytes() for j in cut], pa.binary())], names=["slice", "sums"])

    def added(batches):
        totals = {}
        for b in batches:
            for i, raw in zip(b.column("slice").to_pylist(), b.column("sums").to_pylist(), strict=True):
                got = np.frombuffer(raw, dtype=np.int64)
                totals[i] = totals[i] + got if i in totals else got
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())],
                                         names=["slice", "sums"])

    schema = "slice int, sums binary"
    try:
        rows = parts.mapInArrow(copies, schema).repartition("slice").mapInArrow(added, schema).collect()
    finally:
        shipped.destroy()
    flat = np.concatenate([np.frombuffer(bytes(r["sums"]), dtype=np.int64) for r in sorted(rows, key=lambda r: r["slice"])])
    out = flat.reshape(shape) / UNIT
    for row, before in zip(out, state, strict=True):  # classes that stand in no context keep their vectors
        views(row, size)[0][mass == 0] = views(before, size)[0][mass == 0]
    return out


def train_stored(triples: DataFrame, size: int) -> Scores:
    """``triples``: a stored table (code, n).  The driver gets counts by class
    and, in each round, one set of parameters."""
    unigram, mass, rows = np.zeros(size), np.zeros(size), 0
    code = F.col("code")
    places = F.array(F.floor(code / size**2), F.floor(code / size) % size, code % size)
    by_class = triples.select(F.posexplode(places).alias("place", "c"), "n").groupBy("place", "c").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    for r in by_class.collect():
        if r["place"] == 2:
            unigram[r["c"]] += r["n"]
            rows += r["rows"]
        else:
            mass[r["c"]] += r["n"]
    state = first_state(unigram)
    if rows:
        number = -(-rows // PART_TRIPLES)
        part = F.pmod(F.hash(F.floor(code / size)), F.lit(number)).cast("int")
        dealt = triples.select(part.alias("part"), "code", "n").repartitionById(number, "part").sortWithinPartitions("part", "code")
        parts = stored(dealt, "lm-parts")
        for turn in range(ROUNDS):
            state = averaged(parts, state, unigram, mass, turn)
    return scores_of(state, size)


class Model:
    """What scoring needs; its size follows from HEAD and the square of the classes."""

    def __init__(self, classes, numbers, head, scores, class_total, docs, n, v):
        self.classes, self.head, self.scores = classes, head, scores
        self.numbers = numbers  # classes of frequent tokens and classes by spelling
        self.class_total = class_total  # smoothed count of each class
        self.docs = docs  # training texts: the count of the end mark
        self.n, self.v = n, v  # training tokens, distinct training tokens (end mark included)


def fit(texts: DataFrame, counts: DataFrame) -> Model:
    """``texts``: the training rows (text); ``counts``: their token counts."""
    docs = texts.count()
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    head_rows = most_frequent(counts, "n", HEAD).collect()
    head = {bytes(r["word"]): r["n"] for r in sorted(head_rows, key=lambda r: (-r["n"], bytes(r["word"])))}
    frequent, spelled = class_numbers((total or 0) + docs, distinct)
    size = 1 + frequent + spelled
    first = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    classes = {bytes(r["word"]): 1 + i for i, r in enumerate(first)}
    scores = train_stored(stored(triple_counts(texts, classes, frequent, spelled), "lm-triples"), size)

    def by_class(batches):
        for b in batches:
            at = [classes.get(w) or spelled_class(w, frequent, spelled) for w in b.column("word").to_pylist()]
            n = b.column("n").to_numpy() + 0.5
            sums = np.bincount(at, weights=n, minlength=size) if at else np.zeros(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(sums)], names=["c", "s"])

    sums = counts.mapInArrow(by_class, "c int, s double").groupBy("c").agg(F.sum("s").alias("s")).collect()
    class_total = np.zeros(size)
    for r in sums:
        class_total[r["c"]] = r["s"]
    class_total[END] = docs + 0.5
    class_total[1 + frequent:] += 0.5  # one unknown type for each shared class
    return Model(classes, (frequent, spelled), head, scores, class_total, docs, (total or 0) + docs, (distinct or 0) + (1 if docs else 0))


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for
    the rows of ``docs`` (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.classes, model.numbers, model.head, model.scores, model.class_total))
    denominator = math.log10(model.n + 0.5 * (model.v + 1))
    end_count = model.docs
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches):
        classes, (frequent, spelled), head, scores, class_total = shipped.value
        log_total = np.log10(np.maximum(class_total, 0.5))
        # Of each head token: its class and log10(c + 0.5), looked up by place.
        place = {w: i for i, w in enumerate(head)}
        head_class = np.array([classes.get(w) or spelled_class(w, frequent, spelled) for w in head], dtype=np.int64)
        head_log = np.log10(np.fromiter(head.values(), dtype=np.float64, count=len(head)) + 0.5)
        for b in batches:
            out_row, out_word, out_n, out_stats = [], [], [], []
            for row, doc_id, text in zip(*[b.column(c).to_pylist() for c in ("row", "doc_id", "text")], strict=True):
                words = tokens_of(text)
                at = np.array([place.get(w, -1) for w in words], dtype=np.int64)
                known = at >= 0
                ids = np.empty(len(words) + 1, dtype=np.int64)
                ids[-1] = END
                ids[:-1][known] = head_class[at[known]]
                rare = [words[i] for i in np.flatnonzero(~known).tolist()]
                ids[:-1][~known] = [classes.get(w) or spelled_class(w, frequent, spelled) for w in rare]
                model_part = scores.of(ids).sum() - log_total[ids].sum()
                count_part = head_log[at[known]].sum() + math.log10(end_count + 0.5)
                out_stats.append((row, doc_id, None, len(ids), int(known.sum()) + (1 if end_count else 0), model_part, count_part))
                if rare:
                    tally = Counter(rare)
                    out_row += [row] * len(tally)
                    out_word += tally
                    out_n += tally.values()
            yield pa.RecordBatch.from_arrays([
                pa.array([s[0] for s in out_stats] + out_row, pa.int64()),
                pa.array([s[1] for s in out_stats] + [None] * len(out_row), pa.int64()),
                pa.array([None] * len(out_stats) + out_word, pa.binary()),
                pa.array([0] * len(out_stats) + out_n, pa.int64()),
                pa.array([s[3] for s in out_stats] + [None] * len(out_row), pa.int64()),
                pa.array([s[4] for s in out_stats] + [None] * len(out_row), pa.int64()),
                pa.array([s[5] for s in out_stats] + [None] * len(out_row), pa.float64()),
                pa.array([s[6] for s in out_stats] + [None] * len(out_row), pa.float64()),
            ], names=["row", "doc_id", "word", "times", "n_tokens", "n_known", "model_part", "count_part"])

    # One row for each text, and one for each of its distinct tokens outside the head.
    looked = stored(rows.mapInArrow(run, "row bigint, doc_id bigint, word binary, times bigint, n_tokens bigint, "
                                         "n_known bigint, model_part double, count_part double"), "lm-lookups")
    stats = looked.where(F.col("word").isNull()).drop("word", "times")
    tail = looked.where(F.col("word").isNotNull()).select("row", "word", "times")
    joined = tail.join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    tails = joined.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("tail_log"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    out = stats.join(tails, "row", "left")
    counted = F.col("count_part") + F.coalesce("tail_log", F.lit(0.0))
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (counted - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        (counted + F.col("model_part")).alias("score"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(load(spark, sf_dir, "documents"), "doc_id", "text")
    texts = docs.where(~held_out()).select("text")
    counts = stored(token_counts(texts), "lm-counts")
    return score(docs, counts, fit(texts, counts))
