"""Best-fit packing by a grouping genetic algorithm.

Documents become token ids with an end mark; longer ones than a sequence are
cut into pieces, all full but the first.  Full pieces are sequences of their
own.  All others are packed: an individual of the algorithm is a grouping of
pieces into bins.  Crossover injects whole well-filled bins of one parent into
the other, drops the bins of the other that hold an injected piece, and puts
displaced pieces back by best fit, longest first.  Mutation dissolves a few
badly filled bins.  Every block of pieces evolves on several islands, rows of
their own that run in parallel; between epochs the elites migrate to the next
island of the block.

Blocks have a bounded number of pieces, dealt evenly.  The bins that a block
fills to the last token are final; the pieces of all others meet again in the
blocks of the next, much smaller round, until one block is left or a round
stops saving.  So the waste does not grow with the number of blocks.

Defined cases: a null text is empty and consists of the end mark; repeated
rows are packed one by one; ties resolve by place in the block; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import load, pick, process_cache, stored, text_batches

CAPACITY = 1024
END_ID = 2
#: Pieces in a block, islands of a block, individuals of an island.
BLOCK = 16_384
ISLANDS = 2
POPULATION = 4
GENERATIONS = 4
EPOCHS = 2
MAX_ROUNDS = 4
#: A run of so many characters without or of white space is left to the tokenizer library,
#: as the words of the pattern could be of any length there.
LONG = 512
LONG_RUN = re.compile(r"\S{%d}|\s{%d}" % (LONG, LONG))
#: Words of a known pattern and what it does with white space: of two or more characters
#: before a word, all but the last are one token's text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
AHEAD = r"|\s+(?!\S)|\s+"
SPACE = r"[^\S\x1c-\x1f]"  # what the pattern takes for white space; Python counts four separators more
BEFORE_LAST_SPACE = re.compile(rf"(?<={SPACE})(?={SPACE}[\S\x1c-\x1f])")
#: Texts from so many characters on are not held as lists of words or ids.
LIST_CHARS = 1_000_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: bytes
    that print as one visible character stand for themselves, the others follow
    from 256 on."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    others = [c for c in range(256) if c not in set(shown)]
    return {**{chr(c): c for c in shown}, **{chr(256 + i): c for i, c in enumerate(others)}}


class TextTokenizer:
    """Ids of whole texts by the tokenizer file, a byte-level BPE whose ids
    rise with its merges.  Its vocabulary is read from the file and applied as
    ranks, which takes less time and holds nothing of earlier texts.  Parts
    with a long run (see ``LONG_RUN``) go through the tokenizer library itself.

    With the pattern ``WORDS + AHEAD``, texts are cut before the last of several
    white space characters that stand before a word.  The pattern cuts there
    too, and in the parts it need not look ahead, which takes most of its time."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in word): i for word, i in self.encoder.get_vocab(with_added_tokens=False).items()
                 if all(c in letters for c in word)}
        self.cuts = pattern == WORDS + AHEAD
        self.ranks = tiktoken.Encoding("file", pat_str=WORDS + r"|\s+" if self.cuts else pattern, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str, spaced: bool = True) -> bytes:
        """``spaced``: white space may stand beside white space."""
        parts = BEFORE_LAST_SPACE.split(text) if self.cuts and spaced else [text]
        if len(text) < LIST_CHARS:
            ids = [i for p in parts for i in self.ranks.encode_ordinary(p)] if len(parts) > 1 else self.ranks.encode_ordinary(text)
            return np.array(array("I", ids)).astype("<u4").tobytes()
        return b"".join(self.ranks.encode_to_numpy(p, disallowed_special=()).astype("<u4").tobytes() for p in parts)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(text) < LIST_CHARS:
            sizes = [len(w) for w in text.split()]
            more = len(text) - sum(sizes) - len(sizes)  # -1: single characters of white space between the words, no others
            if max(sizes, default=0) < LONG and more < LONG - 2:
                return self._plain(text, more >= 0)
        if not LONG_RUN.search(text):
            return self._plain(text)
        out, short = [], []
        for chunk in chunks_of(text):
            if LONG_RUN.search(chunk):
                out += [self._plain("".join(short)), np.array(self.encoder.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()]
                short = []
            else:
                short.append(chunk)
        return b"".join([*out, self._plain("".join(short))])


def chunks_of(text: str) -> list[str]:
    """The text cut before each space that stands between two characters that
    are not white space: such a space always begins a new word of the
    tokenizer, so the chunks can be encoded alone."""
    parts = text.split(" ")
    out, open_run = [parts[0]], not parts[0] or parts[0][-1].isspace()
    for p in parts[1:]:
        if not p or p[0].isspace() or open_run:
            out[-1] += " " + p
        else:
            out.append(" " + p)
        open_run = not p or p[-1].isspace()
    return out


def tokenize(docs: DataFrame, tokenizer_path: str, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids.
    ``pattern``: how the tokenizer of the file divides a text into words."""
    pattern = pattern or word_pattern()

    def run(batches):
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker held
        known = process_cache("tokenizers")
        coder = known.get(tokenizer_path) or known.setdefault(tokenizer_path, TextTokenizer(tokenizer_path, pattern))
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            rows, held = [], 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = (coder.ids(text) if text else b"") + end
                n = len(ids) // 4
                at = 0
                size = n % capacity or capacity
                k = 0
                while at < n:
                    rows.append((doc_id, k, at, size, ids[4 * at:4 * (at + size)]))
                    at, size, k = at + size, capacity, k + 1
                held += n
                if held > 1_000_000:
                    yield _piece_batch(rows)
                    rows, held = [], 0
            yield _piece_batch(rows)

    return text_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, PIECES)


def _piece_batch(rows):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    cols = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds, strict=True)],
                                      names=["doc_id", "piece", "start", "length", "ids"])


# ---- the algorithm on one block: bins are lists of places in the block ----


def best_fit(places, lengths, capacity, bins, free):
    """Put places (longest first) into the fullest bin that still holds them;
    ``bins`` and ``free`` grow in place."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit f: some bin has f tokens free
    for i, f in enumerate(free):
        by_free[f].append(i)
        mask |= 1 << f
    for p in places:
        n = lengths[p]
        fits = mask >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            i = by_free[f].pop()
            if not by_free[f]:
                mask &= ~(1 << f)
            bins[i].append(p)
        else:
            f, i = capacity, len(bins)
            bins.append([p])
            free.append(capacity)
        f -= n
        free[i] = f
        by_free[f].append(i)
        mask |= 1 << f
    return bins, free


def fitness(free, capacity):
    """Fewer bins first, then the fuller ones: mean squared fill."""
    used = 1.0 - np.asarray(free, dtype=np.float64) / capacity
    return float((used * used).mean()) if len(free) else 1.0


def crossover(a, b, lengths, capacity, rng):
    """Child of two groupings (bins, free)."""
    (bins_a, free_a), (bins_b, free_b) = a, b
    full_a = np.asarray(free_a)
    good = np.flatnonzero(full_a <= max(0, int(np.median(full_a))))
    keep = good[rng.random(len(good)) < rng.uniform(0.5, 1.0)]
    taken = bytearray(len(lengths))
    bins, free = [], []
    for i in keep.tolist():
        bins.append(list(bins_a[i]))
        free.append(free_a[i])
        for p in bins_a[i]:
            taken[p] = 1
    displaced = []
    for one, f in zip(bins_b, free_b, strict=True):
        hit = [p for p in one if taken[p]]
        if not hit:
            bins.append(list(one))
            free.append(f)
        elif len(hit) < len(one):
            displaced += [p for p in one if not taken[p]]
    displaced.sort(key=lambda p: (-lengths[p], p))
    return best_fit(displaced, lengths, capacity, bins, free)


def mutate(one, lengths, capacity, rng, share=0.02):
    """Dissolve the worst bins and a few others; best fit puts the pieces back."""
    bins, free = one
    order = np.argsort(-np.asarray(free), kind="stable")
    n = max(1, int(len(bins) * share))
    out = set(order[:n].tolist()) | set(rng.integers(0, len(bins), n).tolist())
    loose = [p for i in out for p in bins[i]]
    kept = [(list(bins[i]), free[i]) for i in range(len(bins)) if i not in out]
    loose.sort(key=lambda p: (-lengths[p], p))
    return best_fit(loose, lengths, capacity, [k[0] for k in kept], [k[1] for k in kept])


def first_grouping(lengths, capacity, rng, noise):
    """Best fit, longest first; with noise the order is a little off."""
    keys = np.asarray(lengths) * (1.0 + noise * rng.random(len(lengths)))
    return best_fit(np.argsort(-keys, kind="stable").tolist(), lengths, capacity, [], [])


def evolve(population, lengths, capacity, rng, generations):
    """Steady state: each child replaces the worst if it is better."""
    scored = sorted(((fitness(f, capacity), b, f) for b, f in population), key=lambda x: -x[0])
    for _ in range(generations):
        if scored[0][0] >= 1.0 or len(scored) < 2:
            break
        i, j = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[i][1:], scored[j][1:], lengths, capacity, rng)
        child = mutate(child, lengths, capacity, rng)
        value = fitness(child[1], capacity)
        if value > scored[-1][0]:
            scored[-1] = (value, *child)
            scored.sort(key=lambda x: -x[0])
    return [(b, f) for _, b, f in scored]


def dumped(one, n) -> bytes:
    """A grouping as the bin number of every place."""
    at = np.empty(n, dtype=np.int32)
    for i, places in enumerate(one[0]):
        at[places] = i
    return at.tobytes()


def restored(data, lengths, capacity):
    at = np.frombuffer(data, dtype=np.int32)
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    bins = [part.tolist() for part in np.split(order, cuts)]
    return bins, [capacity - sum(lengths[p] for p in b) for b in bins]


# ---- the same, distributed ----

ISLAND = "block bigint, island int, lengths binary, population array<binary>"


def _epoch(islands: DataFrame, capacity: int, epoch: int, population: int, generations: int) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                lengths = np.frombuffer(row["lengths"], dtype=np.int32).tolist()
                rng = np.random.Generator(np.random.PCG64([int(row["block"]), int(row["island"]), epoch]))
                if epoch == 0:
                    pop = [first_grouping(lengths, capacity, rng, 0.0 if i + row["island"] == 0 else 0.05 * (i + 1))
                           for i in range(population)]
                else:
                    pop = [restored(d, lengths, capacity) for d in row["population"]]
                pop = evolve(pop, lengths, capacity, rng, generations)
                out.append((row["block"], row["island"], row["lengths"], [dumped(p, len(lengths)) for p in pop]))
            yield pd.DataFrame(out, columns=["block", "island", "lengths", "population"])

    return islands.mapInPandas(run, ISLAND)


def _migrate(islands: DataFrame, count: int) -> DataFrame:
    """Each island's best individual takes the place of the last one on the
    next island of the block."""
    elite = islands.select("block", ((F.col("island") + 1) % count).alias("island"),
                           F.element_at("population", 1).alias("elite"))
    return islands.join(elite, ["block", "island"]).select(
        "block", "island", "lengths",
        F.concat(F.slice("population", F.lit(1), F.size("population") - 1), F.array("elite")).alias("population"))


def _pack_round(pieces: DataFrame, blocks: int, capacity: int, final: bool, number: int):
    """One round over pieces (doc_id, piece, start, length, ...): placed rows,
    and the rows of bins that are not full (none if ``final``)."""
    cols = [c for c in pieces.columns if c != "block"]
    dealt = pieces.withColumn("block", F.monotonically_increasing_id() % blocks)
    grouped = stored(dealt.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("length", *[c for c in cols if c != "length"])), asc=False).alias("items")),
        "pack-blocks")

    def lengths_of(batches):
        for b in batches:
            data = [np.array([i["length"] for i in items], dtype=np.int32).tobytes()
                    for items in b.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(data, pa.binary())], names=["block", "lengths"])

    slim = grouped.select("block", F.transform("items", lambda i: F.struct(i["length"].alias("length"))).alias("items"))
    lengths = slim.mapInArrow(lengths_of, "block bigint, lengths binary")
    islands = lengths.select("block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "lengths",
                             F.array().cast("array<binary>").alias("population"))
    islands = islands.repartition(blocks * ISLANDS, "block", "island")
    for epoch in range(EPOCHS):
        islands = stored(_epoch(islands, capacity, epoch, POPULATION, GENERATIONS), "pack-islands")
        if epoch + 1 < EPOCHS:
            islands = _migrate(islands, ISLANDS)

    def choose(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                lengths = np.frombuffer(row["lengths"], dtype=np.int32).tolist()
                best = max((restored(d, lengths, capacity) for d in row["elites"]), key=lambda g: fitness(g[1], capacity))
                bin_of, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
                is_full = np.empty(len(lengths), dtype=bool)
                for i, places in enumerate(best[0]):
                    at = 0
                    for p in places:
                        bin_of[p], offset[p], is_full[p] = i, at, best[1][i] == 0
                        at += lengths[p]
                out.append((row["block"], bin_of.tolist(), offset.tolist(), is_full.tolist()))
            yield pd.DataFrame(out, columns=["block", "bin", "offset", "is_full"])

    elites = islands.groupBy("block").agg(F.first("lengths").alias("lengths"), F.flatten(F.sort_array(
        F.collect_list("population"))).alias("elites"))
    solved = elites.mapInPandas(choose, "block bigint, bin array<bigint>, offset array<bigint>, is_full array<boolean>")
    rows = (grouped.join(solved, "block")
            .select("block", F.explode(F.arrays_zip("items", "bin", "offset", "is_full")).alias("x"))
            .select(*[F.col(f"x.items.{c}").alias(c) for c in cols],
                    # rounds and blocks number their sequences apart
                    ((F.col("block") * F.lit(4 * BLOCK) + F.col("x.bin")) * F.lit(MAX_ROUNDS + 1) + F.lit(number + 1)).alias("sequence_id"),
                    F.col("x.offset").alias("offset"), F.col("x.is_full").alias("is_full")))
    rows = stored(rows, "pack-placed")
    if final:
        return rows.drop("is_full"), None
    return rows.where("is_full").drop("is_full"), rows.where("not is_full").select(*cols)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``pieces`` (length and any others) with sequence_id and offset.  Pieces
    must come from a stored table, so that a second read deals them alike."""
    whole = pieces.where(F.col("length") == capacity).select(
        *pieces.columns, (F.monotonically_increasing_id() * F.lit(MAX_ROUNDS + 1)).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    parts, rest, before = [whole], pieces.where(F.col("length") < capacity), None
    for number in range(MAX_ROUNDS):
        n = rest.count()
        if not n:
            break
        blocks = max(1, -(-n // block))
        final = blocks == 1 or number + 1 == MAX_ROUNDS or (before is not None and n > 0.9 * before)
        placed, rest = _pack_round(rest, blocks, capacity, final, number)
        parts.append(placed)
        before = n
        if final:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(load(spark, sf_dir, "documents"), "doc_id", "text")
    pieces = tokenize(docs, tokenizer_path()).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(pieces, "pack-pieces"))
