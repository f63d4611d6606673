"""Spelling variants by a frequency-vector trie.

A word's vector is its length and then the counts of its letters in each of a
row of letter groups.  Words are arranged in a trie by these counts, level by
level.  One replaced letter moves at most one count up and one down, an
inserted or deleted letter moves one; so a depth-first search with a budget of
one surplus and one deficit reaches every word one edit away, and few others.
The words of the reached leaves are verified.

Distributed, the upper part of the trie deals the words: a node with more than
a bounded number of words is cut into its children, until the parts are small
enough (words that agree in every count are cut by hash).  Only the cut nodes
are known to all tasks.  Each word goes to the part it belongs to and, as a
query, to each part that its budget can reach.  A task builds the trie of one
part at a time and answers its queries in a stream.

Defined cases: a null or empty text has no words; repeated rows count each for
themselves; a null id reads as an empty one in ``<doc_id>:<run>``; of near
words with the same count the smallest in code-point order is the form; an
empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import load, pick, release_worker_memory, stored

RUNS = re.compile("[A-Za-zÀ-ÿ]{%d,}")
MIN_LENGTH = 7
MIN_COUNT = 2
#: One in so many (document, run) pairs loses a letter.
DROP = 31
#: A form is at least this many times as frequent as its variant.
RATIO = 10
#: Words counted by a task before it hands them on.
HELD_WORDS = 400_000
#: Words in a part of the trie: at least PART_WORDS, and not more parts than about MAX_PARTS.
PART_WORDS = 25_000
MAX_PARTS = 4096
#: Levels of the trie below the length: counts of these letters.  All letters
#: beyond a to z share the last level.
GROUPS = ["e", "t", "a", "o", "n", "i", "s", "r", "h", "lu", "dg", "cm", "bfpw", "vkyjxqz", ""]
#: Largest query-candidate matrix that is compared at once.
MATRIX = 1 << 18


# ---- words ----


def run_counts(texts, min_length: int = MIN_LENGTH) -> Counter:
    """Words of (doc_id, text) pairs, with the letter dropped where it applies."""
    runs_of = re.compile(RUNS.pattern % min_length).findall
    counts, drop, crc = Counter(), DROP, zlib.crc32
    for doc_id, text in texts:
        if not text:
            continue
        runs = runs_of(text.encode().lower().decode())  # bytes: A to Z only
        counts.update(runs)
        start = crc(f"{'' if doc_id is None else doc_id}:".encode())
        for w in set(runs):
            h = crc(w.encode(), start)
            if h % drop == 0:
                n, at = runs.count(w), h % len(w)
                counts[w] -= n
                if len(w) > min_length:
                    counts[w[:at] + w[at + 1:]] += n
    return counts


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over whole texts: words of the least length and count."""

    def run(batches):
        release_worker_memory()
        counts = Counter()

        def held():
            rows = [(w, n) for w, n in counts.items() if n]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
                                              names=["word", "n"])

        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                counts.update(run_counts(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)))
                if len(counts) > HELD_WORDS:
                    yield held()
                    counts.clear()
        yield held()

    rows = pick(docs, "doc_id", "text").where(F.col("text").isNotNull())
    parts = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# ---- vectors and the upper trie ----


def group_table(groups=None) -> bytes:
    """The group of each code point below 256, as a translation table."""
    groups = GROUPS if groups is None else groups
    table = bytearray([len(groups) - 1]) * 256
    for g, letters in enumerate(groups):
        for c in letters:
            table[ord(c)] = g
    return bytes(table)


TABLE = group_table()


def vector_of(word: str) -> bytes:
    """The counts, a byte each; those beyond 255 stay 255, where unspent budget
    reaches all that the true counts would (verification is exact)."""
    marks = word.encode("latin-1").translate(TABLE)
    return bytes([min(marks.count(g), 255) for g in range(len(GROUPS))])


def near_counts(c: int, up: int, down: int):
    """Counts that a near word may have at one level, with the budget left."""
    yield c, up, down
    if up and c < 255:
        yield c + 1, up - 1, down
    if down and c:
        yield c - 1, up, down - 1


#: For the near word's length relative to the query's: surplus and deficit, spent in full at most.
BUDGETS = {-1: (0, 1), 0: (1, 1), 1: (1, 0)}


class Parts:
    """The nodes that are cut: path -> 0 (cut by the next count) or, for whole
    vectors, the number of hash parts.  A path is the length and the counts so
    far."""

    def __init__(self, cut: dict[tuple, int]):
        self.cut = cut

    def home(self, word: str, vector: bytes) -> str:
        path = (len(word),)
        while path in self.cut and len(path) <= len(vector):
            path += (vector[len(path) - 1],)
        return self._name(path, word)

    def _name(self, path, word) -> str:
        name = ".".join(map(str, path))
        return f"{name}#{zlib.crc32(word.encode()) % self.cut[path]}" if self.cut.get(path) else name

    def reached(self, word: str, vector: bytes) -> set[str]:
        """Parts that may hold a word one edit away."""
        out = set()
        for change, (up, down) in BUDGETS.items():
            todo = [((len(word) + change,), up, down)]
            while todo:
                path, up, down = todo.pop()
                if path not in self.cut:
                    out.add(".".join(map(str, path)))
                elif len(path) > len(vector):
                    out.update(f"{'.'.join(map(str, path))}#{k}" for k in range(self.cut[path]))
                else:
                    todo += [(path + (c,), u, d) for c, u, d in near_counts(vector[len(path) - 1], up, down)]
        return out


def cut_nodes(vectors: DataFrame, words: int) -> Parts:
    """From (size, vector, words) rows: which nodes have more than the allowed
    number of words.  Level by level only such nodes reach the driver, at most
    MAX_PARTS a level."""
    most = max(PART_WORDS, words // MAX_PARTS)
    cut, depth = {}, 0
    while depth <= len(GROUPS):
        prefix = F.substring("vector", 1, depth)
        found = (vectors.groupBy("length", prefix.alias("prefix")).agg(F.sum("words").alias("words"))
                 .where(F.col("words") > most).collect())
        if not found:
            break
        for r in found:
            cut[(r["length"], *r["prefix"])] = 0 if depth < len(GROUPS) else -(-r["words"] // most)
        depth += 1
    return Parts(cut)


# ---- one part: trie, search, verification ----


def packed_ends(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First eight letters, and last eight from the end, each in one number."""
    return tuple(np.array([int.from_bytes(w, "little") for w in ends], dtype=np.uint64)
                 for ends in ([w[:8] for w in words], [w[:-9:-1] for w in words]))


def equal_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters agree from the lowest on, up to eight."""
    x = a ^ b
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


class Trie:
    """The words of one part: a trie over (length, counts), whose leaves are
    ranges of the words, and what verification needs of each word."""

    def __init__(self, words: list[str], counts: list[int], vectors: list[bytes]):
        order = sorted(range(len(words)), key=lambda i: (len(words[i]), vectors[i]))
        self.words = [words[i] for i in order]
        self.counts = np.array([counts[i] for i in order], dtype=np.int64)
        self.letters = [w.encode("latin-1") for w in self.words]
        self.first, self.last = packed_ends(self.letters)
        # Place in the order of preference as a form: most frequent, then smallest.
        best = sorted(range(len(order)), key=lambda i: (-self.counts[i], self.words[i]))
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[best] = np.arange(len(order))
        self.root, start = {}, 0
        for i in range(1, len(order) + 1):
            if i == len(order) or (len(self.words[i]), vectors[order[i]]) != (len(self.words[start]), vectors[order[start]]):
                node, path = self.root, (len(self.words[start]), *vectors[order[start]])
                for c in path[:-1]:
                    node = node.setdefault(c, {})
                node[path[-1]] = (start, i)
                start = i

    def leaves(self, length: int, vector: bytes) -> list[tuple[int, int]]:
        """Ranges of the words that the budget reaches."""
        out = []
        depth_of_leaf = len(vector) - 1

        def search(node, depth, up, down):
            for c, u, d in near_counts(vector[depth], up, down):
                child = node.get(c)
                if child is not None:
                    if depth == depth_of_leaf:
                        out.append(child)
                    else:
                        search(child, depth + 1, u, d)

        for change, (up, down) in BUDGETS.items():
            node = self.root.get(length + change)
            if node is not None:
                search(node, 0, up, down)
        return sorted(set(out))

    def near(self, queries: list[str], vector: bytes):
        """(query, number of near words here, the best one's count, the best
        one) for the queries, which share length and vector."""
        length = len(queries[0])
        ranges = self.leaves(length, vector)
        if not ranges:
            return
        at = np.concatenate([np.arange(a, b) for a, b in ranges])
        letters = [q.encode("latin-1") for q in queries]
        first, last = packed_ends(letters)
        rows = max(1, MATRIX // len(at))
        need = min(length - 1, 8)
        for start in range(0, len(queries), rows):
            same = (equal_letters(first[start:start + rows, None], self.first[at][None, :]).astype(np.int8)
                    + equal_letters(last[start:start + rows, None], self.last[at][None, :]).astype(np.int8))
            found = {}
            for q, c in zip(*(x.tolist() for x in np.nonzero(same >= need)), strict=True):
                if one_edit(letters[start + q], self.letters[at[c]]):
                    found.setdefault(start + q, []).append(at[c])
            for q, near in found.items():
                top = near[int(np.argmin(self.rank[near]))]
                yield queries[q], len(near), int(self.counts[top]), self.words[top]


# ---- jobs ----

ROUTED = "part string, own boolean, vector binary, word string, n bigint"


def dealt(words: DataFrame, parts: Parts) -> DataFrame:
    """Each word in its part (own) and in each part that it can reach."""
    shipped = words.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        known = shipped.value
        for b in (whole.slice(i, 5000) for whole in batches for i in range(0, whole.num_rows, 5000)):
            cols = ([], [], [], [], [])
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                v = vector_of(w)
                rows = [(known.home(w, v), True), *((p, False) for p in known.reached(w, v))]
                for p, own in rows:
                    for col, x in zip(cols, (p, own, v, w, n if own else None), strict=True):
                        col.append(x)
            kinds = (pa.string(), pa.bool_(), pa.binary(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["part", "own", "vector", "word", "n"])

    return words.mapInArrow(run, ROUTED)


def near_words(routed: DataFrame, tasks: int) -> DataFrame:
    """word, n_near, form_n, form: for each word and part with near words of
    it, their number and the best of them.  Rows come sorted by part, its own
    words first, and queries of one vector together."""
    ordered = routed.repartition(tasks, "part").sortWithinPartitions("part", F.desc("own"), F.length("word"), "vector")

    def run(batches):
        part, trie, own, queries, key, out = None, None, [], [], None, []

        def flush():
            nonlocal queries
            if queries:
                out.extend(trie.near(queries, key[1]))
                queries = []

        def held():
            rows, out[:] = list(out), []
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            cols = zip(*rows, strict=True) if rows else ([],) * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)],
                                              names=["word", "n_near", "form_n", "form"])

        for b in batches:
            for p, is_own, v, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    flush()
                    part, trie, own = p, None, []
                if is_own:
                    own.append((w, n, v))
                    continue
                if trie is None:
                    trie = Trie(*map(list, zip(*own, strict=True))) if own else Trie([], [], [])
                    key = None
                if (len(w), v) != key or len(queries) >= 10_000:
                    flush()
                    key = (len(w), v)
                queries.append(w)
            if len(out) > 50_000:
                yield held()
        flush()
        yield held()

    return ordered.mapInArrow(run, "word string, n_near bigint, form_n bigint, form string")


def with_forms(words: DataFrame) -> DataFrame:
    """``words`` (word, n; stored) with n_near, form and form_n."""
    vectors = words.select("word").mapInArrow(_vectors, "length int, vector binary").groupBy("length", "vector").agg(
        F.count(F.lit(1)).alias("words"))
    n = words.count()
    parts = cut_nodes(stored(vectors, "variants-vectors"), n)
    tasks = max(8, words.sparkSession.sparkContext.defaultParallelism, 2 * n // PART_WORDS)
    found = near_words(dealt(words, parts), tasks)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))
    top = best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))
    rows = words.join(top, "word", "left")
    enough = F.col("form_n") >= RATIO * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                       F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))


def _vectors(batches):
    for b in batches:
        words = b.column("word").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int32()), pa.array([vector_of(w) for w in words], pa.binary())],
                                         names=["length", "vector"])


def with_roots(rows: DataFrame) -> DataFrame:
    """``rows`` (word, form and others; stored) with root: the end of the chain
    of forms.  Counts grow tenfold along a chain, so it is short; each pass
    doubles the distance followed."""
    links = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        links = stored(links, "variants-links")
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = links.join(onward, "root", "left")
        if longer.where(F.col("next").isNotNull()).isEmpty():
            break
        links = longer.select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of ``docs``."""
    words = stored(word_counts(docs), "variants-words")
    return with_roots(stored(with_forms(words), "variants-forms"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(load(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
