"""Removal of repeated passages with a distributed, sparse suffix array.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
anywhere else, in the same or another document.

Anchors.  Every string of LENGTH bytes is represented by the leftmost minimal
k-gram hash among its first ``WINDOW`` places, so equal strings have equal
anchors at equal distances.  Only suffixes that start at anchors are sorted
(about two in WINDOW positions); an anchor owns the consecutive string starts
it represents.  An anchor whose next LENGTH - WINDOW bytes occur nowhere else
(by hash) cannot take part and is dropped before any text moves.

Merge sort.  Tasks sort the suffixes of their documents into runs and send
them front-coded: each suffix as the length of the prefix it shares with the
one before, and the rest.  Runs are cut into ranges by the hash of the bytes
all members of a group share, which spreads ranges evenly.  A range's runs are
merged by a loser tree that carries common-prefix lengths: it compares
suffixes only behind the prefix they are known to share.

Matches.  In a group of merged suffixes with common prefix of LENGTH - WINDOW
bytes or more, suffixes are joined by falling common-prefix length R; the
smaller side is sorted into the larger by its bytes left of the anchor, where
only the neighbours can have the longest common left part L.  Every pair with
L + R >= LENGTH marks the bytes from L before to R behind the anchor.  This
finds all bytes to remove without looking at all pairs.

A group with more than ``GROUP`` members does not go to one task.  Members
that are equal in all the bytes they own are counted first, with partial sums:
those that occur twice or more lose all of these bytes, and one of each kind
goes on to the merge.  Where even the kinds are more than GROUP, their string
starts are counted one by one by 128-bit hash.  Both ways are exact.

Passages by words (``remove_repeats(words=...)``, not part of op8).  A passage
of more than ``words`` words that another document holds goes as well, however
few bytes it has; the white space between words is not compared.  Anchors are
chosen among word starts and own consecutive word windows.  Where all the words
an anchor owns are in two documents or more, all its windows go; where only
its context is, the windows of each kind are counted one by one by their
context's and their own 64-bit hash, each once a document.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing;
repeated rows are different documents (all their strings repeat); null ids are
a key like any other; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import load, pick, release_worker_memory, small, stored

LENGTH = 400
#: Places among which an anchor is chosen; bytes of the hashed k-grams.
WINDOW, KGRAM = 200, 16
#: Most members of a group that one task merges.
GROUP = 50_000
#: Anchors in a range of the merge; bytes of suffixes a task holds as one run.
RANGE_ROWS, RUN_BYTES = 40_000, 16_000_000

FACTOR = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int = KGRAM) -> np.ndarray:
    """A 32-bit hash of the ``gram`` (a power of two) bytes at each place."""
    h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, FACTOR
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % 2**64
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(32)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors_of(data: bytes, length: int = LENGTH, window: int = WINDOW):
    """Anchors of a text and the first and last string start each one owns."""
    n = len(data) - length + 1
    if n <= 0:
        return [], [], []
    at, first, last, base = [], [], [], 0
    step = 1 << 24
    while base < n:  # blocks keep memory bounded; a block's string starts see their whole window
        count = min(step, n - base)
        part = np.frombuffer(data, dtype=np.uint8, count=count + window - 1 + KGRAM - 1, offset=base)
        packed = (gram_hashes(part) << np.uint64(32)) | np.arange(count + window - 1, dtype=np.uint64)
        chosen = (sliding_min(packed, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        at += (chosen[cut] + base).tolist()
        first += (cut + base).tolist()
        last += (np.append(cut[1:], count) - 1 + base).tolist()
        base += count
    return at, first, last


def anchor_table(docs: DataFrame, length: int, window: int) -> DataFrame:
    """The anchors of ``docs`` (doc_id, th, text).  One row for each document
    and kind of anchor: ctx (hash of the bytes behind it), own (hash of all
    bytes of its strings), before and owned (its distance from the first
    string start, and from there to the last), at (where such anchors are)."""
    shared = length - window

    def run(batches):
        for b in batches:
            cols = [[], [], [], [], [], [], []]
            for doc_id, th, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "text")], strict=True):
                data = text.encode()
                kinds = {}
                for at, lo, hi in zip(*anchors_of(data, length, window), strict=True):
                    kind = (xxhash.xxh64_intdigest(data[at:at + shared]), xxhash.xxh64_intdigest(data[lo:hi + length]), at - lo, hi - lo)
                    kinds.setdefault(kind, []).append(at)
                cols[0] += [doc_id] * len(kinds)
                cols[1] += [th] * len(kinds)
                for i in range(4):
                    cols[2 + i] += [k[i] for k in kinds]
                cols[6] += kinds.values()
            ctx, own = (np.array(c, dtype=np.uint64).view(np.int64) for c in cols[2:4])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(ctx), pa.array(own),
                 pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.list_(pa.int32()))],
                names=["doc_id", "th", "ctx", "own", "before", "owned", "at"])

    return docs.mapInArrow(run, "doc_id bigint, th bigint, ctx bigint, own bigint, before int, owned int, at array<int>")


# ---- passages by words ----

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def context_words(words: int) -> int:
    """Words behind an anchor that all windows of ``words`` + 1 words it owns share."""
    return words // 3 + 1


class Words:
    """The words of a text: ``start`` and ``end`` of each in its bytes, and
    ``run(i, j)``, the words from i up to j with one space between them."""

    def __init__(self, data: bytes):
        edges = np.flatnonzero(np.diff(SPACE[np.frombuffer(data, dtype=np.uint8)], prepend=True, append=True))
        self.start, self.end = edges[::2], edges[1::2]
        self.plain = b" ".join(data.split())
        self.at = np.cumsum(self.end - self.start + 1) - (self.end - self.start + 1)

    def __len__(self) -> int:
        return len(self.start)

    def run(self, i: int, j: int) -> bytes:
        return self.plain[self.at[i]:self.at[j - 1] + self.end[j - 1] - self.start[j - 1]]


def word_anchors(text: Words, words: int):
    """Anchors (word numbers) of a text and the first and last window of
    ``words`` + 1 words each one owns: the leftmost minimal hash of the bytes at
    the word starts that leave the context inside the window."""
    n, context = len(text) - words, context_words(words)
    places = words + 2 - context
    gram = min(KGRAM, 1 << (2 * context - 1).bit_length() - 1)  # so many bytes the context has
    at, first, last = [], [], []
    step = 1 << 20
    for base in range(0, n, step):  # blocks keep memory bounded; a block's windows see all their places
        count = min(step, n - base)
        where = text.at[base:base + count + places - 1]
        part = np.frombuffer(text.plain, dtype=np.uint8, count=int(where[-1] - where[0]) + gram, offset=int(where[0]))
        packed = (gram_hashes(part, gram)[where - where[0]] << np.uint64(32)) | np.arange(len(where), dtype=np.uint64)
        chosen = (sliding_min(packed, places) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        at += (chosen[cut] + base).tolist()
        first += (cut + base).tolist()
        last += (np.append(cut[1:], count) - 1 + base).tolist()
    return at, first, last


def passage_table(docs: DataFrame, words: int) -> DataFrame:
    """The word anchors of ``docs`` (doc_id, th, text).  One row for each
    document and kind of anchor: ctx (hash of the words behind it), own (hash
    of all words of its windows), s and e (the bytes these have), more (null or
    the same where the document holds them again)."""
    context = context_words(words)

    def run(batches):
        for b in batches:
            cols = [[], [], [], [], [], [], []]
            for doc_id, th, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "text")], strict=True):
                found, kinds = Words(text.encode()), {}
                for at, lo, hi in zip(*word_anchors(found, words), strict=True):
                    end = hi + words + 1
                    kind = (xxhash.xxh64_intdigest(found.run(at, at + context)), xxhash.xxh64_intdigest(found.run(lo, end)))
                    kinds.setdefault(kind, []).append({"s": int(found.start[lo]), "e": int(found.end[end - 1])})
                cols[0] += [doc_id] * len(kinds)
                cols[1] += [th] * len(kinds)
                for i in range(2):
                    cols[2 + i] += [k[i] for k in kinds]
                    cols[4 + i] += [v[0]["se"[i]] for v in kinds.values()]
                cols[6] += [v[1:] or None for v in kinds.values()]
            ctx, own = (np.array(c, dtype=np.uint64).view(np.int64) for c in cols[2:4])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(ctx), pa.array(own),
                 pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32()),
                 pa.array(cols[6], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))],
                names=["doc_id", "th", "ctx", "own", "s", "e", "more"])
        release_worker_memory()

    return docs.mapInArrow(run, "doc_id bigint, th bigint, ctx bigint, own bigint, s int, e int, more array<struct<s: int, e: int>>")


def passages_of(docs: DataFrame, words: int):
    """Spans that are in two documents or more with all an anchor owns, and
    the kinds of anchors (doc_id, th, passage) whose windows must be counted."""
    table = stored(passage_table(docs, words), "suffix-words")
    twice = table.groupBy("ctx").agg(F.count("*").alias("n")).where("n > 1").select("ctx")
    shared = stored(table.join(twice, "ctx"), "suffix-word-groups")
    kinds = stored(shared.groupBy("ctx", "own").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "s", "e", "more")).alias("one")),
                   "suffix-word-kinds")
    settled = shared.join(kinds.where("n > 1").select("ctx", "own"), ["ctx", "own"]).select(
        "doc_id", "th", F.explode(places("s", "e", "more")).alias("x")).select(
        "doc_id", "th", F.col("x.s").cast("bigint").alias("s"), F.col("x.e").cast("bigint").alias("e"))
    open_groups = kinds.groupBy("ctx").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("ctx")
    marks = kinds.join(open_groups, "ctx").select("one.doc_id", "one.th", F.struct(
        "ctx", places("one.s", "one.e", "one.more").alias("places"), F.least("n", F.lit(2)).cast("int").alias("documents")).alias("passage"))
    return settled, marks


def word_windows(data: bytes, passages, words: int):
    """(context's hash, hash, documents, places) of each distinct window of
    ``words`` + 1 words in the passages."""
    text, found = Words(data), {}
    for p in sorted(passages, key=lambda p: -p["documents"]):
        for x in p["places"]:
            lo, end = int(np.searchsorted(text.start, x["s"])), int(np.searchsorted(text.end, x["e"])) + 1
            for i in range(lo, end - words):
                k = p["ctx"], xxhash.xxh64_intdigest(text.run(i, i + words + 1)) - 2**63
                found.setdefault(k, (p["documents"], []))[1].append({"s": int(text.start[i]), "e": int(text.end[i + words])})
    for k, (documents, places) in found.items():
        yield *k, documents, places


# ---- runs: front-coded, sorted suffixes ----


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are not compared."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    at = known
    while a[at:at + 32] == b[at:at + 32]:
        at += 32
    while a[at] == b[at]:
        at += 1
    return at


def front_coded(entries: list[tuple]) -> bytes:
    """Entries (suffix, left, doc, th, at), sorted by suffix, as one blob."""
    shared, rests, before = [], [], b""
    for e in entries:
        n = common_prefix(before, e[0])
        shared.append(n)
        rests.append(e[0][n:])
        before = e[0]
    head = np.array([len(entries)], dtype="<i8")
    no_id = [e[2] is None for e in entries]
    parts = [
        head, np.array(shared, dtype="<u4"), np.array([len(r) for r in rests], dtype="<u4"),
        np.array([len(e[1]) for e in entries], dtype="<u4"), np.array([e[2] or 0 for e in entries], dtype="<i8"),
        np.array(no_id, dtype="<u1"), np.array([e[3] for e in entries], dtype="<i8"),
        np.array([e[4] for e in entries], dtype="<u4")]
    raw = b"".join([p.tobytes() for p in parts] + rests + [e[1] for e in entries])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def read_run(blob: bytes):
    """Yields (shared with the one before, suffix, left, doc, th, at)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    pos, cols = 8, []
    for kind in ("<u4", "<u4", "<u4", "<i8", "<u1", "<i8", "<u4"):
        a = np.frombuffer(raw, kind, n, pos)
        pos += a.nbytes
        cols.append(a.tolist())
    shared, sizes, lefts, docs, no_id, ths, at = cols
    left_pos = pos + sum(sizes)
    before = b""
    for i in range(n):
        suffix = before[:shared[i]] + raw[pos:pos + sizes[i]]
        pos += sizes[i]
        left = raw[left_pos:left_pos + lefts[i]]
        left_pos += lefts[i]
        yield shared[i], suffix, left, None if no_id[i] else docs[i], ths[i], at[i]
        before = suffix


def merged(runs):
    """Merge iterators of ``read_run`` entries; yields (shared with the one
    before in merged order, entry).  A loser tree: ``known[r]`` is the common
    prefix of run r's head with the last suffix given out, or with the winner
    it lost to, so no comparison starts before it."""
    runs = [iter(r) for r in runs]
    size = 1
    while size < len(runs):
        size *= 2
    runs += [iter(())] * (size - len(runs))
    heads = [next(r, None) for r in runs]
    known = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; sets what the loser knows."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return x is not None
        if known[a] != known[b]:
            return known[a] > known[b]
        s, t = x[1], y[1]
        n = common_prefix(s, t, known[a])
        if n == len(s) or n == len(t):
            first = len(s) < len(t) or len(s) == len(t) and a < b
        else:
            first = s[n] < t[n]
        known[b if first else a] = n
        return first

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for i in range(size - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        if beats(a, b):
            winners[i], losers[i] = a, b
        else:
            winners[i], losers[i] = b, a
    top = winners[1]
    while heads[top] is not None:
        entry = heads[top]
        yield known[top], entry
        heads[top] = following = next(runs[top], None)
        known[top] = following[0] if following is not None else 0
        i = (top + size) // 2
        while i:
            if not beats(top, losers[i]):
                top, losers[i] = losers[i], top
            i //= 2


# ---- matches inside a group ----


def group_spans(members, shared, length: int):
    """Spans (member, first byte, end) to remove.  ``members`` are entries in
    suffix order (with the group hash in front of each suffix), ``shared[i]``
    the common prefix of members i and i+1 without that hash."""
    order = sorted(range(len(shared)), key=lambda i: -shared[i])
    lists = [[(m[2][::-1], i)] for i, m in enumerate(members)]
    home = list(range(len(members)))

    def find(i):
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    best = [-1] * len(members)
    out = []
    for i in order:
        right = shared[i]
        need = length - right
        a, b = find(i), find(i + 1)
        if len(lists[a]) < len(lists[b]):
            a, b = b, a
        large, little = lists[a], lists[b]
        home[b] = a
        for x in little:
            at = bisect_left(large, x)
            for j in (at - 1, at):
                if 0 <= j < len(large):
                    y = large[j]
                    left = common_prefix(x[0], y[0])
                    if left >= need:
                        for m in (x[1], y[1]):
                            if left > best[m]:
                                best[m] = left
                                out.append((m, members[m][5] - left, members[m][5] + right))
            large.insert(at, x)
        lists[b] = []
    return out


def range_spans(blobs, length: int, window: int):
    """Spans (doc, th, first byte, end) of one range of runs."""
    least = 8 + length - window
    members, shared = [], []

    def flush():
        if len(members) > 1:
            for m, s, e in group_spans(members, shared, length):
                yield members[m][3], members[m][4], s, e
        members.clear()
        shared.clear()

    for n, entry in merged([read_run(b) for b in blobs]):
        if members and n >= least:
            shared.append(n - 8)
        else:
            yield from flush()
        members.append(entry)
    yield from flush()


SPANS = "doc_id bigint, th bigint, s bigint, e bigint"
PLACES = "array<struct<s: int, e: int>>"
#: Most bits of the table that tells which texts need not travel.
FILTER_BITS = 1 << 25


def places(s, e, more):
    """Array of the place (s, e) and of ``more``, which may be null."""
    first = F.array(F.struct(F.col(s).cast("int").alias("s"), F.col(e).cast("int").alias("e")))
    return F.when(F.col(more).isNull(), first).otherwise(F.concat(first, F.col(more)))


def may_be_in(df: DataFrame, keys: DataFrame) -> DataFrame:
    """``df`` with a boolean column maybe: false only where no row of ``keys``
    (stored) has its th.  From a broadcast table of bits, 16 or more for each row
    as far as FILTER_BITS go; a fuller one lets more texts travel and changes no
    result."""
    size = min(max(1 << (16 * keys.count()).bit_length(), 64), FILTER_BITS)
    bits = stored(keys.select(F.col("th").bitwiseAND(F.lit(size - 1)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("bits_at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits_set")), "suffix-bits")
    own = F.shiftright(F.col("th").bitwiseAND(F.lit(size - 1)), 6) == F.col("bits_at")
    return df.join(F.broadcast(bits), own, "left").withColumn(
        "maybe", F.expr("coalesce(shiftright(bits_set, cast(th & 63 as int)) & 1, 0) = 1")).drop("bits_at", "bits_set")


def repeated_spans(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, group: int = GROUP, words: int | None = None) -> DataFrame:
    """doc_id, th, s, e: byte spans to remove (they overlap).  ``docs`` has
    doc_id, th (a hash of the text) and text; a document is (doc_id, th)."""
    table = stored(anchor_table(docs.where(F.octet_length("text") >= length), length, window), "suffix-anchors")
    groups = stored(table.groupBy("ctx").agg(F.sum(F.size("at")).alias("n")).where("n > 1"), "suffix-groups")
    cold = table.join(groups.where(F.col("n") <= group), "ctx").select(
        "doc_id", "th", F.struct("ctx", "before", "owned", "at", F.lit(False).alias("one_by_one")).alias("mark"))
    settled = None
    if groups.where(F.col("n") > group).limit(1).count():
        hot = table.join(small(groups.where(F.col("n") > group).select("ctx")), "ctx")
        kinds = stored(hot.groupBy("ctx", "own").agg(
            F.sum(F.size("at")).alias("n"), F.min(F.struct("doc_id", "th", "before", "owned", F.slice("at", 1, 1).alias("at"))).alias("one")),
            "suffix-kinds")
        per_group = kinds.groupBy("ctx").agg(F.count("*").alias("kinds"))
        ones = kinds.join(per_group, "ctx").select("one.doc_id", "one.th", F.struct(
            "ctx", "one.before", "one.owned", "one.at", (F.col("kinds") > group).alias("one_by_one")).alias("mark"))
        cold = cold.unionByName(ones)
        settled = hot.join(kinds.where("n > 1").select("ctx", "own"), ["ctx", "own"]).select(
            "doc_id", "th", F.explode("at").alias("at"), "before", "owned").select(
            "doc_id", "th", (F.col("at") - F.col("before")).cast("bigint").alias("s"),
            (F.col("at") - F.col("before") + F.col("owned") + length).cast("bigint").alias("e"))
    passage = f"struct<ctx: bigint, places: {PLACES}, documents: int>"
    cold = cold.withColumn("passage", F.lit(None).cast(passage))
    if words is not None:
        same, marks = passages_of(docs, words)
        settled = same if settled is None else settled.unionByName(same)
        cold = cold.unionByName(marks, allowMissingColumns=True)
    wanted = stored(cold.groupBy("doc_id", "th").agg(
        F.collect_set("mark").alias("marks"), F.collect_set("passage").alias("passages")), "suffix-candidates")
    total = wanted.agg(F.sum(F.aggregate("marks", F.lit(0), lambda a, m: a + F.size(m["at"])))).first()[0] or 0
    ranges = max(1, -(-total // RANGE_ROWS))
    joined = may_be_in(docs, wanted).where("maybe").alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id AND d.th = w.th")).select(
        "d.doc_id", "d.th", "d.text", "w.marks", "w.passages")

    def make_runs(batches):
        entries, held = [], 0
        for b in batches:
            hot = [[], [], [], [], [], [], [], []]
            columns = [b.column(c).to_pylist() for c in ("doc_id", "th", "text", "marks", "passages")]
            for doc_id, th, text, marks, passages in zip(*columns, strict=True):
                data = text.encode()
                if passages:
                    for k1, k2, documents, at in word_windows(data, passages, words):
                        for c, v in zip(hot, (k1, k2, doc_id, th, at[0]["s"], at[0]["e"], documents, at[1:] or None), strict=True):
                            c.append(v)
                for m, at in ((m, at) for m in marks for at in m["at"]):
                    lo = at - m["before"]
                    hi = lo + m["owned"]
                    if m["one_by_one"]:
                        for i in range(lo, hi + 1):
                            k = xxhash.xxh128_intdigest(data[i:i + length])
                            hot[0].append((k >> 64) - 2**63)
                            hot[1].append((k & (2**64 - 1)) - 2**63)
                            hot[2].append(doc_id)
                            hot[3].append(th)
                            hot[4].append(i)
                            hot[5].append(i + length)
                            hot[6].append(None)
                            hot[7].append(None)
                        continue
                    ctx = (m["ctx"] % 2**64).to_bytes(8, "big")
                    entries.append((ctx + data[at:hi + length], data[lo:at], doc_id, th, at))
                    held += hi + length - lo
                    if held > RUN_BYTES:
                        yield run_batch(entries)
                        entries, held = [], 0
            if hot[0]:
                yield batch_of([-1] * len(hot[0]), [None] * len(hot[0]), *hot)
        if entries:
            yield run_batch(entries)
        entries.clear()
        release_worker_memory()

    def run_batch(entries):
        entries.sort(key=lambda e: e[0])
        cut, numbers, blobs = 0, [], []
        where = [int.from_bytes(e[0][:8], "big") * ranges >> 64 for e in entries]
        for i in range(1, len(entries) + 1):
            if i == len(entries) or where[i] != where[cut]:
                numbers.append(where[cut])
                blobs.append(front_coded(entries[cut:i]))
                cut = i
        none = [None] * len(blobs)
        return batch_of(numbers, blobs, none, none, none, none, none, none, none, none)

    def batch_of(numbers, blobs, *hot):
        names = ["range", "run", "k1", "k2", "doc_id", "th", "s", "e", "documents", "more"]
        kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 7, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip((numbers, blobs, *hot), kinds, strict=True)], names=names)

    runs = stored(joined.mapInArrow(
        make_runs, f"range bigint, run binary, k1 bigint, k2 bigint, doc_id bigint, th bigint, s bigint, e bigint, documents bigint, more {PLACES}"),
        "suffix-runs")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(range_spans(list(pdf["run"]), length, window))
        frame = pd.DataFrame(out, columns=["doc_id", "th", "s", "e"])
        return frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    spans = runs.where("run is not null").select("range", "run").groupBy("range").applyInPandas(merge, SPANS)
    # Strings of bytes count wherever they start, windows of words once a document.
    starts = runs.where("run is null").withColumn("bytes", F.col("documents").isNull())
    again = starts.groupBy("bytes", "k1", "k2").agg(F.sum(F.coalesce("documents", F.lit(1))).alias("n")).where("n > 1").drop("n")
    spans = spans.unionByName(starts.join(again, ["bytes", "k1", "k2"]).select(
        "doc_id", "th", F.explode(places("s", "e", "more")).alias("x")).selectExpr("doc_id", "th", "bigint(x.s) s", "bigint(x.e) e"))
    return spans if settled is None else spans.unionByName(settled)


def union_of(spans) -> list[list[int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def cut_out(data: bytes, runs) -> bytes:
    at, kept = 0, []
    for s, e in runs:
        kept.append(data[at:s])
        at = e
    kept.append(data[at:])
    return b"".join(kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, group: int = GROUP, words: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any others but th, spans, maybe) with spans
    (array of [first byte, end)) and kept (the remaining bytes).  With
    ``words``, passages of more words that another document holds go too."""
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", F.xxhash64("text"))
    slim = keyed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "th", "text").where(
        F.octet_length("text") >= (length if words is None else min(length, 2 * words + 1)))
    spans = stored(repeated_spans(slim, length, window, group, words).groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("s", "e")).alias("spans")), "suffix-spans")
    some = may_be_in(keyed, spans)
    joined = some.where("maybe").alias("d").join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id AND d.th = s.th"), "left").select(
        *[F.col(f"d.{c}") for c in docs.columns], F.col("s.spans").alias("spans"))
    joined = joined.unionByName(some.where("NOT maybe").select(*docs.columns, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    names = [*docs.columns, "spans", "kept"]

    def run(batches):
        at_text, at_spans = names.index("text"), names.index("spans")
        for b in batches:
            runs = [union_of((x["s"], x["e"]) for x in s or ()) for s in b.column(at_spans).to_pylist()]
            kept = [cut_out(t.encode(), r) for t, r in zip(b.column(at_text).to_pylist(), runs, strict=True)]
            cols = list(b.columns)
            cols[at_spans] = pa.array(runs, pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.binary())], names=names)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields if f.name != "th"],
                        "spans array<array<bigint>>", "kept binary"])
    return joined.mapInArrow(run, schema)


def whole_characters(data):
    """Binary column without the bytes of characters that lost a part."""

    @F.pandas_udf("binary")
    def clean(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else bytes(v).decode("utf-8", "ignore").encode())

    return clean(data)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(pick(load(spark, sf_dir, "documents"), "doc_id", "text"))
    n_bytes, n_kept = F.octet_length("text"), F.octet_length("kept")
    return out.select("doc_id", n_bytes.cast("bigint").alias("n_bytes"), (n_bytes - n_kept).cast("bigint").alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
