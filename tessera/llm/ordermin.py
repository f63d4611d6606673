"""Document fingerprints by order MinHash.

The character k-mers of a text are numbered by occurrence (the second "abcde"
differs from the first).  Each of ``SKETCHES`` hash functions selects the
``TUPLE`` numbered k-mers with the smallest values, puts them back into text
order and hashes them as a tuple.  Two texts agree in a tuple only if the same
k-mers are minimal *and* come in the same order, so the share of equal tuples
follows edit distance, not only the set of k-mers.

``with_next`` pairs each document with the next by ascending doc_id without a
global sort in one task: the rows are dealt by ranges whose bounds are ids of
the table; a bound's row is also sent to the range before, as its end.  Inside
a range one pass over sorted rows holds two texts at a time.

Defined cases: a null text is empty; texts shorter than k code points have one
k-mer, the whole text; equal texts have equal fingerprints; two empty texts
have likeness 1; null ids come first; of equal ids the smaller text comes
first, and repeated rows are separate rows; after the last row comes the
first, for a single row itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import load, map_lists, pick, text_batches

K = 8
SKETCHES = 64
TUPLE = 2
#: k-mers looked at at once; longer texts go through block by block.
BLOCK = 1 << 16
#: Rows of a range.
RANGE_ROWS = 1_000
#: Most ranges; beyond it they get longer (a range is read row by row).
MAX_RANGES = 10_000

# Odd multipliers and offsets, drawn from a fixed generator.
_RNG = np.random.Generator(np.random.PCG64(7))
MULTIPLIERS = (_RNG.integers(0, 2**32, SKETCHES, dtype=np.uint32) | np.uint32(1))
OFFSETS = _RNG.integers(0, 2**32, SKETCHES, dtype=np.uint32)
BASE = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """One hash for each k-mer, by doubling: a window of 2w is two of w."""
    if len(points) <= k:
        whole = np.uint64(len(points))
        for p in points.tolist():
            whole = np.uint64((int(whole) * int(BASE) + p + 1) % 2**64)
        return mixed(np.array([whole], dtype=np.uint64))
    h, width, factor = points.astype(np.uint64) + np.uint64(1), 1, BASE
    out, have, rest = None, 0, k
    while rest:
        if rest & 1:
            if out is None:
                out, have = h, width
            else:
                n = len(points) - have - width + 1
                out = out[:n] * factor + h[have:have + n]
                have += width
        rest >>= 1
        if rest:
            n = len(h) - width
            h = h[:n] * factor + h[width:width + n]
            width *= 2
            factor = np.uint64(int(factor) ** 2 % 2**64)
    return mixed(out)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """32-bit values of (k-mer, occurrence number), by position."""
    n = len(hashes)
    packed = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    packed.sort()  # groups equal k-mers, positions ascending inside a group
    key, pos = packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(key[1:], key[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    if len(starts) == n:
        return (hashes >> np.uint64(32)).astype(np.uint32)
    order = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    again = order > 0
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    values[pos[again]] = (mixed(hashes[pos[again]] + order[again].astype(np.uint64) * BASE) >> np.uint64(32)).astype(np.uint32)
    return values


def signature(text: str, k: int = K) -> np.ndarray:
    """``SKETCHES`` 32-bit tuple hashes."""
    values = numbered(kmer_hashes(code_points(text), k))
    rows = np.arange(SKETCHES)
    best = np.full((SKETCHES, 0), 0, dtype=np.uint64)
    for at in range(0, len(values), BLOCK):
        part = values[at:at + BLOCK]
        ranked = part[None, :] * MULTIPLIERS[:, None]
        ranked ^= OFFSETS[:, None]
        found = []
        for _ in range(min(TUPLE, len(part))):
            j = ranked.argmin(axis=1)
            # rank above, position below: a tie goes to the earlier k-mer
            found.append(ranked[rows, j].astype(np.uint64) << np.uint64(32) | (j + at).astype(np.uint64))
            ranked[rows, j] = np.uint32(0xFFFFFFFF)
        best = np.concatenate([best, np.stack(found, axis=1)], axis=1)
        best.sort(axis=1)
        best = best[:, :TUPLE]
    pos = np.sort(best & np.uint64(0xFFFFFFFF), axis=1).astype(np.int64)
    out = np.zeros(SKETCHES, dtype=np.uint64)
    for i in range(pos.shape[1]):
        out = mixed(out * BASE + values[pos[:, i]].astype(np.uint64) + np.uint64(1))
    return (out >> np.uint64(32)).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SKETCHES


def with_next(docs: DataFrame, run, schema: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``run`` gets pairs ((doc_id, text), (next id, next text)) of every
    row in ascending order of doc_id, range by range, and yields result rows."""
    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, low, nulls = rows.agg(F.count("*"), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = min(MAX_RANGES, max(1, n // range_rows))
    # Bounds are ids of rows (one number for each range), so no range is empty.
    bounds = []
    if ranges > 1 and low is not None:
        at = [i / ranges for i in range(1, ranges)]
        bounds = rows.agg(F.percentile_approx("doc_id", at, 10 * ranges)).first()[0]
        bounds = sorted({b for b in bounds if b > low})
    return _dealt(rows, bounds, low if not nulls else None, len(bounds), run, schema)


def _dealt(rows, bounds, first_id, last, run, schema):
    edges = np.array(bounds, dtype=np.int64)

    def deal(batches):
        for b in batches:
            ids = b.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            plain = ids.fill_null(0).to_numpy(zero_copy_only=False)

            def told(rows, part, after, b=b):
                picked = b if rows is None else b.filter(pa.array(rows))
                part = np.broadcast_to(np.asarray(part, dtype=np.int32), picked.num_rows)
                return pa.RecordBatch.from_arrays([*picked.columns, pa.array(part), pa.array(np.full(picked.num_rows, after, dtype=np.int32))],
                                                  names=["doc_id", "text", "part", "after"])

            part = np.where(missing, 0, np.searchsorted(edges, plain, side="right"))
            yield told(None, part, 0)
            # The first row of a range ends the range before; the first of all ends the last.
            ends = ~missing & np.isin(plain, edges)
            if ends.any():
                yield told(ends, part[ends] - 1, 1)
            head = missing if first_id is None else (~missing & (plain == first_id))
            if head.any():
                yield told(head, last, 2)

    dealt = text_batches(rows).mapInArrow(deal, "doc_id bigint, text string, part int, after int")

    def pairs(batches):
        held, part, ended = None, None, False
        for b in batches:
            for i, t, p, after in zip(b["doc_id"], b["text"], b["part"], b["after"], strict=True):
                if p != part:
                    held, part, ended = None, p, False
                if ended:
                    continue  # only the first of several end rows follows the last row
                row = (i, t)
                if held is not None:
                    yield held, row
                ended = after > 0
                held = row

    def work(batches):
        yield from run(pairs(batches))

    ordered = dealt.repartition(last + 1, "part").sortWithinPartitions("part", "after", F.asc_nulls_first("doc_id"), "text")
    return map_lists(ordered, work, schema)


FINGERPRINT_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                      "edited_fingerprint string, near_edited double, near_next double")


def edited(text: str, following: str) -> str:
    """The last half replaced by the beginning of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_pairs(pairs):
    out, size, previous = [], 0, None
    for (i, text), (_, following) in pairs:
        own = previous[1] if previous is not None and previous[0] is text else signature(text)
        after = signature(following)
        previous = (following, after)
        changed = edited(text, following)
        new = signature(changed)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), new.tobytes().hex(),
                    likeness(own, new), likeness(own, after)))
        if len(out) == 1000:
            yield out
            out = []
    if out:
        yield out


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(load(spark, sf_dir, "documents"), fingerprint_pairs, FINGERPRINT_SCHEMA)
