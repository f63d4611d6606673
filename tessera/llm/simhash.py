"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has one bit for each bit of a 64-bit hash: 1 if more than
half of its shingles' hashes have it.  Two fingerprints link when they differ
in at most ``radius`` bits; a component is what links reach.

Covering: every bit position gets a code of ``radius + 1`` bits.  For each
non-zero vector v of that many bits there is a table; its mask keeps the
positions whose code has an odd inner product with v.  For any ``radius``
positions some v is orthogonal to all their codes (they span less than the
whole space), so that table's mask leaves them out: every pair within the
radius collides in at least one of the ``2**(radius+1) - 1`` tables.

Equal fingerprints are one node, so groups of copies cost one row.  A bucket
holds distinct fingerprints only; its task checks every pair that is not yet
connected and returns the links of a spanning forest, not all pairs.  A bucket
that may hold more than ``BUCKET`` fingerprints is dealt again by covering
masks over the positions its own mask leaves out (at most 32): the same
argument holds there, so no pair is lost, and what is left open is at most 16
bits, so no bucket ever holds more than 65,536 fingerprints.  Links become
components by rounds of big-star and small-star joins, each written to the
shared folder.  Nothing of this goes through the driver.

Defined cases: a null text is empty; a text without words has fingerprint
zero and links like any other; fewer words than a shingle form one shingle; a
null doc_id counts as larger than any other; repeated rows are separate rows
with one fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, load, pick, small, stored

SHINGLE = 4
RADIUS = 4
BITS = 64
SEED = 42
#: Fingerprints of one bucket that are compared without dealing them again.
BUCKET = 8192


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle.  ASCII letters fold, ASCII white space splits."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 65_536):  # bounded memory for texts of any length
        part = h[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def covering_masks(radius: int = RADIUS, positions: list[int] | None = None) -> list[int]:
    """The masks over some bit positions (default: all 64) as signed numbers.
    Codes go round the non-zero vectors, so that no position has an empty mask
    in every table."""
    n = 2 ** (radius + 1)
    codes = [(p, 1 + i % (n - 1)) for i, p in enumerate(range(BITS) if positions is None else positions)]
    masks = [sum(1 << p for p, c in codes if (c & v).bit_count() % 2) for v in range(1, n)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def inner_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks for a bucket of the table ``mask``: over the positions it leaves out, each with the bucket's own."""
    return [mask | m for m in covering_masks(radius, [p for p in range(BITS) if not mask >> p & 1])]


def forest_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the graph of pairs within the radius.
    Walks from node to node; each step compares with unreached nodes only."""
    fps = np.unique(fps)
    values = fps.view(np.uint64)
    left = np.arange(len(fps))
    links, todo = [], []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
        node = todo.pop()
        near = np.bitwise_count(values[left] ^ values[node]) <= radius
        found = left[near]
        if len(found):
            links += [(int(fps[node]), int(fps[j])) for j in found]
            todo += found.tolist()
            left = left[~near]
    return links


def covering_links(fingerprints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a < b: links between distinct ``fp`` values (a table that is cheap to
    read again) that connect whatever pairs within the radius connect."""
    masks = covering_masks(radius)
    rows = fingerprints.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("tab", "mask"))
    rows = rows.select("tab", F.col("fp").bitwiseAND(F.col("mask")).alias("kept"), "fp")

    # Counted by hashed groups of buckets, few beside the rows, so that the count shuffles little.  A small bucket
    # that shares a group with a large one is dealt again too; its links are the same.
    n_groups = 64 + 16 * len(masks) * fingerprints.count() // bucket
    grouped = rows.withColumn("crowd", F.pmod(F.xxhash64("tab", "kept"), F.lit(n_groups)))
    crowds = stored(grouped.groupBy("crowd").count().where(F.col("count") > bucket).select("crowd"), "simhash-crowds")
    if crowds.isEmpty():
        dealt = rows.select(F.col("tab").alias("t"), F.col("kept").alias("k"), "fp")
    else:
        inner = F.array(*[F.array(*[F.lit(m) for m in inner_masks(mask, radius)]) for mask in masks])
        hot = grouped.join(small(crowds), "crowd", "left_semi").select(
            "tab", "fp", F.posexplode(F.element_at(inner, F.col("tab") + 1)).alias("sub", "mask"))
        dealt = grouped.join(small(crowds), "crowd", "left_anti").select(F.col("tab").alias("t"), F.col("kept").alias("k"), "fp")
        dealt = dealt.unionByName(hot.select((len(masks) * (F.col("tab") + 1) + F.col("sub")).alias("t"),
                                             F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp"))
    buckets = dealt.groupBy("t", "k").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    two = buckets.where(F.size("fps") == 2).select(F.array_min("fps").alias("a"), F.array_max("fps").alias("b"))
    two = two.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)

    def run(batches):
        for b in batches:
            pairs = [p for fps in b["fps"] for p in forest_links(np.asarray(fps, dtype=np.int64), radius)]
            yield pd.DataFrame({"a": np.array([min(p) for p in pairs], dtype=np.int64),
                                "b": np.array([max(p) for p in pairs], dtype=np.int64)})

    more = buckets.where(F.size("fps") > 2).mapInPandas(run, "a bigint, b bigint")
    return two.unionByName(more).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of the component) for every node that has a
    link.  Alternating star joins; every round is written and counted."""
    edges = stored(links.select("a", "b"), "simhash-links")
    while True:
        # Big star: neighbours larger than a node go to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        big = (both.where(F.col("b") > F.col("a")).join(least, "a")
               .select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        # Small star: smaller neighbours and the node itself go to the smallest.
        least = big.groupBy("b").agg(F.min("a").alias("m"))
        joined = big.join(least, "b")
        new = (joined.select(F.col("m").alias("a"), "b")
               .unionByName(joined.select(F.col("m").alias("a"), F.col("a").alias("b")))
               .where("a <> b").distinct())
        new = stored(new, "simhash-stars")
        # Done when every node hangs on one root that itself hangs on nothing.
        loose = new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        several = new.groupBy("b").count().where("count > 1").limit(1).count()
        edges = new
        if not loose and not several:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` (must have ``text``) with the column ``fp`` instead of text."""

    def start():
        return lambda texts: ([simhash(t, size) for t in texts],)

    return add_columns(docs, ["text"], [("fp", "bigint")], start).drop("text")


def components_of(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and others) but text, with fp,
    root (one fingerprint that stands for the component) and component_id
    (its smallest doc_id)."""
    marked = stored(fingerprints(docs, size), "simhash-fps")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    nodes = components(covering_links(distinct.select("fp"), radius))
    roots = distinct.join(nodes, distinct.fp == nodes.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stored(roots.join(by_root, "root").select("fp", "root", "component_id"), "simhash-components")
    return marked.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text)."""
    return components_of(pick(docs, "doc_id", "text"), size, radius).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
