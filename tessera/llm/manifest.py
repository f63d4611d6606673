"""Merkle manifest of a dataset by bitmap-rank indexing.

Every row is a leaf.  Leaves of a group (``lang``) stand in ascending doc_id,
and every two consecutive nodes become their hash until one is left, the
group's subroot; the subroots, ordered by group, give the root in the same way.

No leaf is sorted for its place.  The ids of a group are a bitmap cut into
64-bit words, of which only those with a bit are kept; tasks build partial
words, which are merged by OR.  A popcount directory of four levels (each node
has at most 65,536 children) tells how many rows of the group lie below each
word, so the place of a leaf is one lookup and one popcount.  Leaves are then
grouped by place / 256 into slot arrays of bounded size: an array reduces by
eight levels in one task and is one node of the next round, so a group with
most of the rows is as parallel as many small ones.  On the way back each
array hands its children their proofs.

Defined cases: a null id comes first in its group; rows with the same id, also
null ids, are ordered by leaf hash and get their places by a range sort of
those rows alone; equal rows have equal leaves, so their order does not show.
A null group is a group of its own and comes first.  A null ``n_chars`` cannot
be tampered with.  An empty table gives no rows; columns besides the five are
ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import load, pick, stored

#: Nodes in a slot array: 2 ** SLOT_BITS.
SLOT_BITS = 8
WIDTH = 1 << SLOT_BITS
#: Key of the word that holds null ids: below every other word.
NULL_WORD = -(2**57) - 1
#: Bits of a word's key that one level of the popcount directory covers.
DIRECTORY_BITS = 16
#: Rows of a range partition where rows with equal ids are put in order.
RANGE_ROWS = 200_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


# ---- leaves ----


def field_text(value):
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values):
    return F.unhex(F.sha2(F.concat(*[field_text(v) for v in values]), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (the group), lang, digest, tampered (the digest after one is
    added to n_chars, for the rows that are tampered with, else null)."""
    own = pick(docs, *FIELDS)
    cols = [F.col(c) for c in FIELDS]
    more = [F.col(c) if c != "n_chars" else F.col(c).cast("decimal(20,0)") + 1 for c in FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return own.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("key"), "lang",
                      leaf_digest(cols).alias("digest"), F.when(hit, leaf_digest(more)).alias("tampered"))


# ---- places ----


def id_words(leaves: DataFrame) -> DataFrame:
    """key, word, bits, n: the groups' bitmaps without their empty words; n
    rows have an id in the word."""
    bit = F.when(F.col("doc_id").isNull(), F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")))
    return (leaves.select("key", word_of("doc_id").alias("word"), bit.alias("bit"))
            .groupBy("key", "word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n")))


def word_of(doc_id: str):
    return F.coalesce(F.shiftright(F.col(doc_id), 6), F.lit(NULL_WORD).cast("bigint"))


def with_directory(words: DataFrame) -> DataFrame:
    """``words`` with ``before`` (rows of the group in lower words) and
    ``size`` (rows of the group), from popcounts summed level by level."""
    levels = [words.select("key", F.col("word").alias("at"), "bits", "n")]
    for _ in range(3):
        levels.append(levels[-1].groupBy("key", F.shiftright("at", DIRECTORY_BITS).alias("at")).agg(F.sum("n").alias("n")))
    inside = Window.partitionBy("key")
    below = inside.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = levels[3].select("key", "at", "n", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"),
                             F.sum("n").over(inside).alias("size"))
    for level in (levels[2], levels[1], levels[0]):
        upper = known.select("key", F.col("at").alias("up"), F.col("before").alias("start"), "size")
        rows = level.withColumn("up", F.shiftright("at", DIRECTORY_BITS)).join(upper, ["key", "up"])
        below = Window.partitionBy("key", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        known = rows.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(below), F.lit(0))).drop("start", "up")
    return known.withColumnRenamed("at", "word")


def sorted_places(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``position``, their place in the order of the columns.
    Ranges are sorted one by one; only their sizes meet."""
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("mark", F.monotonically_increasing_id()), "manifest-ranges")
    part = F.shiftright("mark", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ranged.withColumn("part", part).join(F.broadcast(starts), "part").withColumn(
        "position", F.col("start") + F.col("mark").bitwiseAND(F.lit(2**33 - 1))).drop("part", "start", "mark")


def placed(leaves: DataFrame) -> DataFrame:
    """Stored ``leaves`` with idx (place in the group) and size (of the group)
    instead of row, a number of its own for each row."""
    directory = stored(with_directory(stored(id_words(leaves), "manifest-words")), "manifest-directory")
    rows = leaves.withColumn("word", word_of("doc_id")).join(directory, ["key", "word"])
    single = F.col("n") == F.bit_count("bits")
    low = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")))
    columns = [*[c for c in leaves.columns if c != "row"], "idx", "size"]
    alone = rows.where(single).withColumn("idx", F.col("before") + F.bit_count(F.col("bits").bitwiseAND(low))).select(*columns)
    if directory.where(~single).isEmpty():
        return alone
    # Words in which an id is repeated: their rows are put in order by id and leaf.
    crowd = sorted_places(rows.where(~single), "key", "word", "doc_id", "digest", "row")
    first = crowd.groupBy("key", "word").agg(F.min("position").alias("first"))
    crowd = crowd.join(first, ["key", "word"]).withColumn("idx", F.col("before") + F.col("position") - F.col("first"))
    return alone.unionByName(crowd.select(*columns))


# ---- hashing in a task ----


def node(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def levels_of(nodes: list[bytes], size: int) -> list[list[bytes]]:
    """The nodes of a slot array and the levels above them: eight, or as many
    as lead to one node where the array is all of its group."""
    levels = [nodes]
    for _ in range(SLOT_BITS if size > WIDTH else (size - 1).bit_length()):
        row = levels[-1]
        levels.append([node(b"".join(row[i:i + 2])) for i in range(0, len(row), 2)])
    return levels


def steps_of(levels: list[list[bytes]], slot: int) -> list[tuple[bytes, bytes]]:
    """Side (L, R or none) and digest of the sibling at each level."""
    out = []
    for row in levels[:-1]:
        other = slot ^ 1
        out.append((b"-", b"") if other >= len(row) else (b"L" if slot & 1 else b"R", row[other]))
        slot >>= 1
    return out


def fold(start: bytes, steps) -> bytes:
    for side, sibling in steps:
        start = node(sibling + start if side == b"L" else start + sibling)
    return start


def packed(steps) -> bytes:
    return b"".join(side + (sibling or b"-" * 64) for side, sibling in steps)


def unpacked(path: bytes) -> list[tuple[bytes, bytes]]:
    return [(path[i:i + 1], b"" if path[i:i + 1] == b"-" else path[i + 1:i + 65]) for i in range(0, len(path), 65)]


def arrays(batch: pa.RecordBatch):
    """For each row of the batch: its number, its nodes by slot, and the places
    of their entries in the batch's flat list."""
    items = batch.column("items")
    flat = items.values
    slots, digests = flat.field("slot").to_pylist(), flat.field("digest").to_pylist()
    offsets = items.offsets.to_pylist()
    for i in range(batch.num_rows):
        at = [0] * (offsets[i + 1] - offsets[i])
        for j in range(offsets[i], offsets[i + 1]):
            at[slots[j]] = j
        yield i, [digests[j].hex().encode() for j in at], at


# ---- rounds ----


def reduced(nodes: DataFrame) -> DataFrame:
    """Nodes (key, idx, size, digest and others) as slot arrays: key, block,
    size, items, top (the array's node)."""
    others = [c for c in nodes.columns if c not in ("key", "idx", "size")]
    slot = F.col("idx").bitwiseAND(F.lit(WIDTH - 1)).cast("int")
    grouped = nodes.groupBy("key", F.shiftright("idx", SLOT_BITS).alias("block")).agg(
        F.first("size").alias("size"), F.collect_list(F.struct(slot.alias("slot"), *others)).alias("items"))

    def run(batches):
        for b in batches:
            sizes = b.column("size").to_pylist()
            tops = [bytes.fromhex(levels_of(nodes, sizes[i])[-1][0].decode()) for i, nodes, _ in arrays(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tops, pa.binary())], names=[*b.schema.names, "top"])

    return grouped.mapInArrow(run, T.StructType([*grouped.schema.fields, T.StructField("top", T.BinaryType())]))


def build(nodes: DataFrame) -> list[DataFrame]:
    """The stored rounds of slot arrays, up to one array a key."""
    rounds = []
    while True:
        rounds.append(stored(reduced(nodes), "manifest-round"))
        largest = rounds[-1].agg(F.max("size")).first()[0]
        if largest is None or largest <= WIDTH:
            return rounds
        nodes = rounds[-1].select("key", F.col("block").alias("idx"),
                                  F.floor((F.col("size") + (WIDTH - 1)) / F.lit(WIDTH)).alias("size"), F.col("top").alias("digest"))


def paths_of(arrays_with_path: DataFrame) -> DataFrame:
    """key, idx, path of the nodes of slot arrays (key, block, size, items,
    path): the packed siblings from the node up to the root."""

    def run(batches):
        for b in batches:
            keys, blocks, sizes, above = (b.column(c).to_pylist() for c in ("key", "block", "size", "path"))
            out = [(keys[i], blocks[i] * WIDTH + s, packed(steps_of(levels, s)) + above[i])
                   for i, nodes, _ in arrays(b) for levels in [levels_of(nodes, sizes[i])] for s in range(len(nodes))]
            cols = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary()), strict=True)],
                                             names=["key", "idx", "path"])

    return arrays_with_path.mapInArrow(run, "key string, idx bigint, path binary")


def descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """key, block, path of the lowest round's arrays, from the path of each
    key's last array (key, path)."""
    above = top.select("key", F.lit(0).cast("bigint").alias("block"), "path")
    for level in reversed(rounds[1:]):
        below = paths_of(level.join(above, ["key", "block"]).select("key", "block", "size", "items", "path"))
        above = stored(below.withColumnRenamed("idx", "block"), "manifest-paths")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for
    every row of ``docs``."""
    leaves = stored(leaves_of(docs).withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")
    rounds = build(placed(leaves.drop("lang")))
    tops = rounds[-1].select("key", F.col("top").alias("digest"))
    langs = leaves.groupBy("key").agg(F.first("lang", ignorenulls=True).alias("lang"))
    groups = sorted_places(tops.join(langs, "key"), "lang")
    groups = stored(groups, "manifest-groups")
    n = groups.count()
    upper = build(groups.select(F.lit("").alias("key"), F.col("position").alias("idx"), F.lit(n).cast("bigint").alias("size"),
                                "digest", F.col("key").alias("group")))
    got = upper[-1].select(F.hex("top")).first()
    root = (got[0] if got else "").lower()
    of_root = docs.sparkSession.createDataFrame([("", b"")], "key string, path binary")
    group_paths = paths_of(upper[0].join(descend(upper, of_root), ["key", "block"]).select("key", "block", "size", "items", "path"))
    top_paths = groups.join(group_paths.select(F.col("idx").alias("position"), "path"), "position").select(
        "key", "path", F.lower(F.hex("digest")).alias("subroot"))
    top_paths = stored(top_paths, "manifest-tops")
    lowest = rounds[0].join(descend(rounds, top_paths), ["key", "block"]).join(top_paths.select("key", "subroot"), "key")

    def run(batches):
        for b in (whole.slice(i, 64) for whole in batches for i in range(0, whole.num_rows, 64)):
            sizes, above, subroots = (b.column(c).to_pylist() for c in ("size", "path", "subroot"))
            flat = b.column("items").values
            ids, tampered = flat.field("doc_id").to_pylist(), flat.field("tampered").to_pylist()
            out = []
            for i, nodes, at in arrays(b):
                levels, upper_steps = levels_of(nodes, sizes[i]), unpacked(above[i])
                upper_siblings = b"".join(s for _, s in upper_steps)
                for slot, j in enumerate(at):
                    steps = steps_of(levels, slot)
                    proof = hashlib.sha256(b"".join([s for _, s in steps]) + upper_siblings).hexdigest()
                    start = tampered[j].hex().encode() if tampered[j] is not None else nodes[slot]
                    folded = fold(fold(start, steps), upper_steps).decode()
                    out.append((ids[j], nodes[slot].decode(), subroots[i], root, proof, folded, folded == root))
            cols = zip(*out, strict=True) if out else ([],) * 7
            kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return lowest.select("size", "items", "path", "subroot").mapInArrow(
        run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(load(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, lang, n_chars,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(i AS BIGINT) FOR i IN range(8)]),
             lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND xor(crc, 4294967295) % 7 = 0
              THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS tampered
  FROM parts
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size
  FROM leaves
), tree AS (
  SELECT 0 AS lvl, coalesce('=' || lang, '-') AS key, idx, size, leaf AS h FROM numbered
  UNION ALL
  SELECT lvl + 1, key, idx // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE size > 1 GROUP BY lvl, key, idx // 2, size
), tops AS (
  SELECT key, h, row_number() OVER (ORDER BY key <> '-', encode(key)) - 1 AS idx, count(*) OVER () AS size FROM tree WHERE size = 1
), upper_tree AS (
  SELECT 0 AS lvl, idx, size, h FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_tree WHERE size > 1 GROUP BY lvl, idx // 2, size
), steps AS (
  SELECT n.doc_id, n.lang, n.idx, p.lvl, CASE WHEN s.h IS NULL THEN '-' WHEN p.idx % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step
  FROM numbered n
  JOIN tree p ON p.key = coalesce('=' || n.lang, '-') AND p.idx = n.idx >> p.lvl AND p.size > 1
  LEFT JOIN tree s ON s.key = p.key AND s.lvl = p.lvl AND s.idx = xor(p.idx, 1)
), upper_steps AS (
  SELECT t.key, list(CASE WHEN s.h IS NULL THEN '-' WHEN p.idx % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') ORDER BY p.lvl) AS path
  FROM tops t
  JOIN upper_tree p ON p.idx = t.idx >> p.lvl AND p.size > 1
  LEFT JOIN upper_tree s ON s.lvl = p.lvl AND s.idx = xor(p.idx, 1)
  GROUP BY t.key
), lower_steps AS (
  SELECT coalesce('=' || lang, '-') AS key, idx, list(step ORDER BY lvl) AS path FROM steps GROUP BY ALL
), whole AS (
  SELECT n.doc_id, n.leaf, t.h AS subroot, (SELECT h FROM upper_tree WHERE size = 1) AS root, coalesce(n.tampered, n.leaf) AS start,
         list_concat(coalesce(l.path, []), coalesce(u.path, [])) AS path
  FROM numbered n
  JOIN tops t ON t.key = coalesce('=' || n.lang, '-')
  LEFT JOIN lower_steps l ON l.key = t.key AND l.idx = n.idx
  LEFT JOIN upper_steps u ON u.key = t.key
), folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: substr(s, 2)), '')) AS proof_sha256,
         list_reduce(list_prepend(start, path), lambda acc, s: sha256(CASE WHEN s[1] = 'L' THEN substr(s, 2) || acc ELSE acc || substr(s, 2) END)) AS folded_root
  FROM whole
)
SELECT *, folded_root = root AS verified FROM folded
"""
