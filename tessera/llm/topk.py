"""Exact top-k search by inner product with a pivot table.

Vectors are turned into integers.  The angle between two vectors is a metric,
so for a query q, a candidate x and a pivot p ``|angle(q,p) - angle(x,p)|`` is
a lower bound of angle(q,x); with the largest bound b over all pivots,
``|q| |x| cos(b)`` is an upper bound of the score.  The angles of all vectors
to the pivots are computed once, when rows are packed into blocks, and stored
with them (the pivot table, two bytes an angle; the rounding is allowed for).

Pivots are spread: each is the row of a bounded sample that is farthest from
those chosen before.  Candidates are taken in the order of their bound, best
first, until the bound of the next is below the k-th best score found so far;
a bound equal to it goes on, so that ties are exact.

Query blocks and groups of candidate blocks form cells, dealt by both numbers;
a cell holds a bounded number of rows, orders all its candidates together and
returns at most k rows a query, which a second, grouped step merges.  No step
gathers all candidates of a query block, and nothing but the pivots is sent to
every task.  The query set meets all rows in blocks; the table is shipped once
for each block of queries.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part; shorter vectors count as padded with zeros; a vector of zeros
has score 0 with all; a repeated vec_id is a row like any other, and a query
leaves out its own row only; ties go to the smaller vec_id; fewer candidates
than k give all of them; an empty table gives no rows.  Components times 256
must fit 31 bits (an error otherwise).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import load, map_lists, pick, small, stored

#: Rows that serve as pivots.
PIVOTS = 256
#: Rows packed into one block, fewer if they have over ``BLOCK_VALUES`` components.
BLOCK_ROWS = 4096
BLOCK_VALUES = 2**18
#: Candidate blocks of one cell.
CELL_BLOCKS = 8
#: Candidates evaluated before the first look at the stopping rule; doubles.
CHUNK = 256
#: One step of a stored angle, and what a bound gives way for its rounding.
STEP = np.pi / 65_535
SLACK = STEP

RESULT = "query_uid bigint, query_id bigint, uid bigint, vec_id bigint, score bigint"
PARTS = ("uids", "ids", "nulls", "data", "angles")


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """uid, vec_id, v: floor(scale * x) of each component as array<bigint>."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    fits = F.forall("v", lambda x: F.abs(x) < 2**31)
    return (pick(vectors, "vec_id", "embedding").where(F.col("embedding").isNotNull() & usable)
            .select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"),
                    scaled.alias("v"))
            .where(F.when(fits, True).otherwise(F.raise_error(F.lit("component beyond 31 bits")).cast("boolean"))))


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` rows of ``sample``, each the farthest (by angle) from those before it."""
    rows = np.unique(sample[(sample != 0).any(axis=1)], axis=0)
    if not len(rows):
        return rows
    unit = rows / np.sqrt((rows.astype(np.float64) ** 2).sum(1))[:, None]
    chosen, nearest = [0], unit @ unit[0]  # cosine to the nearest pivot so far
    while len(chosen) < min(n, len(rows)):
        far = int(np.argmin(nearest))
        chosen.append(far)
        nearest = np.maximum(nearest, unit @ unit[far])
        nearest[far] = np.inf
    return rows[chosen]


def pivot_angles(data: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The angles in steps, one row for each pivot.  A vector of zeros has no angle; any value is right for it."""
    exact, p = data.astype(np.float64), pivots.astype(np.float64)
    norms = np.sqrt((exact * exact).sum(1))
    cos = (p / np.sqrt((p * p).sum(1))[:, None]) @ (exact / np.where(norms > 0, norms, 1.0)[:, None]).T
    return np.rint(np.arccos(np.clip(cos, -1.0, 1.0)) / STEP).astype("<u2")


def _packed(rows: DataFrame, block_rows: int, dim: int, pivots: np.ndarray) -> DataFrame:
    """One row per block: the block's number, its ids, vectors and angles to the pivots as binary."""

    def run(batches):
        uids, ids, vecs = [], [], []

        def frame():
            data = np.zeros((len(vecs), dim), dtype="<i4")
            for i, v in enumerate(vecs):
                data[i, :len(v)] = v
            missing = np.array([x is None for x in ids], dtype=bool)
            plain = np.array([0 if x is None else x for x in ids], dtype="<i8")
            # The smallest uid of a block names it.
            return [(min(uids), np.array(uids, dtype="<i8").tobytes(), plain.tobytes(), missing.tobytes(), data.tobytes(),
                     pivot_angles(data, pivots).tobytes())]

        for b in batches:
            for u, i, v in zip(b["uid"], b["vec_id"], b["v"], strict=True):
                uids.append(u)
                ids.append(i)
                vecs.append(v)
                if len(uids) == block_rows:
                    yield frame()
                    uids, ids, vecs = [], [], []
        if uids:
            yield frame()

    return map_lists(rows.select("uid", "vec_id", "v"), run, "block bigint, " + ", ".join(f"{c} binary" for c in PARTS))


def _unpacked(blocks: pa.Table, dim: int, n_pivots: int):
    """The blocks of a cell as one: ids, nulls, vectors and angles."""
    each = []
    for r in blocks.select(list(PARTS)).to_pylist():
        uids = np.frombuffer(r["uids"], dtype="<i8")
        each.append((uids, np.frombuffer(r["ids"], dtype="<i8"), np.frombuffer(r["nulls"], dtype=bool),
                     np.frombuffer(r["data"], dtype="<i4").reshape(len(uids), dim),
                     np.frombuffer(r["angles"], dtype="<u2").reshape(n_pivots, len(uids))))
    return tuple(np.concatenate(part, axis=1 if i == 4 else 0) for i, part in enumerate(zip(*each, strict=True)))


def search_block(q, x, k: int, chunk: int = CHUNK):
    """The k best candidates of ``x`` for every query of ``q`` (each: uids,
    ids, nulls, vectors, angles), exact: rows (query position, candidate
    position, score), and how many scores were evaluated."""
    (q_uid, _, _, q_data, q_angle), (x_uid, x_id, x_null, x_data, x_angle) = q, x
    norm_q, norm_x = (np.sqrt((d.astype(np.float64) ** 2).sum(1)) for d in (q_data, x_data))
    largest = float(np.abs(q_data.astype(np.int64)).max(initial=0)) * float(np.abs(x_data.astype(np.int64)).max(initial=0))
    number = np.float64 if largest * max(1, q_data.shape[1]) < 2**53 else np.int64  # products of floats are exact below
    xs, angles = x_data.astype(number), x_angle.astype(np.float32)
    out, evaluated = [], 0
    for i in range(len(q_uid)):
        steps = np.zeros(len(x_uid), dtype=np.float32)
        for p in range(len(angles)):
            np.maximum(steps, np.abs(angles[p] - np.float32(q_angle[p, i])), out=steps)
        nearest = np.maximum(steps.astype(np.float64) * STEP - SLACK, 0.0)
        scale = norm_q[i] * norm_x
        bound = scale * np.cos(nearest) + 1e-9 * scale + 1e-3
        order = np.argsort(-bound, kind="stable")
        vec = q_data[i].astype(number)
        best_pos, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at, size = 0, chunk
        while at < len(order) and not (len(best) == k and bound[order[at]] < best[-1]):
            pos = order[at:at + size]
            at, size = at + size, 2 * size
            if len(best) == k:
                pos = pos[bound[pos] >= best[-1]]
            pos = pos[x_uid[pos] != q_uid[i]]
            evaluated += len(pos)
            score = (xs[pos] @ vec).astype(np.int64)
            if len(best) == k:
                pos, score = pos[score >= best[-1]], score[score >= best[-1]]
            pos, score = np.concatenate([best_pos, pos]), np.concatenate([best, score])
            keep = np.lexsort((x_uid[pos], x_id[pos], ~x_null[pos], -score))[:k]
            best_pos, best = pos[keep], score[keep]
        out += [(i, int(j), int(s)) for j, s in zip(best_pos, best, strict=True)]
    return out, evaluated


def top_k(vectors: DataFrame, is_query, k: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id,
    embedding) that the column expression ``is_query`` selects."""
    spark = vectors.sparkSession
    table = stored(quantize(vectors), "topk-vectors")
    stats = table.agg(F.max(F.size("v")), F.count(F.when(is_query, 1))).first()
    dim, n_queries = int(stats[0] or 0), int(stats[1])
    if not n_queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    block_rows = max(1, min(block_rows, BLOCK_VALUES // max(1, dim)))
    # A bounded sample for the pivots: the rows with the smallest hash, one block of them.
    drawn = [r[0] for r in table.orderBy(F.xxhash64("v"), "uid").limit(block_rows).select("v").collect()]
    sample = np.zeros((len(drawn), dim), dtype=np.int64)
    for i, v in enumerate(drawn):
        sample[i, :len(v)] = v
    chosen = spread_pivots(sample, pivots)

    candidates = stored(_packed(table, block_rows, dim, chosen), "topk-candidates")
    # Queries are a few in a hundred rows: gather them into full blocks first.
    n_asked = -(-n_queries // block_rows)
    queries = table.where(is_query).repartition(n_asked, F.xxhash64("uid")).sortWithinPartitions("uid")
    asked = stored(_packed(queries, block_rows, dim, chosen).withColumn("i", F.expr(f"int(pmod(xxhash64(block), {n_asked}))")), "topk-queries")

    # A group of candidates has at most about CELL_BLOCKS blocks, fewer while there are too few cells to keep all cores busy.
    n_blocks, cores = candidates.count(), spark.sparkContext.defaultParallelism
    n_groups = max(1, -(-n_blocks // CELL_BLOCKS), min(n_blocks, -(-2 * cores // n_asked)))
    cells = min(4 * n_asked * n_groups, max(3 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    x = (candidates.withColumn("j", F.expr(f"int(pmod(xxhash64(block), {n_groups}))"))
         .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
         .join(small(asked.select("i").distinct()), "i", "left_semi").repartition(cells, "i", "j"))
    q = asked.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).repartition(cells, "i", "j")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in RESULT.split(", ")]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], type=pa.int64()) for n in names})
        q, x = _unpacked(left, dim, len(chosen)), _unpacked(right, dim, len(chosen))
        found, _ = search_block(q, x, k)
        at = np.array(found, dtype=np.int64).reshape(-1, 3)
        of_q, of_x = at[:, 0], at[:, 1]
        return pa.table([pa.array(q[0][of_q]), pa.array(q[1][of_q], mask=q[2][of_q]), pa.array(x[0][of_x]),
                         pa.array(x[1][of_x], mask=x[2][of_x]), pa.array(at[:, 2])], names=names)

    found = q.groupBy("i", "j").cogroup(x.groupBy("i", "j")).applyInArrow(cell, RESULT)
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("uid"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


#: DuckDB SQL for the query's rows.  The score of every (query, row) pair.
ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.uid AS quid, q.vec_id AS query_id, c.vec_id AS vec_id, c.uid AS cuid,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY quid ORDER BY score DESC, vec_id, cuid) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
