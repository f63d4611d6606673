"""Mixing sources to target weights by temperature.

A source with token share p gets the weight ``p**t / sum(p**t)``.  The
exponent t is the largest in [0, 1] found by bisection at which the weights
reach the target entropy; it is raised again as far as needed so that no
source is repeated more often than allowed.  t = 1 keeps the shares, t = 0
makes all sources equal.

The weights are realised under a token budget as block permutations: epoch e
of a source is a block that holds each of its documents once, in an order
fixed by a hash of (seed, source, epoch, document).  Whole epochs are taken
first; of the last block the documents up to the budget, in block order: a
document is taken if the tokens before it are below what is left.

Everything is DataFrame and SQL functions.  The last block needs running sums
inside a source.  They are taken in two levels, over hash buckets and then
inside the one bucket in which the budget ends, so a source with most rows is
never sorted in one task; bucket widths shrink as the source grows.

Defined cases: a null source is the source ``""``; a null or wordless text has
0 tokens and is taken in each whole epoch and wherever its place comes before
the budget's end; sources without tokens have weight 0 and are left out; ties
of the hash go to the smaller document id; repeated rows are separate
documents; one source gets weight 1; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import load, pick, small, stored

#: The target: this share of the entropy that equal weights would have.
ENTROPY_SHARE = 0.99
#: The most times a source may be repeated.
MAX_EPOCHS = 2.0
#: The budget is this many times the tokens of all sources.
BUDGET = 1.0
BISECTIONS = 50
SEED = "mix-1"
#: Rows that a bucket of a source's block should hold.
BUCKET_ROWS = 10_000

WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def entropy(shares: Column, t: Column) -> Column:
    """Entropy (nats) of the weights at exponent t; ``shares`` is an array."""
    powers = F.transform(shares, lambda p: F.pow(p, t))
    z = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.log(z) - F.aggregate(powers, F.lit(0.0), lambda a, x: a + x * F.log(x)) / z


def repeats(shares: Column, t: Column, budget: float) -> Column:
    """Epochs of the source that is repeated most."""
    z = F.aggregate(F.transform(shares, lambda p: F.pow(p, t)), F.lit(0.0), lambda a, x: a + x)
    return F.lit(budget) * F.array_max(F.transform(shares, lambda p: F.pow(p, t - 1))) / z


def _bisect(low: Column, ok) -> Column:
    """The end of [low, 1] up to which moving from low keeps ``ok`` true."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(BISECTIONS)), F.struct(low.alias("lo"), F.lit(1.0).alias("hi")),
        lambda s, _: F.when(ok((s["lo"] + s["hi"]) / 2), F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))))
    return step["lo"]


def source_weights(counted: DataFrame, entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS,
                   budget: float | None = BUDGET) -> DataFrame:
    """source, tokens, n_docs, share, exponent, weight, budget_tokens.

    ``counted`` has source and n_tokens.  ``budget`` None: the budget at which
    the source that is repeated least is taken exactly once, so that no
    document is lost."""
    per = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    # One row: as many array entries as there are sources, far below any row count.
    one = per.where("tokens > 0").agg(F.sort_array(F.collect_list(F.struct("source", "tokens", "n_docs"))).alias("s"))
    one = one.withColumn("total", F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))
    one = one.withColumn("p", F.transform("s", lambda x: x["tokens"].cast("double") / F.col("total")))
    p = F.col("p")
    goal = F.lit(entropy_share) * F.log(F.size("s").cast("double"))
    # Entropy falls with t, and so do repeats: the first wants t small, the second large.
    one = one.withColumn("t_entropy", F.when(entropy(p, F.lit(1.0)) >= goal, 1.0)
                         .otherwise(_bisect(F.lit(0.0), lambda t: entropy(p, t) >= goal)))
    if budget is None:
        over = lambda t: F.array_max(F.transform(p, lambda x: F.pow(x, t - 1))) / F.array_min(
            F.transform(p, lambda x: F.pow(x, t - 1))) > max_epochs
    else:
        over = lambda t: repeats(p, t, budget) > max_epochs
    one = one.withColumn("t", F.when(~over(F.col("t_entropy")), F.col("t_entropy"))
                         .otherwise(_bisect(F.col("t_entropy"), over)))
    one = one.withColumn("z", F.aggregate(F.transform(p, lambda x: F.pow(x, F.col("t"))), F.lit(0.0), lambda a, x: a + x))
    if budget is None:
        scale = F.col("z") / F.array_min(F.transform(p, lambda x: F.pow(x, F.col("t") - 1)))
    else:
        scale = F.lit(float(budget))
    one = one.withColumn("budget", scale * F.col("total"))
    row = one.select(F.explode(F.arrays_zip("s", "p")).alias("x"), "t", "z", "budget", "total")
    weight = F.pow(F.col("x.p"), F.col("t")) / F.col("z")
    return row.select(F.col("x.s.source").alias("source"), F.col("x.s.tokens").alias("tokens"),
                      F.col("x.s.n_docs").alias("n_docs"), F.col("x.p").alias("share"), F.col("t").alias("exponent"),
                      weight.alias("weight"),
                      F.round(weight * F.col("budget")).cast("bigint").alias("budget_tokens"))


def mix_key(source: Column, epoch: Column, doc: Column) -> Column:
    """The place of a document in its source's block: 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(SEED), source, epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))))


def mix(counted: DataFrame, weights: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``counted`` (source, doc_id, n_tokens and any others) as
    often as they are taken, with epoch (from 0) and mix_key."""
    plan = weights.where("budget_tokens > 0").select(
        "source", F.expr("budget_tokens div tokens").alias("whole"), F.expr("budget_tokens % tokens").alias("rest"),
        # Buckets: the leading bits of the key, as many as the source's rows need (at most 32).
        F.least(F.lit(32), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n_docs") / F.lit(bucket_rows))))).cast("int").alias("bits"))
    rows = counted.join(small(plan), "source")
    full = (rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)))
            .withColumn("mix_key", mix_key(F.col("source"), F.col("epoch"), F.col("doc_id"))))
    last = (rows.where("rest > 0").withColumn("epoch", F.col("whole"))
            .withColumn("mix_key", mix_key(F.col("source"), F.col("epoch"), F.col("doc_id"))))
    last = last.withColumn("bucket", F.expr(
        "shiftrightunsigned(cast(conv(substring(mix_key, 1, 8), 16, 10) as bigint), 32 - bits)"))
    sums = last.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    w = Window.partitionBy("source").orderBy("bucket")
    before = small(stored(sums.select("source", "bucket", "in_bucket",
                                      (F.sum("in_bucket").over(w) - F.col("in_bucket")).alias("before")), "mix-buckets"))
    last = last.join(before, ["source", "bucket"]).where("before < rest")
    inside = F.col("before") + F.col("in_bucket") <= F.col("rest")
    taken = last.where(inside)
    # At most one bucket of each source holds the budget's end.
    order = Window.partitionBy("source", "bucket").orderBy("mix_key", "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    edge = (last.where(~inside).withColumn("upto", F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens"))
            .where("upto < rest"))
    cols = [*counted.columns, "epoch", "mix_key"]
    return full.select(cols).unionByName(taken.select(cols)).unionByName(edge.select(cols))


def count_tokens(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, source ("" if null), n_tokens and the other named columns."""
    return pick(docs, "doc_id", "source", "text", *[c for c in others if c not in ("doc_id", "source", "text")]).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), token_count(F.col("text")).alias("n_tokens"),
        *[c for c in others if c not in ("doc_id", "source")])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored(count_tokens(load(spark, sf_dir, "documents")), "mix-counts")
    weights = stored(source_weights(counted), "mix-weights")
    taken = mix(counted, weights)
    return taken.join(small(weights.select("source", "weight")), "source").select(
        "doc_id", "source", "epoch", "n_tokens", "mix_key", F.round("weight", 6).alias("weight"))


#: DuckDB SQL for the query's rows.
ORACLE_SQL = rf"""
WITH RECURSIVE counted AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents
), per AS (
  SELECT source, sum(n_tokens) AS tokens FROM counted GROUP BY source HAVING sum(n_tokens) > 0
), p AS MATERIALIZED (
  SELECT source, CAST(tokens AS BIGINT) AS tokens, CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM per) AS share FROM per
), goal AS (
  SELECT {ENTROPY_SHARE} * ln(count(*)) AS g, list(share ORDER BY source) AS ps FROM p
), search AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
           ln(list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))))
           - list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) * ln(pow(x, (lo + hi) / 2))))
             / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) >= g AS ok
    FROM search, goal) WHERE i < {BISECTIONS}
), entropy_t AS (
  SELECT CASE WHEN -list_sum(list_transform(ps, lambda x: x * ln(x))) >= g THEN 1.0
         ELSE (SELECT lo FROM search WHERE i = {BISECTIONS}) END AS t FROM goal
), search2 AS (
  SELECT 0 AS i, (SELECT t FROM entropy_t) AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
           {BUDGET} * list_max(list_transform(ps, lambda x: pow(x, (lo + hi) / 2 - 1)))
           / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) > {MAX_EPOCHS} AS over
    FROM search2, goal) WHERE i < {BISECTIONS}
), final_t AS (
  SELECT CASE WHEN {BUDGET} * list_max(list_transform(ps, lambda x: pow(x, t - 1)))
                   / list_sum(list_transform(ps, lambda x: pow(x, t))) <= {MAX_EPOCHS} THEN t
         ELSE (SELECT lo FROM search2 WHERE i = {BISECTIONS}) END AS t FROM goal, entropy_t
), w AS MATERIALIZED (
  SELECT source, tokens, pow(share, t) / (SELECT sum(pow(share, t)) FROM p, final_t) AS weight FROM p, final_t
), plan AS MATERIALIZED (
  SELECT source, weight, CAST(round(weight * {BUDGET} * (SELECT sum(tokens) FROM per)) AS BIGINT) // tokens AS whole,
         CAST(round(weight * {BUDGET} * (SELECT sum(tokens) FROM per)) AS BIGINT) % tokens AS rest FROM w
), epochs AS (
  SELECT c.*, plan.weight, plan.whole, plan.rest, e.epoch,
         md5(concat_ws('|', '{SEED}', c.source, CAST(e.epoch AS VARCHAR), coalesce(CAST(c.doc_id AS VARCHAR), ''))) AS mix_key
  FROM counted c JOIN plan USING (source) JOIN (SELECT range AS epoch FROM range(0, 1000)) e ON e.epoch <= plan.whole
), placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY mix_key, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS upto
  FROM epochs
)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, n_tokens, mix_key, round(weight, 6) AS weight
FROM placed WHERE epoch < whole OR (rest > 0 AND upto < rest)
"""
