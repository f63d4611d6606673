"""Time-ordered split, preprocessing and the class-balanced logistic model
(B6: M1-M9, P4, P6, P12, S11).

Preprocessing follows the original estimator graph: categorical columns are
imputed with their most frequent training value (ties -> smallest) and
one-hot encoded with unknown levels mapped to all zeros; numeric columns are
imputed with 0 and standardised with the training mean and population
standard deviation (0 -> 1).  The classifier is an L2 logistic regression
with balanced class weights n / (2 n_c).  With weights that sum to n, the
Spark objective (1/n) sum w_i l_i + reg/2 |b|^2 equals the original
C-scaled objective divided by C*n, hence ``regParam = 1 / (C * n_train)``.

Fitted constants (modes, means, scales, weights) are a handful of numbers,
computed by single aggregate jobs; the data never leaves the executors.
The split rows are written as a table under the shared checkpoint folder
before the iterative fit, so a lost executor re-reads it instead of replaying
the whole feature lineage.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.session import materialize

ROWS_PER_FIT_PARTITION = 200_000

# ---------------------------------------------------------------------------
# FIXED VALUES (the original's feature names)
# ---------------------------------------------------------------------------
BASE_CATEGORICAL = ["species", "stateProvince"]
BASE_NUMERIC = [
    "week_of_year",
    "lag_1_obs_count",
    "lag_2_obs_count",
    "lag_3_obs_count",
    "rolling_2wk_mean_obs_count",
    "rolling_3wk_mean_obs_count",
    "rolling_4wk_max_obs_count",
    "week_sin",
    "week_cos",
    "had_recent_activity",
]
# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


def with_split(df: DataFrame, train_end: int, valid: int, test: int, year: str = "year") -> DataFrame:
    """split = train (year <= train_end) / valid / test, NULL otherwise."""
    y = F.col(year)
    return df.withColumn("split", F.when(y <= train_end, "train").when(y == valid, "valid")
                         .when(y == test, "test"))


def split_counts(df: DataFrame, target: str) -> DataFrame:
    """P12 input: rows, positives and positive rate per split in one pass."""
    return (df.where(F.col("split").isNotNull()).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(target).cast("bigint").alias("n_positive"),
                 F.avg(F.col(target).cast("double")).alias("positive_rate")))


def mode_values(train: DataFrame, cols) -> DataFrame:
    """M2: most frequent non-NULL value per column (ties -> smallest), as
    rows (column_name, mode_value).  One grouped count per column."""
    parts = []
    for c in cols:
        top = (train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
               .orderBy(F.desc("_n"), F.asc(c)).limit(1))
        parts.append(top.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("mode_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_weights(train: DataFrame, target: str) -> DataFrame:
    """M7: balanced weights n / (2 n_c) for the classes 0 and 1, as rows
    (label, n_rows, weight); one aggregate job."""
    t = F.col(target).cast("int")
    c = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(t == 0).alias("n0"), F.count_if(t == 1).alias("n1"))
    rows = F.array(*[
        F.struct(F.lit(lab).alias("label"), F.col(nc).alias("n_rows"),
                 F.try_divide(F.col("n").cast("double"), F.lit(2.0) * F.col(nc)).alias("weight"))
        for lab, nc in ((0, "n0"), (1, "n1"))
    ])
    return c.select(F.inline(rows))


def scaler_stats(train: DataFrame, numeric) -> DataFrame:
    """M4/M5: mean and population std of each zero-imputed numeric column,
    std 0 -> scale 1, as rows (feature, mean, scale).  One aggregate job."""
    aggs = []
    for c in numeric:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs += [F.avg(v).alias(f"m__{c}"), F.stddev_pop(v).alias(f"s__{c}")]
    row = train.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m__{c}").alias("mean"),
                 F.when(F.col(f"s__{c}") > 0, F.col(f"s__{c}")).otherwise(F.lit(1.0)).alias("scale"))
        for c in numeric
    ])
    return row.select(F.inline(rows))


def _q(name: str) -> str:
    return f"`{name}`"


def _sql_literal(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def preprocessing_sql(categorical, numeric, modes: dict, stats: dict) -> str:
    """The imputation/scaling step as one SQL projection (kept inside the
    saved pipeline, so scoring applies the training constants)."""
    cols = ["*"]
    for c in categorical:
        m = modes.get(c)
        expr = f"coalesce(CAST({_q(c)} AS STRING), {_sql_literal(m)})" if m is not None else f"CAST({_q(c)} AS STRING)"
        cols.append(f"{expr} AS {_q(c + '__imp')}")
    for c in numeric:
        mean, scale = stats[c]
        cols.append(f"(coalesce(CAST({_q(c)} AS DOUBLE), 0.0) - ({mean!r})) / ({scale!r}) AS {_q(c + '__std')}")
    return "SELECT " + ", ".join(cols) + " FROM __THIS__"


def one_hot_stages(categorical) -> list:
    """M3: levels in alphabetical order; an unknown level is all zeros."""
    return [StringIndexer(inputCols=[c + "__imp" for c in categorical], outputCols=[c + "__idx" for c in categorical],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[c + "__idx" for c in categorical],
                          outputCols=[c + "__oh" for c in categorical], dropLast=True)]


def one_hot(train: DataFrame, df: DataFrame, categorical) -> DataFrame:
    """M2/M3 alone: ``df`` with an array column ``<name>_onehot`` for each
    categorical column, levels and modes taken from ``train``."""
    modes = {r["column_name"]: r["mode_value"] for r in mode_values(train, categorical).collect()}
    stages = [SQLTransformer(statement=preprocessing_sql(categorical, [], modes, {})), *one_hot_stages(categorical)]
    out = Pipeline(stages=stages).fit(train).transform(df)
    return out.select(*df.columns, *[vector_to_array(c + "__oh").alias(c + "_onehot") for c in categorical])


def build_pipeline(categorical, numeric, modes: dict, stats: dict, n_train: int, max_iter: int,
                   label: str = "_label", weight: str = "_weight", C: float = 1.0) -> Pipeline:
    """M3/M6/M8: preprocessing + one-hot + assembler + logistic regression."""
    stages = [SQLTransformer(statement=preprocessing_sql(categorical, numeric, modes, stats))]
    if categorical:
        stages += one_hot_stages(categorical)
    stages.append(VectorAssembler(inputCols=[c + "__oh" for c in categorical] + [c + "__std" for c in numeric],
                                  outputCol="_features"))
    stages.append(LogisticRegression(featuresCol="_features", labelCol=label, weightCol=weight,
                                     regParam=1.0 / (C * n_train), elasticNetParam=0.0,
                                     standardization=False, fitIntercept=True, maxIter=max_iter, tol=1e-6))
    return Pipeline(stages=stages)


def fitted_constants(s: DataFrame, target: str, categorical, numeric):
    """Everything the fit needs from the data in two passes over the split
    frame: (1) one aggregate with the split sizes, the training class counts
    and the mean / population std of every zero-imputed numeric column;
    (2) one GROUPING SETS count giving each categorical column's most
    frequent training value (ties -> smallest)."""
    is_train = F.col("split") == "train"
    t = F.col(target).cast("int")
    aggs = [F.count_if(F.col("split") == x).alias(f"n_{x}") for x in ("train", "valid", "test")]
    aggs += [F.count_if(is_train & (t == 0)).alias("c0"), F.count_if(is_train & (t == 1)).alias("c1")]
    for c in numeric:
        v = F.when(is_train, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        aggs += [F.avg(v).alias(f"m__{c}"), F.stddev_pop(v).alias(f"s__{c}")]
    row = s.agg(*aggs).first()
    sizes = {x: row[f"n_{x}"] for x in ("train", "valid", "test")}
    if any(v == 0 for v in sizes.values()):
        raise ValueError(f"One of the splits is empty: {sizes}")
    n = sizes["train"]
    weights = {lab: n / (2.0 * row[c]) for lab, c in ((0, "c0"), (1, "c1")) if row[c]}
    stats = {c: (row[f"m__{c}"], row[f"s__{c}"] if row[f"s__{c}"] else 1.0) for c in numeric}
    modes = {c: None for c in categorical}
    if categorical:
        train = s.where(is_train)
        counted = (train.groupingSets([[c] for c in categorical], *categorical)
                   .agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_n")))
        value = F.coalesce(*[F.col(c).cast("string") for c in categorical])
        which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in categorical])
        ranked = counted.where(value.isNotNull()).select(
            which.alias("_col"), value.alias("_val"), "_n",
            F.row_number().over(Window.partitionBy("_gid").orderBy(F.desc("_n"), F.asc(value))).alias("_rk"))
        for r in ranked.where(F.col("_rk") == 1).collect():
            modes[r["_col"]] = r["_val"]
    return sizes, weights, stats, modes


def fit_presence_model(df: DataFrame, target: str, train_end: int, valid: int, test: int,
                       categorical=None, numeric=None, max_iter: int = 2000):
    """Split, guard, fit.  Returns (PipelineModel, split frame)."""
    categorical = list(BASE_CATEGORICAL if categorical is None else categorical)
    numeric = list(BASE_NUMERIC if numeric is None else numeric)
    s = materialize(with_split(df, train_end, valid, test), "model-rows")
    sizes, weights, stats, modes = fitted_constants(s, target, categorical, numeric)
    if len(weights) < 2:
        raise ValueError("the training split holds a single class")
    train = s.where(F.col("split") == "train")
    w = F.lit(0.0)
    for lab, wt in weights.items():
        w = F.when(F.col(target).cast("int") == lab, F.lit(float(wt))).otherwise(w)
    # Every solver iteration is a job over these partitions: size them by rows.
    parts = max(1, math.ceil(sizes["train"] / ROWS_PER_FIT_PARTITION))
    fit_input = train.select(*categorical, *numeric, F.col(target).cast("double").alias("_label"),
                             w.alias("_weight")).repartition(parts)
    # Fit the preprocessing stages, keep the assembled vectors in memory for the
    # solver's passes, then fit the classifier alone on them.
    stages = build_pipeline(categorical, numeric, modes, stats, sizes["train"], max_iter).getStages()
    prefix = Pipeline(stages=stages[:-1]).fit(fit_input)
    vectors = (prefix.transform(fit_input).select("_features", "_label", "_weight")
               .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        classifier = stages[-1].fit(vectors)
    finally:
        vectors.unpersist()
    return PipelineModel(stages=[*prefix.stages, classifier]), s


def score(model: PipelineModel, df: DataFrame, keep=None) -> DataFrame:
    """M9: predicted class and probability of class 1."""
    out = model.transform(df)
    cols = list(df.columns) if keep is None else list(keep)
    return out.select(*cols, F.col("prediction").cast("int").alias("y_pred"),
                      vector_to_array("probability")[1].alias("y_proba"))


def save_model(model: PipelineModel, path: str) -> None:
    """S11."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_names(model: PipelineModel, categorical, numeric) -> list[str]:
    """Names of the assembled features: ``column=level``, then the numeric ones."""
    indexer = next((st for st in model.stages if isinstance(st, StringIndexerModel)), None)
    levels = indexer.labelsArray if indexer else []
    return [f"{c}={v}" for c, own in zip(categorical, levels, strict=True) for v in own] + list(numeric)


def objective_gradient(model: PipelineModel, split: DataFrame, target: str, categorical, numeric) -> DataFrame:
    """Rows (feature, gradient): the gradient of the penalised, class-weighted
    objective at the fitted coefficients over the training rows.  It is 0 at
    the optimum.  One aggregate, pre-summed by feature in every task."""
    train = split.where(F.col("split") == "train")
    weights = {r["label"]: r["weight"] for r in class_weights(train, target).collect()}
    y = F.col(target).cast("double")
    w = F.when(y == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    fitted = model.stages[-1]
    names = [*feature_names(model, categorical, numeric), "intercept"]
    penalty = [float(b) * fitted.getRegParam() for b in fitted.coefficients.toArray()] + [0.0]
    own = split.sparkSession.createDataFrame(
        [(i, n, p) for i, (n, p) in enumerate(zip(names, penalty, strict=True))], "_at int, feature string, _penalty double")
    rows = model.transform(train).select(
        F.posexplode(F.concat(vector_to_array("_features"), F.array(F.lit(1.0)))).alias("_at", "_x"),
        (w * (vector_to_array("probability")[1] - y)).alias("_r"), w.alias("_w"))
    g = rows.groupBy("_at").agg((F.sum(F.col("_x") * F.col("_r")) / F.sum("_w")).alias("_g"))
    return g.join(F.broadcast(own), "_at").select("feature", (F.col("_g") + F.col("_penalty")).alias("gradient"))


def evaluate(model: PipelineModel, split: DataFrame, target: str, levels=((), ("stateProvince",), ("species",)),
             splits=("valid", "test")) -> DataFrame:
    """Metrics of a (loaded) model on the validation and test rows: one row
    per split, level ('overall' or the grouping column) and key."""
    scored = materialize(score(model, split.where(F.col("split").isin(*splits)), keep=[
        "split", *sorted({c for by in levels for c in by}), target]).withColumnRenamed(target, "y_true"), "scored")
    out = None
    for by in levels:
        m = metrics.grouped_metrics(scored, ["split", *by])
        key = F.concat_ws("/", *by) if by else F.lit("all")
        m = m.select("split", F.lit("/".join(by) or "overall").alias("level"), key.alias("key"),
                     *[c for c in m.columns if c not in ("split", *by)])
        out = m if out is None else out.unionByName(m)
    return out
