"""Logistic model vs a NumPy Newton solve of the same weighted, L2-penalised
objective; one-hot of an unknown category; split guard."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import model


def make_frame(seed=0, n=800):
    rng = np.random.default_rng(seed)
    cat = rng.choice(["p", "q", "r"], n)
    x1 = rng.normal(size=n)
    x2 = rng.integers(0, 5, n).astype(float)
    logit = 0.8 * x1 - 0.3 * x2 + (cat == "q") * 0.7
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    y[:10] = 1  # unbalanced classes -> weights differ
    year = np.where(np.arange(n) < 600, 2000, np.where(np.arange(n) < 700, 2001, 2002))
    return pd.DataFrame({"cat": cat, "x1": x1, "x2": x2, "y": y, "year": year})


def newton_fit(X, y, w, lam):
    beta = np.zeros(X.shape[1] + 1)
    Xb = np.hstack([X, np.ones((len(X), 1))])
    P = np.eye(len(beta)) * lam
    P[-1, -1] = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-Xb @ beta))
        g = Xb.T @ (w * (p - y)) + P @ beta
        H = Xb.T @ (Xb * (w * p * (1 - p))[:, None]) + P
        step = np.linalg.solve(H, g)
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def test_lr_matches_newton(spark):
    pdf = make_frame()
    fitted, _ = model.fit_presence_model(spark.createDataFrame(pdf), "y", 2000, 2001, 2002,
                                         categorical=["cat"], numeric=["x1", "x2"], max_iter=500)
    tr = pdf[pdf.year <= 2000]
    n, n1 = len(tr), tr.y.sum()
    w = np.where(tr.y == 1, n / (2 * n1), n / (2 * (n - n1)))
    Z = tr[["x1", "x2"]].values
    Z = (Z - Z.mean(0)) / Z.std(0)
    X = np.hstack([pd.get_dummies(tr.cat).astype(float)[["p", "q", "r"]].values, Z])
    beta = newton_fit(X, tr.y.values.astype(float), w, 1.0)  # C = 1
    lr = fitted.stages[-1]
    got = np.append(lr.coefficients.toArray(), lr.intercept)
    assert np.allclose(got, beta, atol=1e-4), (got, beta)


def test_unknown_category_scores_like_all_zero(spark):
    pdf = make_frame(seed=1)
    fitted, _ = model.fit_presence_model(spark.createDataFrame(pdf), "y", 2000, 2001, 2002,
                                         categorical=["cat"], numeric=["x1", "x2"], max_iter=200)
    lr = fitted.stages[-1]
    test = spark.createDataFrame([("zzz", 0.5, 1.0, 0, 2002)], "cat string, x1 double, x2 double, y int, year int")
    p = model.score(fitted, test).first().y_proba
    # the unknown level contributes nothing: only numerics + intercept remain
    coef = lr.coefficients.toArray()
    tr = pdf[pdf.year <= 2000][["x1", "x2"]].values
    z = (np.array([0.5, 1.0]) - tr.mean(0)) / tr.std(0)
    want = 1 / (1 + np.exp(-(coef[3:] @ z + lr.intercept)))
    assert abs(p - want) < 1e-9


def test_empty_split_raises(spark):
    pdf = make_frame(seed=2)
    pdf = pdf[pdf.year != 2001]
    with pytest.raises(ValueError, match="empty"):
        model.fit_presence_model(spark.createDataFrame(pdf), "y", 2000, 2001, 2002, categorical=["cat"],
                                 numeric=["x1"], max_iter=10)


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "c string")
    assert model.mode_values(df, ["c"]).first().mode_value == "a"


def test_save_load_same_scores(spark):
    from tessera.session import scratch_path
    pdf = make_frame(seed=3)
    df = spark.createDataFrame(pdf)
    fitted, _ = model.fit_presence_model(df, "y", 2000, 2001, 2002, categorical=["cat"], numeric=["x1", "x2"],
                                         max_iter=100)
    path = scratch_path(spark, "model-test")
    model.save_model(fitted, path)
    a = model.score(fitted, df).select("y_proba").collect()
    b = model.score(model.load_model(path), df).select("y_proba").collect()
    assert a == b


def test_fitted_constants_match_separate_jobs(spark):
    pdf = make_frame(seed=4)
    s = model.with_split(spark.createDataFrame(pdf), 2000, 2001, 2002)
    sizes, weights, stats, modes = model.fitted_constants(s, "y", ["cat"], ["x1", "x2"])
    train = s.where("split = 'train'")
    assert sizes == {r.split: r.n_rows for r in model.split_counts(s, "y").collect()}
    assert weights == {r.label: r.weight for r in model.class_weights(train, "y").collect()}
    for r in model.scaler_stats(train, ["x1", "x2"]).collect():
        assert abs(stats[r.feature][0] - r.mean) < 1e-12 and abs(stats[r.feature][1] - r.scale) < 1e-12
    assert modes == {r.column_name: r.mode_value for r in model.mode_values(train, ["cat"]).collect()}


def test_unknown_entity_raises_when_strict(spark):
    from tessera.dims import species_dim
    from tessera.operators import score
    feats = spark.createDataFrame([("Georgia", "Yellow Warbler"), ("Georgia", "Dodo")], "state string, comName string")
    with pytest.raises(Exception, match="Unsupported entity: Dodo"):
        score.to_model_features(feats, species_dim(spark)).collect()
    lax = score.to_model_features(feats, species_dim(spark), strict=False).collect()
    assert {r.comName: r.species for r in lax} == {"Yellow Warbler": "Setophaga petechia", "Dodo": None}


def test_gradient_vanishes_at_the_fit_only(spark):
    pdf = make_frame(seed=5)
    fitted, split = model.fit_presence_model(spark.createDataFrame(pdf), "y", 2000, 2001, 2002,
                                             categorical=["cat"], numeric=["x1", "x2"], max_iter=500)
    got = {r.feature: r.gradient for r in model.objective_gradient(fitted, split, "y", ["cat"], ["x1", "x2"]).collect()}
    assert set(got) == {"cat=p", "cat=q", "cat=r", "x1", "x2", "intercept"}
    assert max(abs(g) for g in got.values()) < 5e-4
    poor, split = model.fit_presence_model(spark.createDataFrame(pdf), "y", 2000, 2001, 2002,
                                           categorical=["cat"], numeric=["x1", "x2"], max_iter=1)
    got = [r.gradient for r in model.objective_gradient(poor, split, "y", ["cat"], ["x1", "x2"]).collect()]
    assert max(abs(g) for g in got) > 1e-2


def test_evaluate_counts_validation_and_test_rows(spark):
    pdf = make_frame(seed=6)
    fitted, split = model.fit_presence_model(spark.createDataFrame(pdf), "y", 2000, 2001, 2002,
                                             categorical=["cat"], numeric=["x1", "x2"], max_iter=100)
    rows = {(r.split, r.level, r.key): r for r in model.evaluate(fitted, split, "y", levels=((), ("cat",))).collect()}
    scored = model.score(fitted, split, keep=["split", "cat", "y"]).toPandas()
    assert len(rows) == 8
    for (part, level, key), r in rows.items():
        own = scored[(scored.split == part) & ((scored.cat == key) | (level == "overall"))]
        assert r.n_rows == len(own) and abs(r.accuracy - (own.y == own.y_pred).mean()) < 1e-12
        pos, neg = own[own.y == 1].y_proba.values, own[own.y == 0].y_proba.values
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert abs(r.roc_auc - wins / (len(pos) * len(neg))) < 1e-9


def test_one_hot_of_unknown_and_missing_values(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    got = {r.c: r.c_onehot for r in model.one_hot(train, df, ["c"]).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 1.0], "z": [0.0, 0.0], None: [0.0, 1.0]}
