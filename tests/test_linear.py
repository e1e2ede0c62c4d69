import numpy as np
import pandas as pd
import pytest

from survspark.operators import linear

X = ["a", "b"]


def _data(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [3.0, 100.0] + [5.0, 1000.0]
    y = 2.0 * x[:, 0] - 0.03 * x[:, 1] + rng.normal(size=n)
    return pd.DataFrame({"id": np.arange(n), "fold": np.arange(n) % 4, "a": x[:, 0], "b": x[:, 1], "y": y, "z": (y + 20 + rng.normal(size=n) * 5 > 0).astype(int),
                         "w": rng.integers(1, 4, n).astype(float)})


@pytest.mark.parametrize("l2,weight", [(0.0, None), (7.5, None), (3.0, "w")])
def test_linear_and_ridge_equal_normal_equations(spark, l2, weight):
    pdf = _data()
    df = spark.createDataFrame(pdf)
    fit = linear.fit_linear_folds(df, X, "y", l2=l2, weight=weight)
    for f, m in fit["models"].items():
        s = pdf[pdf.fold != f]
        w = s[weight].to_numpy() if weight else np.ones(len(s))
        mean = np.average(s[X], axis=0, weights=w)
        c = s[X].to_numpy() - mean
        coef = np.linalg.solve((c * w[:, None]).T @ c + l2 * np.eye(2), (c * w[:, None]).T @ (s.y - np.average(s.y, weights=w)))
        assert np.allclose(m["coef"], coef, rtol=1e-9) and np.isclose(m["intercept"], np.average(s.y, weights=w) - coef @ mean, rtol=1e-9)
    got = {r.id: r.prediction for r in linear.predict_folds_linear(df, fit).collect()}
    for r in pdf.head(20).itertuples():
        m = fit["models"][r.fold]
        assert np.isclose(got[r.id], m["intercept"] + m["coef"][0] * r.a + m["coef"][1] * r.b)


@pytest.mark.parametrize("l2,weight", [(0.0, None), (1.0, "w")])
def test_logistic_gradient_is_zero(spark, l2, weight):
    pdf = _data(seed=1)
    fit = linear.fit_logistic_folds(spark.createDataFrame(pdf), X, "z", l2=l2, weight=weight)
    assert len(fit["models"]) == 4
    for f, m in fit["models"].items():
        s = pdf[pdf.fold != f]
        x = np.column_stack([np.ones(len(s)), s[X].to_numpy()])
        b = np.array([m["intercept"], *m["coef"]])
        w = s[weight].to_numpy() if weight else 1.0
        g = x.T @ (w * (1 / (1 + np.exp(-x @ b)) - s.z.to_numpy())) + l2 * np.array([0.0, *m["coef"]])
        assert m["converged"] and np.abs(g / [1, 5, 1000]).max() < 1e-6


def test_missing_values_null_folds_and_dependent_features(spark):
    pdf = _data(seed=2)
    rows = [tuple(x.item() for x in r) for r in pdf[["id", "fold", "a", "b", "y"]].to_records(index=False)]
    rows += [(900, 1, None, 1.0, 2.0), (901, None, 1.0, 1.0, 50.0), (902, 2, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, fold int, a double, b double, y double")
    fit = linear.fit_linear_folds(df, X, "y")
    got = {r.id: r.prediction for r in linear.predict_folds_linear(df, fit).collect()}
    assert set(fit["models"]) == {0, 1, 2, 3} and got[900] is None and got[901] is None and got[902] is not None
    with pytest.raises(ValueError, match="dependent"):
        linear.fit_linear_folds(df.withColumn("b", df.a * 3), X, "y")
