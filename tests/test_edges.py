"""Cases at the edge: missing classes, scores, events and scales; large ties; parameters near zero."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from survspark.operators import cox, estimate, folds, gengamma, metrics, parametric, targets
from survspark.session import ensure_checkpoint_dir


@pytest.mark.parametrize("n,d", [(150_000, 150_000), (150_000, 149_999), (200_000, 199_995), (1_000_000, 1), (40, 12), (33, 33), (5, 5), (7, 0)])
def test_tie_sums_equal_term_by_term(spark, n, d):
    df = spark.createDataFrame([(n, d)], "n long, d long")
    r = df.select(estimate.smooth_increment(F.col("n"), F.col("d")).alias("h"), estimate.smooth_variance(F.col("n"), F.col("d")).alias("v")).first()
    k = np.arange(n - d + 1, n + 1, dtype=float)
    assert math.isclose(r.h, math.fsum(1 / k), rel_tol=1e-13, abs_tol=1e-300) and math.isclose(r.v, math.fsum(1 / (k * k)), rel_tol=1e-13, abs_tol=1e-300)


def test_roc_and_auc_with_one_class_and_missing_scores(spark):
    rows = [("a", 1, 0.9), ("a", 1, 0.8), ("a", 0, 0.2), ("a", 0, 0.1), ("a", 1, None), ("a", 0, float("nan")), ("b", 1, 0.3), ("b", 1, 0.4), ("c", 0, 0.5)]
    df = spark.createDataFrame(rows, "grp string, event int, pred double")
    auc = {r.grp: r.roc_auc for r in metrics.auc_table(df, "event", "pred", ["grp"]).collect()}
    assert auc["a"] == 1.0 and auc["b"] is None and auc["c"] is None
    pts = metrics.roc_points(df, by=["grp"]).where("threshold < 1").collect()
    assert all((p.fpr is None) == (p.grp == "b") and (p.tpr is None) == (p.grp == "c") for p in pts)


def test_constant_column_has_no_scale(spark):
    assert [r.x for r in targets.min_max_scale(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()] == [None, None]


@pytest.mark.parametrize("family", ["exponential", "weibull", "loglogistic", "lognormal"])
def test_groups_without_events_have_null_parameters(spark, family):
    rng = np.random.default_rng(1)
    rows = [("a", float(t), int(e)) for t, e in zip(rng.weibull(1.5, 200) * 50 + 1, rng.random(200) < 0.7)] + [("b", float(t), 0) for t in range(1, 6)]
    df = spark.createDataFrame(rows, "grp string, time double, event int")
    got = {r.grp: r.asDict() for r in parametric.fit(df, family, group="grp").collect()}
    names = [c for c in got["a"] if c.endswith("_")]
    assert all(got["b"][c] is None for c in names) and all(got["a"][c] > 0 or c == "mu_" for c in names)
    if family != "exponential":
        assert got["a"]["converged"] and got["b"]["converged"] is None
        grad = parametric.score_equations(df.where("grp = 'a'"), {c: got["a"][c] for c in names}, family)
        assert all(abs(g) < 1e-4 for g in grad.values())


def test_generalised_gamma_is_smooth_through_lambda_zero():
    _, loglik = gengamma._kernel()
    x, none, all_ = np.array([0.0, -1.2, 2.0]), np.zeros(3), np.ones(3)
    at0 = np.exp(loglik(x, none, 0.0, 0.0, 0.0))
    assert abs(at0[0] - 0.5) < 1e-15
    for lam in (1e-8, 1e-6, 1e-4, 1e-3, 3e-3, -1e-4):
        s = np.exp(loglik(x, none, 0.0, 0.0, lam))
        assert np.all(np.abs(s - at0) < 0.4 * abs(lam) + 1e-9) and abs(s[0] - (0.5 - lam / (3 * math.sqrt(2 * math.pi)))) < 1e-6 * abs(lam) + 1e-8
    for lam in (0.5, 0.0101, 0.0099, 1e-4, -0.02):  # the density is the derivative of the survival function
        up, down = (np.exp(loglik(x + h, none, 0.0, 0.0, lam)) for h in (1e-4, -1e-4))
        assert np.allclose((down - up) / 2e-4, np.exp(loglik(x, all_, 0.0, 0.0, lam) + x), rtol=1e-6)


def test_cox_gradient_is_zero_and_bad_input_is_reported(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 2))
    t = rng.exponential(np.exp(-0.7 * x[:, 0]))
    rows = [(float(a), int(b), float(u), float(v), float(2 * u)) for a, b, (u, v) in zip(t, rng.random(150) < 0.8, x)]
    df = spark.createDataFrame(rows, "time double, event int, u double, v double, w double")
    m = cox.fit_cox(df, "time", "event", ["u", "v"])
    beta = np.array([m["coef"]["u"], m["coef"]["v"]])
    tt, e, f = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2:4] for r in rows])
    w = np.exp(f @ beta)
    grad = sum(f[i] - (w[tt >= tt[i], None] * f[tt >= tt[i]]).sum(0) / w[tt >= tt[i]].sum() for i in range(150) if e[i])
    assert m["converged"] and np.all(np.abs(grad) < 1e-6) and 0.3 < beta[0] < 1.1
    with pytest.raises(ValueError, match="event"):
        cox.fit_cox(df.withColumn("event", F.lit(0)), "time", "event", ["u"])
    with pytest.raises(ValueError, match="dependent"):
        cox.fit_cox(df, "time", "event", ["u", "w"])


def test_fold_counts_align(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 0), (2, "b", 1)], "fold int, grp string, event int")
    got = {(r["fold"], r["kind"], r["value"]): r["count"] for r in folds.fold_counts(df).collect()}
    assert got == {(1, "group", "a"): 2, (2, "group", "a"): 0, (1, "group", "b"): 0, (2, "group", "b"): 1,
                   (1, "event", "1"): 1, (2, "event", "1"): 1, (1, "event", "0"): 1, (2, "event", "0"): 0}


def test_scratch_folder_is_not_local_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        ensure_checkpoint_dir(Session())
