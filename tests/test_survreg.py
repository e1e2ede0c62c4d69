import math

import numpy as np
import pandas as pd
import pytest

from survspark.operators import survreg
from survspark.operators.scan import quantile_bounds

FEATS = ["u", "v", "w"]


def _data(seed=0, n=240, times=12, folds=3):
    """Heavy ties: some twenty rows share a time."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + [1.0, -2.0, 0.5]
    t = np.ceil(rng.exponential(np.exp(-0.5 * x[:, 0] + 0.3 * x[:, 1])) * 3).clip(1, times)
    e = (rng.random(n) < 0.7).astype(int)
    return pd.DataFrame({"id": np.arange(n), "fold": np.arange(n) % folds + 1, "time": t, "event": e, "u": x[:, 0], "v": x[:, 1], "w": x[:, 2]})


def _loglik(b, t, e, x, ties):
    """Log partial likelihood and gradient by the definition, one event at a time."""
    ll, g = 0.0, np.zeros(len(b))
    w = np.exp(x @ b)
    for time in np.unique(t[e == 1]):
        risk, dead = t >= time, (t == time) & (e == 1)
        d = int(dead.sum())
        for l in range(d):  # noqa: E741
            c = l / d if ties == "efron" else 0.0
            s0 = w[risk].sum() - c * w[dead].sum()
            s1 = (w[risk, None] * x[risk]).sum(0) - c * (w[dead, None] * x[dead]).sum(0)
            ll -= math.log(s0)
            g -= s1 / s0
        ll += (x[dead] @ b).sum()
        g += x[dead].sum(0)
    return ll, g


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_sums_equal_the_definition_on_heavy_ties(spark, ties):
    pdf = _data()
    frame = survreg.Frame(spark.createDataFrame(pdf), "time", "event", FEATS, "fold", with_all=True)
    rng = np.random.default_rng(5)
    betas = {m: rng.normal(size=3) * 0.4 for m in range(4)}
    got = survreg.cox_sums(frame, betas, ties, quantile_bounds(frame.table.select("t").distinct(), "t"))
    for m, b in betas.items():
        s = pdf[pdf.fold != frame.names[m]] if m < 3 else pdf
        x = s[FEATS].to_numpy() - frame.centre
        ll, g = _loglik(b, s.time.to_numpy(), s.event.to_numpy(), x, ties)
        assert math.isclose(got[m][0], ll, rel_tol=1e-9) and np.allclose(got[m][1], g, rtol=1e-9, atol=1e-9)
        step = 1e-5
        for i in range(3):
            up, down = (_loglik(b + s_ * step * np.eye(3)[i], s.time.to_numpy(), s.event.to_numpy(), x, ties)[1] for s_ in (1, -1))
            assert np.allclose(-(up - down) / (2 * step), got[m][2][i], rtol=1e-5, atol=1e-5)


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_folds_and_predictions(spark, ties):
    pdf = _data(1)
    df = spark.createDataFrame(pdf).repartition(3)
    fit = survreg.fit_cox_folds(df, "time", "event", FEATS, ties=ties, with_all=True)
    assert set(fit["models"]) == {1, 2, 3, "all"} and all(m["converged"] for m in fit["models"].values())
    for f, m in fit["models"].items():
        s = pdf[pdf.fold != f] if f != "all" else pdf
        _, g = _loglik(np.array(m["coef"]), s.time.to_numpy(), s.event.to_numpy(), s[FEATS].to_numpy() - np.array(m["mean"]), ties)
        assert np.abs(g).max() < 1e-6
    base = survreg.cox_baseline(df, fit, "time", "event")
    got = {r.id: r for r in survreg.predict_cox_folds(df, fit, base, "time").collect()}
    assert len(got) == len(pdf)
    for r in pdf.itertuples():
        m = fit["models"][r.fold]
        s = pdf[pdf.fold != r.fold]
        b, c = np.array(m["coef"]), np.array(m["mean"])
        w = np.exp((s[FEATS].to_numpy() - c) @ b)
        h0 = sum(((s.time == t) & (s.event == 1)).sum() / w[s.time >= t].sum() for t in np.unique(s.time) if t <= r.time)
        risk = math.exp((np.array([r.u, r.v, r.w]) - c) @ b)
        assert math.isclose(got[r.id].oof_risk_score, risk, rel_tol=1e-9)
        assert math.isclose(got[r.id].oof_cumulative_hazard, h0 * risk, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(got[r.id].oof_survival_probability, math.exp(-h0 * risk), rel_tol=1e-9)
    coef = survreg.coefficient_table(spark, fit).toPandas()
    assert len(coef) == 9 and np.allclose(coef.groupby("feature")["coef"].std(), coef.groupby("feature")["std"].first())


def test_a_prediction_does_not_depend_on_its_companions(spark):
    pdf = _data(2)
    df = spark.createDataFrame(pdf)
    fit = survreg.fit_cox_folds(df, "time", "event", FEATS)
    base = survreg.cox_baseline(df, fit, "time", "event")
    whole = {r.id: tuple(r) for r in survreg.predict_cox_folds(df, fit, base, "time").collect()}
    some = spark.createDataFrame(pdf[pdf.id % 7 == 0].assign(event=1))
    assert all(whole[r.id] == tuple(r) for r in survreg.predict_cox_folds(some, fit, base, "time").collect())


def test_missing_values_null_folds_and_errors(spark):
    pdf = _data(3)
    rows = [tuple(r) for r in pdf.itertuples(index=False)]
    rows += [(900, 1, 2.0, 1, None, 0.0, 0.0), (901, None, 3.0, 1, 0.0, 0.0, 0.0), (902, 2, None, 1, 0.0, 0.0, 0.0), (903, 1, 0.5, 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame([tuple(None if x is None else float(x) if i in (2, 4, 5, 6) else int(x) for i, x in enumerate(r)) for r in rows],
                               "id long, fold int, time double, event int, u double, v double, w double")
    fit = survreg.fit_cox_folds(df, "time", "event", FEATS)
    assert set(fit["models"]) == {1, 2, 3}
    got = {r.id: r for r in survreg.predict_cox_folds(df, fit, survreg.cox_baseline(df, fit, "time", "event"), "time").collect()}
    assert got[900].oof_risk_score is None and got[901].oof_risk_score is None and got[902].oof_cumulative_hazard is None
    assert got[903].oof_cumulative_hazard == 0.0 and got[903].oof_survival_probability == 1.0  # before the first training time
    with pytest.raises(ValueError, match="no event"):
        survreg.fit_cox_folds(df.withColumn("event", df.event * 0), "time", "event", FEATS)
    with pytest.raises(ValueError, match="dependent"):
        survreg.fit_cox_folds(df.withColumn("v", df.u * 2), "time", "event", FEATS)


def test_coxnet_path_meets_its_optimality_conditions(spark):
    pdf = _data(4, n=180)
    df = spark.createDataFrame(pdf)
    table, last = survreg.coxnet_path(df, "time", "event", FEATS, n_alphas=5, alpha_min_ratio=0.01, l1_ratio=0.7)
    t = table.toPandas()
    assert len(t) == 3 * 5 * 3 and t.converged.all()
    for (f, k), rows in t.groupby(["fold", "step"]):
        s = pdf[pdf.fold != int(f)]
        b = rows.set_index("feature")["coef"][FEATS].to_numpy()
        a = rows.alpha.iloc[0]
        _, g = _loglik(b, s.time.to_numpy(), s.event.to_numpy(), s[FEATS].to_numpy() - s[FEATS].to_numpy().mean(0), "breslow")
        slope = g / len(s) - a * 0.3 * b
        assert np.allclose(slope[b != 0], a * 0.7 * np.sign(b[b != 0]), atol=1e-6 * a + 1e-10) and (np.abs(slope[b == 0]) <= a * 0.7 * (1 + 1e-6)).all()
        assert k > 0 or (b == 0).all()
    assert (t[t.step == 4].coef != 0).any() and set(last["models"]) == {1, 2, 3}


def _aft_score(family, fit, s):
    """Gradient of the log-likelihood in intercept, coefficients and ln sigma by numerical differences of the definition."""
    def ll(theta):
        z = (np.log(s.time) - theta[0] - s[FEATS].to_numpy() @ theta[1:4]) / math.exp(theta[4])
        e = s.event.to_numpy() == 1
        if family == "weibull":
            f, big_s = z - np.exp(z), -np.exp(z)
        elif family == "loglogistic":
            f, big_s = z - 2 * np.log1p(np.exp(z)), -np.log1p(np.exp(z))
        else:
            f = -z * z / 2 - 0.5 * math.log(2 * math.pi)
            big_s = np.array([math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z])
        return np.where(e, f - theta[4], big_s).sum()

    at = np.array([fit["intercept"], *fit["coef"], math.log(fit["sigma"])])
    return np.array([(ll(at + 1e-5 * d) - ll(at - 1e-5 * d)) / 2e-5 for d in np.eye(5)])


@pytest.mark.parametrize("family", survreg.FAMILIES)
def test_aft_score_equations_and_curves(spark, family):
    pdf = _data(6)
    df = spark.createDataFrame(pdf)
    fit = survreg.fit_aft_folds(df, family, "time", "event", FEATS, with_all=True)
    assert all(m["converged"] for m in fit["models"].values())
    for f, m in fit["models"].items():
        assert np.abs(_aft_score(family, m, pdf[pdf.fold != f] if f != "all" else pdf)).max() < 2e-4
    got = {r.id: r for r in survreg.predict_aft_folds(df, fit, "time").collect()}
    for r in pdf.itertuples():
        m = fit["models"][r.fold]
        eta = m["intercept"] + np.dot(m["coef"], [r.u, r.v, r.w])
        z = (math.log(r.time) - eta) / m["sigma"]
        s = {"weibull": math.exp(-math.exp(z)), "loglogistic": 1 / (1 + math.exp(z)), "lognormal": 0.5 * math.erfc(z / math.sqrt(2))}[family]
        assert math.isclose(got[r.id].oof_survival_probability, s, rel_tol=1e-6) and math.isclose(got[r.id].oof_cumulative_hazard, -math.log(s), rel_tol=1e-5, abs_tol=1e-9)
        zm = (math.log(got[r.id].oof_median) - eta) / m["sigma"]
        assert math.isclose({"weibull": math.exp(-math.exp(zm))}.get(family, 0.5 if abs(zm) < 1e-9 else 0), 0.5, rel_tol=1e-9)
    with pytest.raises(ValueError, match="family"):
        survreg.fit_aft_folds(df, "gompertz", "time", "event", FEATS)


def test_a_step_lays_no_row_out_for_a_model_or_an_event(spark, monkeypatch):
    """Tasks send sums by time, at most one row a model, time and piece; heavy ties are added some events at a time."""
    rng = np.random.default_rng(8)
    n = 4000
    pdf = pd.DataFrame({"id": np.arange(n), "fold": rng.integers(1, 4, n), "time": rng.integers(1, 4, n).astype(float), "event": rng.integers(0, 2, n),
                        **{f: rng.normal(size=n) for f in FEATS}})
    frame = survreg.Frame(spark.createDataFrame(pdf).coalesce(1), "time", "event", FEATS, "fold")
    betas = {m: np.full(3, 0.1 * m) for m in range(3)}
    assert survreg._per_time(frame, betas, True).count() == 9
    whole = survreg.cox_sums(frame, betas, "efron", [])
    efron = survreg._efron_sums
    monkeypatch.setattr(survreg, "_efron_sums", lambda at, p, risk: efron(at, p, risk, events_at_once=100))
    for m, (ll, g, h) in survreg.cox_sums(frame, betas, "efron", []).items():
        assert math.isclose(ll, whole[m][0], rel_tol=1e-12) and np.allclose(g, whole[m][1]) and np.allclose(h, whole[m][2])
        s = pdf[pdf.fold != frame.names[m]]
        want, _ = _loglik(betas[m], s.time.to_numpy(), s.event.to_numpy(), s[FEATS].to_numpy() - frame.centre, "efron")
        assert math.isclose(ll, want, rel_tol=1e-9)
