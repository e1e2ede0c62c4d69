"""Parametric survival fits (SV9-SV11, SV14), globally or per group.

Fitting is maximum likelihood with right censoring.  Rows of one group, time and event indicator are
collapsed once.  Every Newton step is one distributed aggregate of score and Hessian terms grouped by the
group key, joined to a table of the groups' parameters, which a projection advances; groups that have converged leave
(``iterate``).  No group's numbers reach the driver, so there may be as many groups as rows.  Evaluation is a scalar projection
after joining the parameter table (one row per group).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import norm_logsf, norm_sf
from ..session import written

_SQRT_2PI = math.sqrt(2.0 * math.pi)

FAMILIES = ("exponential", "weibull", "loglogistic", "lognormal")


def _clean(df: DataFrame, time: str, event: str, group: str | None) -> DataFrame:
    cond = F.col(time).isNotNull() & F.col(event).isNotNull()
    if group:
        cond = cond & F.col(group).isNotNull()
    return df.filter(cond)


def fit_exponential(df: DataFrame, time: str = "time", event: str = "event", group: str | None = None) -> DataFrame:
    """SV9: ``lambda_ = sum(t) / sum(e)`` (scale form, ``S = exp(-t / lambda_)``); one aggregate.
    A group without an event has no maximum: null."""
    keys = [group] if group else []
    x = _clean(df, time, event, group)
    return x.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(time).cast("double")), F.sum(F.col(event).cast("double"))).alias("lambda_"))


def params_frame(spark: SparkSession, family: str, params: Mapping[str, float]) -> DataFrame:
    """A one-row parameter table for evaluating a curve with given parameters."""
    if family not in FAMILIES:
        raise ValueError(family)
    return spark.createDataFrame([tuple(float(v) for v in params.values())], ", ".join(f"{k} double" for k in params))


def _curves(family: str, t: Column) -> tuple[Column, Column, Column]:
    """(S, H, h) expressions of a family given parameter columns on the row."""
    if family == "exponential":
        lam = F.col("lambda_")
        H = t / lam
        return F.exp(-H), H, F.lit(1.0) / lam
    if family == "weibull":
        lam, rho = F.col("lambda_"), F.col("rho_")
        H = F.pow(t / lam, rho)
        return F.exp(-H), H, rho / lam * F.pow(t / lam, rho - F.lit(1.0))
    if family == "loglogistic":
        a, b = F.col("alpha_"), F.col("beta_")
        q = F.pow(t / a, b)
        return F.lit(1.0) / (F.lit(1.0) + q), F.log1p(q), b / a * F.pow(t / a, b - F.lit(1.0)) / (F.lit(1.0) + q)
    if family == "lognormal":
        mu, sigma = F.col("mu_"), F.col("sigma_")
        z = (F.log(t) - mu) / sigma
        S = norm_sf(z)
        pdf = F.exp(-z * z / F.lit(2.0)) / (sigma * t * F.lit(_SQRT_2PI))
        return S, -norm_logsf(z), pdf / S
    raise ValueError(family)


def evaluate(df: DataFrame, params: DataFrame, family: str, time: str = "time", group: str | None = None,
             prefix: str = "") -> DataFrame:
    """SV14: survival, cumulative hazard and hazard of a fitted family at each row's time.

    Per-group parameters are joined on the group (one row per group); global parameters are a
    single row and are inlined as literals."""
    pcols = [c for c in params.columns if c.endswith("_") and c != group]
    if group:
        x = df.join(params.select(group, *pcols), group, "left")
    else:
        r = params.first()
        x = df.select("*", *[F.lit(r[c]).cast("double").alias(c) for c in pcols])
    S, H, h = _curves(family, F.col(time).cast("double"))
    return x.select(*df.columns, S.alias(f"{prefix}survival"), H.alias(f"{prefix}cumulative_hazard"),
                    h.alias(f"{prefix}hazard"))


def _collapsed(df: DataFrame, time: str, event: str, keys: Sequence[str]) -> DataFrame:
    """(keys, l = ln t, e, n): rows of one time and event indicator of a group are one row."""
    x = _clean(df, time, event, keys[0] if keys else None).filter(F.col(time) > 0)
    x = x.groupBy(*keys, F.col(time).cast("double").alias("__t"), F.col(event).cast("double").alias("__e")).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    return written(x.select(*keys, F.log("__t").alias("__l"), "__e", "__n"), "fit_rows")


def _with_state(base: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(state, list(keys)) if keys else base.crossJoin(F.broadcast(state))  # without keys the state is one row


def iterate(base: DataFrame, state: DataFrame, keys: Sequence[str], sums: Sequence[Column], advance: Mapping[str, Column], max_iter: int) -> DataFrame:
    """A fit of every group at once, table to table: ``state`` has a row for each group with its parameters and a
    boolean ``done``; a step joins the open groups to their rows, takes ``sums`` and replaces the columns of
    ``advance``.  Groups that are done leave; the driver sees only whether any are left.  Columns in ``advance`` may use
    the sums and the old state; the state is written once a step, so the plan does not grow."""
    names = state.columns
    state = written(state, "fit_state")
    finished = state.where("done")
    for _ in range(max_iter):
        if state.where("NOT done").isEmpty():
            break
        open_ = state.where("NOT done")
        got = _with_state(base, open_, keys).groupBy(*keys).agg(*sums)
        new = _with_state(open_, got, keys).withColumns(dict(advance)).select(*names)
        state = written(new, "fit_state")
        finished = finished.unionByName(state.where("done"))
    return finished.unionByName(state.where("NOT done"))


def newton_state(init: DataFrame, keys: Sequence[str], first: tuple[Column, Column]) -> DataFrame:
    """The state of a damped Newton search in two parameters ``a, b``: best point, its value, the step to try."""
    return init.select(*keys, "has", first[0].alias("a"), first[1].alias("b"), F.lit(None).cast("double").alias("best"), F.lit(0.0).alias("sa"), F.lit(0.0).alias("sb"),
                       (~F.col("has")).alias("done"))


def newton_step(tol: float, positive_b: bool) -> dict[str, Column]:
    """One damped Newton step for a group: the tried point (a + sa, b + sb) has value ``ll``, gradient ``ga, gb`` and
    Hessian ``haa, hab, hbb``.  A point that does not improve halves the step from the best one; else
    it becomes the best one and a new step is taken: Newton's where the Hessian is negative definite, else a short one up the
    gradient, of at most one (for a positive b: relative to b, and b stays positive)."""
    got = [F.col(c) for c in ("ga", "gb", "haa", "hab", "hbb")]
    ga, gb, haa, hab, hbb = got
    b = F.col("b") + F.col("sb")
    better = F.col("best").isNull() | (F.col("ll") >= F.col("best") - F.lit(1e-12) * F.abs("best"))
    det = haa * hbb - hab * hab
    concave = (det > 0) & (haa < 0)
    da = F.when(concave, -(hbb * ga - hab * gb) / det).otherwise(F.lit(1e-3) * ga)
    db = F.when(concave, -(haa * gb - hab * ga) / det).otherwise(F.lit(1e-3) * gb)
    size = F.greatest(F.abs(da), F.abs(db) / F.greatest(b, F.lit(1e-12)) if positive_b else F.abs(db), F.lit(1e-300))
    scale = F.least(F.lit(1.0), F.lit(1.0) / size)
    if positive_b:  # as many halves as keep b above 0
        down = -db * scale / b
        scale = scale * F.when(down >= 1, F.pow(F.lit(0.5), F.floor(F.log2(down)) + 1)).otherwise(F.lit(1.0))
    tried = F.greatest(F.abs("sa"), F.abs("sb"))
    new_a, new_b = da * scale, db * scale
    small = F.greatest(F.abs(new_a), F.abs(new_b)) < tol
    return {
        "a": F.when(better, F.col("a") + F.col("sa")).otherwise(F.col("a")), "b": F.when(better, b).otherwise(F.col("b")),
        "done": F.when(better, small | (F.col("best").isNotNull() & (tried < tol))).otherwise(tried / 2 < tol),
        "sa": F.when(better, new_a).otherwise(F.col("sa") / 2), "sb": F.when(better, new_b).otherwise(F.col("sb") / 2),
        "best": F.when(better, F.col("ll")).otherwise(F.col("best")),
    }


def _fitted(state: DataFrame, keys: Sequence[str], **params: Column) -> DataFrame:
    """One row a group; null parameters where a group has no maximum (no event)."""
    return state.select(*keys, *[F.when(F.col("has"), c).alias(n) for n, c in params.items()], F.when(F.col("has"), F.col("done")).alias("converged"))


def fit_weibull(df: DataFrame, time: str = "time", event: str = "event", group: str | None = None,
                max_iter: int = 50, tol: float = 1e-10) -> DataFrame:
    """SV10: Weibull MLE (``S = exp(-(t/lambda_)^rho_)``) by Newton on the profile score of ``rho_``.

    For fixed ``rho``, ``lambda^rho = sum t^rho / sum e``; the profile score is
    ``D/rho + sum_e ln t - D * sum(t^rho ln t) / sum(t^rho)``.  Times are scaled by the group
    maximum so ``t^rho`` cannot overflow.  Each step is one grouped aggregate.  A group without an event
    has null parameters; ``converged`` tells whether the steps fell below ``tol``.
    """
    keys = [group] if group else []
    base = _collapsed(df, time, event, keys)
    n, u = F.col("__n"), F.col("__l") - F.col("mx")  # ln of the time over the group's largest
    stats = base.groupBy(*keys).agg(F.max("__l").alias("mx"), F.sum(n * F.col("__e")).alias("D"), F.sum(n * F.col("__e") * F.col("__l")).alias("SL"))
    has = F.coalesce(F.col("D") > 0, F.lit(False))
    state = stats.select(*keys, has.alias("has"), "mx", "D", (F.col("SL") - F.col("D") * F.col("mx")).alias("SL"), F.lit(1.0).alias("rho"),
                         F.lit(0.0).alias("S"), (~has).alias("done"), F.lit(False).alias("last"))
    w = n * F.exp(F.col("rho") * u)
    D, A, B, C, r = (F.col(c) for c in ("D", "A", "B", "C", "rho"))
    score, deriv = D / r + F.col("SL") - D * B / A, -D / (r * r) - D * (C * A - B * B) / (A * A)
    new = F.when(r - score / deriv > 0, r - score / deriv).otherwise(r / 2)
    close = F.abs(new - r) < F.lit(tol) * F.greatest(F.lit(1.0), F.abs(r))
    # the step after the last small one only takes the sum for the scale
    advance = {"S": F.when(F.col("last"), A).otherwise(F.lit(0.0)), "done": F.col("last"), "last": F.col("last") | close, "rho": F.when(F.col("last"), r).otherwise(new)}
    sums = [F.sum(w).alias("A"), F.sum(w * u).alias("B"), F.sum(w * u * u).alias("C")]
    out = iterate(base, state, keys, sums, advance, max_iter)
    return _fitted(out, keys, lambda_=F.exp(F.col("mx") + F.log(F.col("S") / D) / r), rho_=r)


def loglogistic_terms(a: Column, b: Column, x: Column, e: Column) -> dict[str, Column]:
    """Per-row log-likelihood, gradient and Hessian terms of the log-logistic model in
    ``(a = ln alpha, b = beta)`` with ``x = ln t``."""
    u = x - a
    z = b * u
    sig = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    one_e = F.lit(1.0) + e
    softplus = F.when(z > 30, z).otherwise(F.log1p(F.exp(z)))
    return {
        "ll": e * (F.log(b) - a + (b - F.lit(1.0)) * u) - one_e * softplus,
        "ga": -e * b + one_e * b * sig,
        "gb": e * (F.lit(1.0) / b + u) - one_e * sig * u,
        "haa": -one_e * b * b * sig * (F.lit(1.0) - sig),
        "hab": -e + one_e * sig + one_e * b * sig * (F.lit(1.0) - sig) * u,
        "hbb": -e / (b * b) - one_e * sig * (F.lit(1.0) - sig) * u * u,
    }


def fit_loglogistic(df: DataFrame, time: str = "time", event: str = "event", group: str | None = None,
                    max_iter: int = 100, tol: float = 1e-10) -> DataFrame:
    """SV11: log-logistic MLE (``S = 1 / (1 + (t/alpha_)^beta_)``) by damped Newton on
    ``(ln alpha, beta)``; each step is one grouped aggregate of gradient and Hessian terms."""
    keys = [group] if group else []
    base = _collapsed(df, time, event, keys)
    n = F.col("__n")
    init = base.groupBy(*keys).agg((F.sum(n * F.col("__l")) / F.sum(n)).alias("m"), F.coalesce(F.sum(n * F.col("__e")) > 0, F.lit(False)).alias("has"))
    t = loglogistic_terms(F.col("a") + F.col("sa"), F.col("b") + F.col("sb"), F.col("__l"), F.col("__e"))
    out = iterate(base, newton_state(init, keys, (F.col("m"), F.lit(1.0))), keys, [F.sum(n * v).alias(k) for k, v in t.items()], newton_step(tol, True), max_iter)
    return _fitted(out, keys, alpha_=F.exp("a"), beta_=F.col("b"))


def lognormal_terms(mu: Column, s: Column, x: Column, e: Column) -> dict[str, Column]:
    """Per-row log-likelihood, gradient and Hessian of the log-normal model in ``(mu, s = ln sigma)``
    with ``x = ln t``; censored rows use the normal hazard ``lam = phi(z) / (1 - Phi(z))``."""
    sigma = F.exp(s)
    z = (x - mu) / sigma
    phi = F.exp(-z * z / F.lit(2.0)) / F.lit(_SQRT_2PI)
    sf = norm_sf(z)
    lam = F.when(z > 30, z + F.lit(1.0) / z).otherwise(phi / sf)
    dl = lam * (lam - z)
    ev = e
    ce = F.lit(1.0) - e
    return {
        "ll": ev * (-s - x - F.lit(0.5 * math.log(2 * math.pi)) - z * z / F.lit(2.0)) + ce * norm_logsf(z),
        "gm": ev * z / sigma + ce * lam / sigma,
        "gs": ev * (z * z - F.lit(1.0)) + ce * lam * z,
        "hmm": ev * (-F.lit(1.0) / (sigma * sigma)) + ce * (-dl / (sigma * sigma)),
        "hms": ev * (-F.lit(2.0) * z / sigma) + ce * ((-z * dl - lam) / sigma),
        "hss": ev * (-F.lit(2.0) * z * z) + ce * (-z * z * dl - lam * z),
    }


def fit_lognormal(df: DataFrame, time: str = "time", event: str = "event", group: str | None = None,
                  max_iter: int = 100, tol: float = 1e-9) -> DataFrame:
    """SV12: log-normal MLE (``S = 1 - Phi((ln t - mu_) / sigma_)``) by damped Newton on
    ``(mu, ln sigma)``; each step is one grouped aggregate.  The normal tail uses a Catalyst
    ``erfc`` (fractional error < 1.2e-7), so parameters are exact to about that precision."""
    keys = [group] if group else []
    base = _collapsed(df, time, event, keys)
    n, x = F.col("__n"), F.col("__l")
    init = base.groupBy(*keys).agg((F.sum(n * x) / F.sum(n)).alias("m"), (F.sum(n * x * x) / F.sum(n)).alias("q"),
                                   F.coalesce(F.sum(n * F.col("__e")) > 0, F.lit(False)).alias("has"))
    spread = F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))
    t = lognormal_terms(F.col("a") + F.col("sa"), F.col("b") + F.col("sb"), x, F.col("__e"))
    t = {{"gm": "ga", "gs": "gb", "hmm": "haa", "hms": "hab", "hss": "hbb"}.get(k, k): v for k, v in t.items()}
    first = (F.col("m"), F.log(F.greatest(F.when(spread > 0, F.sqrt(spread)).otherwise(F.lit(1.0)), F.lit(1e-6))))
    out = iterate(base, newton_state(init, keys, first), keys, [F.sum(n * v).alias(k) for k, v in t.items()], newton_step(tol, False), max_iter)
    return _fitted(out, keys, mu_=F.col("a"), sigma_=F.exp("b"))


def fit(df: DataFrame, family: str, time: str = "time", event: str = "event", group: str | None = None) -> DataFrame:
    if family == "exponential":
        return fit_exponential(df, time, event, group)
    if family == "weibull":
        return fit_weibull(df, time, event, group)
    if family == "loglogistic":
        return fit_loglogistic(df, time, event, group)
    if family == "lognormal":
        return fit_lognormal(df, time, event, group)
    raise ValueError(family)


def score_equations(df: DataFrame, params: Mapping[str, float], family: str, time: str = "time",
                    event: str = "event") -> dict[str, float]:
    """Gradient of the log-likelihood at given parameters (tests: ~0 at the fit)."""
    x = df.filter(F.col(time) > 0)
    if family == "weibull":
        lam, rho = params["lambda_"], params["rho_"]
        z = F.log(F.col(time) / F.lit(lam))
        w = F.exp(F.lit(rho) * z)
        e = F.col(event).cast("double")
        r = x.agg(F.sum(e / F.lit(rho) + e * z - w * z).alias("g_rho"),
                  F.sum((F.lit(rho) / F.lit(lam)) * (w - e)).alias("g_lambda")).first()
        return {"rho_": r["g_rho"], "lambda_": r["g_lambda"]}
    if family == "loglogistic":
        t = loglogistic_terms(F.lit(math.log(params["alpha_"])), F.lit(params["beta_"]), F.log(time),
                              F.col(event).cast("double"))
        r = x.agg(F.sum(t["ga"]).alias("ga"), F.sum(t["gb"]).alias("gb")).first()
        return {"log_alpha": r["ga"], "beta_": r["gb"]}
    if family == "lognormal":
        t = lognormal_terms(F.lit(params["mu_"]), F.lit(math.log(params["sigma_"])), F.log(time),
                            F.col(event).cast("double"))
        r = x.agg(F.sum(t["gm"]).alias("gm"), F.sum(t["gs"]).alias("gs")).first()
        return {"mu_": r["gm"], "log_sigma": r["gs"]}
    raise ValueError(family)

