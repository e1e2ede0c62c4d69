"""Generalised gamma survival model (SV13), fitted by maximum likelihood on Spark.

Parameterisation (``mu_``, ``sigma_``, ``lambda_``), ``z = (ln t - mu) / sigma``, ``a = 1 / lambda^2``,
``u = a * exp(lambda * z)``:

* ``ln f(t) = ln|lambda| - ln sigma - ln t + a ln a - lgamma(a) + a lambda z - u``
* ``S(t) = 1 - P(a, u)`` for ``lambda > 0`` and ``P(a, u)`` for ``lambda < 0``

with ``P`` the regularised lower incomplete gamma function (series / continued fraction in NumPy:
Spark SQL has no incomplete gamma).  Each Newton step evaluates the log-likelihood at a
19-point stencil around the current parameters in one distributed pass (``mapInPandas``
partial sums per group, reduced by ``groupBy``); gradient and Hessian come from central
differences, group by group, in the tasks.  The groups' parameters stay a table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import written


def _kernel():
    """NumPy routines shipped to the workers by value (no package import needed there)."""

    erfc = np.vectorize(math.erfc, otypes=[np.float64])

    def log_half_erfc(y):
        """ln(erfc(y) / 2), also where erfc underflows."""
        y = np.asarray(y, dtype=np.float64)
        out = np.log(0.5 * np.maximum(erfc(np.minimum(y, 25.0)), 1e-300))
        far = y > 25.0
        if far.any():
            v = y[far]
            out[far] = -v * v - np.log(2.0 * v * math.sqrt(math.pi)) + np.log1p(-0.5 / (v * v) + 0.75 / v ** 4)
        return out

    def uniform_log_p_q(a, x):
        """(ln P, ln Q) for large ``a`` by the uniform asymptotic expansion in
        ``eta^2 / 2 = x/a - 1 - ln(x/a)``: half a complementary error function plus a correction in 1/a,
        which holds through the transition at x = a where series and fraction need many terms."""
        m = x / a - 1.0
        with np.errstate(divide="ignore", invalid="ignore"):
            half = np.where(np.abs(m) < 1e-2, m * m * (0.5 - m * (1 / 3 - m * (0.25 - m * (0.2 - m * (1 / 6 - m / 7))))), m - np.log1p(m))
            eta = np.sign(m) * np.sqrt(2.0 * np.maximum(half, 0.0))
            near = np.abs(eta) < 0.05
            # Taylor coefficients of the two correction terms about eta = 0
            c0 = np.where(near, -1 / 3 + eta * (1 / 12 + eta * (-2 / 135 + eta * (1 / 864 + eta * (1 / 2835 - eta * 139 / 777600)))),
                          1.0 / m - 1.0 / eta)
            c1 = np.where(near, -1 / 540 + eta * (-1 / 288 + eta * (25 / 12096 + eta * (-223 / 1088640))),
                          1.0 / eta ** 3 - 1.0 / m ** 3 - 1.0 / m ** 2 - 1.0 / (12.0 * m))
            y = eta * math.sqrt(a / 2.0)
            # the correction relative to the Gaussian density exp(-a eta^2 / 2)
            r = (c0 + c1 / a) / math.sqrt(2.0 * math.pi * a)
            lq0, lp0 = log_half_erfc(y), log_half_erfc(-y)
            g = -y * y
            lq = lq0 + np.log1p(np.maximum(r * np.exp(np.minimum(g - lq0, 700.0)), -1 + 1e-15))
            lp = lp0 + np.log1p(np.maximum(-r * np.exp(np.minimum(g - lp0, 700.0)), -1 + 1e-15))
        zero = x <= 0
        return np.where(zero, -np.inf, np.minimum(lp, 0.0)), np.where(zero, 0.0, np.minimum(lq, 0.0))

    def log_p_q(a, x):
        """(ln P(a, x), ln Q(a, x)) elementwise for scalar ``a > 0`` and array ``x >= 0``.

        Series and continued fraction run until they converge (about the square root of ``a`` terms at
        worst); from a = 10,000 on the uniform expansion, whose error there is below 1e-12, replaces them."""
        x = np.asarray(x, dtype=np.float64)
        if a >= 1e4:
            return uniform_log_p_q(a, x)
        lp = np.full(x.shape, -np.inf)
        lq = np.zeros(x.shape)
        pos = x > 0
        lpre = np.where(pos, -x + a * np.log(np.where(pos, x, 1.0)) - math.lgamma(a), -np.inf)
        ser = pos & (x < a + 1)
        if ser.any():
            xs = x[ser]
            term = np.full(xs.shape, 1.0 / a)
            total = term.copy()
            ap = a
            while np.any(term > total * 1e-16):  # the terms are positive and fall once ap exceeds x
                ap += 1.0
                term = term * xs / ap
                total += term
            lps = lpre[ser] + np.log(total)
            lp[ser] = lps
            lq[ser] = np.log1p(-np.exp(np.minimum(lps, -1e-300)))
        cf = pos & ~(x < a + 1) & np.isfinite(x)
        if cf.any():
            xc = x[cf]
            tiny = 1e-300
            b = xc + 1.0 - a
            c = np.full(xc.shape, 1.0 / tiny)
            d = 1.0 / b
            h = d.copy()
            i, worst = 0, 1.0
            while worst > 4e-16:
                i += 1
                an = -i * (i - a)
                b = b + 2.0
                d = an * d + b
                d = np.where(np.abs(d) < tiny, tiny, d)
                c = b + an / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                d = 1.0 / d
                delta = d * c
                h = h * delta
                worst = float(np.max(np.abs(delta - 1.0)))
            lqs = lpre[cf] + np.log(h)
            lq[cf] = lqs
            lp[cf] = np.log1p(-np.exp(np.minimum(lqs, -1e-300)))
        inf = pos & ~np.isfinite(x)
        lp[inf], lq[inf] = 0.0, -np.inf
        return lp, lq

    def loglik(x, e, mu, s, lam):
        """Per-row log-likelihood; ``x = ln t``, ``e`` event flag, ``s = ln sigma``."""
        sigma = math.exp(s)
        z = (x - mu) / sigma
        if abs(lam) < 1e-7:  # the log-normal limit; the difference is of order lambda
            lf = -s - x - 0.5 * math.log(2.0 * math.pi) - 0.5 * z * z
            third = lam * z * (z * z - 3.0) / 6.0  # first-order term of the density in lambda
            ls = log_half_erfc(z / math.sqrt(2.0))
            return np.where(e > 0, lf - third, ls)
        a = 1.0 / (lam * lam)
        lz = lam * z
        with np.errstate(over="ignore"):
            u = a * np.exp(lz)  # infinite where the density and one tail are zero
        # a ln a - a - lgamma(a), without cancellation for large a (Stirling)
        if a > 1e3:
            scale = 0.5 * math.log(a / (2.0 * math.pi)) - 1.0 / (12.0 * a) + 1.0 / (360.0 * a ** 3)
        else:
            scale = a * math.log(a) - a - math.lgamma(a)
        lf = math.log(abs(lam)) - s - x + scale - a * (np.expm1(lz) - lz)
        lp, lq = log_p_q(a, u)
        ls = lq if lam > 0 else lp
        return np.where(e > 0, lf, ls)

    return log_p_q, loglik


def _stencil(theta: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    pts = [theta.copy()]
    for i in range(3):
        for sgn in (1, -1):
            p = theta.copy()
            p[i] += sgn * h[i]
            pts.append(p)
    for i in range(3):
        for j in range(i + 1, 3):
            for si, sj in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
                p = theta.copy()
                p[i] += si * h[i]
                p[j] += sj * h[j]
                pts.append(p)
    return pts


def _derivatives(f: list[float], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f0 = f[0]
    g = np.zeros(3)
    H = np.zeros((3, 3))
    for i in range(3):
        fp, fm = f[1 + 2 * i], f[2 + 2 * i]
        g[i] = (fp - fm) / (2 * h[i])
        H[i, i] = (fp - 2 * f0 + fm) / (h[i] * h[i])
    k = 7
    for i in range(3):
        for j in range(i + 1, 3):
            fpp, fpm, fmp, fmm = f[k:k + 4]
            H[i, j] = H[j, i] = (fpp - fpm - fmp + fmm) / (4 * h[i] * h[j])
            k += 4
    return g, H


_H = np.array([1e-4, 1e-4, 1e-4])
_VALUES = [f"f{k}" for k in range(19)]
_STATE = "g string, has boolean, t0 double, t1 double, t2 double, best double, s0 double, s1 double, s2 double, done boolean"


def _advance(row: dict, tol: float) -> dict:
    """One damped Newton step of a group from the values at the stencil around its tried point ``t + s``."""
    f = [v if v is not None and not math.isnan(v) else float("-inf") for v in (row[k] for k in _VALUES)]
    t, s = (np.array([row[f"{c}{i}"] for i in range(3)], np.float64) for c in "ts")
    best, done = row["best"], False
    if not np.isnan(best) and f[0] < best - 1e-10 * abs(best):
        s = s / 2
        done = np.max(np.abs(s)) < tol
    else:
        t, best = t + s, f[0]
        grad, hess = _derivatives(f, _H)
        try:
            s = -np.linalg.solve(hess, grad) if np.all(np.linalg.eigvalsh(hess) < 0) else 1e-3 * grad
        except np.linalg.LinAlgError:
            s = 1e-3 * grad
        s = s / max(1.0, np.max(np.abs(s)))
        if np.max(np.abs(s)) < tol:
            t, s, done = t + s, np.zeros(3), True
    return {"g": row["g"], "has": True, "t0": t[0], "t1": t[1], "t2": t[2], "best": best, "s0": s[0], "s1": s[1], "s2": s[2], "done": bool(done)}


def fit_generalized_gamma(df: DataFrame, time: str = "time", event: str = "event", group: str | None = None,
                          max_iter: int = 60, tol: float = 1e-7) -> DataFrame:
    """SV13: ``(group?, mu_, sigma_, lambda_, converged)`` maximising the censored log-likelihood of every group.

    The groups' parameters are a table: a step joins the open groups to their rows (one for each time and event
    indicator), sums the likelihood at each stencil point, and advances the table; converged groups leave."""
    gcol = F.col(group).cast("string") if group else F.lit("")
    cond = F.col(time).isNotNull() & (F.col(time) > 0) & F.col(event).isNotNull()
    if group:
        cond = cond & F.col(group).isNotNull()
    base = written(df.filter(cond).groupBy(gcol.alias("g"), F.log(F.col(time).cast("double")).alias("x"), F.col(event).cast("double").alias("e")).agg(
        F.count(F.lit(1)).cast("double").alias("n")), "fit_rows")
    n, x = F.col("n"), F.col("x")
    init = base.groupBy("g").agg((F.sum(n * x) / F.sum(n)).alias("m"), (F.sum(n * x * x) / F.sum(n)).alias("q"), F.coalesce(F.sum(n * F.col("e")) > 0, F.lit(False)).alias("has"))
    spread = F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))
    zero = [F.lit(0.0).alias(f"s{i}") for i in range(3)]
    state = written(init.select("g", "has", F.col("m").alias("t0"), F.log(F.greatest(F.when(spread > 0, F.sqrt(spread)).otherwise(F.lit(1.0)), F.lit(1e-6))).alias("t1"),
                                F.lit(1.0).alias("t2"), F.lit(float("nan")).alias("best"), *zero, (~F.col("has")).alias("done")), "fit_state")
    _, loglik = _kernel()
    finished = state.where("done")

    def values(batches):
        for pdf in batches:
            out = []
            for g, sub in pdf.groupby("g", sort=False):
                r = sub.iloc[0]
                x, e, n = (sub[c].to_numpy(np.float64) for c in ("x", "e", "n"))
                theta = np.array([r[f"t{i}"] + r[f"s{i}"] for i in range(3)])
                out.append([g, *(float(np.sum(n * loglik(x, e, float(mu), float(s), float(lam)))) for mu, s, lam in _stencil(theta, _H))])
            yield pd.DataFrame(out, columns=["g", *_VALUES])

    def steps(batches):
        for pdf in batches:
            yield pd.DataFrame([_advance(r, tol) for r in pdf.to_dict("records")], columns=[c.split()[0] for c in _STATE.split(", ")])

    for _ in range(max_iter):
        if state.where("NOT done").isEmpty():
            break
        open_ = state.where("NOT done")
        part = base.join(open_.select("g", *[f"{c}{i}" for c in "ts" for i in range(3)]), "g").mapInPandas(values, "g string, " + ", ".join(f"{k} double" for k in _VALUES))
        got = part.groupBy("g").agg(*[F.sum(k).alias(k) for k in _VALUES])
        state = written(open_.join(got, "g").mapInPandas(steps, _STATE), "fit_state")
        finished = finished.unionByName(state.where("done"))
    out = finished.unionByName(state.where("NOT done"))
    # a group without an event has no maximum: null parameters
    cols = [F.when(F.col("has"), c).alias(name) for name, c in (("mu_", F.col("t0")), ("sigma_", F.exp("t1")), ("lambda_", F.col("t2")), ("converged", F.col("done")))]
    return out.select(*([F.col("g").alias(group)] if group else []), *cols)


def evaluate_generalized_gamma(df: DataFrame, params: dict, time: str = "time") -> DataFrame:
    """SV13/SV14: survival, cumulative hazard and hazard at each row's time for given parameters
    (vectorised ``mapInPandas``, the incomplete gamma has no SQL form)."""
    log_p_q, loglik = _kernel()
    mu, sigma, lam = float(params["mu_"]), float(params["sigma_"]), float(params["lambda_"])
    s = math.log(sigma)
    cols = df.columns
    schema = StructType([*df.schema.fields, StructField("survival", DoubleType()),
                         StructField("cumulative_hazard", DoubleType()), StructField("hazard", DoubleType())])

    def part(it):
        for pdf in it:
            t = pdf[time].to_numpy(np.float64)
            x = np.log(t)
            lf = loglik(x, np.ones_like(x), mu, s, lam)
            ls = loglik(x, np.zeros_like(x), mu, s, lam)
            out = pdf[cols].copy()
            out["survival"] = np.exp(ls)
            out["cumulative_hazard"] = -ls
            out["hazard"] = np.exp(lf - ls)
            yield out

    return df.mapInPandas(part, schema)
