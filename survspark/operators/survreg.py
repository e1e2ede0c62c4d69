"""Survival regression out of fold (SV16, SV17): Cox with Efron or Breslow ties, elastic-net Cox paths, and
accelerated-failure-time models (Weibull, log-logistic, log-normal).

A model is fitted for each fold on the rows of all other folds, and one on all rows.  The models of all
folds are fitted by one job a step: tasks read each row once and add it, in arrays, to the sums of every model that it
trains; a shuffle adds these sums by model (and time).  A step brings a gradient and a Hessian for each model
to the driver, ``p + p^2`` numbers times the number of folds; models that have converged leave the next job.

Cox risk sets are one reverse prefix scan over the distinct times of each model.  Efron ties: the l-th of d tied events sees
the risk set less ``l / d`` of the tied events' own sums; these terms are made in arrays, some events at a time.

Predictions never look at the outcome of the rows they score: the baseline hazard is a stored table for each
model, made from its training rows, and a scored row reads it at its own time by the as-of lookup.

Defined cases: rows with a missing time, event or feature train no model and score null; rows of a null
fold train every model and are scored by none; rows of AFT models need positive times.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import norm_logsf, np_norm_logsf, np_norm_sf
from ..session import written
from .scan import lookup_asof, prefix_scan, quantile_bounds

ALL = "all"  # the model fitted on every row


class Frame:
    """Training rows (own fold as ``m``-number, time, event, centred features), written once."""

    def __init__(self, df: DataFrame, time: str, event: str, features: Sequence[str], fold: str, with_all: bool = False, positive: bool = False):
        self.features, self.p = list(features), len(features)
        cols = [F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]]
        x = df.select(F.col(fold).alias("fold"), *cols).dropna(subset=["t", "e", *[f"x{i}" for i in range(self.p)]])
        x = x.where("t > 0") if positive else x
        # sums of each fold give the means of each complement
        per = x.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("d"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(self.p)]).collect()
        n, d = sum(r["n"] for r in per), sum(r["d"] for r in per)
        total = np.array([sum(r[f"s{i}"] for r in per) for i in range(self.p)])
        self.centre = total / max(n, 1)
        own = sorted((r for r in per if r["fold"] is not None), key=lambda r: r["fold"])
        self.names = [r["fold"] for r in own] + [ALL] * with_all
        self.rows = [n - r["n"] for r in own] + [n] * with_all
        self.events = [d - r["d"] for r in own] + [d] * with_all
        self.means = [(total - np.array([r[f"s{i}"] for i in range(self.p)])) / max(n - r["n"], 1) for r in own] + [self.centre] * with_all
        for name, events in zip(self.names, self.events):
            if not events:
                raise ValueError(f"no event in the training rows of model {name}: the likelihood has no maximum")
        number = F.coalesce(*[F.when(F.col("fold") == F.lit(r["fold"]), F.lit(i)) for i, r in enumerate(own)], F.lit(-1)) if own else F.lit(-1)
        self.table = written(x.select(number.cast("int").alias("own"), "t", "e", *[(F.col(f"x{i}") - F.lit(float(c))).alias(f"x{i}") for i, c in enumerate(self.centre)]), "survreg")


def _eta(p: int, offset: int = 0) -> Column:
    return sum((F.col(f"x{i}") * F.col("b")[i + offset] for i in range(p)), F.lit(0.0))


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _pieces(batches, names: Sequence[str], rows: int = 250_000):
    """Columns of a task's rows as arrays, about ``rows`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def _table(columns: Mapping[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "m" else pa.float64()) for k, c in columns.items()], names=list(columns))


def _per_time(frame: Frame, betas: Mapping[int, np.ndarray], own_sums: bool) -> DataFrame:
    """Sums of each model and time, ``(m, t, a0, a1_i, a2_i_j, d, fit, xe_i)``, with ``own_sums`` also those of the events alone
    (d0, d1_i, d2_i_j).  Tasks add up pieces of their rows by time for all models; a shuffle adds the pieces."""
    p, pairs = frame.p, _pairs(frame.p)
    risk = ["a0", *[f"a1_{i}" for i in range(p)], *[f"a2_{i}_{j}" for i, j in pairs]]
    names = [*risk, "d", "fit", *[f"xe_{i}" for i in range(p)], *[f"d{k[1:]}" for k in risk if own_sums]]
    betas = {m: np.asarray(b, float) for m, b in betas.items()}

    def run(batches):
        for own, t, e, *x in _pieces(batches, ["own", "t", "e", *[f"x{i}" for i in range(p)]]):
            order = np.argsort(t, kind="stable")
            own, t, e, x = own[order], t[order], e[order], [c[order] for c in x]
            for m, beta in betas.items():
                on = own != m
                tm, em, xm = t[on], e[on], [c[on] for c in x]
                if not len(tm):
                    continue
                starts = np.flatnonzero(np.r_[True, tm[1:] != tm[:-1]])
                eta = sum((c * b for c, b in zip(xm, beta)), np.zeros(len(tm)))
                with np.errstate(over="ignore"):
                    w = np.exp(eta)
                weighted = [w * c for c in xm]
                cols = [w, *weighted, *[weighted[i] * xm[j] for i, j in pairs]]
                add = [np.add.reduceat(c, starts) for c in [*cols, em, em * eta, *[em * c for c in xm]]]
                if own_sums:
                    add += [np.add.reduceat(em * c, starts) for c in cols]
                yield _table({"m": np.full(len(starts), m), "t": tm[starts], **dict(zip(names, add))})

    schema = "m int, t double, " + ", ".join(f"{k} double" for k in names)
    return frame.table.mapInArrow(run, schema).groupBy("m", "t").agg(*[F.sum(k).alias(k) for k in names])


def _efron_sums(at: DataFrame, p: int, risk: Sequence[str], events_at_once: int = 500_000) -> DataFrame:
    """Parts of the log-likelihood, gradient and negative Hessian by model.  The l-th of d tied events sees the risk sums less
    ``l / d`` of the tied events' own; the sums over l of the powers that this takes are made for some events at a time."""
    pairs = _pairs(p)
    names = ["fit", "d", *[f"xe_{i}" for i in range(p)], *[f"s{k[1:]}" for k in risk], *[f"d{k[1:]}" for k in risk]]
    out = ["ll", *[f"g{i}" for i in range(p)], *[f"h{i}_{j}" for i, j in pairs]]

    def run(batches):
        for m, *cols in _pieces(batches, ["m", *names], 50_000):
            v = dict(zip(names, cols))
            d = v["d"].astype(np.int64)
            ends = np.cumsum(d)
            log, a0, a1, b0, b1, b2 = (np.zeros(len(d)) for _ in range(6))
            for first in range(0, int(ends[-1]), events_at_once):
                event = np.arange(first, min(first + events_at_once, int(ends[-1])))
                row = np.searchsorted(ends, event, side="right")
                c = (event - (ends[row] - d[row])) / d[row]
                low = int(row[0])
                at = slice(low, int(row[-1]) + 1)
                with np.errstate(all="ignore"):
                    r0 = v["s0"][row] - c * v["d0"][row]
                    inv = 1 / r0
                    for to, what in ((log, np.log(r0)), (a0, inv), (a1, c * inv), (b0, inv * inv), (b1, c * inv * inv), (b2, c * c * inv * inv)):
                        to[at] += np.bincount(row - low, what)
            s1, d1 = [v[f"s1_{i}"] for i in range(p)], [v[f"d1_{i}"] for i in range(p)]
            sums = {"ll": v["fit"] - log}
            sums |= {f"g{i}": v[f"xe_{i}"] - (s1[i] * a0 - d1[i] * a1) for i in range(p)}
            sums |= {f"h{i}_{j}": v[f"s2_{i}_{j}"] * a0 - v[f"d2_{i}_{j}"] * a1
                     - (s1[i] * s1[j] * b0 - (s1[i] * d1[j] + d1[i] * s1[j]) * b1 + d1[i] * d1[j] * b2) for i, j in pairs}
            models, where = np.unique(m, return_inverse=True)
            yield _table({"m": models, **{k: np.bincount(where, sums[k], minlength=len(models)) for k in out}})

    return at.select("m", *names).mapInArrow(run, "m int, " + ", ".join(f"{k} double" for k in out))


def cox_sums(frame: Frame, betas: Mapping[int, np.ndarray], ties: str, bounds) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Log partial likelihood, gradient and negative Hessian of each model at its coefficients: one job."""
    p = frame.p
    risk = ["a0", *[f"a1_{i}" for i in range(p)], *[f"a2_{i}_{j}" for i, j in _pairs(p)]]
    per_t = _per_time(frame, betas, ties == "efron")
    at = prefix_scan(per_t, "t", {f"s{k[1:]}": F.col(k) for k in risk}, by=["m"], reverse=True, unique=True, bounds=bounds).where("d > 0")
    names = ["ll", *[f"g{i}" for i in range(p)], *[f"h{i}_{j}" for i, j in _pairs(p)]]
    if ties == "efron":
        aggs = [F.sum(k).alias(k) for k in names]
        at = _efron_sums(at, p, risk)
    else:
        mean = [F.col(f"s1_{i}") / F.col("s0") for i in range(p)]
        aggs = [F.sum(F.col("fit") - F.col("d") * F.log("s0")).alias("ll")]
        aggs += [F.sum(F.col(f"xe_{i}") - F.col("d") * mean[i]).alias(f"g{i}") for i in range(p)]
        aggs += [F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - mean[i] * mean[j])).alias(f"h{i}_{j}") for i, j in _pairs(p)]
    return {r["m"]: (r["ll"], np.array([r[f"g{i}"] for i in range(p)]), _symmetric(r, p)) for r in at.groupBy("m").agg(*aggs).collect()}


def _symmetric(r, p: int) -> np.ndarray:
    h = np.zeros((p, p))
    for i, j in _pairs(p):
        h[i, j] = h[j, i] = r[f"h{i}_{j}"]
    return h


def _solve(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
    if not np.isfinite(h).all() or np.linalg.cond(h / np.outer(scale, scale)) > 1e12:
        raise ValueError("the features are linearly dependent on the training rows of a model: give a ridge (l2)")
    return np.linalg.solve(h, g)


def _newton(start: dict[int, np.ndarray], evaluate, direction, max_iter: int, tol: float) -> dict[int, dict]:
    """Newton with halved steps for all models at once; ``evaluate`` takes the models still open."""
    at, step, best, open_, out = dict(start), {}, {}, set(start), {}
    for it in range(1, max_iter + 1):
        got = evaluate({m: at[m] for m in open_})
        for m in list(open_):
            value = got[m][0]
            if m in best and not value >= best[m][0] - 1e-12 * abs(best[m][0]):
                step[m] = step[m] / 2  # worse: half the step from the last good point
            else:
                best[m], step[m] = (value, at[m]), direction(got[m])
            at[m] = best[m][1] + step[m]
            done = np.max(np.abs(step[m])) < tol
            out[m] = {"at": at[m], "value": best[m][0], "iterations": it, "converged": bool(done)}
            if done:
                open_.discard(m)
        if not open_:
            break
    return out


def fit_cox_folds(df: DataFrame, time: str, event: str, features: Sequence[str], fold: str = "fold", ties: str = "efron", l2: float = 0.0,
                  with_all: bool = False, max_iter: int = 30, tol: float = 1e-9) -> dict:
    """SV16: a Cox model for each fold, trained on the other folds (and, if asked for, ``"all"``).

    Returns ``{"models": {name: {"coef", "mean", "loglik", "iterations", "converged"}}, ...}``; ``l2`` is the factor of
    ``|b|^2 / 2`` taken from the log-likelihood.  Without an event, or with dependent features and no ridge,
    a ``ValueError`` says so."""
    if ties not in ("efron", "breslow"):
        raise ValueError(f"unknown ties {ties!r}")
    frame = Frame(df, time, event, features, fold, with_all)
    bounds = quantile_bounds(frame.table.select("t").distinct(), "t")

    def evaluate(betas):
        got = cox_sums(frame, betas, ties, bounds)
        return {m: (ll - l2 / 2 * float(betas[m] @ betas[m]), g - l2 * betas[m], h + l2 * np.eye(frame.p)) for m, (ll, g, h) in got.items()}

    fitted = _newton({m: np.zeros(frame.p) for m in range(len(frame.names))}, evaluate, lambda s: _solve(s[2], s[1]), max_iter, tol)
    return {"features": frame.features, "fold": fold, "ties": ties, "frame": frame,
            "models": {frame.names[m]: {"coef": f["at"].tolist(), "mean": frame.means[m].tolist(), "loglik": float(f["value"]),
                                        "iterations": f["iterations"], "converged": f["converged"]} for m, f in fitted.items()}}


def cox_models(coefficients: Mapping, means: Mapping, features: Sequence[str], fold: str = "fold") -> dict:
    """Given coefficients and centres by fold, in the form that ``fit_cox_folds`` returns."""
    return {"features": list(features), "fold": fold, "models": {f: {"coef": list(c), "mean": list(means[f])} for f, c in coefficients.items()}}


def _by_model(fitted: dict, fold_type: str) -> tuple[list, Column, Column]:
    """Names, and literal maps from fold to coefficients and centre."""
    names = [f for f in fitted["models"] if f != ALL]
    table = [F.create_map(*[c for f in names for c in (F.lit(f).cast(fold_type), F.lit([float(v) for v in fitted["models"][f][key]]))]) for key in ("coef", "mean")]
    return names, *table


def cox_baseline(df: DataFrame, fitted: dict, time: str, event: str) -> DataFrame:
    """The baseline hazard of each fold's model, ``(fold, time, hazard, cumulative_hazard)``, from the training
    rows alone: events over the sum of the risk set's partial hazards, and its running sum.  Written once."""
    fold, features = fitted["fold"], fitted["features"]
    kind = df.schema[fold].dataType.simpleString()
    names, coef, mean = _by_model(fitted, kind)
    x = df.select(F.col(fold).alias("own"), F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"),
                  *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).dropna(subset=["t", "e", *[f"x{i}" for i in range(len(features))]])
    folds = F.array(*[F.lit(f).cast(kind) for f in names])
    x = x.select("*", F.explode(F.filter(folds, lambda f: ~f.eqNullSafe(F.col("own")))).alias("m"))
    x = x.withColumn("b", F.element_at(coef, F.col("m"))).withColumn("c", F.element_at(mean, F.col("m")))
    eta = sum(((F.col(f"x{i}") - F.col("c")[i]) * F.col("b")[i] for i in range(len(features))), F.lit(0.0))
    per_t = written(x.groupBy("m", "t").agg(F.sum("e").alias("d"), F.sum(F.exp(eta)).alias("a0")), "cox_times")
    bounds = quantile_bounds(per_t, "t")
    s = prefix_scan(per_t, "t", {"s0": "a0"}, by=["m"], reverse=True, unique=True, bounds=bounds).withColumn("hazard", F.col("d") / F.col("s0"))
    h = prefix_scan(s, "t", {"cumulative_hazard": "hazard"}, by=["m"], unique=True, bounds=bounds)
    return written(h.select(F.col("m").alias(fold), F.col("t").alias("time"), "hazard", "cumulative_hazard"), "cox_baseline")


def predict_cox_folds(df: DataFrame, fitted: dict, baseline: DataFrame, time: str, key: str = "id") -> DataFrame:
    """``(key, fold, oof_risk_score, oof_cumulative_hazard, oof_survival_probability)``: each row by the model
    that did not see it, at its own time.  The event column is never read."""
    fold, features = fitted["fold"], fitted["features"]
    _, coef, mean = _by_model(fitted, df.schema[fold].dataType.simpleString())
    x = df.select(key, fold, F.col(time).cast("double").alias("time"), F.element_at(coef, F.col(fold)).alias("b"), F.element_at(mean, F.col(fold)).alias("c"),
                  *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    eta = sum(((F.col(f"x{i}") - F.col("c")[i]) * F.col("b")[i] for i in range(len(features))), F.lit(0.0))
    x = x.select(key, fold, "time", F.exp(eta).alias("oof_risk_score"))
    x = lookup_asof(x, baseline.select(fold, "time", F.col("cumulative_hazard").alias("h0")), "time", ["h0"], key, by=[fold], initial={"h0": 0.0})
    H = F.when(F.col("time").isNotNull(), F.col("h0") * F.col("oof_risk_score"))
    return x.select(key, fold, "oof_risk_score", H.alias("oof_cumulative_hazard"), F.exp(-H).alias("oof_survival_probability"))


def coefficient_table(spark, fitted: dict) -> DataFrame:
    """``(feature, fold, coef, mean, std)``: coefficients of each fold's model, with mean and sample std over the folds (0 for one fold)."""
    names = [f for f in fitted["models"] if f != ALL]
    rows = []
    for i, f in enumerate(fitted["features"]):
        c = [float(fitted["models"][n]["coef"][i]) for n in names]
        rows += [(f, str(n), v, float(np.mean(c)), float(np.std(c, ddof=1)) if len(c) > 1 else 0.0) for n, v in zip(names, c)]
    return spark.createDataFrame(rows, "feature string, fold string, coef double, mean double, std double")


def _descend(g: np.ndarray, h: np.ndarray, start: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Coordinate descent on the quadratic model at ``start`` (gradient ``g``, negative Hessian ``h``) less the penalty."""
    b = start.copy()
    for _ in range(10_000):
        most = 0.0
        for j in range(len(b)):
            slope = g[j] - h[j] @ (b - start) + h[j, j] * b[j]
            new = np.sign(slope) * max(abs(slope) - l1, 0.0) / max(h[j, j] + l2, 1e-300)
            most, b[j] = max(most, abs(new - b[j])), new
        if most <= 1e-12 * max(1.0, np.abs(b).max()):
            break
    return b


def optimality(g: np.ndarray, b: np.ndarray, l1: float, l2: float) -> float:
    """How far the elastic-net optimality conditions are from holding (0: they hold)."""
    slope = g - l2 * b
    return float(np.max(np.where(b != 0, np.abs(slope - l1 * np.sign(b)), np.maximum(np.abs(slope) - l1, 0.0))))


def coxnet_path(df: DataFrame, time: str, event: str, features: Sequence[str], fold: str = "fold", n_alphas: int = 100, alpha_min_ratio: float = 1e-4,
                l1_ratio: float = 0.5, ties: str = "breslow", with_all: bool = False, max_iter: int = 50, tol: float = 1e-7) -> tuple[DataFrame, dict]:
    """SV17: elastic-net Cox coefficients along falling alphas for each fold's training rows.

    Maximises ``ll / n - alpha (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2)`` over the n training rows.  Each model
    starts at its own alpha_max, where all coefficients are 0, and takes the solution of one alpha as the start
    of the next: coordinate descent on the quadratic model of the risk-set sums, which one job a step brings for
    all folds, until the optimality conditions hold to ``tol`` times alpha.  A model goes on to its next alpha with the sums
    it has, without waiting for the others.

    Returns the table ``(fold, step, alpha, feature, coef, optimality, converged)`` and the models at the last alpha."""
    if not 0 < l1_ratio <= 1:
        raise ValueError("l1_ratio must be above 0 and at most 1")
    frame = Frame(df, time, event, features, fold, with_all)
    bounds = quantile_bounds(frame.table.select("t").distinct(), "t")
    m_all = range(len(frame.names))
    beta, k, tries = {m: np.zeros(frame.p) for m in m_all}, {m: 0 for m in m_all}, {m: 0 for m in m_all}
    alphas, good, rows = {}, {}, []
    while open_ := [m for m in m_all if k[m] < n_alphas]:
        sums = cox_sums(frame, {m: beta[m] for m in open_}, ties, bounds)
        for m in open_:
            n = frame.rows[m]
            ll, g, h = sums[m][0] / n, sums[m][1] / n, sums[m][2] / n
            if m not in alphas:
                top = np.abs(g).max() / l1_ratio
                alphas[m] = top * np.geomspace(1.0, alpha_min_ratio, n_alphas) if n_alphas > 1 else np.array([top])
            b = beta[m]
            while k[m] < n_alphas:
                a = alphas[m][k[m]]
                l1, l2 = a * l1_ratio, a * (1 - l1_ratio)
                value = ll - l1 * np.abs(b).sum() - l2 / 2 * float(b @ b)
                if m in good and not value >= good[m][0] - 1e-12 * abs(good[m][0]):
                    beta[m] = (good[m][1] + b) / 2  # worse than the last point of this alpha: half way back
                    tries[m] += 1
                    break
                off = optimality(g, b, l1, l2)
                if off > tol * a and tries[m] < max_iter:
                    good[m], tries[m] = (value, b), tries[m] + 1
                    beta[m] = _descend(g, h, b, l1, l2)
                    break
                rows += [(str(frame.names[m]), k[m], float(a), f, float(v), off, bool(off <= tol * a)) for f, v in zip(frame.features, b)]
                k[m], tries[m] = k[m] + 1, 0
                good.pop(m, None)
    table = df.sparkSession.createDataFrame(rows, "fold string, step int, alpha double, feature string, coef double, optimality double, converged boolean")
    return table, {"features": frame.features, "fold": fold, "ties": ties,
                   "models": {frame.names[m]: {"coef": beta[m].tolist(), "mean": frame.means[m].tolist()} for m in m_all}}


# --------------------------------------------------------------------------- accelerated failure time

FAMILIES = ("weibull", "loglogistic", "lognormal")


def _aft_terms(family: str, z: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value and first two derivatives by z of ``e ln f(z) + (1 - e) ln S(z)``, the density of the standard error."""
    if family == "weibull":
        u = np.exp(np.minimum(z, 700.0))
        return e * z - u, e - u, -u
    if family == "loglogistic":
        s = 1 / (1 + np.exp(-z))
        soft = np.where(z > 30, z, np.log1p(np.exp(np.minimum(z, 30.0))))
        return e * z - (1 + e) * soft, e - (1 + e) * s, -(1 + e) * s * (1 - s)
    if family == "lognormal":
        sf, logsf = np_norm_sf(z), np_norm_logsf(z)
        lam = np.where(z > 30, z + 1 / np.where(z > 30, z, 1.0), np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / sf)
        return e * (-z * z / 2 - 0.5 * math.log(2 * math.pi)) + (1 - e) * logsf, -e * z - (1 - e) * lam, -e - (1 - e) * lam * (lam - z)
    raise ValueError(f"unknown family {family!r}")


def aft_sums(frame: Frame, family: str, params: Mapping[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Log-likelihood, gradient and negative Hessian in (intercept, coefficients, ln sigma) of each model: one job.
    Tasks add up pieces of their rows for all models, and what leaves a task is a row for each piece and model."""
    p = frame.p
    params = {m: np.asarray(b, float) for m, b in params.items()}
    names = ["ll", *[f"g{i}" for i in range(p + 2)], *[f"h{i}_{j}" for i, j in _pairs(p + 2)]]

    def run(batches):
        for own, t, e, *x in _pieces(batches, ["own", "t", "e", *[f"x{i}" for i in range(p)]]):
            log_t = np.log(t)
            for m, b in params.items():
                on = own != m
                em, lt, row = e[on], log_t[on], [np.ones(int(on.sum())), *[c[on] for c in x]]
                s = math.exp(b[p + 1])
                with np.errstate(all="ignore"):
                    z = (lt - sum(c * k for c, k in zip(row, b[: p + 1]))) / s
                    v, d1, d2 = _aft_terms(family, z, em)
                    out = {"ll": np.sum(v - em * (b[p + 1] + lt)), f"g{p + 1}": np.sum(-z * d1 - em), f"h{p + 1}_{p + 1}": -np.sum(z * d1 + z * z * d2)}
                    a1, a2, a3 = -d1 / s, -d2 / (s * s), -(d1 + z * d2) / s
                    out |= {f"g{i}": np.sum(a1 * c) for i, c in enumerate(row)} | {f"h{i}_{p + 1}": np.sum(a3 * c) for i, c in enumerate(row)}
                    out |= {f"h{i}_{j}": np.sum(a2 * row[i] * row[j]) for i, j in _pairs(p + 1)}
                yield _table({"m": np.array([m]), **{k: np.array([out[k]]) for k in names}})

    parts = frame.table.mapInArrow(run, "m int, " + ", ".join(f"{k} double" for k in names))
    got = parts.groupBy("m").agg(*[F.sum(k).alias(k) for k in names]).collect()
    return {r["m"]: (r["ll"], np.array([r[f"g{i}"] for i in range(p + 2)]), _symmetric(r, p + 2)) for r in got}


def fit_aft_folds(df: DataFrame, family: str, time: str, event: str, features: Sequence[str], fold: str = "fold", l2: float = 0.0,
                  with_all: bool = False, max_iter: int = 60, tol: float = 1e-8) -> dict:
    """SV16: ``ln t = intercept + x.b + sigma * error`` with right censoring, a model for each fold on the other folds.

    ``family`` sets the error: smallest extreme value (Weibull), logistic or normal.  Newton on all parameters at
    once; where the Hessian is not definite a multiple of its diagonal is added.  ``l2`` spares intercept and
    sigma."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    frame = Frame(df, time, event, features, fold, with_all, positive=True)
    p = frame.p
    ridge = np.diag([0.0, *[l2] * p, 0.0])
    y = frame.table.agg(F.avg(F.log("t")).alias("m"), F.stddev_pop(F.log("t")).alias("s")).first()
    start = np.array([y["m"] or 0.0, *[0.0] * p, math.log(max(y["s"] or 1.0, 1e-3))])

    def evaluate(params):
        got = aft_sums(frame, family, params)
        return {m: (ll - 0.5 * float(params[m] @ ridge @ params[m]), g - ridge @ params[m], h + ridge) for m, (ll, g, h) in got.items()}

    def direction(sums):
        _, g, h = sums
        scale = np.maximum(np.abs(np.diag(h)), 1e-12)
        shift = 0.0
        while np.linalg.eigvalsh((h + shift * np.diag(scale)) / np.sqrt(np.outer(scale, scale))).min() < 1e-10:
            shift = max(2 * shift, 1e-3)
            if shift > 1e6:
                raise ValueError("the features are linearly dependent on the training rows of a model: give a ridge (l2)")
        step = np.linalg.solve(h + shift * np.diag(scale), g)
        return step / max(1.0, abs(step[-1]))  # ln sigma moves by one at most

    fitted = _newton({m: start for m in range(len(frame.names))}, evaluate, direction, max_iter, tol)
    models = {}
    for m, f in fitted.items():
        b = f["at"]
        models[frame.names[m]] = {"intercept": float(b[0] - b[1: p + 1] @ frame.centre), "coef": b[1: p + 1].tolist(), "sigma": float(math.exp(b[p + 1])),
                                  "loglik": float(f["value"]), "iterations": f["iterations"], "converged": f["converged"]}
    return {"features": frame.features, "fold": fold, "family": family, "frame": frame, "models": models}


def aft_models(family: str, params: Mapping, features: Sequence[str], fold: str = "fold") -> dict:
    """Given ``{fold: (intercept, coefficients, sigma)}``, in the form that ``fit_aft_folds`` returns."""
    return {"features": list(features), "fold": fold, "family": family,
            "models": {f: {"intercept": a, "coef": list(c), "sigma": s} for f, (a, c, s) in params.items()}}


def predict_aft_folds(df: DataFrame, fitted: dict, time: str, key: str = "id") -> DataFrame:
    """``(key, fold, oof_risk_score, oof_cumulative_hazard, oof_survival_probability, oof_median)``: each row by the
    model that did not see it, at its own time; the risk is ``-(intercept + x.b)``, so higher means earlier."""
    fold, family = fitted["fold"], fitted["family"]
    kind = df.schema[fold].dataType.simpleString()
    names = [f for f in fitted["models"] if f != ALL]
    table = F.create_map(*[c for f in names for c in (F.lit(f).cast(kind), F.lit(
        [float(v) for v in (fitted["models"][f]["intercept"], *fitted["models"][f]["coef"], fitted["models"][f]["sigma"])]))])
    p = len(fitted["features"])
    x = df.select(key, fold, F.col(time).cast("double").alias("t"), F.element_at(table, F.col(fold)).alias("b"),
                  *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(fitted["features"])])
    x = x.withColumn("eta", F.col("b")[0] + _eta(p, 1)).withColumn("z", F.when(F.col("t") > 0, (F.log("t") - F.col("eta")) / F.col("b")[p + 1]))
    z = F.col("z")
    if family == "weibull":
        H, middle = F.exp(z), F.lit(math.log(math.log(2.0)))
    elif family == "loglogistic":
        H, middle = F.when(z > 30, z).otherwise(F.log1p(F.exp(z))), F.lit(0.0)
    else:
        H, middle = -norm_logsf(z), F.lit(0.0)
    return x.select(key, fold, (-F.col("eta")).alias("oof_risk_score"), H.alias("oof_cumulative_hazard"), F.exp(-H).alias("oof_survival_probability"),
                    F.exp(F.col("eta") + F.col("b")[p + 1] * middle).alias("oof_median"))
