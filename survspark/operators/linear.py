"""Linear, ridge and logistic regression of all folds at once (ML4, ML9).

Linear models need only second moments: one aggregate brings those of every fold, and the training moments of a
fold are the total less its own, so seven folds cost one scan.  Logistic regression takes Newton steps; a
step lays each row out once for each model that it trains and brings every model's gradient and Hessian in one
job.  ``p^2`` numbers a fold reach the driver.

Defined cases: rows with a missing feature or target train nothing, and rows with a missing feature score
null; rows of a null fold train every model and are scored by none; weights count as repeated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _columns(df: DataFrame, features: Sequence[str], target: str, fold: str, weight: str | None) -> DataFrame:
    cols = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.col(fold).alias("fold"), F.col(target).cast("double").alias("y"), w.alias("w"), *cols).dropna(
        subset=["y", "w", *[f"x{i}" for i in range(len(cols))]])


def _moments(x: DataFrame, p: int) -> tuple[np.ndarray, dict]:
    """Shift near the means, and the weighted moments of (1, x - shift, y - shift) of each fold."""
    names = [f"x{i}" for i in range(p)] + ["y"]
    means = x.agg(*[F.avg(c).alias(c) for c in names]).first()
    shift = np.array([means[c] or 0.0 for c in names])
    z = [F.lit(1.0), *[F.col(c) - F.lit(float(s)) for c, s in zip(names, shift)]]
    sums = x.groupBy("fold").agg(*[F.sum(F.col("w") * z[i] * z[j]).alias(f"m{i}_{j}") for i, j in _pairs(p + 2)]).collect()  # one row a fold
    out = {}
    for r in sums:
        m = np.zeros((p + 2, p + 2))
        for i, j in _pairs(p + 2):
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        out[r["fold"]] = m
    return shift, out


def _solve(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    if np.linalg.cond(a / np.outer(scale, scale)) > 1e12:
        raise ValueError("the features are linearly dependent on the training rows of a model: give a ridge (l2)")
    return np.linalg.solve(a, c)


def fit_linear_folds(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold", l2: float = 0.0, weight: str | None = None) -> dict:
    """Least squares (or ridge: ``l2 |b|^2`` added to the squared error, the intercept spared) for each fold on the
    others; ``{"models": {fold: {"intercept", "coef"}}}``."""
    p = len(features)
    shift, moments = _moments(_columns(df, features, target, fold, weight), p)
    total = sum(moments.values())
    models = {}
    for f in sorted(k for k in moments if k is not None):
        m = total - moments[f]
        n, s = m[0, 0], m[0, 1:]
        if not n > 0:
            raise ValueError(f"no training rows for fold {f}")
        centred = m[1:, 1:] - np.outer(s, s) / n
        coef = _solve(centred[:p, :p] + l2 * np.eye(p), centred[:p, p])
        mean = s / n + shift
        models[f] = {"intercept": float(mean[p] - coef @ mean[:p]), "coef": coef.tolist()}
    return {"features": list(features), "fold": fold, "models": models, "link": "identity"}


def fit_logistic_folds(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold", l2: float = 1.0, weight: str | None = None,
                       max_iter: int = 50, tol: float = 1e-9) -> dict:
    """Logistic regression for each fold on the others: the weighted log-loss plus ``l2 |b|^2 / 2``, the
    intercept spared, by Newton steps that are halved until the loss falls."""
    p = len(features)
    x = _columns(df, features, target, fold, weight)
    means = x.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(p)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(p)]).first()
    centre, spread = (np.array([means[f"{c}{i}"] or 0.0 for i in range(p)]) for c in "xs")
    spread = np.where(spread > 0, spread, 1.0)
    x = written(x.select("fold", "y", "w", *[((F.col(f"x{i}") - F.lit(float(centre[i]))) / F.lit(float(spread[i]))).alias(f"x{i}") for i in range(p)]), "logistic_rows")
    names = sorted(r[0] for r in x.select("fold").distinct().collect() if r[0] is not None)
    number = F.coalesce(*[F.when(F.col("fold") == F.lit(f), F.lit(i)) for i, f in enumerate(names)], F.lit(-1)) if names else F.lit(-1)
    ridge = np.diag([0.0, *(l2 / spread ** 2)])
    at = {m: np.zeros(p + 1) for m in range(len(names))}
    best, step, open_, out = {}, {}, set(at), {}
    row = [F.lit(1.0), *[F.col(f"x{i}") for i in range(p)]]

    def sums(params: dict) -> dict:
        table = F.create_map(*[c for m, b in params.items() for c in (F.lit(m), F.lit([float(v) for v in b]))])
        long = x.select("*", F.explode(F.filter(F.lit(sorted(params)), lambda m: m != number)).alias("m")).withColumn("b", F.element_at(table, F.col("m")))
        eta = sum((F.col("b")[i] * c for i, c in enumerate(row)), F.lit(0.0))
        long = long.withColumn("eta", eta).withColumn("q", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("eta"))))
        loss = F.when(F.col("eta") > 30, F.col("eta")).otherwise(F.log1p(F.exp("eta"))) - F.col("y") * F.col("eta")
        aggs = [F.sum(F.col("w") * loss).alias("loss")] + [F.sum(F.col("w") * (F.col("q") - F.col("y")) * c).alias(f"g{i}") for i, c in enumerate(row)]
        aggs += [F.sum(F.col("w") * F.col("q") * (1 - F.col("q")) * row[i] * row[j]).alias(f"h{i}_{j}") for i, j in _pairs(p + 1)]
        got = {}
        for r in long.groupBy("m").agg(*aggs).collect():  # one row a fold
            h = np.zeros((p + 1, p + 1))
            for i, j in _pairs(p + 1):
                h[i, j] = h[j, i] = r[f"h{i}_{j}"]
            b = params[r["m"]]
            got[r["m"]] = (r["loss"] + 0.5 * float(b @ ridge @ b), np.array([r[f"g{i}"] for i in range(p + 1)]) + ridge @ b, h + ridge)
        return got

    for it in range(1, max_iter + 1):
        got = sums({m: at[m] for m in open_})
        for m in list(open_):
            loss, g, h = got[m]
            if m in best and not loss <= best[m][0] + 1e-12 * abs(best[m][0]):
                step[m] = step[m] / 2
            else:
                best[m], step[m] = (loss, at[m]), -_solve(h, g)
            at[m] = best[m][1] + step[m]
            done = np.max(np.abs(step[m])) < tol
            coef = at[m][1:] / spread
            out[names[m]] = {"intercept": float(at[m][0] - coef @ centre), "coef": coef.tolist(), "iterations": it, "converged": bool(done)}
            if done:
                open_.discard(m)
        if not open_:
            break
    return {"features": list(features), "fold": fold, "models": out, "link": "logit"}


def predict_folds_linear(df: DataFrame, fitted: dict, key: str = "id") -> DataFrame:
    """``(key, fold, prediction)``: each row by the model that did not see it."""
    fold, p = fitted["fold"], len(fitted["features"])
    kind = df.schema[fold].dataType.simpleString()
    table = F.create_map(*[c for f, m in fitted["models"].items() for c in (F.lit(f).cast(kind), F.lit([float(v) for v in (m["intercept"], *m["coef"])]))])
    x = df.select(key, fold, F.element_at(table, F.col(fold)).alias("b"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(fitted["features"])])
    eta: Column = F.col("b")[0]
    for i in range(p):
        eta = eta + F.col("b")[i + 1] * F.col(f"x{i}")
    return x.select(key, fold, (F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)) if fitted["link"] == "logit" else eta).alias("prediction"))
