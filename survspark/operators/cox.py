"""Cox proportional hazards (SV16, SV17) with Breslow ties and optional ridge penalty.

Each Newton step: rows are collapsed per time into weighted sums of ``exp(x.b)``, ``x exp(x.b)``
and ``x x' exp(x.b)``; the risk-set sums over ``t' >= t`` are one reverse bucketed prefix scan;
gradient and Hessian are one aggregate over the event times.  Only ``p + p^2`` numbers per
step reach the driver.  Survival at each row's own time uses the Breslow baseline, a forward
scan, and is evaluated per row (no n x n matrix).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import prefix_scan, quantile_bounds


def _eta(features: Sequence[str], beta: np.ndarray):
    e = F.lit(0.0)
    for f, b in zip(features, beta):
        e = e + F.col(f) * F.lit(float(b))
    return e


def fit_cox(df: DataFrame, time: str, event: str, features: Sequence[str], l2: float = 0.0, max_iter: int = 25,
            tol: float = 1e-9) -> dict:
    """Newton-Raphson on the Breslow partial likelihood; returns ``{"coef", "means", "iterations"}``.
    Features are centred (means kept) for numerical stability; rows with missing values are dropped.
    Steps are halved until the likelihood does not fall; ``converged`` is False where ``max_iter`` ended
    the search.  Without an event, or with linearly dependent features and no ridge, there is no single
    maximum and a ``ValueError`` says so."""
    feats = list(features)
    p = len(feats)
    clean = df.select(time, event, *feats).dropna()
    means = clean.agg(*[F.avg(f).alias(f) for f in feats], F.sum(F.col(event).cast("double")).alias("__d")).first()
    if not means["__d"]:
        raise ValueError("no event in the data: the partial likelihood has no maximum")
    mu = np.array([float(means[f]) for f in feats])
    x = clean.select(F.col(time).cast("double").alias("__t"), F.col(event).cast("double").alias("__e"),
                     *[(F.col(f) - F.lit(m)).alias(f) for f, m in zip(feats, mu)]).persist(StorageLevel.MEMORY_AND_DISK)
    beta, kept, best, step, converged = np.zeros(p), np.zeros(p), -np.inf, None, False
    it = 0
    try:
        # the distinct times do not change between steps: cut them once
        bounds = quantile_bounds(x.select("__t").distinct(), "__t")
        for it in range(1, max_iter + 1):
            w = F.exp(_eta(feats, beta))
            sums = {"a0": F.sum(w)}
            for i, f in enumerate(feats):
                sums[f"a1_{i}"] = F.sum(w * F.col(f))
                sums[f"xe_{i}"] = F.sum(F.col("__e") * F.col(f))
                for j in range(i, p):
                    sums[f"a2_{i}_{j}"] = F.sum(w * F.col(f) * F.col(feats[j]))
            per_t = x.groupBy("__t").agg(F.sum("__e").alias("d"), *[v.alias(k) for k, v in sums.items()])
            risk = {f"s_{k}": F.col(k) for k in sums if k.startswith("a")}
            sc = prefix_scan(per_t, "__t", risk, reverse=True, unique=True, bounds=bounds).filter(F.col("d") > 0)
            s0 = F.col("s_a0")
            fit = sum((F.col(f"xe_{i}") * F.lit(float(b)) for i, b in enumerate(beta)), F.lit(0.0))
            aggs = [F.sum(fit - F.col("d") * F.log(s0)).alias("ll")]
            for i in range(p):
                aggs.append(F.sum(F.col(f"xe_{i}") - F.col("d") * F.col(f"s_a1_{i}") / s0).alias(f"g{i}"))
                for j in range(i, p):
                    aggs.append(F.sum(F.col("d") * (F.col(f"s_a2_{i}_{j}") / s0
                                                    - F.col(f"s_a1_{i}") * F.col(f"s_a1_{j}") / (s0 * s0))).alias(f"h{i}_{j}"))
            r = sc.agg(*aggs).first()
            ll = r["ll"] - 0.5 * l2 * float(beta @ beta)
            if step is not None and not ll >= best - 1e-12 * abs(best):  # worse: half the step from the last good point
                step = step / 2
            else:
                kept, best = beta, ll
                g = np.array([r[f"g{i}"] for i in range(p)]) - l2 * beta
                h = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        h[i, j] = h[j, i] = r[f"h{i}_{j}"]
                h += l2 * np.eye(p)
                scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
                if np.linalg.cond(h / np.outer(scale, scale)) > 1e12:
                    raise ValueError("the features are linearly dependent on the risk sets: give a ridge (l2)")
                step = np.linalg.solve(h, g)
            beta = kept + step
            if np.max(np.abs(step)) < tol:
                converged = True
                break
    finally:
        x.unpersist()
    return {"coef": dict(zip(feats, beta.tolist())), "means": dict(zip(feats, mu.tolist())), "iterations": it,
            "converged": converged}


def predict_cox(df: DataFrame, model: dict, time: str, event: str, key: str = "id") -> DataFrame:
    """SV16: ``risk = (x - mean).b``, cumulative hazard and survival at the row's own time
    (Breslow baseline from the same rows)."""
    feats = list(model["coef"])
    beta = np.array([model["coef"][f] for f in feats])
    centred = df.select(key, F.col(time).cast("double").alias("__t"), F.col(event).cast("double").alias("__e"),
                        *[(F.col(f) - F.lit(model["means"][f])).alias(f) for f in feats]).dropna()
    x = centred.withColumn("risk", _eta(feats, beta))
    per_t = x.groupBy("__t").agg(F.sum("__e").alias("d"), F.sum(F.exp("risk")).alias("a0"))
    bounds = quantile_bounds(per_t, "__t")
    s = prefix_scan(per_t, "__t", {"s0": "a0"}, reverse=True, unique=True, bounds=bounds)
    h0 = prefix_scan(s.withColumn("inc", F.col("d") / F.col("s0")), "__t", {"h0": "inc"}, unique=True, bounds=bounds)
    out = x.join(h0.select("__t", "h0"), "__t")
    H = F.col("h0") * F.exp("risk")
    return out.select(key, "risk", H.alias("cumulative_hazard"), F.exp(-H).alias("survival"))
