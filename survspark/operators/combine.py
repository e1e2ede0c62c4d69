"""Prediction combination and post-processing (PP1-PP13, WN1, ML10, ML12, JN1, PR5, PR6).

Everything here is a projection, a keyed join or a keyed aggregation; the only ordered
operator, the percentile rank, runs on the bucketed prefix scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import weighted_sum
from .scan import prefix_scan

# fixed values: blend weights of the published ensembles
CLASSIFIER_BLEND = {"p1": 0.45, "p2": 0.05, "p3": 0.05, "p4": 0.2, "p5": 0.125, "p6": 0.125}
CLASSIFIER_BLEND_2 = {"p1": 0.975, "p2": 0.025}
RANKING_BLEND = {"r1": 0.29, "r2": 0.29, "r3": 0.29, "r4": 0.06, "r5": 0.07}


def rank_pct(df: DataFrame, col: str, out: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """WN1/PP5: percentile rank with average ties, ``rank / n`` (pandas ``rank(pct=True)``).

    Values are collapsed to ``(by, value, count)``; an exclusive prefix scan gives the number of
    smaller values; ``rank = (smaller + (count + 1) / 2) / n``.  Missing values keep a null rank
    and do not count in ``n``.  The rank table is equi-joined back on ``(by, value)``.
    """
    by = list(by)
    ok = F.col(col).isNotNull() & ~F.isnan(F.col(col))
    for g in by:
        ok = ok & F.col(g).isNotNull()
    cnt = df.filter(ok).groupBy(*by, F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    sc = prefix_scan(cnt, "__v", {"__lt": "__c"}, by=by, exclusive=True, unique=True, buckets=buckets)
    if by:
        tot = cnt.groupBy(*by).agg(F.sum("__c").alias("__n"))
        sc = sc.join(tot, by, "left")
        n = F.col("__n")
    else:
        n = F.lit(int(df.filter(ok).count()))
    ranks = sc.select(*by, "__v", ((F.col("__lt") + (F.col("__c") + F.lit(1)) / F.lit(2.0)) / n).alias(out))
    x = df.withColumn("__v", F.col(col))
    res = x.join(ranks, [*by, "__v"], "left").drop("__v")
    return res


def blend(df: DataFrame, weights: Mapping[str, float], out: str = "prediction") -> DataFrame:
    """PR6/PP6-PP8: weighted linear blend, summed left to right in the given order."""
    return df.withColumn(out, weighted_sum(list(weights.items())))


def two_stage(df: DataFrame, prob: str, reg: str, target: str, out: str = "prediction",
              keep_raw: str | None = "reg_1_prediction") -> DataFrame:
    """PP1-PP4: combine event probability ``p`` with a regression output ``r``.

    ``log_time``: ``p / exp(r)``; ``time``: ``p / r``; survival-probability, hazard and
    generalized-gamma targets: ``p * exp(r)``.  The raw regression output is kept as
    ``reg_1_prediction``.  Unknown targets raise.
    """
    p, r = F.col(prob), F.col(reg)
    if target in ("log_time", "log_efs_time"):
        e = p / F.exp(r)
    elif target in ("time", "efs_time"):
        e = p / r
    elif target in ("log_km_survival_probability", "km_survival_probability", "na_cumulative_hazard",
                    "na_hazard_rate", "gg_cumulative_hazard", "cumulative_hazard", "survival_probability"):
        e = p * F.exp(r)
    else:
        raise ValueError(f"no two-stage rule for target {target!r}")
    x = df.withColumn(keep_raw, r) if keep_raw else df
    return x.withColumn(out, e)


def scale_where(df: DataFrame, col: str, rules: Sequence[tuple[Column, float]]) -> DataFrame:
    """PR5: ``df.loc[mask, col] *= k`` for each ``(mask, k)``, applied in order."""
    e = F.col(col)
    for cond, k in rules:
        e = F.when(cond, e * F.lit(float(k))).otherwise(e)
    return df.withColumn(col, e)


def group_multiplier(df: DataFrame, col: str, group: str, factors: Mapping[str, float]) -> DataFrame:
    """PP9: multiply ``col`` by a per-group factor (groups not listed are unchanged)."""
    return scale_where(df, col, [(F.col(group) == g, k) for g, k in factors.items()])


def snap_extremes(df: DataFrame, col: str, lo: float = 0.03, hi: float = 0.97) -> DataFrame:
    """PP10: probabilities ``>= hi`` become 1 and ``<= lo`` become 0."""
    c = F.col(col)
    return df.withColumn(col, F.when(c >= hi, F.lit(1.0)).when(c <= lo, F.lit(0.0)).otherwise(c))


def threshold_grid(stop: float = 0.33, step: float = 0.01) -> list[tuple[float, float, float]]:
    """``(low, high, factor)`` of the post-processing grid as the float loop produces them:
    ``low = i * step`` for ``i`` while ``low < stop``, ``high = low + step``, ``factor = high``."""
    if not step > 0:
        raise ValueError("step must be positive")
    out, i = [], 0
    while i * step < stop:
        lo = i * step
        out.append((lo, lo + step, lo + step))
        i += 1
    return out


def threshold_scaling(df: DataFrame, prob: str, score: str, stop: float = 0.33, step: float = 0.01,
                      out: str | None = None) -> DataFrame:
    """PP12: for each grid cell ``[low, high)`` of the event probability, multiply the score by
    ``high``, cells applied in order.  Float cell edges overlap or leave gaps exactly where the
    float loop does, so the literal bounds are used, not ``floor(p / step)``."""
    p = F.col(prob)
    e = F.col(score)
    for lo, hi, k in threshold_grid(stop, step):
        e = e * F.when((p >= F.lit(lo)) & (p < F.lit(hi)), F.lit(k)).otherwise(F.lit(1.0))
    return df.withColumn(out or score, e)


def prediction_error(df: DataFrame, event: str, prob: str, out: str | None = None) -> DataFrame:
    """PP11: ``event - p``."""
    return df.withColumn(out or f"{prob}_error", F.col(event) - F.col(prob))


def seed_average(long: DataFrame, key: str = "id", value: str = "prediction",
                 by: Sequence[str] = ()) -> DataFrame:
    """ML10: average the predictions of all seeds per row (``+= pred / len(seeds)``)."""
    return long.groupBy(key, *by).agg(F.avg(value).alias(value))


def fold_rank_average(long: DataFrame, key: str = "id", model: str = "model", value: str = "prediction",
                      buckets: int | None = None) -> DataFrame:
    """ML12: rank-transform each fold model's predictions over the scored rows, then average
    the ranks per row."""
    r = rank_pct(long, value, "__rank", by=[model], buckets=buckets)
    return r.groupBy(key).agg(F.avg("__rank").alias(value))


def attach(df: DataFrame, other: DataFrame, key: str = "id", cols: Sequence[str] | None = None,
           rename: Mapping[str, str] | None = None) -> DataFrame:
    """JN1/PR2: the reference's positional concat, as a left equi-join on the key."""
    cols = list(cols or [c for c in other.columns if c != key])
    o = other.select(key, *[F.col(c).alias((rename or {}).get(c, c)) for c in cols])
    return df.join(o, key, "left")


def append_oof(parts: Sequence[DataFrame]) -> DataFrame:
    """PP13/ST1: union of per-fold outputs aligned by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
