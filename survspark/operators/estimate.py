"""Non-parametric survival estimators (SV1-SV8, SV15, SV18).

Plan: collapse rows to one row per ``(group, time)`` (partial aggregation before the shuffle),
run the bucketed prefix scan for the at-risk counts and a second one for the running
log-survival / hazard sums, and equi-join the curve back to rows on ``(group, time)``.
Every row time is a curve time, so the step-function lookup is an equi-join; rows never
travel through one task.

Step semantics follow the usual right-continuous estimators: the value at ``t`` includes the
events at ``t``; before the first time S=1 and H=0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .scan import prefix_scan, scan_stats

# fixed value: normal quantile for a 95% band
Z_95 = 1.959963984540054
# terms 1/k with k up to this are added one by one, the others in closed form
HEAD = 32


def _tail(n: Column, d: Column) -> tuple[Column, Column, Column]:
    """(m, n, n - m) as doubles: the terms k = m + 1 .. n of a tie of ``d`` among ``n`` lie above ``HEAD``."""
    m = F.greatest(n - d, F.least(n, F.lit(HEAD)))
    return m.cast("double"), n.cast("double"), (n - m).cast("double")


def _head(n: Column, d: Column, power: int) -> Column:
    """Sum of 1/k^power over the terms k = n - d + 1 .. n that do not exceed ``HEAD``: two entries of a short table of sums."""
    sums = [0.0]
    for k in range(1, HEAD + 1):
        sums.append(sums[-1] + 1.0 / k ** power)
    at = lambda k: F.lit(sums)[F.greatest(F.least(k, F.lit(HEAD)), F.lit(0)).cast("int")]
    return at(n) - at(n - d)


def smooth_increment(n: Column, d: Column) -> Column:
    """Nelson-Aalen tie-smoothed increment: sum_{j=0}^{d-1} 1/(n-j) (= H_n - H_{n-d}), the same way for
    every size of tie: the smallest ``HEAD`` terms one by one, the others by the Euler-Maclaurin series of
    the harmonic numbers, written as differences so that small ties lose no digits."""
    m, n_, gap = _tail(n, d)
    part = lambda k: F.pow(n_, F.lit(-float(k))) - F.pow(m, F.lit(-float(k)))
    tail = (-F.log1p(-gap / n_) - gap / (F.lit(2.0) * n_ * m) - part(2) / F.lit(12.0) + part(4) / F.lit(120.0)
            - part(6) / F.lit(252.0))
    return F.when(d <= 0, F.lit(0.0)).otherwise(_head(n, d, 1) + F.when(gap > 0, tail).otherwise(F.lit(0.0)))


def smooth_variance(n: Column, d: Column) -> Column:
    """Variance term of the smoothed estimator: sum_{j=0}^{d-1} 1/(n-j)^2, as ``smooth_increment``."""
    m, n_, gap = _tail(n, d)
    part = lambda k: F.pow(m, F.lit(-float(k))) - F.pow(n_, F.lit(-float(k)))
    tail = (gap / (n_ * m) - part(2) / F.lit(2.0) + part(3) / F.lit(6.0) - part(5) / F.lit(30.0) + part(7) / F.lit(42.0))
    return F.when(d <= 0, F.lit(0.0)).otherwise(_head(n, d, 2) + F.when(gap > 0, tail).otherwise(F.lit(0.0)))


def _clean(df: DataFrame, time: str, event: str, by: Sequence[str]) -> DataFrame:
    cond = F.col(time).isNotNull() & ~F.isnan(F.col(time)) & F.col(event).isNotNull()
    for g in by:
        cond = cond & F.col(g).isNotNull()
    return df.filter(cond)


def survival_curve(df: DataFrame, time: str = "time", event: str = "event", by: Sequence[str] = (),
                   buckets: int | None = None) -> DataFrame:
    """One row per ``(by, time)``: counts, at-risk, and every curve value at that time.

    Columns: ``removed`` (rows at t), ``observed`` (events at t), ``censored``, ``at_risk`` (rows
    with time >= t), ``events_cum`` (events <= t), ``km_events_only`` (Kaplan-Meier fitted on event
    rows only), ``km`` (Kaplan-Meier with censoring), ``greenwood`` (sum d/(n(n-d))),
    ``na_smooth``/``na_breslow`` (cumulative hazards), ``na_smooth_inc``/``na_breslow_inc`` (the
    increments at t, i.e. the discrete hazard rate), ``na_var`` (smoothed variance sum).
    """
    by = list(by)
    return _curve(_counts(_clean(df, time, event, by), time, event, by), by, buckets)


def _counts(base: DataFrame, time: str, event: str, by: Sequence[Column | str]) -> DataFrame:
    """One row per (group, time): the only table the scans touch."""
    return written(base.groupBy(*by, F.col(time).cast("double").alias("time")).agg(
        F.count(F.lit(1)).alias("removed"), F.sum(F.col(event)).cast("long").alias("observed")), "curve_counts")


def _curve(counts: DataFrame, by: list[str], buckets: int | None) -> DataFrame:
    """The curves of ``survival_curve`` from stored counts: a scan for the at-risk counts, stored with the increments, and a
    scan for their sums."""
    bounds, _ = scan_stats(counts, "time", buckets, force=buckets is not None)
    s1 = prefix_scan(counts, "time", {"at_risk": "removed"}, by=by, reverse=True, unique=True, bounds=bounds)
    n, d = F.col("at_risk"), F.col("observed")
    full = d >= n
    # stored: the increments are computed once, for the totals of the second scan and for its rows
    s1 = written(s1.select(
        *by, "time", "removed", "observed", n.cast("long").alias("at_risk"),
        F.when(full, F.lit(0.0)).otherwise(F.log1p(-d / n)).alias("__log_s"), F.when(full & (d > 0), 1).otherwise(0).alias("__zero"),
        F.when(full, F.lit(0.0)).otherwise(d / (n.cast("double") * (n - d))).alias("__gw"), smooth_increment(n, d).alias("na_smooth_inc"),
        smooth_variance(n, d).alias("__var")), "curve_steps")
    s2 = prefix_scan(
        s1, "time",
        {"events_cum": "observed", "__ls": "__log_s", "__z": "__zero", "greenwood": "__gw", "na_smooth": "na_smooth_inc",
         "na_breslow": F.col("observed") / F.col("at_risk"), "na_var": "__var"},
        by=by, unique=True, bounds=bounds)
    if by:
        s2 = s2.join(counts.groupBy(*by).agg(F.sum("observed").alias("__E")), by)
    else:
        s2 = s2.crossJoin(F.broadcast(counts.agg(F.sum("observed").alias("__E"))))  # one row
    km_eo = F.when(F.col("__E") > 0, F.lit(1.0) - F.col("events_cum") / F.col("__E")).otherwise(F.lit(1.0))
    km = F.when(F.col("__z") > 0, F.lit(0.0)).otherwise(F.exp(F.col("__ls")))
    return s2.select(
        *by, "time", "removed", "observed", (F.col("removed") - F.col("observed")).alias("censored"), "at_risk", "events_cum",
        km_eo.alias("km_events_only"), km.alias("km"), "greenwood",
        "na_smooth", "na_smooth_inc",
        "na_breslow", (F.col("observed") / F.col("at_risk")).alias("na_breslow_inc"), "na_var",
    )


def attach_curve(df: DataFrame, curve: DataFrame, cols: dict[str, str], time: str = "time",
                 by: Sequence[str] = ()) -> DataFrame:
    """JN2/JN4/SV4/SV7: scatter curve values back to rows by ``(by, time)`` (left equi-join).

    ``cols`` maps output names to curve columns.  Rows with a missing time or group get null.
    """
    by = list(by)
    c = curve.select(*by, F.col("time").alias("__ct"), *[F.col(v).alias(k) for k, v in cols.items()])
    x = df.withColumn("__rt", F.col(time).cast("double"))
    out = x.join(c, [x["__rt"] == c["__ct"], *[x[g] == c[g] for g in by]], "left")
    for g in by:
        out = out.drop(c[g])
    return out.drop("__rt", "__ct")


def kaplan_meier(df: DataFrame, time: str = "time", event: str = "event", by: Sequence[str] = (),
                 events_only: bool = True, buckets: int | None = None) -> DataFrame:
    """SV1-SV3: Kaplan-Meier curve ``(by, time, at_risk, observed, survival)``."""
    c = survival_curve(df, time, event, by, buckets)
    col = "km_events_only" if events_only else "km"
    return c.select(*by, "time", "at_risk", "observed", F.col(col).alias("survival"))


def nelson_aalen(df: DataFrame, time: str = "time", event: str = "event", by: Sequence[str] = (),
                 ties: str = "smooth", buckets: int | None = None) -> DataFrame:
    """SV5/SV6: cumulative hazard curve ``(by, time, at_risk, observed, cumulative_hazard, hazard_rate)``."""
    if ties not in ("smooth", "breslow"):
        raise ValueError(f"unknown tie handling {ties!r}")
    c = survival_curve(df, time, event, by, buckets)
    return c.select(*by, "time", "at_risk", "observed", F.col(f"na_{ties}").alias("cumulative_hazard"),
                    F.col(f"na_{ties}_inc").alias("hazard_rate"))


def curve_table(df: DataFrame, time: str = "time", event: str = "event", by: Sequence[str] = (),
                z: float = Z_95, buckets: int | None = None) -> DataFrame:
    """SV18: numbers behind the survival plots, one row per time.

    KM with log-log (exponential Greenwood) band, cumulative density ``1 - S``, censor counts,
    Nelson-Aalen cumulative hazard with its log-transformed band.
    """
    c = survival_curve(df, time, event, by, buckets)
    s, v = F.col("km"), F.col("greenwood")
    ls = F.log(s)
    ok = (s > 0) & (s < 1)
    half = F.lit(z) * F.sqrt(v) / (-ls)
    lower = F.when(ok, F.exp(-F.exp(F.log(-ls) + half))).when(s >= 1, F.lit(1.0))
    upper = F.when(ok, F.exp(-F.exp(F.log(-ls) - half))).when(s >= 1, F.lit(1.0))
    h, hv = F.col("na_smooth"), F.col("na_var")
    hpos = h > 0
    return c.select(
        *by, "time", "at_risk", "observed", "censored",
        s.alias("survival"), (F.lit(1.0) - s).alias("cumulative_density"),
        lower.alias("survival_lower"), upper.alias("survival_upper"),
        h.alias("cumulative_hazard"),
        F.when(hpos, h * F.exp(-F.lit(z) * F.sqrt(hv) / h)).alias("hazard_lower"),
        F.when(hpos, h * F.exp(F.lit(z) * F.sqrt(hv) / h)).alias("hazard_upper"),
    )


def survival_targets(df: DataFrame, id_col: str = "id", time: str = "time", event: str = "event",
                     group: str | None = "grp", buckets: int | None = None) -> DataFrame:
    """SV15 + TG3-TG5: the per-row target table.

    ``survival_probability`` (KM on event rows, evaluated at every row's time),
    ``cumulative_hazard`` and ``hazard_rate`` (smoothed Nelson-Aalen on all rows), each also per
    group as ``group_*``; then ``log_km_survival_probability`` (log1p, min-shifted, max-scaled),
    ``na_cumulative_hazard = -exp(H)`` and ``na_hazard_rate = -exp(h)``.
    """
    # the rows are collapsed once, per group; the overall counts are sums of these, and one pair of scans serves both
    base = _clean(df, time, event, ())
    key = F.col(group).cast("string").alias("__g") if group else F.lit(None).cast("string").alias("__g")
    counts = _counts(base, time, event, [key])
    scoped = counts.groupBy("time").agg(F.sum("removed").alias("removed"), F.sum("observed").alias("observed")).select(
        F.lit(0).alias("__scope"), F.lit("").alias("__g"), "time", "removed", "observed")
    if group:
        scoped = scoped.unionByName(counts.where("__g IS NOT NULL").withColumn("__scope", F.lit(1)))
    curve = written(_curve(written(scoped, "curve_scopes"), ["__scope", "__g"], buckets).select(
        "__scope", "__g", "time", "km_events_only", "na_smooth", "na_smooth_inc"), "curve")
    g = curve.where("__scope = 0")
    out = attach_curve(df.select(id_col, time, *([group, F.col(group).cast("string").alias("__g")] if group else [])), g,
                       {"survival_probability": "km_events_only", "cumulative_hazard": "na_smooth",
                        "hazard_rate": "na_smooth_inc"}, time=time)
    if group:
        out = attach_curve(out, curve.where("__scope = 1"), {"group_survival_probability": "km_events_only",
                                     "group_cumulative_hazard": "na_smooth",
                                     "group_hazard_rate": "na_smooth_inc"}, time=time, by=["__g"]).drop("__g")
    # TG3: min/max of log1p(S) over rows = over the curve (every row time is a curve time), so the
    # two statistics come from the small curve table instead of another pass over the rows
    r = g.agg(F.min(F.log1p("km_events_only")).alias("lo"), F.max(F.log1p("km_events_only")).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    lk = F.log1p(F.col("survival_probability")) - F.lit(lo)
    # a constant column has no scale: null, as in ``min_max_scale``
    out = out.withColumn("log_km_survival_probability",
                         lk / F.lit(float(hi) - float(lo)) if hi != lo else F.lit(None).cast("double"))
    return (out.withColumn("na_cumulative_hazard", -F.exp(F.col("cumulative_hazard")))
               .withColumn("na_hazard_rate", -F.exp(F.col("hazard_rate"))))
