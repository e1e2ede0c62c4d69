"""Metrics (MT4-MT15, AG7, AG8, AG12, ML11, ML14, SO1, SO2, WN5, ST1, ST2).

Overall and per-group values come from one pass: rows are fed under a ``scope`` key (0 =
overall, 1 = per group), the same idea as ``GROUPING SETS ((group), ())``.  Curves are built
from distinct scores with a bucketed prefix scan; each curve point carries its neighbour so
trapezoids and grid interpolation need no ordered window over the whole curve.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import slug
from .concord import concordance_counts
from .scan import prefix_scan

# fixed value: float64 machine epsilon, the clip of log loss and the floor of the MAPE denominator
EPS = 2.220446049250313e-16


def _scoped(df: DataFrame, group: str | None, cols: Sequence[str], extra_scope: Sequence[str] = ()) -> DataFrame:
    """Feed rows once per scope: overall (``__scope=0``, ``__g=''``) and per group (``__scope=1``)."""
    sel = df.select(*extra_scope, *cols, (F.col(group).cast("string") if group else F.lit(None).cast("string"))
                    .alias("__g"))
    overall = sel.withColumn("__scope", F.lit(0)).withColumn("__g", F.lit(""))
    if not group:
        return overall
    return overall.unionByName(sel.filter(F.col("__g").isNotNull()).withColumn("__scope", F.lit(1)))


def _long(scored: DataFrame, metrics: Sequence[str], extra_scope: Sequence[str] = ()) -> DataFrame:
    """``(scope, g, m1, m2..)`` -> long ``(metric, value)``; group metrics get ``{slug(g)}_`` prefixes."""
    arr = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in metrics])
    x = scored.select(*extra_scope, "__scope", "__g", F.explode(arr).alias("r"))
    name = F.when(F.col("__scope") == 0, F.col("r.m")).otherwise(
        F.concat(slug(F.col("__g")), F.lit("_"), F.col("r.m")))
    return x.select(*extra_scope, name.alias("metric"), F.col("r.v").alias("value"))


def log_loss_expr(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def auc_table(df: DataFrame, event: str, pred: str, by: Sequence[str], buckets: int | None = None, rows: str | None = None) -> DataFrame:
    """MT5: ROC AUC per ``by`` key by the rank-sum identity with average ranks for ties:
    ``(sum of positive ranks - P(P+1)/2) / (P N)``.  Integer arithmetic on doubled ranks.  Rows
    without a score (null or NaN) take no part.  With ``rows`` a row stands for so many rows, and ``event`` counts the events
    among them."""
    by = list(by)
    c = df.filter(F.col(pred).isNotNull() & ~F.isnan(pred)).groupBy(*by, F.col(pred).cast("double").alias("__p")).agg(
        (F.sum(F.col(rows).cast("long")) if rows else F.count(F.lit(1))).alias("__c"), F.sum(F.col(event).cast("long")).alias("__pos"))
    sc = prefix_scan(c, "__p", {"__lt": "__c"}, by=by, exclusive=True, unique=True, buckets=buckets)
    big = "decimal(38,0)"
    agg = sc.groupBy(*by).agg(
        F.sum(F.col("__pos").cast(big) * (F.lit(2) * F.col("__lt") + F.col("__c") + F.lit(1)).cast(big)).alias("__r2"),
        F.sum("__pos").alias("__P"), F.sum("__c").alias("__n"))
    P = F.col("__P").cast("double")
    N = (F.col("__n") - F.col("__P")).cast("double")
    auc = F.when((P > 0) & (N > 0), (F.col("__r2").cast("double") / F.lit(2.0) - P * (P + F.lit(1.0)) / F.lit(2.0)) / (P * N))
    return agg.select(*by, auc.alias("roc_auc"))


def classification_score(df: DataFrame, group: str | None = "grp", event: str = "event", pred: str = "pred",
                         weight: str | None = None, extra_scope: Sequence[str] = ()) -> DataFrame:
    """MT4/MT5: long ``(metric, value)``: ``log_loss``, ``roc_auc`` and ``{slug(group)}_`` versions.

    Log loss clips probabilities to ``[eps, 1 - eps]`` and is weighted when ``weight`` is given.
    Rows with a missing prediction are left out (the OOF mask).
    """
    extra_scope = list(extra_scope)
    cols = [event, pred] + ([weight] if weight else [])
    base = df.filter(F.col(pred).isNotNull() & ~F.isnan(pred))
    s = _scoped(base, group, cols, extra_scope)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ll = s.groupBy(*extra_scope, "__scope", "__g").agg(
        (F.sum(w * log_loss_expr(F.col(event).cast("double"), F.col(pred).cast("double"))) / F.sum(w)).alias("log_loss"))
    auc = auc_table(s, event, pred, [*extra_scope, "__scope", "__g"])
    return _long(ll.join(auc, [*extra_scope, "__scope", "__g"]), ["log_loss", "roc_auc"], extra_scope)


def regression_score(df: DataFrame, group: str | None = "grp", target: str = "time", pred: str = "pred",
                     extra_scope: Sequence[str] = ()) -> DataFrame:
    """MT8: ``mean_squared_error``, ``mean_absolute_error``, ``mean_absolute_percentage_error``
    (computed on ``target + 1`` and ``pred + 1``), overall and per group."""
    extra_scope = list(extra_scope)
    base = df.filter(F.col(pred).isNotNull() & ~F.isnan(pred))
    s = _scoped(base, group, [target, pred], extra_scope)
    y, p = F.col(target).cast("double"), F.col(pred).cast("double")
    y1, p1 = y + F.lit(1.0), p + F.lit(1.0)
    agg = s.groupBy(*extra_scope, "__scope", "__g").agg(
        F.avg((y - p) * (y - p)).alias("mean_squared_error"),
        F.avg(F.abs(y - p)).alias("mean_absolute_error"),
        F.avg(F.abs(p1 - y1) / F.greatest(F.abs(y1), F.lit(EPS))).alias("mean_absolute_percentage_error"))
    return _long(agg, ["mean_squared_error", "mean_absolute_error", "mean_absolute_percentage_error"], extra_scope)


def _counts_by_score(df: DataFrame, event: str, pred: str, by: Sequence[str], buckets: int | None) -> DataFrame:
    """Per ``(by, threshold)``: cumulative positives/negatives with score ``>=`` and ``>`` threshold."""
    by = list(by)
    base = df.filter(F.col(pred).isNotNull() & ~F.isnan(pred))
    c = base.groupBy(*by, F.col(pred).cast("double").alias("threshold")).agg(
        F.sum(F.col(event).cast("long")).alias("__pos"), F.count(F.lit(1)).alias("__all"))
    c = c.withColumn("__neg", F.col("__all") - F.col("__pos"))
    sc = prefix_scan(c, "threshold", {"tp": "__pos", "fp": "__neg"}, by=by, reverse=True, unique=True,
                     buckets=buckets)
    sc = sc.withColumn("tp_above", F.col("tp") - F.col("__pos")).withColumn("fp_above", F.col("fp") - F.col("__neg"))
    tot = base.groupBy(*by).agg(F.sum(F.col(event).cast("long")).alias("P"),
                                (F.count(F.lit(1)) - F.sum(F.col(event).cast("long"))).alias("N"))
    if by:
        return sc.join(tot, by, "left")
    r = tot.first()
    return sc.withColumn("P", F.lit(int(r["P"] or 0))).withColumn("N", F.lit(int(r["N"] or 0)))


def roc_points(df: DataFrame, event: str = "event", pred: str = "pred", by: Sequence[str] = (),
               buckets: int | None = None) -> DataFrame:
    """MT6: ROC curve points ``(by, threshold, fpr, tpr, fpr_prev, tpr_prev)``: one point per distinct
    score (no intermediate point dropped), plus the origin at ``threshold = +inf``.  ``*_prev`` is
    the neighbouring point at the next higher threshold.  Where a class is absent its rate is null."""
    by = list(by)
    c = _counts_by_score(df, event, pred, by, buckets)
    P = F.when(F.col("P") > 0, F.col("P").cast("double"))
    N = F.when(F.col("N") > 0, F.col("N").cast("double"))
    pts = c.select(*by, "threshold", (F.col("fp") / N).alias("fpr"), (F.col("tp") / P).alias("tpr"),
                   (F.col("fp_above") / N).alias("fpr_prev"), (F.col("tp_above") / P).alias("tpr_prev"))
    keys = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    origin = keys.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                         F.lit(None).cast("double").alias("fpr_prev"), F.lit(None).cast("double").alias("tpr_prev"))
    return pts.unionByName(origin)


def pr_points(df: DataFrame, event: str = "event", pred: str = "pred", by: Sequence[str] = (),
              buckets: int | None = None) -> DataFrame:
    """MT7: precision-recall points ``(by, threshold, precision, recall, precision_next, recall_next)``
    per distinct score, plus the end point ``(precision 1, recall 0, threshold null)``.  ``*_next``
    is the neighbouring point at the next higher threshold (the end point after the highest)."""
    by = list(by)
    c = _counts_by_score(df, event, pred, by, buckets)
    P = F.col("P").cast("double")
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    prec_n = F.when(F.col("tp_above") + F.col("fp_above") > 0,
                    F.col("tp_above") / (F.col("tp_above") + F.col("fp_above"))).otherwise(F.lit(1.0))
    rec = F.when(P > 0, F.col("tp") / P).otherwise(F.lit(1.0))
    rec_n = F.when(P > 0, F.col("tp_above") / P).otherwise(F.lit(0.0))
    pts = c.select(*by, "threshold", prec.alias("precision"), rec.alias("recall"),
                   prec_n.alias("precision_next"), rec_n.alias("recall_next"))
    keys = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    end = keys.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                      F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("precision_next"),
                      F.lit(None).cast("double").alias("recall_next"))
    return pts.unionByName(end)


def curve_auc(points: DataFrame, kind: str = "roc", by: Sequence[str] = ()) -> DataFrame:
    """MT9: trapezoid area under a ROC or PR curve built by ``roc_points`` / ``pr_points``."""
    by = list(by)
    if kind == "roc":
        seg = (F.col("fpr") - F.col("fpr_prev")) * (F.col("tpr") + F.col("tpr_prev")) / F.lit(2.0)
    elif kind == "pr":
        seg = (F.col("recall") - F.col("recall_next")) * (F.col("precision") + F.col("precision_next")) / F.lit(2.0)
    else:
        raise ValueError(kind)
    return points.groupBy(*by).agg(F.sum(seg).alias("auc"))


def linspace_grid(n: int = 100) -> list[float]:
    return [float(v) for v in np.linspace(0.0, 1.0, n)]


def _interp_segments(seg: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Evaluate piecewise-linear segments ``(x0, y0, x1, y1)`` at the fixed grid (SC9).

    Each grid value takes the segment with ``x0 <= g < x1`` (the last point at or left of ``g``
    and the next one, as ``np.interp``); a final open segment holds the last value.  A segment makes
    exactly the grid points it covers: their numbers lie between its ends times ``n - 1``, a grid point more on
    either side is compared exactly, and no join is needed.
    """
    grid = F.lit(linspace_grid(n))
    low = F.greatest(F.floor(F.col("x0") * (n - 1)).cast("int"), F.lit(0))
    high = F.least(F.ceil(F.least("x1", F.lit(2.0)) * (n - 1)).cast("int"), F.lit(n - 1))
    covered = F.filter(F.sequence(low, high), lambda k: (grid[k] >= F.col("x0")) & (grid[k] < F.col("x1")))
    j = seg.where((F.col("x1") > F.col("x0")) & (low <= high)).select(*by, "x0", "y0", "x1", "y1", F.explode(covered).alias("k")).withColumn("g", grid[F.col("k")])
    val = F.when(F.col("g") == F.col("x0"), F.col("y0")).otherwise(
        F.col("y0") + (F.col("g") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    return j.select(*by, "k", "g", val.alias("y"))


def mean_roc(df: DataFrame, event: str = "event", pred: str = "pred", fold: str = "fold", n: int = 100,
             buckets: int | None = None) -> DataFrame:
    """MT10: mean ROC over folds on an ``n``-point FPR grid: ``(k, fpr, tpr_mean, tpr_std,
    tpr_lower, tpr_upper)``; each fold's interpolated curve starts at 0, the mean ends at 1, the
    band is mean +/- population std clipped to [0, 1]."""
    pts = roc_points(df, event, pred, [fold], buckets).filter(F.col("fpr_prev").isNotNull())
    seg = pts.select(fold, F.col("fpr_prev").alias("x0"), F.col("tpr_prev").alias("y0"),
                     F.col("fpr").alias("x1"), F.col("tpr").alias("y1"))
    last = pts.groupBy(fold).agg(F.max_by(F.struct("fpr", "tpr"), F.struct("fpr", "tpr")).alias("l"))
    tail = last.select(fold, F.col("l.fpr").alias("x0"), F.col("l.tpr").alias("y0"),
                       F.lit(float("inf")).alias("x1"), F.col("l.tpr").alias("y1"))
    it = _interp_segments(seg.unionByName(tail), [fold], n)
    it = it.withColumn("y", F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.col("y")))
    m = it.groupBy("k", "g").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    m = m.withColumn("m", F.when(F.col("k") == n - 1, F.lit(1.0)).otherwise(F.col("m")))
    return m.select("k", F.col("g").alias("fpr"), F.col("m").alias("tpr_mean"), F.col("s").alias("tpr_std"),
                    F.greatest(F.col("m") - F.col("s"), F.lit(0.0)).alias("tpr_lower"),
                    F.least(F.col("m") + F.col("s"), F.lit(1.0)).alias("tpr_upper"))


def mean_pr(df: DataFrame, event: str = "event", pred: str = "pred", fold: str = "fold", n: int = 100,
            buckets: int | None = None) -> DataFrame:
    """MT11: mean precision-recall curve over folds on an ``n``-point recall grid:
    ``(k, recall, precision_mean, precision_std, precision_lower, precision_upper)``.

    Per fold, precision is interpolated against ``1 - recall`` and reversed onto the recall
    grid; the first entry is pinned to 1 and the mean's last entry to 0."""
    pts = pr_points(df, event, pred, [fold], buckets).filter(F.col("threshold").isNotNull())
    seg = pts.select(fold, (F.lit(1.0) - F.col("recall")).alias("x0"), F.col("precision").alias("y0"),
                     (F.lit(1.0) - F.col("recall_next")).alias("x1"), F.col("precision_next").alias("y1"))
    # the end point (recall 0, precision 1) holds beyond the curve
    tail = pts.select(fold).distinct().select(fold, F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"),
                                              F.lit(float("inf")).alias("x1"), F.lit(1.0).alias("y1"))
    it = _interp_segments(seg.unionByName(tail), [fold], n)
    # reversed: entry k of the fold curve is the interpolation at grid point n-1-k
    it = it.select(fold, (F.lit(n - 1) - F.col("k")).alias("k"), "y")
    it = it.withColumn("y", F.when(F.col("k") == 0, F.lit(1.0)).otherwise(F.col("y")))
    m = it.groupBy("k").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).withColumn("g", F.lit(linspace_grid(n))[F.col("k")])
    m = m.withColumn("m", F.when(F.col("k") == n - 1, F.lit(0.0)).otherwise(F.col("m")))
    return m.select("k", F.col("g").alias("recall"), F.col("m").alias("precision_mean"),
                    F.col("s").alias("precision_std"),
                    F.greatest(F.col("m") - F.col("s"), F.lit(0.0)).alias("precision_lower"),
                    F.least(F.col("m") + F.col("s"), F.lit(1.0)).alias("precision_upper"))


def grid_summary(curve: DataFrame, x: str, y: str, kind: str = "roc") -> DataFrame:
    """MT10/MT11 summary of a mean curve: trapezoid AUC and the best point (Youden ``y - x`` for
    ROC, F1 for PR; first index on ties).  The curve has a fixed number of grid rows."""
    w = Window.orderBy("k")
    c = curve.select("k", x, y, F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("y0"))
    score = (F.col(y) - F.col(x)) if kind == "roc" else (
        F.lit(2.0) * F.col(x) * F.col(y) / (F.col(x) + F.col(y)))
    c = c.withColumn("__s", score)
    return c.agg(F.sum((F.col(x) - F.col("x0")) * (F.col(y) + F.col("y0")) / F.lit(2.0)).alias("auc"),
                 F.min_by(F.struct(x, y), F.struct((-F.coalesce(F.col("__s"), F.lit(float("-inf")))).alias("s"),
                                                   F.col("k"))).alias("best")
                 ).select("auc", F.col(f"best.{x}").alias(f"best_{x}"), F.col(f"best.{y}").alias(f"best_{y}"))


def fold_auc_summary(df: DataFrame, event: str, pred: str, fold: str, kind: str = "roc", n: int = 100) -> DataFrame:
    """MT10/MT11: what stands beside a mean curve: ``(auc, auc_mean, auc_std, best_...)``.

    ``auc`` is the area under the mean curve, ``auc_mean`` and ``auc_std`` (population) are those of the folds'
    own curves, and the best point is ``grid_summary``'s."""
    points, curve, x, y = (roc_points, mean_roc, "fpr", "tpr_mean") if kind == "roc" else (pr_points, mean_pr, "recall", "precision_mean")
    per = curve_auc(points(df, event, pred, [fold]), kind, [fold]).agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))
    return grid_summary(curve(df, event, pred, fold, n), x, y, kind).crossJoin(F.broadcast(per))  # one row each


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG7: Pearson correlation of every pair of columns (diagonal included), long ``(a, b, corr)``,
    from one aggregate."""
    cols = list(cols)
    pairs = [(a, b) for a in cols for b in cols]
    r = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("corr"))
                    for i, (a, b) in enumerate(pairs)])
    return r.select(F.explode(arr).alias("x")).select("x.a", "x.b", "x.corr")


def histogram(df: DataFrame, col: str, by: str | None = None, bins: int = 32) -> DataFrame:
    """AG8/MT14: fixed-width histogram over ``[min, max]`` of the whole column, counted per ``by``
    class; the maximum falls in the last bin.  ``(by, bin, lo, hi, count)``, empty bins omitted; a column without
    values has no bins."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = float(r["lo"] or 0.0), float(r["hi"] or 0.0)
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    h = df.filter(F.col(col).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return h.select(*keys, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count")


def score_table(df: DataFrame, task: str, fold: str = "fold", group: str = "grp", time: str = "time",
                event: str = "event", pred: str = "prediction", target: str | None = None,
                buckets: int | None = None) -> DataFrame:
    """MT12/MT13/ST1: long ``(fold, metric, value)``, one block per validation fold plus ``OOF``.

    ``task`` is ``ranking`` (concordance family), ``classification`` (log loss, AUC) or
    ``regression`` (errors against ``target``); anything else raises.  Folds and OOF are scored
    in the same pass under a fold scope.
    """
    base = df.filter(F.col(pred).isNotNull() & ~F.isnan(pred))
    if task == "ranking":
        # the ranking scores are computed eagerly: read the input once for all fold/group scopes
        base = base.select(fold, group, time, event, pred).persist(StorageLevel.MEMORY_AND_DISK)
    scoped = (base.withColumn("__fold", F.col(fold).cast("string"))
              .unionByName(base.withColumn("__fold", F.lit("OOF"))))
    if task == "ranking":
        sel = scoped.select("__fold", F.col(group).cast("string").alias("__g"), time, event, pred)
        both = (sel.withColumn("__scope", F.lit(0)).withColumn("__g", F.lit(""))
                .unionByName(sel.filter(F.col("__g").isNotNull()).withColumn("__scope", F.lit(1))))
        try:
            c = concordance_counts(both, time, event, pred, ["__fold", "__scope", "__g"], buckets)
        finally:
            base.unpersist()
        micro = c.filter(F.col("__scope") == 0).select("__fold", F.lit("micro_concordance_index").alias("metric"),
                                                       F.col("concordance").alias("value"))
        per = c.filter(F.col("__scope") == 1)
        groups = per.select("__fold", F.concat(slug(F.col("__g")), F.lit("_concordance_index")).alias("metric"),
                            F.col("concordance").alias("value"))
        st = per.groupBy("__fold").agg(F.avg("concordance").alias("m"), F.stddev_pop("concordance").alias("s"))
        summ = st.select("__fold", F.explode(F.array(
            F.struct(F.lit("macro_concordance_index").alias("metric"), F.col("m").alias("value")),
            F.struct(F.lit("std_concordance_index").alias("metric"), F.col("s").alias("value")),
            F.struct(F.lit("stratified_concordance_index").alias("metric"), (F.col("m") - F.col("s")).alias("value")),
        )).alias("r")).select("__fold", "r.metric", "r.value")
        out = micro.unionByName(groups).unionByName(summ)
    elif task == "classification":
        out = classification_score(scoped, group, event, pred, extra_scope=["__fold"])
    elif task == "regression":
        out = regression_score(scoped, group, target or time, pred, extra_scope=["__fold"])
    else:
        raise ValueError(f"Invalid task type {task}")
    return out.withColumnRenamed("__fold", "fold")


def score_summary(scores: DataFrame) -> DataFrame:
    """AG12: mean and sample std (0 for a single fold) of each metric over the validation folds."""
    f = scores.filter(F.col("fold") != "OOF")
    return f.groupBy("metric").agg(F.avg("value").alias("mean"),
                                   F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def oof_vs_folds(scores: DataFrame) -> DataFrame:
    """MT15: per metric, fold mean and std next to the OOF score."""
    oof = scores.filter(F.col("fold") == "OOF").select("metric", F.col("value").alias("oof"))
    return score_summary(scores).join(oof, "metric", "left")


def study_table(trials: DataFrame, value: str = "value", number: str = "number") -> DataFrame:
    """WN5/SO1/ML14: drop incomplete trials, keep one trial per distinct value (the lowest trial
    number), ordered by value descending."""
    full = trials.dropna()
    w = Window.partitionBy(value).orderBy(number)
    return (full.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
            .orderBy(F.col(value).desc()))


def best_trial(trials: DataFrame, value: str = "value", number: str = "number") -> DataFrame:
    """SO2: the trial with the highest value (lowest number on ties), as one row."""
    full = trials.dropna()
    cols = [c for c in full.columns]
    best = full.agg(F.max_by(F.struct(*cols), F.struct(F.col(value), (-F.col(number)).alias("n"))).alias("b"))
    return best.select("b.*")


def importance_summary(importances: DataFrame, feature: str = "feature", fold: str = "fold",
                       value: str = "importance") -> DataFrame:
    """ML11: mean and sample std (0 for one fold) of each feature's importance over folds,
    sorted by mean descending."""
    return (importances.groupBy(feature).agg(F.avg(value).alias("mean"),
                                             F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
            .orderBy(F.col("mean").desc(), F.col(feature)))
