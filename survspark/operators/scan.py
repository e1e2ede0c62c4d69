"""Distributed ordered operators: prefix scan, next-row lookup, as-of lookup, exact lookup.

A ``Window.orderBy`` without ``partitionBy`` sends every row to one task.  All ordered
computations here instead cut the order key into range buckets (bounds from
``approxQuantile``, baked into the plan as literals so every stage sees the same cut),
compute bucket totals (at most ``groups x buckets`` rows), turn them into per-bucket
carry-in offsets with a window over that tiny table, and finish with a window partitioned
by ``(by, bucket)``.  Any cut gives the exact answer; the cut only affects balance.
Equal order values always land in the same bucket because the bucket is a monotone
function of the value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_INF = float("inf")


def default_buckets(df: DataFrame) -> int:
    """Upper bound on buckets: one per shuffle partition (on a cluster sized to the data)."""
    try:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always present
        n = 8
    return max(1, n)


def rows_per_bucket(df: DataFrame) -> int:
    """Largest number of rows one scan task may hold (``survspark.scan.rowsPerBucket``)."""
    return int(df.sparkSession.conf.get("survspark.scan.rowsPerBucket", "1000000"))


def quantile_bounds(df: DataFrame, col: str, buckets: int | None = None, force: bool = False,
                    rows_factor: int = 1) -> list[float]:
    """Sorted distinct inner cut points of range buckets for ``col`` (see ``scan_stats``)."""
    return scan_stats(df, col, buckets, force, rows_factor=rows_factor)[0]


def scan_stats(df: DataFrame, col: str, buckets: int | None = None, force: bool = False,
               extra: Mapping[str, Column] | None = None, rows_factor: int = 1):
    """Cut points for range buckets of ``col`` plus any extra aggregates, in one pass.

    One distributed aggregate returns the row count, ``percentile_approx`` cut points and the
    ``extra`` aggregates together; only those few numbers reach the driver.  There are as many buckets
    as shuffle partitions, and more where a bucket would hold over ``rowsPerBucket`` rows
    (``rows x rows_factor`` in all), so a task is bounded and every size takes the same path.
    ``force`` uses exactly ``buckets`` buckets (tests).
    Returns ``(bounds, row)`` where ``row`` holds ``n`` and the extra aggregates.
    """
    nb = buckets or default_buckets(df)
    fine = nb if force else max(nb, 512)

    def cut(b: int):
        return F.percentile_approx(F.col(col).cast("double"), [i / b for i in range(1, b)], max(10000, 8 * b))

    aggs = [F.count(F.lit(1)).alias("n")] + [c.alias(k) for k, c in (extra or {}).items()]
    if fine > 1:
        aggs.append(cut(fine).alias("__q"))
    r = df.agg(*aggs).first()
    n = int(r["n"] or 0)
    b = nb if force else max(nb, math.ceil(n * rows_factor / rows_per_bucket(df)))
    if b <= 1 or not n:
        return [], r
    if b > fine:  # more buckets than the first sketch can tell apart
        qs = list(df.agg(cut(b).alias("q")).first()["q"] or [])
        fine = b
    else:
        qs = list(r["__q"] or [])
    if not qs:
        return [], r
    picks = [qs[min(len(qs) - 1, max(0, round(i * fine / b) - 1))] for i in range(1, b)]
    return sorted({float(q) for q in picks if q is not None and not math.isnan(q)}), r


def with_bucket(df: DataFrame, source: str, bounds: Sequence[float], out: str = "__bkt") -> DataFrame:
    """Add an int range-bucket column (binary search in the JVM via ``Bucketizer``)."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    tmp = f"{out}_src"
    splits = [-_INF, *bounds, _INF]
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=f"{out}_d", handleInvalid="keep")
    x = df.withColumn(tmp, F.col(source).cast("double"))
    return b.transform(x).withColumn(out, F.col(f"{out}_d").cast("int")).drop(tmp, f"{out}_d")


def _as_col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def prefix_scan(
    df: DataFrame,
    order: str | Sequence[str],
    sums: Mapping[str, str | Column],
    by: Sequence[str] = (),
    reverse: bool = False,
    exclusive: bool = False,
    unique: bool = False,
    bucket_col: str | None = None,
    buckets: int | None = None,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Running sums over ``order`` within ``by`` without a single-partition window.

    ``sums`` maps output names to the value summed.  Each output holds the sum over rows of
    the same ``by`` whose order value is ``<=`` the row's (``>=`` when ``reverse``), peers
    included; ``exclusive=True`` leaves the peers out (strict ``<`` / ``>``).
    ``unique=True`` declares rows unique on ``(by, order)`` which allows a multi-column
    ``order`` (ROWS frame); otherwise ``order`` is one numeric column (RANGE frame).
    ``bucket_col`` must be numeric and non-decreasing in ``order`` (default ``order[0]``).
    ``bounds`` reuses cut points computed once by the caller (else one sketch pass over ``df``).
    ``by`` keys must be non-null.
    """
    order = [order] if isinstance(order, str) else list(order)
    by = list(by)
    bcol = bucket_col or order[0]
    nb = buckets or default_buckets(df)
    names = list(sums)
    x = df
    for k in names:
        x = x.withColumn(f"__v_{k}", _as_col(sums[k]))
    if bounds is None:
        bounds = quantile_bounds(x, bcol, nb, force=buckets is not None)
    ocols = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    if not bounds:
        # no row, one distinct value or one bucket requested: nothing to carry
        w = Window.partitionBy(*by).orderBy(*ocols)
        w = (w.rowsBetween if unique else w.rangeBetween)(Window.unboundedPreceding, Window.currentRow)
        wp = Window.partitionBy(*by, *order)
        for k in names:
            v = F.col(f"__v_{k}")
            cum = F.sum(v).over(w)
            if exclusive:
                cum = cum - (v if unique else F.sum(v).over(wp))
            x = x.withColumn(k, cum)
        return x.drop(*[f"__v_{k}" for k in names])
    x = with_bucket(x, bcol, bounds, "__bkt")

    # carry-in per (by, bucket): exclusive running total of earlier buckets (tiny table)
    tot = x.groupBy(*by, "__bkt").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in names])
    bord = F.col("__bkt").desc() if reverse else F.col("__bkt").asc()
    wb = Window.partitionBy(*by).orderBy(bord).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(
        *by, "__bkt", *[F.coalesce(F.sum(f"__t_{k}").over(wb), F.lit(0)).alias(f"__o_{k}") for k in names]
    )
    x = x.join(off, [*by, "__bkt"], "left")

    w = Window.partitionBy(*by, "__bkt").orderBy(*ocols)
    w = (w.rowsBetween if unique else w.rangeBetween)(Window.unboundedPreceding, Window.currentRow)
    wp = Window.partitionBy(*by, "__bkt", *order)
    for k in names:
        v = F.col(f"__v_{k}")
        cum = F.sum(v).over(w) + F.col(f"__o_{k}")
        if exclusive:
            cum = cum - (v if unique else F.sum(v).over(wp))
        x = x.withColumn(k, cum)
    return x.drop("__bkt", *[f"__v_{k}" for k in names], *[f"__o_{k}" for k in names])


def lookup_exact(df: DataFrame, curve: DataFrame, time: str, value_cols: Sequence[str], by: Sequence[str] = (),
                 curve_time: str = "time") -> DataFrame:
    """Equi-join of curve values at exactly the row's time; unmatched -> null (``Series.map``)."""
    c = curve.select(*by, F.col(curve_time).alias("__ct"), *value_cols)
    cond = [df[time] == c["__ct"]] + [df[g] == c[g] for g in by]
    out = df.join(c, cond, "left")
    for g in by:
        out = out.drop(c[g])
    return out.drop("__ct")


def lookup_asof(
    df: DataFrame,
    curve: DataFrame,
    time: str,
    value_cols: Sequence[str],
    key: str,
    by: Sequence[str] = (),
    curve_time: str = "time",
    initial: Mapping[str, float] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """JN3: step-function lookup, the curve value at the greatest curve time ``<=`` the row's time.

    ``key`` names the probe rows' id (kept for callers; rows need not be unique).  Probes before the first curve time get
    ``initial[col]`` (e.g. S=1, H=0), null if absent.  Curve and probe rows are unioned and cut
    into shared time buckets; each probe takes ``last(value, ignorenulls)`` inside its bucket,
    falling back to the last curve value of earlier buckets (a carry-in table of at most
    groups x buckets rows).  Probes with a null time get null.
    """
    initial = dict(initial or {})
    by = list(by)
    nb = buckets or default_buckets(df)
    # equal probes are looked up once, so a time that many rows hold is one row of its bucket
    pk = df.select(*by, F.col(time).cast("double").alias("__t")).filter(F.col("__t").isNotNull()).distinct()
    pk = pk.withColumn("__pid", F.lit(1))
    for v in value_cols:
        pk = pk.withColumn(v, F.lit(None).cast("double"))
    ck = curve.select(*by, F.col(curve_time).cast("double").alias("__t"),
                      F.lit(None).cast(pk.schema["__pid"].dataType).alias("__pid"),
                      *[F.col(v).cast("double").alias(v) for v in value_cols])
    u = ck.unionByName(pk).withColumn("__probe", F.col("__pid").isNotNull().cast("int"))
    bounds = quantile_bounds(u, "__t", nb, force=buckets is not None)
    u = with_bucket(u, "__t", bounds, "__bkt")

    # last curve value per (by, bucket), laid on the full bucket range of each curve key so that
    # buckets holding only probes still pass the carry on; then carried into later buckets
    last = (u.filter(F.col("__probe") == 0).groupBy(*by, "__bkt")
            .agg(*[F.max_by(v, "__t").alias(f"__l_{v}") for v in value_cols]))
    keys = ck.select(*by).distinct() if by else df.sparkSession.range(1).select()
    all_b = keys.select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))).alias("__bkt"))
    last = all_b.join(last, [*by, "__bkt"], "left")
    wb = Window.partitionBy(*by).orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*by, "__bkt", *[F.last(f"__l_{v}", ignorenulls=True).over(wb).alias(f"__c_{v}")
                                         for v in value_cols])
    w = (Window.partitionBy(*by, "__bkt").orderBy("__t", "__probe")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = u.select(*by, "__bkt", "__t", "__probe",
                      *[F.last(v, ignorenulls=True).over(w).alias(f"__f_{v}") for v in value_cols])
    filled = filled.filter(F.col("__probe") == 1).join(carry, [*by, "__bkt"], "left")
    vals = []
    for v in value_cols:
        e = F.coalesce(F.col(f"__f_{v}"), F.col(f"__c_{v}"))
        if v in initial:
            e = F.coalesce(e, F.lit(float(initial[v])))
        vals.append(e.alias(v))
    res = filled.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(by)], "__t", *vals)
    keep = df.select(*[c for c in df.columns if c not in value_cols])
    on = [F.col(time).cast("double") == F.col("__t")] + [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(by)]
    return keep.join(res, on, "left").drop("__t", *[f"__g{i}" for i in range(len(by))])


def next_row(df: DataFrame, order: Sequence[str], cols: Sequence[str], by: Sequence[str] = (),
             bucket_col: str | None = None, buckets: int | None = None, prefix: str = "next_") -> DataFrame:
    """``lead()`` of ``cols`` in ``(by, order)`` order without one task per ``by`` key.

    Rows are cut into range buckets of ``bucket_col`` (numeric, non-decreasing in ``order``);
    ``lead`` runs inside ``(by, bucket)``; the last row of a bucket takes the first row of the
    next non-empty bucket of its key from a table of at most ``keys x buckets`` rows.  A key that
    holds a third of the table is therefore spread over all buckets.  ``order`` must be unique
    within ``by`` (add a tie-breaking key).  Output columns ``{prefix}{col}``; null for the last row.
    """
    order, by, cols = list(order), list(by), list(cols)
    bcol = bucket_col or order[0]
    bounds = quantile_bounds(df, bcol, buckets, force=buckets is not None)
    x = with_bucket(df, bcol, bounds, "__bkt")
    w = Window.partitionBy(*by, "__bkt").orderBy(*order)
    x = x.withColumn("__has_next", F.lead(F.lit(1)).over(w).isNotNull())
    for c in cols:
        x = x.withColumn(f"__l_{c}", F.lead(c).over(w))
    if not bounds:
        return x.select(*df.columns, *[F.col(f"__l_{c}").alias(f"{prefix}{c}") for c in cols])
    firsts = x.groupBy(*by, "__bkt").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__first"))
    wb = Window.partitionBy(*by).orderBy("__bkt")
    nxt = firsts.select(*by, "__bkt", F.lead("__first").over(wb).alias("__nf"))
    x = x.join(nxt, [*by, "__bkt"], "left")
    return x.select(*df.columns, *[F.when(F.col("__has_next"), F.col(f"__l_{c}")).otherwise(F.col(f"__nf.{c}"))
                                   .alias(f"{prefix}{c}") for c in cols])
