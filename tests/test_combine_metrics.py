import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from survspark.operators import combine, metrics


def test_rank_pct_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(200), "f": rng.integers(1, 4, 200), "v": rng.integers(0, 20, 200) / 4})
    out = combine.rank_pct(spark.createDataFrame(pdf), "v", "r", by=["f"], buckets=3).toPandas().set_index("id")
    exp = pdf.assign(r=pdf.groupby("f").v.rank(pct=True)).set_index("id")
    assert np.allclose(out.loc[exp.index, "r"].values, exp.r.values)


def test_threshold_grid_edges(spark):
    ps = [0.0, 0.01, 0.29, 0.29999999999999998, 0.3, 0.33]
    df = spark.createDataFrame([(i, p, 1.0) for i, p in enumerate(ps)], "id int, p double, s double")
    got = {r.id: r.s for r in combine.threshold_scaling(df, "p", "s").collect()}
    for i, p in enumerate(ps):
        s = 1.0
        for th in np.arange(0, 0.33, 0.01):
            if th <= p < th + 0.01:
                s *= th + 0.01
        assert got[i] == s


def test_two_stage_unknown_target_raises(spark):
    df = spark.createDataFrame([(0.5, 1.0)], "p double, r double")
    try:
        combine.two_stage(df, "p", "r", "nope")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_log_loss_clipping_and_auc(spark):
    df = spark.createDataFrame([("g", 1, 1.0), ("g", 0, 0.0), ("g", 1, 0.5), ("g", 0, 0.5)],
                               "grp string, event int, p double")
    m = {r.metric: r.value for r in metrics.classification_score(df, "grp", "event", "p").collect()}
    eps = 2.220446049250313e-16
    exp = -(math.log(1 - eps) * 2 + math.log(0.5) * 2) / 4
    assert math.isclose(m["log_loss"], exp, rel_tol=1e-12)
    assert m["roc_auc"] == 0.875 and m["g_roc_auc"] == 0.875


def test_auc_equals_roc_trapezoid(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"event": rng.integers(0, 2, 300), "p": rng.integers(0, 30, 300) / 30})
    df = spark.createDataFrame(pdf)
    auc = metrics.auc_table(df, "event", "p", []).first().roc_auc
    trap = metrics.curve_auc(metrics.roc_points(df, "event", "p", buckets=3), "roc").first().auc
    assert abs(auc - trap) < 1e-12


def test_grid_interpolation_matches_numpy(spark):
    rng = np.random.default_rng(21)
    pdf = pd.DataFrame({"fold": rng.integers(1, 3, 240), "event": rng.integers(0, 2, 240),
                        "p": rng.integers(0, 12, 240) / 12})  # heavy ties -> vertical/horizontal segments
    df = spark.createDataFrame(pdf)
    pts = metrics.roc_points(df, "event", "p", ["fold"]).filter(F.col("fpr_prev").isNotNull())
    seg = pts.select("fold", F.col("fpr_prev").alias("x0"), F.col("tpr_prev").alias("y0"),
                     F.col("fpr").alias("x1"), F.col("tpr").alias("y1"))
    last = pts.groupBy("fold").agg(F.max_by(F.struct("fpr", "tpr"), F.struct("fpr", "tpr")).alias("l"))
    tail = last.select("fold", F.col("l.fpr").alias("x0"), F.col("l.tpr").alias("y0"),
                       F.lit(float("inf")).alias("x1"), F.col("l.tpr").alias("y1"))
    got = metrics._interp_segments(seg.unionByName(tail), ["fold"], 100).toPandas()
    grid = np.linspace(0, 1, 100)
    for f, sub in pdf.groupby("fold"):
        # ROC points in curve order (threshold descending), origin first
        P, N = sub.event.sum(), (1 - sub.event).sum()
        xs, ys = [0.0], [0.0]
        for t in sorted(sub.p.unique(), reverse=True):
            m = sub.p >= t
            xs.append(((1 - sub.event)[m]).sum() / N)
            ys.append(sub.event[m].sum() / P)
        exp = np.interp(grid, xs, ys)
        g = got[got.fold == f].sort_values("k")
        assert len(g) == 100 and np.allclose(g.y.values, exp, atol=1e-12)


def test_strict_one_hot_rejects_unknown(spark):
    from survspark.operators import encode

    train = spark.createDataFrame([(1, "a"), (2, "b")], "id int, c string")
    enc = encode.OneHot(["c"], min_count=0, unknown="error").fit(train)
    bad = spark.createDataFrame([(3, "z")], "id int, c string")
    try:
        enc.transform(bad).collect()
        raise AssertionError("expected failure on an unknown category")
    except Exception as e:  # noqa: BLE001
        assert "unknown category" in str(e)
