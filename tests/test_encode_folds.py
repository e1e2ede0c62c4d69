from pyspark.sql import functions as F

from survspark.operators import encode, folds, parametric


def test_one_hot_and_ordinal_cats(spark):
    train = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None), (6, None)], "id int, c string")
    enc = encode.OneHot(["c"], min_count=2).fit(train)
    assert enc.output_columns() == ["c_a", "c_nan", "c_infrequent_sklearn"]
    test = spark.createDataFrame([(7, "z"), (8, "b"), (9, None)], "id int, c string")
    got = {r.id: (r.c_a, r.c_nan, r.c_infrequent_sklearn) for r in enc.transform(test).collect()}
    assert got == {7: (0, 0, 0), 8: (0, 0, 1), 9: (0, 1, 0)}
    o = encode.Ordinal(["c"]).fit(train)
    codes = {r.id: r.c_encoded for r in o.transform(test).collect()}
    assert codes == {7: -1, 8: 1, 9: 2}  # a=0, b=1, missing=2, unseen -> -1


def test_standardise_population_std_and_median(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "id int, x double")
    s = encode.Standardise(["x"]).fit(df)
    st = s.stats["x"]
    assert st["mean"] == 2.0 and abs(st["std"] - (2 / 3) ** 0.5) < 1e-15 and st["median"] == 2.0
    assert {r.id: r.x_normalized for r in s.transform(df).collect()}[4] == 0.0


def test_folds_balanced_within_strata(spark):
    rows = [(i, "g%d" % (i % 3), i % 2, float(i % 50 + 1)) for i in range(700)]
    df = folds.time_bin(spark.createDataFrame(rows, "id long, grp string, event int, time double"))
    f = folds.stratified_folds(df, "id", ["grp", "event", "time_bin"], k=7, buckets=3)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    per = f.groupBy("grp", "event", "time_bin", "fold").count().groupBy("grp", "event", "time_bin").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in per)


def test_weibull_score_equations_vanish(spark):
    rows = [(float(t), e) for t, e in zip(range(1, 200), [1, 0, 1, 1] * 50)]
    df = spark.createDataFrame(rows, "time double, event int")
    p = parametric.fit_weibull(df).first().asDict()
    g = parametric.score_equations(df, p, "weibull")
    assert abs(g["rho_"]) < 1e-6 and abs(g["lambda_"]) < 1e-6


def test_incomplete_gamma_and_gengamma_nests_weibull(spark):
    import math

    import numpy as np

    from survspark.operators.gengamma import _kernel, fit_generalized_gamma

    log_p_q, loglik = _kernel()
    x = np.array([0.01, 0.5, 1.0, 3.0, 10.0])
    lp, lq = log_p_q(1.0, x)
    assert np.allclose(np.exp(lp), 1 - np.exp(-x), rtol=1e-13, atol=1e-15)
    lp, _ = log_p_q(0.5, x)
    assert np.allclose(np.exp(lp), [math.erf(math.sqrt(v)) for v in x], rtol=1e-13)
    rng = np.random.default_rng(4)
    t = 50.0 * rng.weibull(1.7, 400)
    e = (rng.random(400) < 0.7).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(t, e)], "time double, event int")
    p = fit_generalized_gamma(df).first()
    w = parametric.fit_weibull(df).first()
    ll_gg = loglik(np.log(t), e, p.mu_, math.log(p.sigma_), p.lambda_).sum()
    ll_w = loglik(np.log(t), e, math.log(w.lambda_), math.log(1 / w.rho_), 1.0).sum()
    assert ll_gg >= ll_w - 1e-6


def test_split_fold_masks(spark):
    df = spark.createDataFrame([(i, i % 3 + 1, i % 2) for i in range(30)], "id int, fold int, event int")
    tr, va = folds.split_fold(df, 2)
    ts, _ = folds.split_fold(df, 2, event="event", events_only=True)
    assert va.count() == 10 and tr.count() == 20
    assert ts.filter(F.col("event") != 1).count() == 0 and ts.filter(F.col("fold") == 2).count() == 0


def test_large_cardinality_paths_match_inline(spark):
    rows = [(i, f"v{i % 37:03d}" if i % 11 else None, float(i % 23)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, s string, x double")
    test = df.union(spark.createDataFrame([(999, "zzz", 99.0)], "id int, s string, x double"))

    def run():
        o = encode.Ordinal(["s", "x"]).fit(df).transform(test)
        h = encode.OneHot(["s", "x"], min_count=12).fit(df).transform(test)
        return sorted(map(tuple, o.collect())), sorted(map(tuple, h.collect())), h.columns
    inline = run()
    spark.conf.set("survspark.encode.maxInline", "5")
    try:
        tables = run()
    finally:
        spark.conf.unset("survspark.encode.maxInline")
    assert inline[0] == tables[0]
    assert inline[2] == tables[2] and inline[1] == tables[1]


def test_table_backed_encoder_roundtrip(spark):
    from survspark.session import scratch_path

    rows = [(i, f"v{i % 37:03d}" if i % 11 else None, float(i % 23)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, s string, x double")
    spark.conf.set("survspark.encode.maxInline", "5")
    try:
        enc = encode.Ordinal(["s", "x"]).fit(df)
        path = scratch_path(spark, "enc")
        encode.save_encoder(spark, enc, path)
        back = encode.load_encoder(spark, path)
        a = sorted(map(tuple, enc.transform(df).collect()))
        b = sorted(map(tuple, back.transform(df).collect()))
        assert a == b and back.cardinalities() == enc.cardinalities()
    finally:
        spark.conf.unset("survspark.encode.maxInline")
