import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from survspark.operators.scan import lookup_asof, prefix_scan


def _frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n), "t": rng.integers(0, 40, n).astype(float),
                        "v": rng.integers(0, 5, n).astype("int64")})
    return pdf, spark.createDataFrame(pdf)


def test_prefix_scan_matches_pandas(spark):
    pdf, df = _frame(spark)
    for buckets in (1, 3, 7):
        out = prefix_scan(df, "t", {"c": "v"}, by=["g"], buckets=buckets).toPandas()
        exp = pdf.assign(c=[pdf[(pdf.g == g) & (pdf.t <= t)].v.sum() for g, t in zip(pdf.g, pdf.t)])
        m = out.sort_values(["g", "t", "v"]).reset_index(drop=True)
        e = exp.sort_values(["g", "t", "v"]).reset_index(drop=True)
        assert (m.c.values == e.c.values).all()


def test_prefix_scan_exclusive_reverse(spark):
    pdf, df = _frame(spark, seed=2)
    col = pdf.groupby(["g", "t"]).v.sum().reset_index()
    sdf = spark.createDataFrame(col)
    out = prefix_scan(sdf, "t", {"c": "v"}, by=["g"], reverse=True, exclusive=True, unique=True, buckets=4).toPandas()
    for _, r in out.iterrows():
        assert r.c == col[(col.g == r.g) & (col.t > r.t)].v.sum()


def test_prefix_scan_independent_of_partitions(spark):
    _, df = _frame(spark, seed=3)
    a = prefix_scan(df.repartition(1), "t", {"c": "v"}, buckets=5).groupBy().sum("c").first()[0]
    b = prefix_scan(df.repartition(9), "t", {"c": "v"}, buckets=2).groupBy().sum("c").first()[0]
    assert a == b


def test_bucketed_scan_has_no_single_partition_window_over_rows(spark):
    _, df = _frame(spark, seed=4)
    plan = prefix_scan(df, "t", {"c": "v"}, buckets=4)._jdf.queryExecution().executedPlan().toString()
    # the only single-partition exchange allowed is the one over the bucket-total table
    assert "hashpartitioning(__bkt" in plan


def test_asof_probe_outside(spark):
    curve = spark.createDataFrame([(5.0, 0.8), (10.0, 0.5)], "time double, s double")
    probes = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 7.0), (4, 99.0), (5, None)], "id int, t double")
    out = {r.id: r.s for r in lookup_asof(probes, curve, "t", ["s"], key="id", initial={"s": 1.0}, buckets=3).collect()}
    assert out == {1: 1.0, 2: 0.8, 3: 0.8, 4: 0.5, 5: None}


def test_next_row_matches_lead_across_buckets(spark):
    from pyspark.sql import Window

    from survspark.operators.scan import next_row

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"u": rng.choice([1, 2, 3], 300, p=[0.8, 0.1, 0.1]), "t": rng.integers(0, 50, 300).astype(float),
                        "k": np.arange(300), "v": rng.integers(0, 9, 300)})
    df = spark.createDataFrame(pdf)
    exp = df.withColumn("e", F.lead("v").over(Window.partitionBy("u").orderBy("t", "k")))
    for buckets in (1, 6):
        got = next_row(df, ["t", "k"], ["v"], by=["u"], buckets=buckets).join(exp.select("k", "e"), "k")
        assert got.filter(~F.col("next_v").eqNullSafe(F.col("e"))).count() == 0


def test_asof_probes_in_buckets_without_curve_points(spark):
    curve = spark.createDataFrame([(float(t), 1.0 - t / 100.0) for t in range(1, 11)], "time double, s double")
    probes = spark.createDataFrame([(i, float(t)) for i, t in enumerate([0.5] + list(range(50, 90)))], "id int, t double")
    out = {r.id: r.s for r in lookup_asof(probes, curve, "t", ["s"], key="id", initial={"s": 1.0}, buckets=6).collect()}
    assert out[0] == 1.0 and all(abs(out[i] - 0.9) < 1e-12 for i in range(1, 41))


def test_lookup_exact_leaves_unmatched_missing(spark):
    from survspark.operators.scan import lookup_exact

    curve = spark.createDataFrame([("a", 1.0, 0.1), ("a", 2.0, 0.2), ("b", 1.0, 0.5)], "g string, time double, h double")
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0), (3, "b", 1.0), (4, "c", 1.0)], "id int, g string, t double")
    out = {r.id: r.h for r in lookup_exact(rows, curve, "t", ["h"], by=["g"]).collect()}
    assert out == {1: 0.2, 2: None, 3: 0.5, 4: None}


def test_spark_level_concordance_plan_is_bucketed(spark):
    from survspark.operators.concord import _spark_levels

    rng = np.random.default_rng(9)
    cells = spark.createDataFrame(pd.DataFrame({"__r": rng.integers(0, 64, 300), "__p": rng.random(300),
                                                "__n": rng.integers(1, 4, 300), "__ne": rng.integers(0, 2, 300)}))
    plan = _spark_levels(cells, [], 0, 6, [0.25, 0.5, 0.75])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__lvl" in plan and "__bkt" in plan
