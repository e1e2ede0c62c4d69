import math

from survspark.operators.estimate import survival_curve, survival_targets

TIES = [(1.0, 1, 0.9), (2.0, 1, 0.8), (2.0, 1, 0.7), (2.0, 0, 0.8), (3.0, 0, 0.1), (3.0, 1, 0.8)]


def test_ties_curve_by_hand(spark):
    df = spark.createDataFrame(TIES, "time double, event int, pred double")
    c = {r.time: r for r in survival_curve(df, buckets=2).collect()}
    # at-risk 6, 5, 2; events 1, 2, 1
    assert [c[t].at_risk for t in (1.0, 2.0, 3.0)] == [6, 5, 2]
    assert math.isclose(c[1.0].km, 5 / 6) and math.isclose(c[2.0].km, 5 / 6 * 3 / 5)
    assert math.isclose(c[3.0].km, 5 / 6 * 3 / 5 * 1 / 2)
    assert math.isclose(c[2.0].na_breslow, 1 / 6 + 2 / 5)
    assert math.isclose(c[2.0].na_smooth, 1 / 6 + 1 / 5 + 1 / 4)
    # events-only KM: 4 events, 1 at t=1, 3 by t=2
    assert math.isclose(c[1.0].km_events_only, 0.75) and math.isclose(c[2.0].km_events_only, 0.25)
    assert c[3.0].km_events_only == 0.0


def test_all_censored_and_last_event(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "time double, event int")
    c = survival_curve(df).collect()
    assert all(r.km == 1.0 and r.na_smooth == 0.0 for r in c)
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "time double, event int")
    c = {r.time: r for r in survival_curve(df).collect()}
    assert c[2.0].km == 0.0 and math.isclose(c[1.0].km, 0.5)


def test_curve_monotone_and_targets(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 7 + 1), i % 3 % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, grp string, time double, event int")
    c = sorted(survival_curve(df, by=["grp"], buckets=3).collect(), key=lambda r: (r.grp, r.time))
    for a, b in zip(c, c[1:]):
        if a.grp == b.grp:
            assert b.km <= a.km + 1e-15 and b.na_smooth >= a.na_smooth - 1e-15
    t = survival_targets(df).collect()
    assert len(t) == 60 and all(0 <= r.log_km_survival_probability <= 1 for r in t)
