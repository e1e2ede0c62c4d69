import json
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from survspark.operators import encode, metrics, train


def _frame(spark):
    rng = np.random.default_rng(0)
    n = 400
    pdf = pd.DataFrame({"id": range(n), "c": rng.choice(["a", "b", "x y", "rare", None], n, p=[0.5, 0.3, 0.1, 0.02, 0.08]),
                        "k": rng.choice([1.0, 2.0, 3.0, 7.5, np.nan], n, p=[0.4, 0.3, 0.2, 0.03, 0.07]), "u": rng.normal(size=n)})
    return spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], "id long, c string, k double, u double")


@pytest.mark.parametrize("min_count", [1, 20, 100])
def test_sparse_vectors_equal_the_wide_columns(spark, min_count):
    df = _frame(spark)
    enc = encode.OneHot(["c", "k"], min_count=min_count).fit(df)
    new = df.unionByName(spark.createDataFrame([(900, "unseen", 99.0, 1.0)], df.schema))
    wide = {r.id: [float(r[c]) for c in enc.output_columns()] + [r.u] for r in enc.transform(new).collect()}
    got = enc.sparse(new, ["u"]).select("id", "features", vector_to_array("features").alias("v")).collect()
    assert len(got) == 401 and all(np.array_equal(r.v, wide[r.id]) for r in got)
    assert sum(isinstance(r.features, SparseVector) for r in got) > 300 or len(enc.output_columns()) < 4


def test_sparse_strict_encoder_fails_on_unknown_values(spark):
    df = _frame(spark)
    enc = encode.OneHot(["c"], min_count=1, unknown="error").fit(df)
    with pytest.raises(Exception, match="unknown category"):
        enc.sparse(df.withColumn("c", F.lit("new"))).collect()


def test_samples_stay_in_their_ranges_and_repeat():
    space = {"i": ("int", 5, 100, 5), "f": ("float", 0.2, 1.0, 0.05), "g": ("float", -1.0, 1.0), "l": ("log", 1e-4, 10.0), "c": ("categorical", ["a", 2, None])}
    a, b, more = train.sample_space(space, 200, 3), train.sample_space(space, 200, 3), train.sample_space({**space, "z": ("int", 0, 1)}, 250, 3)
    assert a == b and a != train.sample_space(space, 200, 4) and [{k: v for k, v in t.items() if k != "z"} for t in more[:200]] == a
    assert {t["i"] for t in a} <= set(range(5, 101, 5)) and min(t["i"] for t in a) == 5 and max(t["i"] for t in a) == 100
    assert all(abs(t["f"] / 0.05 - round(t["f"] / 0.05)) < 1e-9 and 0.2 <= t["f"] <= 1.0 + 1e-9 for t in a)
    assert all(1e-4 <= t["l"] <= 10.0 for t in a) and 0.3 < np.mean([t["l"] < 10 ** -1.5 for t in a]) < 0.7 and {t["c"] for t in a} == {"a", 2, None}
    for bad in (("int", 3, 1), ("gauss", 0, 1)):
        with pytest.raises(ValueError):
            train.sample_space({"x": bad}, 1)


def test_halving_keeps_the_best_and_repeats_by_seed(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=240)
    df = spark.createDataFrame(pd.DataFrame({"id": range(240), "fold": np.arange(240) % 2, "x": x, "event": (x + rng.normal(size=240) > 0).astype(int)}))

    def brier(oof):
        return oof.join(df.select("id", "event"), "id").agg(F.avg(F.pow(F.col("event") - F.col("prediction"), 2))).first()[0]

    space = {"maxDepth": ("int", 1, 6), "minInstancesPerNode": ("int", 1, 41, 10)}
    studies = [train.halving_search(df, "random_forest", space, ["x"], "event", "classification", brier, "numTrees", (2, 5), n_trials=4, eta=2, seed=5,
                                    direction="minimize").collect() for _ in range(2)]
    same = [[(r.number, r.rung, round(r.value, 12), r.params, r.state, r.best) for r in s] for s in studies]
    assert same[0] == same[1]
    first, last = ([r for r in studies[0] if r.rung == k] for k in (0, 1))
    kept = sorted(first, key=lambda r: (round(r.value, 12), r.number))[:2]
    assert len(first) == 4 and {r.number for r in last} == {r.number for r in kept} and {r.state for r in first} == {"promoted", "pruned"}
    assert [r.best for r in last].count(True) == 1 and min(last, key=lambda r: (round(r.value, 12), r.number)).best and all(r.budget == 5 and r.state == "complete" for r in last)
    assert json.loads(first[0].params) == train.sample_space(space, 4, 5)[first[0].number]
    with pytest.raises(ValueError):
        train.halving_search(df, "random_forest", space, ["x"], "event", "classification", brier, "numTrees", (), n_trials=1)


def test_halving_prepares_the_frame_once_and_gives_the_metric_its_targets(spark, monkeypatch):
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200) % 190, "fold": np.arange(200) % 2, "x": np.arange(200.0), "event": np.arange(200) % 3 // 2}))
    frames, seen, real = [], [], train.written
    monkeypatch.setattr(train, "written", lambda d, name: frames.append(name) or real(d, name))

    def metric(oof):
        seen.append(sorted((r.id, r.fold, r.event) for r in oof.collect()))
        return 1.0

    train.halving_search(df, "random_forest", {"maxDepth": ("int", 1, 3)}, ["x"], "event", "classification", metric, "numTrees", (1, 2), n_trials=3, carry=["event"])
    assert frames.count("oof_frame") == 1 and len(seen) == 4
    assert all(s == sorted((i % 190, i % 2, i % 3 // 2) for i in range(200)) for s in seen)


def test_auc_of_counted_rows(spark):
    rows = [(0.1, 3, 1), (0.4, 1, 1), (0.4, 2, 0), (0.9, 4, 3), (None, 5, 5)]
    whole = [(p, int(i < e)) for p, n, e in rows for i in range(n)]
    short, long = spark.createDataFrame(rows, "p double, n long, e long"), spark.createDataFrame(whole, "p double, e int")
    assert metrics.auc_table(short, "e", "p", [], rows="n").first() == metrics.auc_table(long, "e", "p", []).first()


def test_vectors_of_numbers_equal_the_assembler(spark):
    df = spark.createDataFrame([(1, 2.5, True, None), (0, None, False, 3.0), (7, 0.0, None, 0.0)], "a int, b double, c boolean, d float")
    names = ["a", "b", "c", "d"]
    own = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df)
    got = train.assemble(df, names)
    assert got.columns == own.columns and got.schema["features"].metadata == own.schema["features"].metadata
    for x, y in zip(got.collect(), own.collect()):
        assert np.array_equal(x.features.toArray(), y.features.toArray(), equal_nan=True)


@pytest.mark.parametrize("rows,most", [(1, 1), (500, 2), (10**9, 4)])
def test_large_frames_are_fitted_a_few_folds_at_a_time(spark, monkeypatch, rows, most):
    """Each fit keeps its own copy of the training rows, so the frame's size bounds the fits side by side."""
    df = spark.createDataFrame(pd.DataFrame({"id": range(240), "fold": np.arange(240) % 4, "x": np.arange(240.0), "event": np.arange(240) % 3 // 2}))
    lock, now, seen = threading.Lock(), [0], []

    class Slow:
        def fit(self, train_rows):
            with lock:
                now[0] += 1
                seen.append(now[0])
            time.sleep(0.3)
            with lock:
                now[0] -= 1
            return real("decision_tree", "classification", {"labelCol": "event", "maxDepth": 2}, 1).fit(train_rows)

    real = train.make_learner
    monkeypatch.setattr(train, "_ROWS_AT_ONCE", rows)
    monkeypatch.setattr(train, "make_learner", lambda *a: Slow())
    oof, models = train.train_oof(df, "decision_tree", ["x"], "event", "classification")
    assert len(models) == 4 and oof.count() == 240 and max(seen) <= most
