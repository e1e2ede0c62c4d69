import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from survspark.operators import combine, concord, metrics, train


def _planted(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x1 = rng.normal(size=n)
    x2 = rng.normal(size=n)
    event = (x1 + 0.5 * rng.normal(size=n) > 0).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "fold": np.arange(n) % 4 + 1, "x1": x1, "x2": x2, "event": event,
                        "time": rng.integers(1, 50, n).astype(float)})
    return spark.createDataFrame(pdf)


def test_oof_covers_every_row_once_with_probabilities(spark):
    df = _planted(spark)
    oof, models = train.train_oof(df, "logistic", ["x1", "x2"], "event", "classification", params={"maxIter": 20})
    rows = oof.collect()
    assert len(rows) == 600 and len({r.id for r in rows}) == 600
    assert all(0.0 <= r.prediction <= 1.0 for r in rows)
    assert set(models) == {f"model_fold_{f}_seed_42" for f in range(1, 5)}
    auc = metrics.auc_table(oof.join(df.select("id", "event"), "id"), "event", "prediction", []).first().roc_auc
    assert auc > 0.6


def test_two_stage_rank_and_blend_linearity(spark):
    df = _planted(spark, seed=1).withColumn("p", F.lit(0.5) + F.col("x2") / 10).withColumn("r", F.col("x1") / 5)
    ts = combine.two_stage(df, "p", "r", "log_time").select("id", "prediction", "p", "r").collect()
    assert all(abs(t.prediction - t.p / np.exp(t.r)) < 1e-12 for t in ts)
    b = combine.blend(df, {"x1": 0.3, "x2": 0.7}).select("id", "x1", "x2", "prediction").collect()
    assert all(abs(t.prediction - (0.3 * t.x1 + 0.7 * t.x2)) < 1e-12 for t in b)


def test_concordance_permutation_invariant(spark):
    df = _planted(spark, seed=2).withColumn("pred", F.round("x1", 1))
    a = concord.concordance(df, "time", "event", "pred").first().concordance
    b = concord.concordance(df.orderBy(F.rand(3)).repartition(7), "time", "event", "pred").first().concordance
    assert a == b


def test_rows_without_a_fold_train_and_are_not_scored(spark):
    df = _planted(spark, n=120, seed=3).withColumn("fold", F.when(F.col("id") >= 100, None).otherwise(F.col("fold")))
    oof, models = train.train_oof(df, "logistic", ["x1", "x2"], "event", "classification", params={"maxIter": 10})
    assert len(models) == 4 and sorted(r.id for r in oof.collect()) == list(range(100))


def test_histogram_of_a_column_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    assert metrics.histogram(df, "x").collect() == [] and metrics.histogram(df.where("false"), "x").collect() == []
    assert [tuple(r) for r in metrics.histogram(df.fillna(3.0), "x").collect()] == [(0, 3.0, 4.0, 2)]


def test_fold_scores_are_ranked_in_partitions_that_grow_with_the_rows(spark, monkeypatch):
    from survspark.operators import train

    df = spark.createDataFrame([(i, i % 3 + 1, (i * 7) % 11 / 11, int((i * 5) % 11 > 5)) for i in range(90)], "id long, fold int, a double, event int")
    _, models = train.train_oof(df, "logistic", ["a"], "event", "classification", params={"maxIter": 3})
    plain = {r.id: r.prediction for r in train.predict_folds(models, df, ["a"], "classification").collect()}
    seen, inner = [], train.rank_pct

    def ranked(*args, **more):
        seen.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return inner(*args, **more)

    monkeypatch.setattr(train, "rank_pct", ranked)
    monkeypatch.setattr(train, "_ROWS_A_TASK", 25)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert {r.id: r.prediction for r in train.predict_folds(models, df, ["a"], "classification").collect()} == plain
    assert seen == [11] and spark.conf.get("spark.sql.shuffle.partitions") == before
