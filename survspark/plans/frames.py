"""Survival frames derived by Spark from the driver's tables.

* ``S``: one subject per order (orders joined to customer): heavy time ties, 5 groups, features with nulls.
* ``G``: time from an event to the same user's next event, almost no ties, one zero duration.
* ``P``: six classifier probabilities and two regressor outputs with a planted signal, plus folds.
* ``E``: embeddings for exact k-nearest-neighbour search.

Every frame grows with the input tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import stratified_folds, time_bin
from ..operators.scan import next_row
from ..sources.io import read_table

# fixed values: multipliers and offsets of the planted classifier columns p1..p6
P_MULTIPLIERS = [(7919, 1), (104729, 2), (1299709, 3), (15485863, 5), (32452843, 7), (49979687, 11)]
# fixed values: the two regressor columns (multiplier, offset)
R1 = (86028121, 13)
R2 = (122949823, 17)
MODULUS = 1000003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def frame_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                               "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return j.select(
        F.col("o_orderkey").cast("long").alias("id"),
        F.col("c_mktsegment").alias("grp"),
        (days + 1).cast("double").alias("time"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("event"),
        (F.col("o_totalprice") / F.lit(500001.0)).cast("double").alias("pred"),
        F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("c_acctbal")).alias("x_num"),
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderpriority")).alias("x_cat"),
        F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("c_nationkey").cast("double")).alias("x_code"),
    )


def frame_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    # the end of observation is one scalar: the latest timestamp of the table
    mx = ev.agg(F.max("ts").alias("mx")).first()["mx"]
    # next event of the same user; a user holding a third of the events is still split over buckets
    ev = ev.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    n = next_row(ev, ["ts", "event_id"], ["ts", "event_type"], by=["user_id"], bucket_col="__us")
    n = n.select(F.col("event_id").alias("id"), F.col("event_type").alias("grp"), "ts", "value",
                 F.col("next_ts").alias("nt"), F.col("next_event_type").alias("ne"))
    end = F.coalesce(F.col("nt"), F.lit(mx).cast(n.schema["ts"].dataType))
    micros = F.expr("timestampdiff(MICROSECOND, ts, __end)")
    return n.withColumn("__end", end).select(
        "id", "grp",
        (micros.cast("double") / F.lit(1e6)).alias("time"),
        F.when(F.col("ne") == "purchase", 1).otherwise(0).alias("event"),
        F.col("value").alias("pred"),
    )


def frame_p(spark: SparkSession, sf_dir: str, k: int = 7, seed: int = 60) -> DataFrame:
    s = frame_s(spark, sf_dir).select("id", "grp", "time", "event")
    cols = []
    for i, (a, b) in enumerate(P_MULTIPLIERS, 1):
        u = ((F.col("id") * a + b) % MODULUS) / F.lit(float(MODULUS))
        cols.append((F.lit(0.05) + F.lit(0.55) * u + F.lit(0.35) * F.col("event")).alias(f"p{i}"))
    r1 = F.lit(0.5) + F.lit(2.0) * ((F.col("id") * R1[0] + R1[1]) % MODULUS) / F.lit(float(MODULUS))
    r2 = ((F.col("id") * R2[0] + R2[1]) % MODULUS) / F.lit(float(MODULUS))
    p = s.select("id", "grp", "time", "event", *cols, r1.alias("r1"), r2.alias("r2"))
    p = time_bin(p, "time", "time_bin")
    return stratified_folds(p, "id", ["grp", "event", "time_bin"], k=k, seed=seed).drop("time_bin")


def frame_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
