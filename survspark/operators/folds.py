"""Folds (FD1-FD6, WN4, AG1-AG4, AG11): time bins, stratified k-fold assignment, balance report.

The reference shuffles inside each stratum with a seeded RNG; we order each stratum by a
seeded hash of the id (deterministic on any cluster, independent of partitioning) and deal
rows round-robin, continuing the count across strata so fold sizes differ by at most one.
The row number inside a stratum is a distributed prefix scan, so a stratum holding a third
of the table is still spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import default_buckets, prefix_scan


def time_bin_col(time: str) -> F.Column:
    """FD1: ``int(clip(log1p(t), 1, 4) // 0.5)`` (null-safe: null time -> null bin)."""
    x = F.log1p(F.col(time))
    clipped = F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(1.0)), F.lit(4.0)))
    return F.floor(clipped / F.lit(0.5)).cast("int")


def time_bin(df: DataFrame, time: str = "time", out: str = "time_bin") -> DataFrame:
    return df.withColumn(out, time_bin_col(time))


def stratified_folds(df: DataFrame, id_col: str, strata: Sequence[str], k: int = 7, seed: int = 60,
                     out: str = "fold", buckets: int | None = None) -> DataFrame:
    """FD2: ``fold = (offset(stratum) + row_number() - 1) % k + 1`` with rows of a stratum ordered
    by ``md5(id || ':' || seed)`` then id; ``offset`` is the running size of earlier strata."""
    strata = list(strata)
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    x = df.withColumn("__h", h).withColumn("__hn", F.conv(F.substring("__h", 1, 13), 16, 10).cast("double"))
    # strata are few; their running offsets form a tiny table
    sizes = x.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    ws = Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(*strata, F.coalesce(F.sum("__n").over(ws), F.lit(0)).alias("__off"))
    # strata keys may be null: compare null-safe via a struct key
    x = x.withColumn("__sk", F.struct(*strata))
    offs = offs.select(F.struct(*strata).alias("__sk"), "__off")
    x = x.join(offs, "__sk", "left")  # one row per stratum; AQE broadcasts it when small
    # the hash prefix is uniform on [0, 16^13): equal-width cut points are already balanced, so the
    # row number needs no sketch pass over the data
    nb = buckets or default_buckets(df)
    bounds = [i * float(16 ** 13) / nb for i in range(1, nb)]
    # ordering by the numeric hash prefix first is the same order as by the hex string, and cheaper
    x = prefix_scan(x, ["__hn", "__h", id_col], {"__rn": F.lit(1)}, by=["__sk"], unique=True, bucket_col="__hn",
                    bounds=bounds)
    fold = ((F.col("__off") + F.col("__rn") - 1) % k + 1).cast("int")
    return x.withColumn(out, fold).drop("__h", "__hn", "__sk", "__off", "__rn")


def fold_columns(k: int) -> list[str]:
    """PR1: generated names ``fold1..foldk``."""
    return [f"fold{i}" for i in range(1, k + 1)]


def widen_folds(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """FD3: one-hot fold membership columns ``fold1..foldk`` (1 = validation row of that fold)."""
    return df.select("*", *[F.when(F.col(fold) == i, 1).otherwise(0).alias(f"fold{i}") for i in range(1, k + 1)])


def split_fold(df: DataFrame, fold_value: int, fold: str = "fold", event: str | None = None,
               events_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """FD4/FD5 (PR3): training and validation frames of one fold; two-stage keeps event rows only."""
    train = df.filter(F.col(fold) != fold_value)
    if events_only:
        train = train.filter(F.col(event) == 1)
    return train, df.filter(F.col(fold) == fold_value)


def fold_report(df: DataFrame, fold: str = "fold", group: str = "grp", event: str = "event",
                time: str = "time") -> DataFrame:
    """AG11/FD6: per-fold validation size, event count and mean time."""
    return (df.groupBy(fold).agg(F.count(F.lit(1)).alias("validation_size"),
                                 F.sum(F.col(event)).cast("long").alias("events"),
                                 F.avg(F.col(time)).alias("time_mean")))


def fold_counts(df: DataFrame, fold: str = "fold", group: str = "grp", event: str = "event") -> DataFrame:
    """FD6: rows of each group and of each event value in every fold, ``(fold, kind, value, count)``; a value
    that a fold lacks has count 0, so the folds align."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
    long = df.select(fold, F.explode(F.array(pair("group", group), pair("event", event))).alias("u")).select(fold, "u.*")
    counts = long.groupBy(fold, "kind", "value").agg(F.count(F.lit(1)).alias("count"))
    folds = [r[0] for r in counts.select(fold).distinct().collect()]  # a handful
    absent = counts.groupBy("kind", "value").agg(F.collect_set(fold).alias("in")).select(
        F.explode(F.array_except(F.array(*[F.lit(f) for f in folds]).cast(f"array<{dict(df.dtypes)[fold]}>"), "in")).alias(fold),
        "kind", "value", F.lit(0).cast("long").alias("count"))
    return counts.unionByName(absent)


def fold_balance(df: DataFrame, fold: str = "fold", group: str = "grp", event: str = "event",
                 time: str = "time") -> DataFrame:
    """AG1-AG4, AG11: balance summary across folds, long form ``(metric, value)``.

    * ``validation_size_std``: population std of fold sizes;
    * ``group_average_std``: sample std over folds of each group's count (folds without the group
      are absent, not zero), averaged over groups;
    * ``event_average_std``: the same over event values;
    * ``time_mean_std``: population std of the per-fold mean time.
    """
    per_fold = fold_report(df, fold, group, event, time)
    size = per_fold.select(F.explode(F.array(
        F.struct(F.lit("validation_size_std").alias("metric"), F.col("validation_size").cast("double").alias("v")),
        F.struct(F.lit("time_mean_std").alias("metric"), F.col("time_mean").alias("v")))).alias("m")
    ).groupBy(F.col("m.metric").alias("metric")).agg(F.stddev_pop("m.v").alias("value"))

    def avg_std(key: str, name: str) -> DataFrame:
        return (df.groupBy(fold, key).agg(F.count(F.lit(1)).alias("n")).groupBy(key)
                .agg(F.stddev_samp("n").alias("s")).agg(F.avg("s").alias("value"))
                .select(F.lit(name).alias("metric"), "value"))

    return size.unionByName(avg_std(group, "group_average_std")).unionByName(avg_std(event, "event_average_std"))
