"""Regression targets and sample weights (TG1-TG6, AG5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ln


def min_max_scale(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """AG5/TG3: ``x - min(x)``, then divided by the max of the shifted column.

    The two statistics are one distributed aggregate; only two numbers reach the driver.  A constant
    column has no scale and becomes null.
    """
    out = out or col
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    span = float(hi) - float(lo)
    shifted = F.col(col) - F.lit(float(lo))
    return df.withColumn(out, shifted / F.lit(span) if span != 0 else F.lit(None).cast("double"))


def add_targets(df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """TG1/TG2: ``log_time = ln(t)`` (ln 0 = -inf as in NumPy) and ``inverted_time`` (-t when censored)."""
    return (df.withColumn("log_time", ln(F.col(time)))
              .withColumn("inverted_time", F.when(F.col(event) == 0, -F.col(time)).otherwise(F.col(time))))


def sample_weight(df: DataFrame, event: str = "event", event_weight: float = 1.0, out: str = "weight") -> DataFrame:
    """TG6: weight 1 for censored rows, ``event_weight`` for event rows."""
    return df.withColumn(out, F.when(F.col(event) == 1, F.lit(float(event_weight))).otherwise(F.lit(1.0)))
