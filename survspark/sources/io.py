"""Sources and sinks (IO1-IO8): CSV/Parquet scans and sinks, OOF prediction loading.

Scans pass an explicit schema when one is given (no inference on a cluster) and stay lazy so
Catalyst pushes filters and column pruning into the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str | None = None,
               **options) -> DataFrame:
    """IO1/IO2: scan a Parquet (default) or headered CSV table."""
    fmt = fmt or ("csv" if str(path).endswith(".csv") else "parquet")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        opts = {"header": "true", "quote": '"', "escape": '"', "multiLine": "false"}
        opts.update({k: str(v) for k, v in options.items()})
        if schema is None:
            opts.setdefault("inferSchema", "true")
        return r.options(**opts).csv(path)
    return r.options(**{k: str(v) for k, v in options.items()}).format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """IO3/IO4: Parquet sink, or CSV with header and no index column."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """IO8: the reference drops its id column; we keep ``id`` and drop only what is asked."""
    return df.drop(*cols)


def load_oof(spark: SparkSession, paths: Mapping[str, str], key: str = "id", column: str = "prediction") -> DataFrame:
    """IO5: read each model's OOF predictions and pivot them to ``{model}_prediction`` columns.

    The inputs are unioned in long form and pivoted with one ``groupBy(key)``; the pivot values
    are the known model names, so no extra pass discovers them.
    """
    parts = [read_table(spark, p).select(F.col(key), F.lit(m).alias("model"), F.col(column).cast("double").alias("v"))
             for m, p in paths.items()]
    return pivot_predictions(_union_all(parts), list(paths), key=key)


def pivot_predictions(long: DataFrame, models: Sequence[str], key: str = "id", model_col: str = "model",
                      value_col: str = "v") -> DataFrame:
    """Long ``(key, model, value)`` -> wide ``(key, {model}_prediction...)``."""
    wide = long.groupBy(key).pivot(model_col, list(models)).agg(F.first(value_col))
    return wide.select(key, *[F.col(f"`{m}`").alias(f"{m}_prediction") for m in models])


def _union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


union_all = _union_all
