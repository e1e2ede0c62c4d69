"""Feature encoders (EN1-EN11, PR10, AG6, IO7): fit -> small parameter table, transform -> one projection.

Fitting reads all encoded columns in one pass: the columns are unpivoted to
``(column, value)`` and counted with one ``groupBy`` (partial aggregation before the
shuffle), instead of one job per column.  Category lists are model parameters (they define
the output columns), so they are brought to the driver like any fitted encoder's labels;
rows never are.  Transform is a single ``select`` of ``CASE``/map-lookup expressions.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import written
from .scan import prefix_scan

INFREQUENT = "infrequent_sklearn"


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NumericType)


def _norm(df: DataFrame, c: str) -> Column:
    """Value used for matching: doubles for numeric columns (NaN -> null), strings otherwise."""
    if _is_numeric(df, c):
        x = F.col(c).cast("double")
        return F.when(F.isnan(x), None).otherwise(x)
    return F.col(c).cast("string")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` for every listed column in one aggregation; null values kept.

    Values are carried as strings (doubles formatted by Spark, e.g. ``2.0``) plus the numeric
    value for numeric columns so numeric order is preserved."""
    parts = []
    for c in cols:
        v = _norm(df, c)
        num = v if _is_numeric(df, c) else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), v.cast("string").alias("value"), num.alias("num")))
    x = df.select(F.explode(F.array(*parts)).alias("u")).select("u.*")
    return x.groupBy("column", "value", "num").agg(F.count(F.lit(1)).alias("count"))


def _lit_for(numeric: bool, value: str, num) -> Column:
    return F.lit(float(num)) if numeric else F.lit(value)


class OneHot:
    """EN1/EN2: one-hot with an infrequent bucket.

    Categories seen fewer than ``min_count`` times share ``{col}_infrequent_sklearn``; missing is
    its own category ``{col}_nan`` (subject to the same frequency rule); output columns are the
    frequent values in sorted order, then ``nan``, then the infrequent bucket.  Unknown values
    give all zeros (``unknown='zero'``) or fail the job (``unknown='error'``).

    Fitting is one counting pass.  Frequent categories define the output columns, so they come to the
    driver; more than ``max_columns`` of them are an error, as is a table of that width.  The infrequent
    values always stay a table, written to the shared folder, that the transform joins on the value.
    """

    def __init__(self, cols: Sequence[str], min_count: int = 128, unknown: str = "zero", max_columns: int = 10_000):
        self.cols, self.min_count, self.unknown, self.max_columns = list(cols), int(min_count), unknown, max_columns
        self.categories: dict[str, list[dict]] = {}
        self.numeric: dict[str, bool] = {}
        self.tables: dict[str, DataFrame] = {}

    def fit(self, df: DataFrame) -> "OneHot":
        self.numeric = {c: _is_numeric(df, c) for c in self.cols}
        counts = written(value_counts(df, self.cols), "category_counts")
        rare = F.col("count") < F.lit(self.min_count)
        small = rare & F.col("value").isNotNull()
        # one row a column: how many output columns, and whether there is an infrequent bucket
        sizes = {r["column"]: r for r in counts.groupBy("column").agg(
            F.sum((~rare).cast("long")).alias("wide"), F.sum(small.cast("long")).alias("rare")).collect()}
        wide = sum(int(r["wide"]) for r in sizes.values())
        if wide > self.max_columns:
            raise ValueError(f"one-hot encoding would make {wide} columns, more than max_columns={self.max_columns}")
        rows = counts.filter(~small).collect()
        self.tables = {c: counts.filter((F.col("column") == c) & small).select("value", "num")
                       for c in self.cols if c in sizes and sizes[c]["rare"]}
        by_col: dict[str, list] = {c: [] for c in self.cols}
        for r in rows:
            by_col[r["column"]].append(r)
        for c, rs in by_col.items():
            present = [r for r in rs if r["value"] is not None]
            present.sort(key=(lambda r: r["num"]) if self.numeric[c] else (lambda r: r["value"]))
            nan = [r for r in rs if r["value"] is None]
            cats = [{"value": r["value"], "num": r["num"], "count": int(r["count"]),
                     "frequent": r["count"] >= self.min_count} for r in present + nan]
            self.categories[c] = cats
        return self

    def _has_infrequent(self, c: str) -> bool:
        return c in self.tables or any(not k["frequent"] for k in self.categories[c])

    def output_columns(self) -> list[str]:
        out = []
        for c in self.cols:
            cats = self.categories[c]
            out += [f"{c}_{'nan' if k['value'] is None else k['value']}" for k in cats if k["frequent"]]
            if self._has_infrequent(c):
                out.append(f"{c}_{INFREQUENT}")
        return out

    def _expressions(self) -> list[Column]:
        exprs = []
        for c in self.cols:
            num = self.numeric[c]
            v = F.col(c).cast("double") if num else F.col(c).cast("string")
            isnull = F.col(c).isNull() | (F.isnan(F.col(c)) if num else F.lit(False))
            cats = self.categories[c]

            def match(k, v=v, isnull=isnull, num=num):
                return isnull if k["value"] is None else ((~isnull) & (v == _lit_for(num, k["value"], k["num"])))

            for k in cats:
                if k["frequent"]:
                    name = f"{c}_{'nan' if k['value'] is None else k['value']}"
                    exprs.append(F.when(match(k), 1).otherwise(0).alias(name))
            cond = F.col(f"__inf_{c}") if c in self.tables else F.lit(False)
            for k in cats:
                if not k["frequent"]:
                    cond = cond | match(k)
            if self._has_infrequent(c):
                exprs.append(F.when(cond, 1).otherwise(0).alias(f"{c}_{INFREQUENT}"))
            if self.unknown == "error":
                known = F.col(f"__inf_{c}") if c in self.tables else F.lit(False)
                for k in cats:
                    known = known | match(k)
                exprs.append(F.when(~known, F.raise_error(F.concat(F.lit(f"unknown category in {c}: "),
                                                                    v.cast("string"))))
                             .alias(f"__check_{c}"))
        return exprs

    def expressions(self) -> list[Column]:
        if self.tables:
            raise ValueError("large infrequent sets need a join: use transform()")
        return self._expressions()

    def transform(self, df: DataFrame) -> DataFrame:
        x = df
        for c, t in self.tables.items():
            key = F.col(c).cast("double") if self.numeric[c] else F.col(c).cast("string")
            tk = t.select((F.col("num") if self.numeric[c] else F.col("value")).alias(f"__k_{c}"),
                          F.lit(True).alias(f"__inf_{c}"))
            x = x.join(tk, key == F.col(f"__k_{c}"), "left").drop(f"__k_{c}")
            x = x.withColumn(f"__inf_{c}", F.coalesce(F.col(f"__inf_{c}"), F.lit(False)))
        out = x.select(*[F.col(f"`{n}`") for n in df.columns], *self._expressions())
        return out.drop(*[f"__check_{c}" for c in self.cols]) if self.unknown == "error" else out

    def sparse(self, df: DataFrame, numeric: Sequence[str] = (), out: str = "features") -> DataFrame:
        """``df`` with a vector of all output columns and the ``numeric`` columns after them, in the order of
        ``output_columns()``: each encoded column becomes the place of its category (one lookup in the category
        table), and the places become sparse vectors, so no wide projection is made.

        Unknown values are all zeros, or fail the job, as in ``transform``; a missing numeric value is NaN."""
        from pyspark.ml.feature import OneHotEncoder, VectorAssembler

        x, places = df, []
        for c, t in self.tables.items():
            key = F.col(c).cast("double") if self.numeric[c] else F.col(c).cast("string")
            tk = t.select((F.col("num") if self.numeric[c] else F.col("value")).alias(f"__k_{c}"), F.lit(True).alias(f"__inf_{c}"))
            x = x.join(tk, key == F.col(f"__k_{c}"), "left").drop(f"__k_{c}")
        for c in self.cols:
            num, cats = self.numeric[c], self.categories[c]
            frequent = [k for k in cats if k["frequent"]]
            n = len(frequent) + self._has_infrequent(c)
            place = {id(k): i for i, k in enumerate(frequent)}
            pairs = [(k, place.get(id(k), n - 1)) for k in cats]
            known = [v for k, i in pairs if k["value"] is not None for v in (_lit_for(num, k["value"], k["num"]), F.lit(i))]
            missing = [i for k, i in pairs if k["value"] is None]
            value = F.col(c).cast("double") if num else F.col(c).cast("string")
            isnull = F.col(c).isNull() | (F.isnan(F.col(c)) if num else F.lit(False))
            at = F.try_element_at(F.create_map(*known), value) if known else F.lit(None).cast("int")
            if c in self.tables:
                at = F.coalesce(at, F.when(F.col(f"__inf_{c}"), F.lit(n - 1)))
            at = F.when(isnull, F.lit(missing[0] if missing else None).cast("int")).otherwise(at)
            unknown = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), value.cast("string"))) if self.unknown == "error" else F.lit(n)
            # the number of categories stands in the metadata, so no pass looks for it
            x = x.withColumn(f"__at_{c}", F.coalesce(at, unknown).cast("double").alias(f"__at_{c}", metadata={"ml_attr": {"type": "nominal", "num_vals": max(n, 1)}}))
            places.append(f"__at_{c}")
        encoder = OneHotEncoder(inputCols=places, outputCols=[f"{p}_v" for p in places], handleInvalid="keep", dropLast=True)
        x = encoder.fit(x).transform(x) if places else x
        for c in numeric:
            x = x.withColumn(f"__num_{c}", F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))
        x = VectorAssembler(inputCols=[f"{p}_v" for p in places] + [f"__num_{c}" for c in numeric], outputCol=out, handleInvalid="keep").transform(x)
        return x.select(*[F.col(f"`{n}`") for n in df.columns], out)

    def params(self) -> list[dict]:
        if self.tables:
            raise ValueError("encoders with large infrequent tables are saved with their tables")
        return [{"kind": "one_hot", "column": c, "numeric": self.numeric[c], "min_count": self.min_count,
                 "unknown": self.unknown, **k} for c in self.cols for k in self.categories[c]]


class Ordinal:
    """EN3/EN4: ordinal codes by sorted value.

    ``missing='code'``: missing becomes ``'missing'`` (strings) or ``-1`` (numbers) before coding,
    codes are ``int``, unknown -> ``-1``.  ``missing='null'``: missing stays null, codes are
    ``double``, unknown -> ``-1``.  Output ``{col}_encoded``.

    Every column has a code table, written to the shared folder, that the transform joins on the value:
    the dense rank of the distinct values, numbers by value and strings in binary order, by a range
    partitioning on the whole value, so values with a common prefix still spread.
    """

    def __init__(self, cols: Sequence[str], missing: str = "code", suffix: str = "encoded"):
        self.cols, self.missing, self.suffix = list(cols), missing, suffix
        self.values: dict[str, list] = {}
        self.numeric: dict[str, bool] = {}
        self.tables: dict[str, DataFrame] = {}
        self.sizes: dict[str, int] = {}

    def _filled(self, df: DataFrame, c: str) -> Column:
        v = _norm(df, c)
        if self.missing == "code":
            return F.coalesce(v, F.lit(-1.0) if self.numeric[c] else F.lit("missing"))
        return v

    def fit(self, df: DataFrame) -> "Ordinal":
        self.numeric = {c: _is_numeric(df, c) for c in self.cols}
        parts = [F.struct(F.lit(c).alias("column"), self._filled(df, c).cast("string").alias("value"),
                          (self._filled(df, c) if self.numeric[c] else F.lit(None).cast("double")).alias("num"))
                 for c in self.cols]
        vals = (df.select(F.explode(F.array(*parts)).alias("u")).select("u.*")
                .filter(F.col("value").isNotNull()).distinct())
        # rank of each value in its column: ranges of the whole value, counted, then numbered inside each
        key = ["column", "num", "value"]
        ranged = written(vals.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "category_ranges")
        ahead = ranged.groupBy("column", "part").agg(F.count(F.lit(1)).alias("n")).select(
            "column", "part", F.coalesce(F.sum("n").over(Window.partitionBy("column").orderBy("part").rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
        inside = F.row_number().over(Window.partitionBy("column", "part").orderBy("num", "value"))
        codes = written(ranged.withColumn("r", inside).join(ahead, ["column", "part"]).select(
            "column", "value", "num", (F.col("r") + F.col("ahead") - 1).cast("int").alias("code")), "category_codes")
        self.sizes = {r["column"]: int(r["n"]) for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.tables = {c: codes.filter(F.col("column") == c).select("value", "num", "code") for c in self.cols}
        return self

    def _source(self, c: str) -> Column:
        src = F.col(c).cast("double") if self.numeric[c] else F.col(c).cast("string")
        if self.numeric[c]:
            src = F.when(F.isnan(src), None).otherwise(src)
        if self.missing == "code":
            src = F.coalesce(src, F.lit(-1.0) if self.numeric[c] else F.lit("missing"))
        return src

    def _finish(self, c: str, src: Column, code: Column) -> Column:
        if self.missing == "code":
            return F.coalesce(code, F.lit(-1)).cast("int").alias(f"{c}_{self.suffix}")
        return F.when(src.isNull(), None).otherwise(F.coalesce(code, F.lit(-1))).cast("double").alias(
            f"{c}_{self.suffix}")

    def _expressions(self) -> list[Column]:
        exprs = []
        for c in self.cols:
            src = self._source(c)
            exprs.append(self._finish(c, src, F.col(f"__code_{c}")))
        return exprs

    def expressions(self) -> list[Column]:
        if self.tables:
            raise ValueError("large code tables need a join: use transform()")
        return self._expressions()

    def transform(self, df: DataFrame) -> DataFrame:
        x = df
        for c, t in self.tables.items():
            tk = t.select((F.col("num") if self.numeric[c] else F.col("value")).alias(f"__k_{c}"),
                          F.col("code").alias(f"__code_{c}"))
            x = x.join(tk, self._source(c) == F.col(f"__k_{c}"), "left").drop(f"__k_{c}")
        return x.select(*[F.col(f"`{n}`") for n in df.columns], *self._expressions())

    def cardinalities(self) -> dict[str, int]:
        """EN9: number of codes per encoded column (``max(code) + 1``)."""
        return {f"{c}_{self.suffix}": self.sizes.get(c, len(self.values.get(c, []))) for c in self.cols}

    def params(self) -> list[dict]:
        if self.tables:
            raise ValueError("encoders with large code tables are saved with their tables")
        return [{"kind": "ordinal", "column": c, "numeric": self.numeric[c], "missing": self.missing,
                 "suffix": self.suffix, "value": v, "num": n, "code": i}
                for c in self.cols if c in self.values for i, (v, n) in enumerate(self.values[c])]


def exact_medians(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> dict[str, float | None]:
    """AG6/PR10: exact medians (midpoint of the two middle values) of several columns in one pass.

    Values are collapsed to ``(column, value, count)``, a prefix scan per column gives
    cumulative counts, and only the (at most two) middle values per column are brought back.
    Missing values are ignored."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]
    x = df.select(F.explode(F.array(*parts)).alias("u")).select("u.*")
    x = x.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    cnt = x.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
    tot = cnt.groupBy("column").agg(F.sum("c").alias("n"))
    sc = prefix_scan(cnt, "v", {"cum": "c"}, by=["column"], unique=True, buckets=buckets).join(tot, "column")
    k1 = F.floor((F.col("n") - 1) / 2)
    k2 = F.floor(F.col("n") / 2)
    before = F.col("cum") - F.col("c")
    hit1 = (before <= k1) & (k1 < F.col("cum"))
    hit2 = (before <= k2) & (k2 < F.col("cum"))
    rows = sc.filter(hit1 | hit2).select("column", "v", hit1.alias("h1"), hit2.alias("h2")).collect()
    out: dict[str, float | None] = {c: None for c in cols}
    for c in cols:
        a = [r["v"] for r in rows if r["column"] == c and r["h1"]]
        b = [r["v"] for r in rows if r["column"] == c and r["h2"]]
        if a and b:
            out[c] = (a[0] + b[0]) / 2.0
    return out


class Standardise:
    """EN5: ``(x - mean) / std`` with mean and population std over non-missing values (std 0 -> 1);
    missing values are filled with the column median (kept with the encoder) before scaling.
    Output ``{col}_normalized``."""

    def __init__(self, cols: Sequence[str], suffix: str = "normalized"):
        self.cols, self.suffix = list(cols), suffix
        self.stats: dict[str, dict] = {}

    def fit(self, df: DataFrame) -> "Standardise":
        clean = {c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in self.cols}
        aggs = []
        for c in self.cols:
            aggs += [F.avg(clean[c]).alias(f"m_{c}"), F.stddev_pop(clean[c]).alias(f"s_{c}")]
        r = df.agg(*aggs).first()
        med = exact_medians(df, self.cols)
        for c in self.cols:
            self.stats[c] = {"mean": r[f"m_{c}"], "std": r[f"s_{c}"], "median": med[c]}
        return self

    def expressions(self) -> list[Column]:
        out = []
        for c in self.cols:
            st = self.stats[c]
            scale = st["std"] if st["std"] not in (None, 0.0) else 1.0
            x = F.col(c).cast("double")
            x = F.when(F.isnan(x), None).otherwise(x)
            filled = F.coalesce(x, F.lit(st["median"]).cast("double"))
            out.append(((filled - F.lit(st["mean"])) / F.lit(float(scale))).alias(f"{c}_{self.suffix}"))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *self.expressions())

    def params(self) -> list[dict]:
        return [{"kind": "standardise", "column": c, "suffix": self.suffix, **self.stats[c]} for c in self.cols]


class MedianImputer:
    """EN8/PR10: fill missing values of listed columns with their exact median."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)
        self.medians: dict[str, float | None] = {}

    def fit(self, df: DataFrame) -> "MedianImputer":
        self.medians = exact_medians(df, self.cols)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.cols:
            x = F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c))
            out[c] = F.coalesce(x, F.lit(self.medians[c]).cast(df.schema[c].dataType))
        return df.withColumns(out)

    def params(self) -> list[dict]:
        return [{"kind": "median", "column": c, "median": m} for c, m in self.medians.items()]


# ---------------------------------------------------------------------------------------------
# IO7 / EN10: encoders are small parameter tables, saved as Parquet and loaded without refitting

def save_encoder(spark: SparkSession, encoder, path: str) -> None:
    """Parameters as one small Parquet table; distributed category/code tables are written next to it."""
    tables = dict(getattr(encoder, "tables", {}) or {})
    saved = {}
    if tables:
        for c, t in tables.items():
            t.write.mode("overwrite").parquet(f"{path}/tables/{c}")
        saved = {"numeric": encoder.numeric}
        if isinstance(encoder, Ordinal):
            saved["sizes"] = encoder.sizes
        encoder_tables, encoder.tables = encoder.tables, {}
        try:
            params = encoder.params()
        finally:
            encoder.tables = encoder_tables
    else:
        params = encoder.params()
    rows = [(json.dumps(p, sort_keys=True),) for p in params]
    meta = {"class": type(encoder).__name__, "cols": encoder.cols, "tables": sorted(tables), **saved}
    for k in ("min_count", "unknown", "missing", "suffix"):
        if hasattr(encoder, k):
            meta[k] = getattr(encoder, k)
    rows.append((json.dumps({"kind": "__meta__", **meta}, sort_keys=True),))
    spark.createDataFrame(rows, "param string").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_encoder(spark: SparkSession, path: str):
    params = [json.loads(r["param"]) for r in spark.read.parquet(f"{path}/params").collect()]
    meta = next(p for p in params if p["kind"] == "__meta__")
    body = [p for p in params if p["kind"] != "__meta__"]
    cls = meta["class"]
    tables = {c: spark.read.parquet(f"{path}/tables/{c}") for c in meta.get("tables", [])}
    if cls == "OneHot":
        enc = OneHot(meta["cols"], meta["min_count"], meta["unknown"])
        enc.tables = tables
        for c in enc.cols:
            cats = [p for p in body if p["column"] == c]
            enc.numeric[c] = bool(meta.get("numeric", {}).get(c, cats[0]["numeric"] if cats else False))
            nonnull = [p for p in cats if p["value"] is not None]
            nonnull.sort(key=(lambda p: p["num"]) if enc.numeric[c] else (lambda p: p["value"]))
            enc.categories[c] = [{k: p[k] for k in ("value", "num", "count", "frequent")}
                                 for p in nonnull + [p for p in cats if p["value"] is None]]
        return enc
    if cls == "Ordinal":
        enc = Ordinal(meta["cols"], meta["missing"], meta["suffix"])
        enc.tables = tables
        enc.sizes = {k: int(v) for k, v in meta.get("sizes", {}).items()}
        for c in enc.cols:
            vals = sorted([p for p in body if p["column"] == c], key=lambda p: p["code"])
            enc.numeric[c] = bool(meta.get("numeric", {}).get(c, vals[0]["numeric"] if vals else False))
            if c not in tables:
                enc.values[c] = [(p["value"], p["num"]) for p in vals]
                enc.sizes.setdefault(c, len(vals))
        return enc
    if cls == "Standardise":
        enc = Standardise(meta["cols"], meta["suffix"])
        for p in body:
            enc.stats[p["column"]] = {"mean": p["mean"], "std": p["std"], "median": p["median"]}
        return enc
    if cls == "MedianImputer":
        enc = MedianImputer(meta["cols"])
        enc.medians = {p["column"]: p["median"] for p in body}
        return enc
    raise ValueError(f"unknown encoder class {cls}")


def preprocess(df: DataFrame, spec: Mapping, encoders: Mapping | None = None):
    """EN11: targets -> sample weights -> one-hot -> ordinal -> standardise, fitted once.

    ``spec`` keys: ``time``, ``event``, ``categorical``, ``continuous``, ``event_weight``,
    ``min_count``.  Pass ``encoders`` from an earlier fit to transform only (no refit).
    Returns ``(frame, encoders)``.
    """
    from .targets import add_targets, sample_weight

    time, event = spec.get("time", "time"), spec.get("event", "event")
    cat, cont = list(spec.get("categorical", [])), list(spec.get("continuous", []))
    x = add_targets(df, time, event)
    x = sample_weight(x, event, spec.get("event_weight", 1.0))
    if encoders is None:
        encoders = {
            "one_hot": OneHot(cat, spec.get("min_count", 128)).fit(x) if cat else None,
            "ordinal": Ordinal(cat).fit(x) if cat else None,
            "standardise": Standardise(cont).fit(x) if cont else None,
        }
    for k in ("one_hot", "ordinal", "standardise"):
        if encoders.get(k) is not None:
            x = encoders[k].transform(x)
    return x, dict(encoders)
