"""Concordance index (JN5, MT1-MT3) without the n^2 pair join.

Pair rule (right-censored data): ``(i, j)`` is comparable when ``e_i = 1`` and
``t_i < t_j`` or ``t_i = t_j and e_j = 0``.  It is concordant when ``p_i > p_j`` (higher risk
fails first) and counts one half when ``p_i = p_j``.

Map each row to the key ``k = (t, 1 - e)`` (events before censorings at equal time); then a
pair is comparable iff ``e_i = 1 and k_i < k_j``.  Rows collapse to cells ``(k, p)`` with counts, and
each group's cells are cut into blocks of keys and into bins of predictions, both of bounded size.  Every
comparable pair is counted exactly once:

* in one block: by the block's NumPy task (all its cells);
* in different blocks, in one bin: by the bin's NumPy task (its cells, collapsed by block and prediction);
* in different blocks and different bins: from the counts of the grid (block, bin) alone, by a bucketed prefix scan.

A cell is shuffled once for its block and twice for its bin, whatever the number of rows.  A key that is
fuller than a block has a block of its own, in which no pair is comparable, and a prediction that is fuller than a
bin collapses to one row for each block; so no task sees more than a bounded number of cells.  All counts are
integers (decimal(38,0)): the result is exact and independent of partitioning.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, StructField, StructType

from ..functions.scalar import slug
from ..session import written
from .scan import prefix_scan, scan_stats, with_bucket

_BIG = "decimal(38,0)"


def _prepared(df: DataFrame, time: str, event: str, pred: str, by: list[str]) -> DataFrame:
    cond = (F.col(time).isNotNull() & ~F.isnan(time) & F.col(event).isNotNull()
            & F.col(pred).isNotNull() & ~F.isnan(pred))
    for g in by:
        cond = cond & F.col(g).isNotNull()
    return df.filter(cond).select(
        *by, F.col(time).cast("double").alias("__t"), (F.lit(1) - F.col(event).cast("int")).alias("__f"),
        F.col(pred).cast("double").alias("__p"), F.col(event).cast("int").alias("__e"))


def concordance_counts(df: DataFrame, time: str = "time", event: str = "event", pred: str = "pred",
                       by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Per ``by`` key: ``numerator2`` (= 2 x concordant + tied), ``pairs`` and ``concordance``.

    The result has one row per observed ``by`` key (null concordance without comparable pairs).
    It is computed eagerly (a metric: one row per group) so the persisted cell table can be
    released afterwards.
    """
    by = list(by or [])
    spark = df.sparkSession
    x = _prepared(df, time, event, pred, by)
    # collapse rows to cells (group, t, 1-e, p) once, so the input rows are read a single time
    cells0 = (x.groupBy(*by, "__t", "__f", "__p")
              .agg(F.count(F.lit(1)).alias("__n"), F.sum("__e").cast("long").alias("__ne"))
              .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        n = cells0.count()
        limit = max(1, n // buckets) if buckets else local_cells_limit(df)
        cells, blocks = _placed(cells0, by, n, limit)
        last, many = blocks.agg(F.max("__blk"), F.max("__many")).first()
        parts = [_counted(cells.filter(~F.col("__alone")), by, "__blk", ["__t", "__f"], pairs=True)]
        if many:
            split = cells.filter("__many")
            grid = written(split.groupBy(*by, "__blk", "__bin").agg(F.sum("__n").alias("__n"), F.sum("__ne").alias("__ne")), "grid")
            binned = split.groupBy(*by, "__bin", "__blk", "__p").agg(F.sum("__n").alias("__n"), F.sum("__ne").alias("__ne"))
            parts.append(_counted(binned, by, "__bin", ["__blk"], pairs=False))
            levels = int(last).bit_length()
            grid = grid.select(*by, F.col("__blk").alias("__r"), F.col("__bin").cast("double").alias("__p"), "__n", "__ne")
            bounds = scan_stats(grid, "__p", buckets, buckets is not None, rows_factor=levels)[0]
            parts.append(_spark_levels(grid, by, 0, levels, bounds, ties=False))
        res = parts[0]
        for q in parts[1:]:
            res = res.unionByName(q)
        res = res.groupBy(*by).agg(F.sum("numerator2").alias("numerator2"), F.sum("pairs").alias("pairs"))
        if by:
            # every observed group is reported, including groups without a comparable pair
            out = blocks.select(*by).distinct().join(res, by, "left")
            rows = [tuple(r) for r in out.select(*by, "numerator2", "pairs").collect()]
            return _result(spark, by, rows, blocks.select(*by).schema)
        r = res.first()
        return _result(spark, by, [(r[0], r[1]) if r else (0, 0)], None)
    finally:
        cells0.unpersist()


def local_cells_limit(df: DataFrame) -> int:
    """Number of cells of a block or bin; one holds at most twice as many (``survspark.concordance.localCells``)."""
    return int(df.sparkSession.conf.get("survspark.concordance.localCells", "150000"))


_SMALL = 200_000  # rows of a table of blocks that is sent to all tasks


def _cuts(quantiles: list[float]) -> tuple[list[float], list[int]]:
    """Bounds of fine buckets, and the buckets that hold one value only: those of values met twice among the quantiles."""
    qs = [float(q) for q in quantiles if q is not None and np.isfinite(q)]
    heavy = {a for a, b in zip(qs, qs[1:]) if a == b}
    bounds = sorted({*qs, *(float(np.nextafter(v, np.inf)) for v in heavy)} - {np.inf})
    return bounds, [i + 1 for i, v in enumerate(bounds) if v in heavy]


def _placed(cells: DataFrame, by: list[str], n: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """``cells`` with their block of keys and bin of predictions, and the table of the blocks.

    Fine buckets of all cells come from one sketch; each group joins neighbouring ones to blocks of about ``limit``
    of its own cells.  Columns: ``__blk`` and ``__bin`` in the order of keys and predictions; ``__alone``: the block is
    one key, so it holds no pair; ``__many``: the group has several blocks."""
    fine = max(1, -(-4 * n // limit))
    bounds = {"__t": ([], []), "__p": ([], [])}
    if fine > 1:
        at = [i / fine for i in range(1, fine)]
        r = cells.agg(*[F.percentile_approx(c, at, max(10000, 8 * fine)).alias(c) for c in bounds]).first()
        bounds = {c: _cuts(r[c]) for c in bounds}
    x = with_bucket(with_bucket(cells, "__t", bounds["__t"][0], "__ft"), "__p", bounds["__p"][0], "__fp")
    # events before censorings: a bucket of one time is two keys
    lone = F.col("__ft").isin(bounds["__t"][1]) if bounds["__t"][1] else F.lit(False)
    x = x.withColumn("__ft", (2 * F.col("__ft") + F.when(lone, F.col("__f")).otherwise(0)).cast("int"))

    def joined(fine_col: str, out: str, *more) -> DataFrame:
        """Fine buckets of each group with the number of their block: a bucket above the limit has one to itself."""
        per = x.groupBy(*by, fine_col).agg(F.count(F.lit(1)).alias("__c"), *more)
        before = F.sum("__c").over(Window.partitionBy(*by).orderBy(fine_col)) - F.col("__c")
        large = F.col("__c") > limit
        return per.withColumn(out, (2 * F.floor(before / F.lit(limit)) + large.cast("int")).cast("long")).withColumn("__large", large).drop("__c")

    key = F.struct("__t", "__f")
    blocks = joined("__ft", "__blk", (F.min(key) == F.max(key)).alias("__one"))
    group = Window.partitionBy(*by)
    blocks = written(blocks.select(*by, "__ft", "__blk", (F.col("__large") & F.col("__one")).alias("__alone"),
                                   (F.max("__blk").over(group) > F.min("__blk").over(group)).alias("__many")), "blocks")
    bins = written(joined("__fp", "__bin").drop("__large"), "bins")
    # a few rows for each block; where groups are so many that the table is long, a shuffled join
    sent = [F.broadcast(t) if t.count() <= _SMALL else t for t in (blocks, bins)]
    return x.join(sent[0], [*by, "__ft"]).join(sent[1], [*by, "__fp"]).drop("__ft", "__fp"), blocks


def _counted(cells: DataFrame, by: list[str], place: str, key: list[str], pairs: bool) -> DataFrame:
    """Pairs inside each ``place`` of a group whose ``key`` differs: one ``applyInArrow`` call for each place.

    The counting routine is nested so it is shipped to the Python workers by value (executors need
    only NumPy and Arrow, not this package)."""
    key_fields = [cells.schema[k] for k in by]
    schema = StructType([*key_fields, StructField("numerator2", StringType()), StructField("pairs", StringType())])

    def ranks(*columns):
        """Dense ranks in the order of the columns."""
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def exact_dot(a, b):
        """Sum of products that may exceed 64 bits, from 22-bit digits whose products stay in 64."""
        digits = lambda x: [(x >> k) & 0x3FFFFF for k in (0, 22, 44)]
        return sum(int(np.dot(u, v)) << (22 * (i + j)) for i, u in enumerate(digits(a)) for j, v in enumerate(digits(b)))

    def count(r, p, n, ne):
        """Exact ``(2 x concordant + tied, comparable pairs)`` over cells: two ranks are apart at exactly one
        level, the highest bit in which they differ, so each level is one running count over the predictions."""
        order = np.argsort(p, kind="stable")
        r, p, n, ne = r[order], p[order], n[order], ne[order]
        num2 = pairs = 0
        for level in range(int(r.max()).bit_length()):
            node = r >> (level + 1)
            node = node.astype(np.uint16) if node.max() < 1 << 16 else node
            order = np.argsort(node, kind="stable")
            nd, pp = node[order], p[order]
            right = ((r[order] >> level) & 1).astype(bool)
            e0, c1 = np.where(right, 0, ne[order]), np.where(right, n[order], 0)
            node_new = np.r_[True, nd[1:] != nd[:-1]]
            starts = np.flatnonzero(node_new | np.r_[True, pp[1:] != pp[:-1]])
            e0, c1, node_new = np.add.reduceat(e0, starts), np.add.reduceat(c1, starts), node_new[starts]
            before = np.cumsum(c1) - c1
            below = before - before[node_new][np.cumsum(node_new) - 1]
            num2 += 2 * exact_dot(e0, below) + exact_dot(e0, c1)
            nodes = np.flatnonzero(node_new)
            pairs += exact_dot(np.add.reduceat(e0, nodes), np.add.reduceat(c1, nodes))
        return num2, pairs

    def fn(group, table):
        import pyarrow as pa

        col = lambda c: table.column(c).to_numpy()
        num2, found = count(ranks(*[col(k) for k in key]), ranks(col("__p")), col("__n"), col("__ne"))
        row = [*group[: len(by)], str(num2), str(found if pairs else 0)]
        return pa.Table.from_arrays([pa.array([v.as_py() if isinstance(v, pa.Scalar) else v], t) for v, t in
                                     zip(row, [*[table.schema.field(k).type for k in by], pa.string(), pa.string()])],
                                    names=[*by, "numerator2", "pairs"])

    out = cells.select(*by, place, *key, "__p", "__n", "__ne").groupBy(*by, place).applyInArrow(fn, schema)
    return out.select(*by, F.col("numerator2").cast(_BIG).alias("numerator2"), F.col("pairs").cast(_BIG).alias("pairs"))


def _spark_levels(cells: DataFrame, by: list[str], lo: int, hi: int, pbounds, ties: bool = True) -> DataFrame:
    """Levels ``lo..hi-1``: explode, collapse per ``(level, node, p)`` and one bucketed scan over p.
    Equal p count one half, or nothing without ``ties``."""
    lv = cells.select(*by, "__p", "__r", "__n", "__ne", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("__lvl"))
    side = F.expr("shiftright(__r, __lvl) & 1")
    lv = lv.select(*by, "__lvl", F.expr("shiftright(__r, __lvl + 1)").alias("__node"), "__p",
                   F.when(side == 0, F.col("__ne")).otherwise(F.lit(0)).alias("__e0"),
                   F.when(side == 1, F.col("__n")).otherwise(F.lit(0)).alias("__c1"))
    lv = lv.filter((F.col("__e0") > 0) | (F.col("__c1") > 0))
    node = [*by, "__lvl", "__node"]
    agg = lv.groupBy(*node, "__p").agg(F.sum("__e0").alias("__e0"), F.sum("__c1").alias("__c1"))
    sc = prefix_scan(agg, "__p", {"__below": "__c1"}, by=node, exclusive=True, unique=True, bounds=pbounds)
    e0 = F.col("__e0").cast(_BIG)
    per_node = sc.groupBy(*node).agg(
        F.sum(F.lit(2).cast(_BIG) * e0 * F.col("__below").cast(_BIG) + (e0 * F.col("__c1").cast(_BIG) if ties else F.lit(0).cast(_BIG))).alias("__num"),
        (F.sum("__e0").cast(_BIG) * F.sum("__c1").cast(_BIG)).alias("__pp"))
    return per_node.groupBy(*by).agg(F.sum("__num").alias("numerator2"), F.sum("__pp").alias("pairs"))


def _result(spark, by, rows, key_schema) -> DataFrame:
    fields = list(key_schema.fields) if key_schema is not None else []
    schema = StructType([*fields, StructField("numerator2", DecimalType(38, 0)),
                         StructField("pairs", DecimalType(38, 0))])
    clean = [(*r[:len(by)], Decimal(int(r[len(by)] or 0)), Decimal(int(r[len(by) + 1] or 0))) for r in rows]
    out = spark.createDataFrame(clean, schema)
    conc = F.when(F.col("pairs") > 0,
                  F.col("numerator2").cast("double") / (F.lit(2.0) * F.col("pairs").cast("double")))
    return out.withColumn("concordance", conc)


def concordance(df: DataFrame, time: str = "time", event: str = "event", pred: str = "pred",
                group: str | None = None, buckets: int | None = None) -> DataFrame:
    """MT1/MT2: concordance index overall (one row) or per group (one row per group)."""
    return concordance_counts(df, time, event, pred, [group] if group else [], buckets)


def ranking_score(df: DataFrame, group: str = "grp", time: str = "time", event: str = "event", pred: str = "pred",
                  buckets: int | None = None) -> DataFrame:
    """MT1-MT3: long ``(metric, value)``: ``micro_concordance_index``, ``{slug(group)}_concordance_index``,
    ``macro_concordance_index`` (mean over groups), ``std_concordance_index`` (population std),
    ``stratified_concordance_index`` (= macro - std).

    Overall and per-group pairs are counted in the same distributed pass: the rows are fed once
    under a ``scope`` key for the overall score and once under their group.
    """
    sel = df.select(F.col(group).cast("string").alias("__g"), time, event, pred)
    both = (sel.withColumn("__scope", F.lit(0)).withColumn("__g", F.lit(""))
            .unionByName(sel.filter(F.col("__g").isNotNull()).withColumn("__scope", F.lit(1))))
    c = concordance_counts(both, time, event, pred, ["__scope", "__g"], buckets)
    micro = c.filter(F.col("__scope") == 0).select(F.lit("micro_concordance_index").alias("metric"),
                                                   F.col("concordance").alias("value"))
    per = c.filter(F.col("__scope") == 1).select(F.col("__g").alias("group"), "concordance")
    return micro.unionByName(stratify(per))


def stratify(per_group: DataFrame, group: str = "group", value: str = "concordance") -> DataFrame:
    """MT2/MT3: per-group scores as ``{slug(group)}_concordance_index`` plus ``macro`` (mean),
    ``std`` (population std) and ``stratified`` (= macro - std), long ``(metric, value)``."""
    groups = per_group.select(F.concat(slug(F.col(group)), F.lit("_concordance_index")).alias("metric"),
                              F.col(value).alias("value"))
    stats = per_group.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    summary = stats.select(F.explode(F.array(
        F.struct(F.lit("macro_concordance_index").alias("metric"), F.col("m").alias("value")),
        F.struct(F.lit("std_concordance_index").alias("metric"), F.col("s").alias("value")),
        F.struct(F.lit("stratified_concordance_index").alias("metric"), (F.col("m") - F.col("s")).alias("value")),
    )).alias("r")).select("r.metric", "r.value")
    return groups.unionByName(summary)
