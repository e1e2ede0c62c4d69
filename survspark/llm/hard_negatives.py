"""Hard negatives by Kronecker-packed integer products.

Vectors become integers, floor(scale * x).  The scores of an anchor with several candidates come from one
product of numbers: the components of F candidates are written as digits of one wide integer,
``c_0 + c_1 R + c_2 R^2 ...``, one such integer for each component; the sum over components of anchor
component times wide integer holds the F scores as its digits, and a bias digit for each field, added as one
more component, keeps every digit between 0 and R - 1, so division by R unpacks exact scores.  By
Cauchy-Schwarz no sum over any subset of components exceeds S, the product of the largest norms; so with
R = 2 S + 1 digits never mix, also half-way through a sum.  As many fields are used as fit 53 bits (three
for unit vectors and scale 256), where double-precision matrix products are exact; where S alone does not fit,
the wide integers are Python's, of any width.

Candidates are dealt out by hash into blocks, and anchors into groups; a task holds one block and
streams one group of anchors past it.  Two passes: positives (products within a label only), then the best
negatives of each (anchor, positive) from all other labels.  A task returns at most k rows for each.

Defined cases: rows with a null id, label or vector, an empty vector, or any null or non-finite component take no part;
rows equal in id, label and vector count once; rows of one id but another label or vector are rows of
their own, never each other's candidates; vectors meet only vectors of their length; ties go to the smaller
id; an anchor without positives and a positive without negatives return nothing; vectors whose scaled norm
reaches 2^31 take no part, as their scores need not fit a long; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import shuffle_parts, stored

_EXACT = 1 << 53  # doubles hold every integer up to here
_WIDE = 64  # fields of one Python integer


class Packed:
    """Integer vectors (rows) packed field by field for exact products with anchors of norm up to ``norm``.

    ``norm`` is the integer square root, rounded up, of the largest squared norm of the anchors."""

    def __init__(self, rows: list | np.ndarray, norm: int):
        self.n = len(rows)
        self.bound = max(1, norm * _norm(rows))
        self.radix = 2 * self.bound + 1
        self.fields = 0
        while self.radix ** (self.fields + 1) < _EXACT:
            self.fields += 1
        self.native = self.fields > 0
        self.fields = self.fields or _WIDE
        kind = np.float64 if self.native else object
        rows = _as(rows, kind)
        short = -self.n % self.fields
        rows = np.concatenate([rows, np.zeros((short, rows.shape[1]), kind)]) if short else rows
        wide = rows[0:: self.fields].copy()
        for f in range(1, self.fields):
            wide += rows[f:: self.fields] * kind(self.radix ** f) if self.native else rows[f:: self.fields] * self.radix ** f
        bias = sum(self.bound * self.radix ** f for f in range(self.fields))
        self.wide = np.concatenate([wide, np.full((len(wide), 1), bias, kind)], axis=1).T

    def scores(self, anchors: list | np.ndarray) -> np.ndarray:
        """Exact inner products, one row for each anchor."""
        kind = np.float64 if self.native else object
        anchors = _as(anchors, kind)
        one = np.ones((len(anchors), 1), kind)
        left = np.concatenate([anchors, one], axis=1) @ self.wide
        out = np.empty((len(anchors), left.shape[1], self.fields), np.int64)
        for f in range(self.fields - 1):
            # a quotient below 2^53 / R is exact after floor: the nearest fraction lies 1 / R away
            rest = np.floor(left / self.radix) if self.native else left // self.radix
            out[:, :, f] = left - rest * self.radix - self.bound
            left = rest
        out[:, :, self.fields - 1] = left - self.bound
        return out.reshape(len(anchors), -1)[:, : self.n]


def _as(rows: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        return np.array([[int(x) for x in r] for r in rows], object).reshape(np.shape(rows))
    return np.asarray(rows, np.float64)


def _norm(rows) -> int:
    """The largest norm of integer rows, rounded up."""
    import math

    rows = np.asarray(rows)
    square = float((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    if square < _EXACT:
        return math.isqrt(max(0, int(square) - 1)) + (square > 0)
    return math.isqrt(max(sum(int(x) ** 2 for x in r) for r in rows)) + 1


def _ints(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each row of a list column, as doubles."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * scale)


def usable_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part, each once; the vectors are unscaled doubles."""
    v = F.col(vector)
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.least(F.greatest(x * scale, F.lit(-2.0 ** 32)), F.lit(2.0 ** 32))).cast("double"), 2))
    return df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & whole & (F.size("v") > 0) & (square < 2.0 ** 62)).dropDuplicates(["id", "label", "v"])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _pass(candidates: DataFrame, anchors: DataFrame, meet, schema: dict, extra: list[str], scale: int, block_rows: int, anchor_rows: int) -> DataFrame:
    """Runs ``meet(block, anchors)`` for each block of candidates and group of anchors of one vector length.

    Both sides go to the partition of their (block, group) as rows of one table, candidates first."""
    spark = candidates.sparkSession
    blocks = max(shuffle_parts(spark), -(-candidates.count() // block_rows))
    groups = max(1, -(-anchors.count() // anchor_rows))
    none = [F.lit(None).cast(t).alias(c) for c, t in anchors.select(*extra).dtypes]
    spread = F.xxhash64("id", "label", "v")
    left = candidates.select(F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
                             F.size("v").alias("size"), F.lit(0).alias("side"), "id", "label", "v", *none)
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(spread, F.lit(groups)).cast("int").alias("grp"),
                           F.size("v").alias("size"), F.lit(1).alias("side"), "id", "label", "v", *extra)
    rows = left.unionByName(right).repartition(blocks * groups, "block", "grp").sortWithinPartitions("block", "grp", "size", "side", "label")

    def run(batches):
        key, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "grp", "size")])
            side = batch.column("side").to_numpy()
            cut = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows]):
                if a == b:
                    continue
                part, now = batch.slice(a, b - a), tuple(keys[:, a])
                if now != key:
                    key, held, block = now, [], None
                if side[a] == 0:
                    held.append(part)
                elif held:
                    if block is None:
                        block = Block(pa.Table.from_batches(held), int(now[2]), scale)
                    for found in meet(block, part):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, schema.values())], names=list(schema))

    kinds = {pa.int64(): "long", pa.int32(): "int"}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[t]}" for c, t in schema.items()))


class Block:
    """One block of candidates of one vector length, ordered by label."""

    def __init__(self, t: pa.Table, size: int, scale: int):
        t = t.combine_chunks()
        order = np.argsort(t["label"].to_numpy(), kind="stable")
        self.size, self.scale = size, scale
        self.ids, self.labels = t["id"].to_numpy()[order], t["label"].to_numpy()[order]
        self.rows = _ints(t["v"].combine_chunks(), size, scale)[order]
        self.packs: dict[tuple[int, int, int], Packed] = {}

    def scores(self, anchors: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
        """Scores with the rows from a to b.  Norms are rounded up to powers of two, so few packings serve all anchors."""
        b = len(self.ids) if b is None else b
        norm = 1 << max(0, _norm(anchors) - 1).bit_length()
        if (a, b, norm) not in self.packs:
            self.packs[a, b, norm] = Packed(self.rows[a:b], norm)
        return self.packs[a, b, norm].scores(anchors)


def _slices(part: pa.RecordBatch, rows: int):
    for i in range(0, part.num_rows, rows):
        yield part.slice(i, rows)


def positives(candidates: DataFrame, anchors: DataFrame, k: int = 5, scale: int = 256, block_rows: int = 524_288, anchor_rows: int = 131_072) -> DataFrame:
    """(anchor, place, positive_id, positive_score): the first k other rows of each anchor's label; ``anchor``
    is the row number that ``anchors`` carries."""
    schema = {"anchor": pa.int64(), "positive_id": pa.int64(), "positive_score": pa.int64(), "twin": pa.int64()}

    def meet(block: Block, part: pa.RecordBatch):
        for some in _slices(part, max(1, 4_000_000 // max(1, len(block.ids)))):
            labels, ids, number = (some.column(c).to_numpy() for c in ("label", "id", "anchor"))
            rows = _ints(some.column("v"), block.size, scale)
            out = [[], [], [], []]
            for label in np.unique(labels):
                a, b = np.searchsorted(block.labels, [label, label + 1])
                own = np.flatnonzero(labels == label)
                if a == b:
                    continue
                score = block.scores(rows[own], a, b)
                for i, line in zip(own, score):
                    other = np.flatnonzero(block.ids[a:b] != ids[i])
                    at = other[_best(line[other], block.ids[a:b][other], k)]
                    for column, values in zip(out, (np.full(len(at), number[i]), block.ids[a:b][at], line[at], a + at)):
                        column.append(values)
            if out[0]:
                yield [np.concatenate(c) for c in out]

    found = _pass(candidates, anchors, meet, schema, ["anchor"], scale, block_rows, anchor_rows)
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "twin")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("twin")


def negatives(candidates: DataFrame, anchors: DataFrame, wanted: DataFrame, k: int = 3, low: int = 50, high: int = 95, scale: int = 256,
              block_rows: int = 524_288, anchor_rows: int = 131_072) -> DataFrame:
    """(anchor, place, rank, negative_id, negative_score): for each row of ``wanted`` the first k rows of
    other labels with ``low * positive <= 100 * negative <= high * positive``."""
    schema = {"anchor": pa.int64(), "place": pa.int32(), "negative_id": pa.int64(), "negative_score": pa.int64(), "twin": pa.int64()}
    asked = anchors.join(wanted.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("asked")), "anchor")
    asked = stored(asked, "asked")  # at most k positives an anchor

    def meet(block: Block, part: pa.RecordBatch):
        for some in _slices(part, max(1, 4_000_000 // max(1, len(block.ids)))):
            labels, ids, number = (some.column(c).to_numpy() for c in ("label", "id", "anchor"))
            lines = block.scores(_ints(some.column("v"), block.size, scale))
            out = [[], [], [], [], []]
            for i, asked in enumerate(some.column("asked").to_pylist()):
                limits = [(x["place"], -(-low * x["positive_score"] // 100), high * x["positive_score"] // 100) for x in asked]
                line = lines[i]
                some_score = (line >= min(x[1] for x in limits)) & (line <= max(x[2] for x in limits))
                at = np.flatnonzero(some_score & (block.labels != labels[i]) & (block.ids != ids[i]))
                at = at[np.lexsort((block.ids[at], -line[at]))]
                falling = -line[at]
                for place, least, most in limits:
                    a, b = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    top = at[a: min(b, a + k)] if most >= least else at[:0]
                    for column, values in zip(out, (np.full(len(top), number[i]), np.full(len(top), place), block.ids[top], line[top], top)):
                        column.append(values)
            if out[0]:
                yield [np.concatenate(c) for c in out]

    found = _pass(candidates, asked, meet, schema, ["anchor", "asked"], scale, block_rows, anchor_rows)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "twin")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("twin")


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         block_rows: int = 524_288, anchor_rows: int = 131_072) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among
    ``rows`` (id, label, v)."""
    rows = stored(rows, "vectors")
    anchors = stored(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    best = stored(positives(rows, anchors, n_positives, scale, block_rows, anchor_rows), "positives")
    found = negatives(rows, anchors, best, n_negatives, low, high, scale, block_rows, anchor_rows)
    return (found.join(best, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = usable_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # the contract's labels: every seventh row is mislabelled by one
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("id") % 50 == 0)


SQL = """
WITH e AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, a.label AS la, c.id AS c, c.label AS lc, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM e a JOIN e c ON a.id <> c.id AND len(a.v) = len(c.v) WHERE a.id % 50 = 0),
pos AS (SELECT a, c AS p, score FROM s WHERE la = lc QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
neg AS (SELECT pos.a, pos.p, pos.score AS ps, s.c AS n, s.score AS ns, row_number() OVER (PARTITION BY pos.a, pos.p ORDER BY s.score DESC, s.c) AS rnk
        FROM pos JOIN s ON s.a = pos.a AND s.la <> s.lc AND 50 * pos.score <= 100 * s.score AND 100 * s.score <= 95 * pos.score)
SELECT a AS anchor_id, p AS positive_id, CAST(rnk AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM neg WHERE rnk <= 3"""
