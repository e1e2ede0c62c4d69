"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  Each block of vectors keeps inverted files:
for every pivot, the rows that have it among their nearest, with its place.  A query walks the posting
lists of its own pivots, sums the differences of places (Spearman's footrule; a pivot that a row lacks
counts the full length), takes the best share of the block and reranks it by exact cosine.

Pivots are fitted on a bounded sample of rows (``sample_rows``); every row is indexed.  The rerank
share is relative to the block, so it behaves alike at every size, and rows tied at its edge are all
reranked.  Blocks of queries meet blocks of rows; per query only the best few of each block travel.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part
(neither as query nor as candidate), nor do vectors whose length differs from that of the pivots; with fewer candidates
than asked for, all are returned; ties in score go to the smaller id; repeated rows of one id are
candidates of their own but never of the query with the same id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored


def usable_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return df.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & whole & F.exists("v", lambda x: x != 0))


def fit_pivots(vectors: DataFrame, pivots: int = 256, sample_rows: int = 4096) -> np.ndarray:
    """Unit pivots: ``pivots`` vectors of a sample of at most ``sample_rows`` distinct ones, those with the
    smallest hashes, which is a random and repeatable choice."""
    # the smallest hashes: a top-k, which keeps k rows a task
    rows = vectors.select("v", F.xxhash64("v").alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(sample_rows).collect()
    if not rows:
        return np.zeros((0, 0))
    size = max({len(r["v"]) for r in rows}, key=[len(r["v"]) for r in rows].count)
    x = np.array([r["v"] for r in rows if len(r["v"]) == size])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x[: min(pivots, len(x))]  # a random sample: hashes do not follow the vectors


def _unit(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / scale
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def permutation(v: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each row, nearest first."""
    near = _unit(v) @ pivots.T
    length = min(length, near.shape[1])
    part = np.argpartition(-near, length - 1, axis=1)[:, :length]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)


class InvertedFiles:
    """Posting lists of one block: rows and their places, ordered by pivot."""

    def __init__(self, perms: np.ndarray, pivots: int):
        n, length = perms.shape
        order = np.argsort(perms.ravel(), kind="stable")
        self.rows, self.places = np.divmod(order, length)
        self.bounds = np.searchsorted(perms.ravel()[order], np.arange(pivots + 1))
        self.n, self.length = n, length

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance of a query to every row; rows met in no list keep the maximum."""
        saved = np.zeros(self.n, np.int32)
        for place, p in enumerate(perm):
            a, b = self.bounds[p], self.bounds[p + 1]
            saved[self.rows[a:b]] += (self.length - np.abs(self.places[a:b] - place)).astype(np.int32)
        return self.length * self.length - saved


def cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine in double precision; equal rows give equal results wherever they stand."""
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


def search(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 256, length: int = 64, share: float = 0.15,
           sample_rows: int = 4096, block_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (id, v) where ``is_query``."""
    vectors = stored(vectors, "ann_vectors")
    pivot = fit_pivots(vectors, pivots, sample_rows)
    dim = pivot.shape[1] if len(pivot) else 0
    vectors = vectors.where(F.size("v") == dim)
    rows = vectors.count()
    blocks, query_blocks = max(1, -(-rows // block_rows)), max(1, -(-vectors.where(is_query).count() // query_rows))
    spread = F.xxhash64("id", "v")
    # each block of rows meets each block of queries once: (block, query block) is the unit of work
    cand = vectors.select("id", "v", F.pmod(spread, F.lit(blocks)).cast("int").alias("block")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    quer = vectors.where(is_query).select("id", "v", F.pmod(spread, F.lit(query_blocks)).cast("int").alias("qb")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(t: pa.Table) -> np.ndarray:
        return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], []
        if len(left) and len(right):
            ids, v = right["id"].to_numpy(), matrix(right)
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            files = InvertedFiles(permutation(v, pivot, length), len(pivot))
            q = matrix(left)
            for qid, x, perm in zip(left["id"].to_numpy(), q, permutation(q, pivot, length)):
                far = files.footrule(perm)
                far[ids == qid] = np.iinfo(np.int32).max
                most = min(len(ids), max(int(share * len(ids)), 4 * k))
                edge = np.partition(far, most - 1)[most - 1]
                near = np.flatnonzero((far <= edge) & (ids != qid))
                score = cosine(x, v[near])
                best = np.argsort(-score, kind="stable")[:k]
                out[0].append(np.full(len(best), qid))
                out[1].append(ids[near[best]])
                out[2].append(score[best])
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)),
                         "score": pa.array(cols[2].astype(np.float64))})

    # ``toArrow`` groups: one block of rows and one of queries are what a task holds
    found = quer.groupBy("block", "qb").cogroup(cand.groupBy("block", "qb")).applyInArrow(
        run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    return search(usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("id") % 50 == 0)
