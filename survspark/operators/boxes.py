"""Exact nearest neighbours in few dimensions (JN6, ML6): the space is cut into boxes.

A k-d tree over a bounded sample of the references deals all rows to boxes of about ``survspark.knn.blockRows`` references.  A probe
meets the references of its own box first; only if a face of another box lies within its k-th distance it goes there too, so the
work grows with the rows, not with their square.  Inside a task a tree of the same kind holds some dozens of references a leaf,
and the probes of a leaf are compared with the leaves that their bounds reach.  A fuller box (many equal rows) is cut into blocks
by hash, and its probes meet each.  Distances, ties and left-out references are those of ``knn``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

MOST = 8  # components up to which boxes prune well
_SAMPLE, _PER_BOX = 262_144, 16  # rows of the sample, least number of them in a box
_LEAF, _TOGETHER = 48, 128  # references of a leaf inside a task, probes compared at once
_FOUND = "array<struct<distance:double,id:long,s:double,c:double>>"


class Tree:
    """Cuts ``x[dim] <= value`` down to about ``leaves`` leaves of equal shares of the given rows."""

    def __init__(self, rows: np.ndarray, leaves: int):
        self.dim, self.value, self.child, self.leaves = [], [], [], 0

        def grow(part: np.ndarray, n: int) -> int:
            """The number of the new node, or of the new leaf as ``-1 - leaf``."""
            if n > 1 and len(part) > 1:
                j = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                v = np.sort(part[:, j])
                at = v[(len(v) - 1) // 2]
                if at == v[-1]:
                    at = v[max(np.searchsorted(v, at) - 1, 0)]
                low = part[:, j] <= at
                if not low.all():
                    me, left = len(self.dim), min(n - 1, max(1, round(n * low.mean())))
                    self.dim.append(j), self.value.append(at), self.child.append(None)
                    self.child[me] = (grow(part[low], left), grow(part[~low], n - left))
                    return me
            self.leaves += 1
            return -self.leaves

        self.root = grow(rows, leaves)
        self.dim, self.value, self.child = np.array(self.dim, np.int64), np.array(self.value), np.array(self.child, np.int64).reshape(-1, 2)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.full(len(x), self.root, np.int64)
        open_ = np.arange(len(x)) if self.root >= 0 else np.zeros(0, np.int64)
        while len(open_):
            node = at[open_]
            at[open_] = self.child[node, (x[open_, self.dim[node]] > self.value[node]).astype(np.int64)]
            open_ = open_[at[open_] >= 0]
        return -1 - at

    def fill(self, lo: np.ndarray, hi: np.ndarray, blocks: np.ndarray) -> None:
        """The extents of what the leaves hold, and their numbers of blocks (0: empty)."""
        self.lo, self.hi, self.blocks = lo, hi, blocks

    def visits(self, x: np.ndarray, bound: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all other leaves that may hold a reference within the bound of a row."""
        reach = bound + 1e-9 * (1 + np.where(np.isinf(bound), 0.0, bound) + np.abs(x).max(axis=1))
        found, todo = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                leaf = -1 - node
                rows = rows[own[rows] != leaf]
                if len(rows) and self.blocks[leaf]:
                    with np.errstate(over="ignore"):
                        gap = np.maximum(np.maximum(self.lo[leaf] - x[rows], x[rows] - self.hi[leaf]), 0.0)
                        rows = rows[np.sqrt((gap * gap).sum(axis=1)) <= reach[rows]]
                    found.append((rows, np.full(len(rows), leaf, np.int64)))
                continue
            at, cut = x[rows, self.dim[node]], self.value[node]
            todo += [(self.child[node, 0], rows[at - reach[rows] <= cut]), (self.child[node, 1], rows[at + reach[rows] >= cut])]
        return tuple(np.concatenate(c) for c in zip(*found))


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Block:
    """References of a block by leaf, and the search of probes among them."""

    def __init__(self, t, size: int):
        v = _matrix(t["v"].combine_chunks(), size)
        self.tree = Tree(v, -(-len(v) // _LEAF))
        leaf = self.tree.home(v)
        order = np.argsort(leaf, kind="stable")
        self.v, self.flat = v[order], np.ascontiguousarray(v[order].T)
        self.ids, self.s, self.c = (t[n].to_numpy()[order] for n in ("id", "s", "c"))
        self.codes: dict = {}
        self.grp = np.array([self.codes.setdefault(g, len(self.codes)) for g in t["grp"].to_pylist()], np.int32)[order]
        self.n = np.bincount(leaf, minlength=self.tree.leaves)
        self.start = np.cumsum(self.n) - self.n
        self.lo, self.hi = np.full((self.tree.leaves, size), np.inf), np.full((self.tree.leaves, size), -np.inf)
        held = np.flatnonzero(self.n)
        self.lo[held], self.hi[held] = np.minimum.reduceat(self.v, self.start[held]), np.maximum.reduceat(self.v, self.start[held])

    def _squares(self, x, ids, grp, refs, skip_self: bool) -> np.ndarray:
        """Squared distances, NaN where the reference is left out."""
        out = np.zeros((len(x), len(refs)))
        with np.errstate(over="ignore"):
            for j in range(x.shape[1]):
                d = x[:, j, None] - self.flat[j][refs]
                d *= d
                out += d
        left = grp[:, None] == self.grp[refs]
        if skip_self:
            left |= ids[:, None] == self.ids[refs]
        out[left] = np.nan
        return out

    def search(self, x: np.ndarray, ids: np.ndarray, grp: list, bound: np.ndarray, k: int, skip_self: bool):
        """(probe, reference, distance) of the best ``k`` of each probe within its bound, and the bounds that follow."""
        grp = np.array([-1 if g is None else self.codes.get(g, -1) for g in grp], np.int32)
        bound, found = np.where(np.isnan(bound), np.inf, bound), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        leaf = self.tree.home(x)
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(order)]):
            own = np.arange(self.start[leaf[order[a]]], self.start[leaf[order[a]]] + self.n[leaf[order[a]]])
            for i in range(a, b, _TOGETHER):
                found.append(self._compare(x, ids, grp, bound, order[i: min(i + _TOGETHER, b)], own, k, skip_self))
        return (*(np.concatenate(c) for c in zip(*found)), bound)

    def _compare(self, x, ids, grp, bound, who, own, k: int, skip_self: bool):
        y, top = x[who], bound[who]
        if np.isinf(top).any() and len(own) > k:  # the own leaf gives a first bound
            d = np.partition(self._squares(y, ids[who], grp[who], own, skip_self), k - 1, axis=1)[:, k - 1]
            top = np.fmin(top, np.sqrt(d))
        with np.errstate(over="ignore", invalid="ignore"):
            gap = np.maximum(np.maximum(self.lo - y.max(axis=0), y.min(axis=0) - self.hi), 0.0)
            near = np.flatnonzero((self.n > 0) & ((gap * gap).sum(axis=1) <= top.max() ** 2 * (1 + 1e-9) + 1e-300))
        n = self.n[near]
        refs = np.arange(n.sum()) + np.repeat(self.start[near] - (np.cumsum(n) - n), n)
        out = []
        for i in range(0, len(who), max(1, 4_000_000 // max(1, len(refs)))):  # all references for a probe without a bound
            w = who[i: i + max(1, 4_000_000 // max(1, len(refs)))]
            d2 = self._squares(x[w], ids[w], grp[w], refs, skip_self)
            kth = np.full(len(w), np.inf)
            if len(refs) > k:
                kth = np.fmin(kth, np.partition(d2, k - 1, axis=1)[:, k - 1])
            p, r = np.nonzero(d2 <= (kth * (1 + 1e-15))[:, None])
            d, kth = np.sqrt(d2[p, r]), np.fmin(np.sqrt(kth), bound[w])
            fit = d <= kth[p]
            p, r, d = p[fit], refs[r[fit]], d[fit]
            many = np.bincount(p, minlength=len(w))
            if (many > k).any():  # equal distances: the smaller ids
                o = np.lexsort((self.ids[r], d, p))
                p, r, d = p[o], r[o], d[o]
                keep = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many) < k
                p, r, d = p[keep], r[keep], d[keep]
            full = many >= k
            bound[w[full]] = kth[full]
            out.append((w[p], r, d))
        return tuple(np.concatenate(c) for c in zip(*out))


def _dealt(rows: DataFrame, tree: Tree, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.home(_matrix(batch.column("v"), size)).astype(np.int32)))

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", leaf int")


def _meet(refs: DataFrame, probes: DataFrame, tree: Tree, size: int, k: int, skip_self: bool, first: bool, brief: bool) -> DataFrame:
    """Each probe with what it found in the block that it visits.  In its own box (``first``) also the boxes to visit next, and
    whether its result is ``open``; a closed ``brief`` result has the sums of ``s`` and ``c`` only."""
    none = {"row": "long", "bound": "double", "s": "double", "c": "double"}
    cols = ["leaf", "block", "side", "row", "id", "grp", "v", "s", "c", "bound"]
    left = refs.withColumn("side", F.lit(0)).withColumns({n: F.lit(None).cast(none[n]) for n in ("row", "bound")})
    right = probes.withColumn("side", F.lit(1)).withColumns({n: F.lit(None).cast(none[n]) for n in ("s", "c")})
    parts = max(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(tree.blocks.sum()), 2000))
    both = left.select(*cols).unionByName(right.select(*cols)).repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", "side")

    def results(block, part, leaf: int, number: int):
        x = _matrix(part.column("v"), size)
        ids, n = part.column("id").to_numpy(), part.num_rows
        p, r, d, bound = block.search(x, ids, part.column("grp").to_pylist(), part.column("bound").to_numpy(zero_copy_only=False), k, skip_self)
        many = int(tree.blocks[leaf]) > 1
        to = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if first and not number:  # one block of the box says where to go next
            to = tree.visits(x, bound, np.full(n, leaf))
            to = tuple(c[np.argsort(to[0], kind="stable")] for c in to)
        open_ = np.bincount(to[0], minlength=n) > 0
        open_ |= many or not first
        s, c = (np.bincount(p, of[r], minlength=n).astype(float) for of in (block.s, block.c))  # without rows the counts are integers
        kept = open_[p] if brief else np.ones(len(p), bool)
        o = np.flatnonzero(kept)[np.argsort(p[kept], kind="stable")]
        items = pa.StructArray.from_arrays([pa.array(d[o]), pa.array(block.ids[r[o]]), pa.array(block.s[r[o]]), pa.array(block.c[r[o]])], names=["distance", "id", "s", "c"])
        ends = np.append(0, np.cumsum(np.bincount(p[o], minlength=n))).astype(np.int32)
        stops = np.append(0, np.cumsum(np.bincount(to[0], minlength=n))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("id"), part.column("grp"), part.column("v"), pa.array(bound), pa.array(open_), pa.array(s), pa.array(c),
             pa.ListArray.from_arrays(pa.array(ends), items), pa.ListArray.from_arrays(pa.array(stops), pa.array(to[1].astype(np.int32)))],
            names=["row", "id", "grp", "v", "bound", "open", "s", "c", "found", "visits"])

    def run(batches):
        key, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("leaf", "block", "side")])
            cut = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows]):
                if a == b:
                    continue
                part, now = batch.slice(a, b - a), (int(keys[0, a]), int(keys[1, a]))
                if now != key:
                    key, held, block = now, [], None
                if keys[2, a] == 0:
                    held.append(part)
                    continue
                if block is None:
                    whole = pa.Table.from_batches(held or [part.slice(0, 0)]).combine_chunks()
                    block, held = Block(whole, size), [None]
                for i in range(0, part.num_rows, 5000):
                    yield results(block, part.slice(i, 5000), *now)

    return both.mapInArrow(run, f"row long, id long, grp string, v array<double>, bound double, open boolean, s double, c double, found {_FOUND}, visits array<int>")


def nearest(probes: DataFrame, refs: DataFrame, size: int, n: int, k: int, exclude_self: bool, target: int, most: int, brief: bool) -> DataFrame:
    """``(row, id, found)`` of probes ``(row, id, grp, v)`` among references ``(id, grp, v, s, c)``, ``n`` of them, in boxes of about
    ``target`` and blocks of at most ``most``; ``brief`` gives ``(id, s, c)``, the sums over what was found."""
    leaves = max(1, min(_SAMPLE // _PER_BOX, -(-n // target)))
    some = max(1, n // min(_SAMPLE, 64 * leaves))
    sample = refs.where(F.pmod(F.xxhash64("id", "v"), F.lit(some)) == 0).select("v").limit(2 * _SAMPLE).toArrow()
    tree = Tree(_matrix(sample["v"].combine_chunks(), size), leaves)
    held = written(_dealt(refs, tree, size), "knn_boxes")
    ends = [g(F.col("v")[j]).alias(f"{name}{j}") for name, g in (("lo", F.min), ("hi", F.max)) for j in range(size)]
    lo, hi, blocks = np.full((tree.leaves, size), np.inf), np.full((tree.leaves, size), -np.inf), np.zeros(tree.leaves, np.int64)
    for r in held.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).collect():  # one row a box
        lo[r["leaf"]], hi[r["leaf"]] = [r[f"lo{j}"] for j in range(size)], [r[f"hi{j}"] for j in range(size)]
        blocks[r["leaf"]] = -(-r["n"] // most)
    tree.fill(lo, hi, blocks)
    count = F.lit(blocks.tolist())[F.col("leaf")]
    held = held.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.greatest(count, F.lit(1))).cast("int"))
    blocked = F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1))  # an empty box is visited too: it says where to go
    home = _dealt(probes, tree, size).withColumn("bound", F.lit(None).cast("double")).withColumn("block", blocked)
    near = written(_meet(held, home, tree, size, k, exclude_self, True, brief), "knn_near")
    onward = near.where(F.size("visits") > 0).select("row", "id", "grp", "v", "bound", F.explode("visits").alias("leaf")).withColumn("block", blocked)
    more = _meet(held, onward, tree, size, k, exclude_self, False, brief)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")
    merged = near.where("open").select("row", "id", "found").unionByName(more.select("row", "id", "found")).groupBy("row").agg(F.first("id").alias("id"), best)
    if not brief:
        return near.where("not open").select("row", "id", F.array_sort("found").alias("found")).unionByName(merged)
    total = [F.aggregate("found", F.lit(0.0), add).alias(f) for f, add in (("s", lambda a, x: a + x["s"]), ("c", lambda a, x: a + x["c"]))]
    return near.where("not open").select("id", "s", "c").unionByName(merged.select("id", *total))
