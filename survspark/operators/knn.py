"""Exact k-nearest neighbours between two tables, also out of fold (JN6, ML6).

References are dealt to the cells of a bounded set of pivots (each to its nearest one); neighbouring cells are put
together to groups, and a group with many references is split into blocks of bounded size.  A probe first meets the group of its
nearest pivot, which bounds the distance of its k-th neighbour.  A cell holds no nearer reference if its pivot is
further away than that bound plus the cell's radius, or if the plane half way between its pivot and the probe's own
is further away than the bound; groups with such cells only never meet the probe, and inside a group such cells are passed over.

A task holds one block and streams the probes past it in batches, cell by cell: a matrix product gives the distances up
to rounding, and what may be among the best k is compared by exact differences.  A task returns at most k rows for
a probe, so no pair becomes a row.  Pivots are fitted on a bounded sample (the rows with the smallest hashes, at most
``_PIVOTS``); every row is searched, and the sample only sets how much is pruned.

Defined cases: rows with a null key or vector, a null or non-finite component, or a length other than the
references' most common one take no part; ties in distance go to the smaller neighbour key; repeated rows are
rows of their own; with fewer references than k, all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import boxes

_PIVOTS = 4096
_SLACK = 1e-9  # relative room for rounding where a bound decides
_TASKS = 48  # least number of groups of cells, where there are so many cells


def cell_rows(df: DataFrame) -> int:
    """Average number of references in a cell (``survspark.knn.cellRows``)."""
    return int(df.sparkSession.conf.get("survspark.knn.cellRows", "1000"))


def block_rows(df: DataFrame) -> int:
    """Most references that a task holds (``survspark.knn.blockRows``)."""
    return int(df.sparkSession.conf.get("survspark.knn.blockRows", "20000"))


def _usable(df: DataFrame, key: str, vec: str, group: str | None, *more: Column) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return df.select(F.col(key).cast("long").alias("id"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"),
                     v.alias("v"), *more).where(F.col("id").isNotNull() & whole & (F.size("v") > 0))


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y by their differences, a component at a time."""
    out = np.empty((len(x), len(y)))
    step, flat = max(1, 131_072 // max(1, len(y))), np.ascontiguousarray(y.T)
    for i in range(0, len(x), step):
        part, to = x[i: i + step], out[i: i + step]
        to[:] = 0.0
        for j in range(x.shape[1]):
            d = part[:, j, None] - flat[j]
            d *= d
            to += d
    return out


def _slices(n: int, width: int):
    """Slices of rows whose products with ``width`` columns stay in a core's cache."""
    step = max(1, 65_536 // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest pivot of each row and its squared distance."""
    cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for s in _slices(len(x), len(pivots)):
        d = _squares(x[s], pivots)
        cell[s] = d.argmin(axis=1)
        far[s] = d[np.arange(len(d)), cell[s]]
    return cell, far


class Cells:
    """Pivots with the radius of their cells, and the groups of cells with their blocks; a bounded literal of the tasks."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.size = pivots, pivots.shape[1]
        self.radius, self.group = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
        self.blocks = np.zeros(1, np.int64)
        self._apart = None

    def __getstate__(self):
        return {**self.__dict__, "_apart": None}

    @property
    def apart(self) -> np.ndarray:
        """Squared distances of the pivots, worked out once in a worker."""
        if self._apart is None:
            self._apart = _squares(self.pivots, self.pivots)
        return self._apart

    def fill(self, stats, target: int, most: int) -> None:
        """Radii, and groups of neighbouring cells of up to ``target`` references in blocks of ``most``."""
        n = np.zeros(len(self.pivots), np.int64)
        for r in stats:
            self.radius[r["cell"]], n[r["cell"]] = r["radius"], r["n"]
        parts, groups = [np.arange(len(n))], []
        while parts:  # halves by the widest component until the references fit
            part = parts.pop()
            if len(part) == 1 or n[part].sum() <= target:
                groups.append(part)
                continue
            v = self.pivots[part]
            order = part[np.argsort(v[:, np.argmax(v.max(axis=0) - v.min(axis=0))], kind="stable")]
            parts += [order[: len(order) // 2], order[len(order) // 2:]]
        self.blocks = np.zeros(len(groups), np.int64)
        for g, part in enumerate(groups):
            self.group[part], self.blocks[g] = g, -(-int(n[part].sum()) // most)

    def visits(self, to_pivots: np.ndarray, home: np.ndarray, bound: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether the cells ``which`` may hold a reference within the bound of each probe; ``to_pivots`` holds the squared
        distances to these cells' pivots, ``home`` the probe's own cell and that pivot's squared distance."""
        own, near = home[0].astype(np.int64), home[1][:, None]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            d = np.sqrt(to_pivots)
            least = np.maximum(d - self.radius[which], (to_pivots - near - 1e-12 * (to_pivots + near)) / (2 * np.sqrt(self.apart[own[:, None], which])))
            return ~(least > bound[:, None] + _SLACK * (1 + d + np.where(np.isinf(bound), 0.0, bound)[:, None])) & (self.radius[which] >= 0)


def _assigned(rows: DataFrame, cells: Cells) -> DataFrame:
    """Each row with its cell and its distance to the cell's pivot."""

    def run(batches):
        for batch in batches:
            cell, far = _nearest(_matrix(batch.column("v"), cells.size), cells.pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(far))],
                                             names=[*batch.schema.names, "cell", "far"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", cell int, far double")


def _meet(refs: DataFrame, probes: DataFrame, cells: Cells, k: int, skip_self: bool) -> DataFrame:
    """(row, id, distance): for each probe (row, id, grp, v, group, block, home, near, bound) the best k of the block that it visits."""
    cols = ["group", "block", "side", "cell", "row", "id", "grp", "v", "home", "near", "bound"]
    left = refs.select("group", "block", F.lit(0).alias("side"), "cell", F.lit(None).cast("long").alias("row"), "id", "grp", "v",
                       F.lit(None).cast("int").alias("home"), F.lit(None).cast("double").alias("near"), F.lit(None).cast("double").alias("bound"))
    right = probes.select("group", "block", F.lit(1).alias("side"), F.col("home").alias("cell"), "row", "id", "grp", "v", "home", "near", "bound")
    parts = max(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(cells.blocks.sum()), 2000))
    both = left.unionByName(right).select(*cols).repartition(parts, "group", "block").sortWithinPartitions("group", "block", "side", "cell")

    def run(batches):
        key, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("group", "block", "side")])
            cut = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows]):
                if a == b:
                    continue
                part, now = batch.slice(a, b - a), (int(keys[0, a]), int(keys[1, a]))
                if now != key:
                    key, held, block = now, [], None
                if keys[2, a] == 0:
                    held.append(part)
                elif held:
                    if block is None:
                        block, held = _Block(pa.Table.from_batches(held).combine_chunks(), cells), [None]
                    for i in range(0, part.num_rows, 2000):
                        found = block.search(part.slice(i, 2000), k, skip_self)
                        if len(found[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["row", "id", "distance"])

    return both.mapInArrow(run, "row long, id long, distance double")


class _Block:
    """References of a block, cell by cell, and the search of a batch of probes among them."""

    def __init__(self, t, cells: Cells):
        self.cells, self.ids = cells, t["id"].to_numpy()
        self.codes: dict = {}
        self.grp = np.array([self.codes.setdefault(g, len(self.codes)) for g in t["grp"].to_pylist()], np.int64)
        cell = t["cell"].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.which, self.start, self.end = cell[start].astype(np.int64), start, np.append(start[1:], len(cell))
        self.v = _matrix(t["v"].combine_chunks(), cells.size)
        self.centre = self.v.mean(axis=0)
        self.flat = np.ascontiguousarray((self.v - self.centre).T)
        self.norm = (self.flat * self.flat).sum(axis=0)

    def search(self, part, k: int, skip_self: bool):
        x = _matrix(part.column("v"), self.cells.size)
        rows, own, home, near, bound = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "home", "near", "bound"))
        grp = np.array([-1 if g is None else self.codes.get(g, -1) for g in part.column("grp").to_pylist()], np.int64)
        bound = np.where(np.isnan(bound), np.inf, bound)
        y = x - self.centre
        norm = (y * y).sum(axis=1)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # probe, id, distance: at most k a probe
        done = np.zeros((len(x), len(self.which)), bool)

        def compare(c: int, who: np.ndarray) -> None:
            nonlocal best, bound
            a, b = self.start[c], self.end[c]
            for a in range(a, b, 4000):
                e = min(a + 4000, b)
                for i in range(0, len(who), 500):
                    w = who[i: i + 500]
                    with np.errstate(invalid="ignore", over="ignore"):
                        d2 = y[w] @ self.flat[:, a:e]
                        d2 *= -2.0
                        d2 += self.norm[a:e]
                        d2 += norm[w, None]
                        room = 1e-15 * (self.cells.size + 8) * (norm[w] + self.norm[a:e].max())
                        top = bound[w] * bound[w] * (1 + 1e-12) + room
                        wide = np.flatnonzero(np.isinf(bound[w]))
                        if len(wide):  # without a bound: the k-th of those that may be taken
                            own_ = d2[wide]
                            if skip_self:
                                own_[self.ids[a:e][None, :] == own[w[wide], None]] = np.inf
                            own_[self.grp[a:e][None, :] == grp[w[wide], None]] = np.inf
                            if e - a > k:
                                top[wide] = np.partition(own_, k - 1, axis=1)[:, k - 1] + 2 * room[wide]
                        p, r = np.nonzero(~(d2 > top[:, None]))
                    p, r = w[p], r + a
                    ok = grp[p] != self.grp[r]
                    if skip_self:
                        ok &= self.ids[r] != own[p]
                    p, r = p[ok], r[ok]
                    if not len(p):
                        continue
                    d = np.empty(len(p))
                    for j in range(0, len(p), 100_000):
                        diff = self.v[r[j: j + 100_000]] - x[p[j: j + 100_000]]
                        d[j: j + 100_000] = np.sqrt((diff * diff).sum(axis=1))
                    fit = d <= bound[p]
                    p, r, d = p[fit], r[fit], d[fit]
                    if not len(p):
                        continue
                    mine = np.isin(best[0], p)
                    rest = tuple(q[~mine] for q in best)
                    p, q, d = np.concatenate([best[0][mine], p]), np.concatenate([best[1][mine], self.ids[r]]), np.concatenate([best[2][mine], d])
                    order = np.lexsort((q, d, p))
                    p, q, d = p[order], q[order], d[order]
                    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                    rank = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))
                    kth = rank == k - 1
                    bound[p[kth]] = np.minimum(bound[p[kth]], d[kth])
                    keep = rank < k
                    best = tuple(np.concatenate([o, n[keep]]) for o, n in zip(rest, (p, q, d)))

        for c, cell in enumerate(self.which.tolist()):  # probes at home here get their bound first
            who = np.flatnonzero(home == cell)
            if len(who):
                done[who, c] = True
                compare(c, who)
        to = _squares(x, self.cells.pivots[self.which])
        for c in range(len(self.which)):
            who = np.flatnonzero(self.cells.visits(to[:, c: c + 1], (home, near), bound, self.which[c: c + 1])[:, 0] & ~done[:, c])
            if len(who):
                compare(c, who)
        return rows[best[0]], best[1], best[2]


def _common_size(found: DataFrame):
    """The length that most references have, and their number."""
    return found.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()


def _box_rows(refs: DataFrame, n: int, cells: int | None = None) -> tuple[int, int]:
    """References of a box and of a block: enough boxes for many tasks, each within what a task may hold."""
    most = block_rows(refs)
    return max(1, -(-n // cells)) if cells else min(most, max(n // _TASKS, cell_rows(refs))), most


def knn_between(probes: DataFrame, refs: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 5, exclude_self: bool = False,
                group: str | None = None, cells: int | None = None) -> DataFrame:
    """JN6: exact Euclidean k-NN of every probe among the references: ``(key, rank, neighbor_id, distance)``.

    ``exclude_self`` leaves out references with the probe's key; with ``group`` references of the probe's own group
    are left out (a fold: neighbours come from the other folds only; a null group leaves out nothing)."""
    spark, k = refs.sparkSession, int(k)
    found = _usable(refs, key, vec, group)
    by_size = _common_size(found)
    rows = _usable(probes, key, vec, group).withColumn("row", F.monotonically_increasing_id())
    if by_size is None:
        return rows.select(F.col("id").alias(key), F.lit(0).alias("rank"), F.col("id").alias("neighbor_id"), F.lit(0.0).alias("distance")).where("false")
    if by_size["size"] <= boxes.MOST:
        size, n = by_size["size"], by_size["count"]
        best = boxes.nearest(rows.where(F.size("v") == size), found.where(F.size("v") == size).select("*", F.lit(0.0).alias("s"), F.lit(0.0).alias("c")),
                             size, n, k, exclude_self, *_box_rows(refs, n, cells), brief=False)
        return best.select("id", F.posexplode("found").alias("at", "x")).select(
            F.col("id").alias(key), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").alias("distance"))
    size, n = by_size["size"], by_size["count"]
    found, rows = found.where(F.size("v") == size), written(rows.where(F.size("v") == size), "knn_probes")
    count = max(1, min(_PIVOTS, cells or -(-n // cell_rows(refs))))
    sample = found.select("v", F.xxhash64("v").alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(count).collect()
    grid = Cells(np.array([r["v"] for r in sample], np.float64))
    most = block_rows(refs)
    held = written(_assigned(found, grid), "knn_cells")
    # enough blocks for many tasks, each within what a task may hold
    grid.fill(held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect(),  # one row a pivot
              min(most, max(n // _TASKS, cell_rows(refs))), most)
    held = held.withColumn("group", F.lit(grid.group.tolist())[F.col("cell")].cast("int"))
    held = held.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.greatest(F.lit(grid.blocks.tolist())[F.col("group")], F.lit(1))).cast("int"))
    # 1. the group of the nearest cell that holds references: a bound for the k-th neighbour
    home = _routed(rows.withColumn("bound", F.lit(None).cast("double")), grid, first=True)
    near = written(_meet(held, home, grid, k, exclude_self), "knn_near")
    kth = near.groupBy("row").agg(F.sort_array(F.collect_list("distance")).alias("d"))  # at most k a block of one group
    bound = rows.join(kth.select("row", F.when(F.size("d") >= k, F.col("d")[k - 1]).alias("bound")), "row", "left")
    # 2. every other group that may hold a nearer one
    more = _meet(held, _routed(bound, grid, first=False), grid, k, exclude_self)
    order = Window.partitionBy("row").orderBy("distance", "id")
    best = near.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumnRenamed("id", "neighbor_id").join(rows.select("row", F.col("id").alias(key)), "row").select(
        key, F.col("rank").cast("int").alias("rank"), "neighbor_id", "distance")


def _routed(rows: DataFrame, cells: Cells, first: bool) -> DataFrame:
    """Each probe once for each block of the groups it visits: that of the nearest cell that holds references (``first``),
    or all others with a cell that may hold a reference within the bound."""
    rows = rows.select("row", "id", "grp", "v", "bound")
    order = np.argsort(cells.group, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(cells.group[order]) != 0]))
    held = np.flatnonzero(cells.radius >= 0)

    def route(batch):
        x = _matrix(batch.column("v"), cells.size)
        home, near = _nearest(x, cells.pivots[held])
        home = held[home]
        own = cells.group[home]
        if first:
            probe, group = np.arange(len(home)), own
        else:
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            bound = np.where(np.isnan(bound), np.inf, bound)
            visit = np.zeros((len(x), len(start)), bool)
            for s in _slices(len(x), len(order)):
                visit[s] = np.logical_or.reduceat(cells.visits(_squares(x[s], cells.pivots[order]), (home[s], near[s]), bound[s], order), start, axis=1)
            visit[np.arange(len(home)), own] = False
            probe, group = np.nonzero(visit)
        times = cells.blocks[group]
        at = np.repeat(np.arange(len(probe)), times)
        block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        for i in range(0, len(at), 10_000):
            s = at[i: i + 10_000]
            out = batch.take(pa.array(probe[s]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(group[s].astype(np.int32)), pa.array(block[i: i + 10_000].astype(np.int32)),
                                              pa.array(home[probe[s]].astype(np.int32)), pa.array(near[probe[s]])],
                                             names=[*out.schema.names, "group", "block", "home", "near"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):  # a row may visit many groups
                yield from route(batch.slice(i, 1000))

    return rows.mapInArrow(run, "row long, id long, grp string, v array<double>, bound double, group int, block int, home int, near double")


def knn(df: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 5, blocks: int | None = None,
        exclude_self: bool = True) -> DataFrame:
    """Leave-one-out exact Euclidean k-NN of every row among all other rows:
    ``(key, rank, neighbor_id, distance)`` with ``rank`` 1..k (distances in float64)."""
    return knn_between(df, df, key, vec, k, exclude_self, cells=blocks)


def knn_classify(neighbors: DataFrame, labels: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """ML6: majority label among the neighbours (smallest label on ties) and its vote share."""
    lab = labels.select(F.col(key).alias("neighbor_id"), F.col(label).alias("__l"))
    votes = neighbors.join(lab, "neighbor_id").groupBy(key, "__l").agg(F.count(F.lit(1)).alias("__c"))
    tot = neighbors.groupBy(key).agg(F.count(F.lit(1)).alias("__k"))
    best = votes.groupBy(key).agg(F.min_by(F.struct("__l", "__c"), F.struct((-F.col("__c")).alias("c"), "__l")).alias("b"))
    return (best.join(tot, key).select(key, F.col("b.__l").alias("predicted_label"),
                                       (F.col("b.__c") / F.col("__k")).alias("share")))


def knn_oof(df: DataFrame, target: str, fold: str = "fold", key: str = "vec_id", vec: str = "embedding", k: int = 5) -> DataFrame:
    """ML6: out-of-fold k-NN score ``(key, fold, prediction)``: the mean target of the k nearest rows of all other folds.
    Rows of a null fold are neighbours of all and are scored by none."""
    scored = df.where(F.col(fold).isNotNull())
    found = _usable(df, key, vec, fold)
    by_size = _common_size(found)
    if by_size is None or by_size["size"] > boxes.MOST:
        near = knn_between(scored, df, key, vec, k, exclude_self=True, group=fold)
        got = near.join(df.select(F.col(key).alias("neighbor_id"), F.col(target).cast("double").alias("__y")), "neighbor_id").groupBy(key).agg(F.avg("__y").alias("prediction"))
        return scored.select(key, fold).join(got, key, "left")
    size, n = by_size["size"], by_size["count"]
    # a neighbour stands for all rows of its key: references carry their own target, or the sums of a key that comes more than once
    y = F.col(target).cast("double")
    sums = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("__s"), F.count(y).cast("double").alias("__c")).where("__n > 1").drop("__n")
    refs = _usable(df, key, vec, fold, y.alias("s")).where(F.size("v") == size).join(written(sums, "knn_keys"), "id", "left").select(
        "id", "grp", "v", F.coalesce("__s", "s", F.lit(0.0)).alias("s"), F.coalesce("__c", F.col("s").isNotNull().cast("double")).alias("c"))
    rows = _usable(scored, key, vec, fold).where(F.size("v") == size).withColumn("row", F.monotonically_increasing_id())
    near = boxes.nearest(rows, refs, size, n, int(k), True, *_box_rows(df, n), brief=True)
    got = near.groupBy(F.col("id").alias(key)).agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0.0))).alias("prediction"))
    return scored.select(key, fold).join(got, key, "left")
