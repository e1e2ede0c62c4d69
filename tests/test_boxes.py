import numpy as np
import pytest

import survspark.operators.boxes as boxes
from survspark.operators.knn import knn_between, knn_oof

SCHEMA = "vec_id long, fold int, embedding array<double>, y int"


def _rows(n, seed=0):
    """Steps in one component, steady values in the others, and rows at the same place."""
    rng = np.random.default_rng(seed)
    v = np.column_stack([rng.integers(0, 4, n) * 2.0, rng.normal(size=n), rng.integers(0, 60, n) / 16])
    v[n // 2: n // 2 + n // 8] = v[: n // 8]
    return [(i, int(rng.integers(0, 3)), v[i].tolist(), int(rng.integers(0, 2))) for i in range(n)]


def _brute(rows, k):
    v, f = np.array([r[2] for r in rows]), np.array([-1 if r[1] is None else r[1] for r in rows])
    ids = np.array([r[0] for r in rows])
    for i in range(len(rows)):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        ok = np.flatnonzero((ids != ids[i]) & ((f != f[i]) | (f[i] < 0)))
        yield ids[i], [(d[j], ids[j]) for j in ok[np.lexsort((ids[ok], d[ok]))][:k]]


@pytest.mark.parametrize("block", [400, 20])
def test_boxes_equal_brute_force_and_the_pivots(spark, monkeypatch, block):
    rows = _rows(600)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("survspark.knn.blockRows", str(block))
    try:
        both = []
        for most in (boxes.MOST, 0):  # 0: by pivots
            monkeypatch.setattr(boxes, "MOST", most)
            got = {}
            for r in knn_between(df, df, k=6, exclude_self=True, group="fold", cells=9).collect():
                got.setdefault(r.vec_id, []).append((r["rank"], r.distance, r.neighbor_id))
            both.append({i: [x[1:] for x in sorted(v)] for i, v in got.items()})
    finally:
        spark.conf.unset("survspark.knn.blockRows")
    assert both[0] == both[1] == dict(_brute(rows, 6))


def test_work_grows_with_the_rows(spark):
    """Twice the rows, about twice the compared pairs in a block (before: four times)."""
    import pyarrow as pa

    pairs = []
    for n in (4000, 8000):
        rows = _rows(n)
        t = pa.table({"id": np.arange(n), "grp": pa.array([str(r[1]) for r in rows]), "v": pa.array([r[2] for r in rows]), "s": np.zeros(n), "c": np.zeros(n)})
        block, real = boxes.Block(t, 3), boxes.Block._squares
        seen = [0]

        def count(self, x, ids, grp, refs, skip_self):
            seen[0] += len(x) * len(refs)
            return real(self, x, ids, grp, refs, skip_self)

        block._squares = count.__get__(block)
        p, _, _, bound = block.search(np.array([r[2] for r in rows]), np.arange(n), [str(r[1]) for r in rows], np.full(n, np.nan), 5, True)
        assert len(p) == 5 * n and np.isfinite(bound).all()
        pairs.append(seen[0])
    assert pairs[1] < 3 * pairs[0] and pairs[1] < 0.15 * 8000 ** 2, pairs


def test_few_probes_leave_their_box(spark, monkeypatch):
    sent, real = [], boxes._meet
    monkeypatch.setattr(boxes, "_meet", lambda refs, probes, *a: sent.append(probes) or real(refs, probes, *a))
    df = spark.createDataFrame(_rows(3000), SCHEMA)
    spark.conf.set("survspark.knn.cellRows", "300")
    try:
        assert knn_oof(df, "y", k=3).where("prediction is not null").count() == 3000
    finally:
        spark.conf.unset("survspark.knn.cellRows")
    assert sent[0].count() == 3000 and sent[1].count() < 3000


def test_oof_with_repeated_keys_and_missing_targets(spark):
    """A neighbour stands for the targets of all rows of its key; a repeated probe has the mean over its rows."""
    rows = _rows(200, 1)
    rows = [(i % 170, None if i == 5 else f, v, None if i % 11 == 0 else y) for i, f, v, y in rows] + [(None, 1, [0.0, 0.0, 0.0], 1), (900, 1, None, 1)]
    usable = [r for r in rows if r[0] is not None and r[2] is not None]
    sums, targets = {}, {}
    for i, _, _, y in rows:
        if y is not None:
            targets.setdefault(i, []).append(y)
    for (i, near), r in zip(_brute(usable, 4), usable):
        if r[1] is not None:
            sums.setdefault(i, []).extend(y for _, j in near for y in targets.get(j, []))
    got = knn_oof(spark.createDataFrame(rows, SCHEMA), "y", k=4).collect()
    assert len(got) == len([r for r in rows if r[1] is not None])
    for r in got:
        want = sums.get(r.vec_id)
        assert r.prediction is None if not want else abs(r.prediction - np.mean(want)) < 1e-12
