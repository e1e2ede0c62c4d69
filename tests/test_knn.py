import time

import numpy as np
import pyarrow as pa

import pytest

import survspark.operators.knn as knn_module
from survspark.operators.knn import knn, knn_between, knn_classify, knn_oof


def test_knn_blocks_agree_with_brute(spark):
    rng = np.random.default_rng(2)
    vecs = rng.integers(0, 4, (60, 3)).astype(float)  # many distance ties
    rows = [(i, [float(v) for v in vecs[i]], int(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exp = {}
    for i in range(60):
        d = np.sqrt(((vecs - vecs[i]) ** 2).sum(axis=1))
        order = sorted((d[j], j) for j in range(60) if j != i)[:4]
        exp[i] = [j for _, j in order]
    for blocks in (1, 3):
        got = {}
        for r in knn(df, k=4, blocks=blocks).collect():
            got.setdefault(r.vec_id, []).append((r["rank"], r.neighbor_id))
        assert {k: [j for _, j in sorted(v)] for k, v in got.items()} == exp
    c = knn_classify(knn(df, k=4, blocks=2), df).collect()
    assert len(c) == 60 and all(0 < r.share <= 1 for r in c)


def _brute(probes, refs, k, same_fold, skip_self):
    out = {}
    for i, f, v in probes:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, g, w in refs
                      if not (skip_self and j == i) and not (same_fold and f is not None and g == f))
        out[i] = [(r + 1, j, d) for r, (d, j) in enumerate(near[:k])]
    return out


def _clustered(rng, n, start, dim=3, clusters=12):
    centres = np.random.default_rng(99).uniform(-50, 50, (clusters, dim))
    return [(start + i, int(rng.integers(0, 3)), (centres[rng.integers(0, clusters)] + rng.integers(-8, 9, dim) / 8).tolist()) for i in range(n)]


@pytest.mark.parametrize("cells,block,same_fold,skip_self", [(1, 20_000, False, False), (15, 20_000, True, True), (15, 7, True, False), (40, 3, False, True)])
def test_between_tables_equals_brute_force(spark, cells, block, same_fold, skip_self):
    rng = np.random.default_rng(cells)
    refs = _clustered(rng, 150, 0) + [(500, 1, [0.0, 0.0, 0.0]), (501, 1, [0.0, 0.0, 0.0])]
    probes = _clustered(rng, 40, 130) + [(900, None, [0.0, 0.0, 0.0]), (901, 0, [1e6, 1e6, -1e6])]
    bad = [(700, 0, None), (701, 0, [1.0, None, 1.0]), (702, 0, [float("nan"), 1.0, 1.0]), (703, 0, [1.0, 1.0]), (None, 0, [1.0, 1.0, 1.0]), (704, 0, [float("inf"), 0.0, 0.0])]
    schema = "vec_id long, fold int, embedding array<double>"
    spark.conf.set("survspark.knn.blockRows", str(block))
    try:
        got = {}
        for r in knn_between(spark.createDataFrame(probes + bad, schema), spark.createDataFrame(refs + bad, schema), k=4, exclude_self=skip_self,
                             group="fold" if same_fold else None, cells=cells).collect():
            got.setdefault(r.vec_id, []).append((r["rank"], r.neighbor_id, r.distance))
    finally:
        spark.conf.unset("survspark.knn.blockRows")
    assert {k: sorted(v) for k, v in got.items()} == _brute(probes, refs, 4, same_fold, skip_self)


def test_pruning_keeps_most_cells_apart(spark):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame(_clustered(rng, 600, 0), "vec_id long, fold int, embedding array<double>")
    sent = []
    real = knn_module._routed
    knn_module._routed = lambda *a, **kw: (sent.append(real(*a, **kw)), sent[-1])[1]
    try:
        assert knn(rows, k=3, blocks=30).count() == 1800
    finally:
        knn_module._routed = real
    visits = sum(x.count() for x in sent)
    assert visits < 0.5 * 600 * 30, visits


def test_oof_scores_and_few_references(spark):
    rows = [(i, i % 3, [float(i), 0.0], i % 2) for i in range(9)] + [(50, None, [3.1, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, fold int, embedding array<double>, y int")
    got = {r.vec_id: r.prediction for r in knn_oof(df, "y", k=2).collect()}
    near = {i: sorted((abs(v[0] - w[0]), j, y) for j, g, w, y in rows if g != f and j != i)[:2] for i, f, v, _ in rows if f is not None}
    assert set(got) == set(near) and all(abs(got[i] - sum(y for *_, y in n) / 2) < 1e-12 for i, n in near.items())
    assert knn(df.limit(2), k=5).count() == 2 and knn(df.where("false"), k=5).count() == 0


def test_block_search_takes_batches_of_probes_together(spark):
    """Compared cell by cell for a whole batch, not a probe at a time: 4 million pairs of 64 components in seconds."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4000, 64))
    v[2000:] = v[:2000][rng.permutation(2000)]  # copies: ties go to the smaller key
    grid = knn_module.Cells(v[:40].copy())
    d = knn_module._squares(v, grid.pivots)
    cell = d.argmin(axis=1)
    grid.fill([{"cell": i, "n": int((cell == i).sum()), "radius": float(np.sqrt(d[cell == i, i].max()))} for i in range(40)], 10_000, 20_000)
    assert len(grid.blocks) == 1
    order = np.argsort(cell, kind="stable")
    held = pa.table({"id": order, "grp": pa.array([None] * 4000, pa.string()), "cell": cell[order].astype(np.int32), "v": pa.array(list(v[order]))}).combine_chunks()
    block = knn_module._Block(held, grid)
    part = pa.table({"row": np.arange(1000), "id": np.arange(1000), "grp": pa.array([None] * 1000, pa.string()), "v": pa.array(list(v[:1000])),
                     "home": cell[:1000].astype(np.int32), "near": d[np.arange(1000), cell[:1000]], "bound": pa.array([None] * 1000, pa.float64())}).to_batches()[0]
    start = time.process_time()
    rows, ids, far = block.search(part, 5, True)
    assert time.process_time() - start < 20
    got = {}
    for r, i, f in zip(rows.tolist(), ids.tolist(), far.tolist()):
        got.setdefault(r, []).append((f, i))
    for i in range(0, 1000, 37):
        e = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        assert sorted(got[i]) == sorted((e[j], j) for j in np.lexsort((np.arange(4000), np.where(np.arange(4000) == i, np.inf, e)))[:5].tolist())
