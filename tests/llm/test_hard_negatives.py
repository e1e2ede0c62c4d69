import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from survspark.llm import hard_negatives as hn


def _brute(rows, n_pos=5, n_neg=3, scale=256):
    """Plain Python integers over all pairs; rows (id, label, vector)."""
    seen, use = set(), []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (i, label, tuple(v))
        if key not in seen:
            seen.add(key)
            use.append((i, label, [math.floor(scale * x) for x in v]))
    out = []
    for i, label, v in use:
        if i % 50:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in use if j != i and len(w) == len(v)]
        for p, j, _ in sorted((x for x in score if x[2] == label), key=lambda x: (-x[0], x[1]))[:n_pos]:
            fit = sorted((x for x in score if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p), key=lambda x: (-x[0], x[1]))
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(fit[:n_neg], 1)]
    return sorted(out)


def _rows(seed, n=260, dim=6):
    rng = random.Random(seed)
    rows = [(i * 5, rng.randrange(3), [rng.choice([-0.5, -0.25, 0.1, 0.3, 0.5, 0.7]) for _ in range(dim)]) for i in range(n)]
    rows += [(7, None, [0.1] * dim), (11, 1, None), (12, 1, [0.1, None] * (dim // 2)), (13, 1, [float("nan")] * dim), (14, 2, [float("inf")] * dim), (16, 1, []),
             (None, 1, [0.1] * dim), (50, 1, [0.9] * dim), rows[4], rows[10], rows[10], (18, 1, [0.5] * 3), (100, 0, [0.5] * 3), (19, 0, [0.5] * 3), (21, 0, [0.0] * dim)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows,anchor_rows", [(524_288, 131_072), (40, 7)])
def test_equals_brute_force(spark, block_rows, anchor_rows):
    rows = _rows(1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, side int")
    same = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got = hn.mine(hn.usable_rows(df), F.col("id") % 50 == 0, block_rows=block_rows, anchor_rows=anchor_rows)
    assert sorted(map(tuple, got.collect())) == _brute(same) != []


def test_scores_beyond_53_bits(spark):
    rng = random.Random(3)
    rows = [(i * 10, i % 2, [rng.choice([1e6, -2.5e5, 3.7e6, 1.0, -2.0]) for _ in range(4)]) for i in range(60)]
    wide = [(3, 0, [1e30] * 4), (4, 1, [1e7, 0.0, 0.0, 0.0])]  # norms past 2^31
    df = spark.createDataFrame(rows + wide, "vec_id long, label int, embedding array<double>")
    got = hn.mine(hn.usable_rows(df), F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == _brute(rows) and max(r.positive_score for r in got) > 2 ** 55


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    rel = con.sql(hn.SQL)
    got = hn.op11_hard_negatives(spark, path)
    assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall()) != []


def test_empty_table(spark):
    assert hn.mine(hn.usable_rows(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")), F.col("id") % 50 == 0).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2 ** 31), st.sampled_from([1, 30, 300, 2 ** 12, 2 ** 20, 2 ** 26, 2 ** 29]))
def test_packed_scores_are_exact(dim, seed, most):
    rng = np.random.default_rng(seed)
    rows, anchors = (rng.integers(-most, most + 1, (n, dim)) for n in (37, 5))
    packed = hn.Packed(rows, hn._norm(anchors))
    want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in rows] for x in anchors]
    assert packed.scores(anchors).tolist() == want


def test_unit_vectors_share_three_fields():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    assert hn.Packed(x, hn._norm(x)).fields == 3 and hn.Packed(x, 512).fields == 2
