import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from survspark.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(rows, window=13):
    first = {}
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in docs:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i: i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i: i + window])] < d:
                gone[i: i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def _corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["Ünï", "A", "a"]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for d in range(n):
        w = [rng.choice(vocab) + str(rng.randrange(50)) for _ in range(rng.randrange(0, 60))]
        if d % 3 == 0:
            at, a = rng.randrange(len(w) + 1), rng.randrange(20)
            w[at:at] = passage[a: a + rng.randrange(10, 25)]
        rows.append((d * 3, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(7, None), (8, ""), (9, " \n "), (5, rows[3][1]), (5, rows[3][1]), (1000, rows[0][1]), (None, rows[30][1]), (1001, "x " * 200), (1002, "x " * 300),
             (1003, "X " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_bytes,window,period", [(4_000_000, 13, None), (300, 13, None), (500, 13, 4), (400, 5, 5), (300, 20, None), (400, 3, 1)])
def test_equals_brute_force(spark, block_bytes, window, period):
    rows = _corpus(window)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, block string").repartition(3)
    got = sd.remove_repeats(docs, window, period, block_bytes, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got), key=repr) == _brute(rows, window)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    rel = con.sql(sd.SQL)
    got = sd.op12_substring_dedup(spark, path)
    assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_sql_equals_brute_force():
    import pandas as pd

    rows = _corpus(5)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert sorted(con.sql(sd.SQL).fetchall(), key=repr) == [r[:4] for r in _brute(rows)]


@pytest.mark.parametrize("p", [*range(1, 32), 50, 100])
def test_cover_holds_every_difference(p):
    d = sd.difference_cover(p)
    assert {(x - y) % p for x in d for y in d} == set(range(p)) and len(d) <= 2 * np.sqrt(p) + 2


def test_long_text_and_empty_table(spark):
    words = " ".join(str(i) for i in range(60_000))
    docs = spark.createDataFrame([(1, words), (2, "start " + words + " end")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.remove_repeats(docs, block_bytes=50_000).collect()}
    assert got == {1: (60_000, 0), 2: (60_002, 60_000)}
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
