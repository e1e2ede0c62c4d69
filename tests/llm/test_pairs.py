"""Similarity join, decontamination, repeated bytes and neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from survspark.llm import ann, components, decontaminate, partenum, suffix_dedup
from survspark.llm.common import word_hashes, utf8
from survspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def test_word_hashes_equal_words():
    texts = ["", None, "a b", " lead\ttrail ", "ÀB c\x0bd", "x", "B a", "ab", "a" * 500 + " b"]
    h, rows, _, _ = word_hashes(*utf8(pa.array(texts)))
    seen = {}
    for t, a, b in zip(texts, rows, rows[1:]):
        assert b - a == len(words(t))
        for w, x in zip(words(t), h[a:b].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def groups(rows, k, num, den):
    sets = [frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if (w := words(t)) else frozenset() for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and den * inter >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_jaccard_groups_equal_brute_force(spark, docs, k, num, den):
    rng = random.Random(k)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = "new%d" % rng.randrange(99)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "only two"), (904, "Only TWO"), (905, None), (3, rows[3][1]), (906, "w " * 6000)]
    got = partenum.jaccard_groups(docs([(d, t, None) for d, t in rows]), k, num, den)
    assert sorted(tuple(r) for r in got.collect()) == groups(rows, k, num, den)


def test_near_copies_without_a_common_original_stay_linear(spark, docs, monkeypatch):
    """Variants with two changed words each are similar to some others only; pairs sent to verification stay few."""
    sent = []
    real = partenum._verified
    monkeypatch.setattr(partenum, "_verified", lambda pairs, *a: (sent.append(pairs.count()), real(pairs, *a))[1])
    counts = {}
    for n in (60, 240):
        rng = random.Random(n)
        base = [f"b{i}" for i in range(60)]
        rows = []
        for i in range(n):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(60)] = f"x{rng.randrange(40)}"
            rows.append((i, " ".join(copy)))
        sent.clear()
        got = partenum.jaccard_groups(docs([(d, t, None) for d, t in rows]), 4, 85, 100)
        assert sorted(tuple(r) for r in got.collect()) == groups(rows, 4, 85, 100)
        counts[n] = sum(sent)
    assert counts[240] <= 8 * counts[60], counts


def test_few_signatures_for_each_set():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in rng.integers(150, 600, 200)]
    for num in (80, 85):
        bands = partenum.Bands(num, 100, 600)
        made = sum(len(partenum.signatures(s, bands)) for s in sets)
        assert made <= 1.1 * sum(map(len, sets)), (num, made)
        for s in sets:  # as many differences as the similarity allows, on either side
            lack = (100 - num) * len(s) // 100
            some = rng.permutation(s)[: len(s) - lack]
            assert np.intersect1d(partenum.signatures(s, bands), partenum.signatures(np.sort(some), bands)).size


def test_rounds_join_components_and_end_when_all_pairs_are_tested(spark, docs, monkeypatch):
    edges, links, rounds = [], [], []
    joined, proposed, verified = partenum.connected_components, partenum._proposals, partenum._verified
    monkeypatch.setattr(partenum, "connected_components", lambda e: (edges.append(e.count()), joined(e))[1])
    monkeypatch.setattr(partenum, "_proposals", lambda *a: (rounds.append(a[-1]), proposed(*a))[1])
    monkeypatch.setattr(partenum, "_verified", lambda *a: [x for x in [verified(*a)] if links.append(x[1].count()) is None][0])
    rng = random.Random(9)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(80)]
        for i in range(20):
            copy = list(base)
            for at in rng.sample(range(80), rng.randrange(4)):
                copy[at] = f"x{rng.randrange(40)}"
            rows.append((len(rows), " ".join(copy)))
    got = partenum.jaccard_groups(docs([(d, t, None) for d, t in rows]), 4, 85, 100)
    assert sorted(tuple(r) for r in got.collect()) == groups(rows, 4, 85, 100)
    # later rounds hand over the new links only, and no round follows one that tested every pair
    assert rounds[-1] == 0 and len(rounds) <= 4, rounds
    assert links[1] and edges == [links[0], *[n for n in links[1:] if n]], (edges, links)


def test_split_groups_and_small_sets_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(partenum, "_GROUP", 5)
    monkeypatch.setattr(partenum, "_BEST", 1)
    monkeypatch.setattr(partenum, "_REACH", (1,))
    rng = random.Random(8)
    rows = []
    for g in range(8):
        base = [f"w{rng.randrange(9)}{rng.randrange(30)}" for _ in range(rng.randrange(9, 26))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(copy))
                copy[at: at + 1] = rng.choice([[], ["n%d" % rng.randrange(5)], [copy[at], "more"]])
            rows.append((len(rows), " ".join(copy)))
    for num in (85, 80, 60):
        got = partenum.jaccard_groups(docs([(d, t, None) for d, t in rows]), 2, num, 100)
        assert sorted(tuple(r) for r in got.collect()) == groups(rows, 2, num, 100)


def test_rows_without_an_id_link_like_others(spark, docs):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "new")
    got = partenum.jaccard_groups(docs([(None, text, None), (7, near, None), (9, near + " end", None), (None, "one two three four five", None),
                                        (None, "one two three four five", None)]), 4, 85, 100).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(None, 57, 7), (7, 57, 7), (9, 58, 7), (None, 2, None), (None, 2, None)], key=repr)


def test_jaccard_of_empty_table_and_of_null_texts(spark, docs):
    assert partenum.jaccard_groups(docs([(1, "a", None)]).where("false")).count() == 0
    assert [tuple(r) for r in partenum.jaccard_groups(docs([(1, None, None)])).collect()] == [(1, 0, 1)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(6, 60)] + [(2, 2), (7, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{x: 5 for x in range(5, 60)}}


def test_edit_distance_kernel():
    rng = np.random.default_rng(5)
    for _ in range(60):
        p, t = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        got = decontaminate.edits_within(p, t, len(p))
        assert got[0] == min(row) and (decontaminate.edits_within(p, t, min(row) - 1) is None if min(row) else True)


def test_decontamination_finds_planted_items(spark, docs):
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(300)] + ["the", "of"] * 40
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60)))) for i in range(40)]
    rows, want = [], set()
    for d in range(160):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 150))]
        if d % 2:
            i = rng.randrange(40)
            p = items[i][1].split()
            for _ in range(rng.randrange(0, int(0.2 * len(p)) + 1)):
                kind, at = rng.randrange(3), rng.randrange(len(p))
                p[at: at + 1] = [["edit"], [], [p[at], "more"]][kind]
            if len(p) >= 1 and decontaminate.edits_within(np.array([hash(x) for x in items[i][1].split()]), np.array([hash(x) for x in p]),
                                                           int(0.2 * len(items[i][1].split()))):
                want.add((d, i))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in p]
        rows.append((d, " ".join(w), None))
    rows += [(500, None, None), (501, "", None), (502, items[3][1] * 1, None), (502, items[3][1], None)]
    table = spark.createDataFrame([(i, t, "x") for i, t in items] + [(90, None, "x"), (91, "too short", "x"), (92, items[3][1], "x")],
                                  "item_id long, text string, doc_id string")
    for block in (20_000, 15):
        got = decontaminate.find_contamination(docs(rows), table, block_items=block).collect()
        pairs = {(r.doc_id, r.item_id) for r in got}
        assert len(want - pairs) <= 0.02 * len(want) and {(502, 3), (502, 92)} <= pairs
        assert all(d % 2 or d >= 500 for d, _ in pairs) and not any(d in (500, 501) or i in (90, 91) for d, i in pairs)
    assert decontaminate.find_contamination(docs(rows).where("false"), table).count() == 0
    assert decontaminate.find_contamination(docs(rows), table.where("false")).count() == 0


def repeats(rows, n):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0] if r[0] is not None else -1):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if b[i: i + n] in seen:
                gone[i: i + n] = b"\1" * n
            seen.add(b[i: i + n])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [100, 40])
def test_repeated_bytes_equal_brute_force(spark, docs, length):
    rng = random.Random(length)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randrange(30, 400))) for _ in range(12)]
    rows = [(i, "".join(rng.choice([rng.choice(passages), rng.choice(passages)[:rng.randrange(1, 200)], "xyz%d" % rng.randrange(50)])
                        for _ in range(rng.randrange(0, 9)))) for i in range(120)]
    rows += [(200, "a" * 1500), (201, "a" * 700 + "b"), (202, "ab" * 400), (203, None), (204, ""), (None, passages[0] * 2), (205, rows[0][1]),
             (206, "\0" * 300 + passages[1])]
    rng.shuffle(rows)
    got = suffix_dedup.remove_repeats(docs([(d, t, None) for d, t in rows]), length, with_text=True).collect()
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(repeats(rows, length), key=key)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_rows_keep_one_whole_copy(spark, docs):
    text = "q" * 50 + "".join(str(i) for i in range(200))
    got = suffix_dedup.remove_repeats(docs([(4, text, None)] * 3 + [(9, "short", None)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, len(text), len(text)]
    assert suffix_dedup.remove_repeats(docs([(1, "a", None)]).where("false")).count() == 0


def test_deep_shallow_sort_orders_rows():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (500, 76)).astype(np.uint8)
    rows[:200, :60] = rows[0, :60]
    rows[50:80] = rows[50]
    group = rng.integers(0, 3, 500)
    order, common = suffix_dedup.deep_shallow_sort(rows, group)
    keys = [(int(group[i]), bytes(rows[i])) for i in order]
    assert keys == sorted(keys)
    for a, b, c in zip(keys, keys[1:], common[1:]):
        same = next((i for i in range(76) if a[1][i] != b[1][i]), 76)
        assert c == (same if a[0] == b[0] else -1)


def nearest(rows, queries, k):
    out = set()
    for q in queries:
        v = np.array(rows[q])
        s = sorted(((-float((np.array(w) * v).sum() / (np.sqrt((np.array(w) ** 2).sum()) * np.sqrt((v ** 2).sum()))), i)
                    for i, w in rows.items() if i != q))
        out |= {(q, r + 1, i) for r, (_, i) in enumerate(s[:k])}
    return out


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = {i: rng.normal(size=16).tolist() for i in range(900)}
    for i in range(300, 340):
        rows[i] = rows[300]
    extra = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, [float("inf")] + [1.0] * 15), (2006, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in list(rows.items()) + extra], "vec_id long, embedding array<float>, score int")
    rows = {i: np.array(v, np.float32).astype(float).tolist() for i, v in rows.items()}
    got = ann.search(ann.usable_vectors(df), F.col("id") % 50 == 0, block_rows=200, query_rows=7, sample_rows=300).collect()
    want = nearest(rows, range(0, 900, 50), 5)
    have = {(r.query_id, r.rank, r.vec_id) for r in got}
    assert len(got) == len(want) and len({(q, i) for q, _, i in want} & {(q, i) for q, _, i in have}) >= 0.9 * len(want)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 300] == [301, 302, 303, 304, 305]
    few = ann.search(ann.usable_vectors(df.where("vec_id < 3")), F.col("id") % 50 == 0).collect()
    assert {(r.query_id, r.vec_id) for r in few} == {(0, 1), (0, 2)}
    assert ann.search(ann.usable_vectors(df.where("false")), F.col("id") % 50 == 0).count() == 0


def test_whole_queries_on_the_small_tables(spark):
    for n in ("op4_nearest", "op9_jaccard", "op10_decontamination", "op5_suffix_dedup"):
        assert QUERIES[n](spark, SF).count() > 0
