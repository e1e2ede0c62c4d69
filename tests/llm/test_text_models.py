"""Language id, Katz scoring and tokenised output against direct computation."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from survspark.llm import katz, langid, packing, simple8b
from survspark.llm.queries import QUERIES
from survspark.llm.tokenizing import PieceCache

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b", "x\n y", "\n", "It's they're 'tis a''s b", "café İstanbul ΣΣ 你好 áb", "don't stop... end.\n\nNew,line; a:b 12 345,6",
       "<|endoftext|> a", "tab\there  x", "A.\nB,\nC. D", "\x1c a\x1d b", "ﬁ ½ a​b", "word " * 3000]


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pandas()


@pytest.mark.parametrize("name,blank", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_pieces_give_the_library_ids(name, blank):
    cache = PieceCache(public_tokenizers.path(name), blank, entries=300)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    for t in [*ODD, *table("documents").text.head(60)]:
        assert cache.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_language_query_is_accurate_on_held_out_rows(spark):
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    truth = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas().set_index("doc_id").lang
    held = got[got.held_out & truth.reindex(got.index).notna()]
    assert (held.lang_pred == truth.reindex(held.index)).mean() > 0.97
    assert all(got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.index]) and got.score.between(0, 1).all()


def test_language_edge_cases(spark, docs):
    model = langid.LanguageModel({"aa": b"alpha beta gamma delta " * 20, "bb": b"uno dos tres cuatro " * 20})
    df = docs([(1, None, None), (2, "12 34!", None), (3, "alpha beta gamma delta", None), (4, "", None), (3, "alpha beta gamma delta", None),
               (5, "uno dos tres cuatro " * 5000, None)])
    rows = sorted(tuple(r) for r in langid.predict_languages(df, model).select("doc_id", "lang_pred", "rejected").collect())
    assert rows == [(1, "und", True), (2, "und", True), (3, "aa", False), (3, "aa", False), (4, "und", True), (5, "bb", False)]
    empty = df.where("false")
    assert langid.predict_languages(empty, model).count() == 0
    assert langid.fit_languages(empty).dictionaries == {}
    assert langid.predict_languages(df, langid.LanguageModel({})).where("not rejected").count() == 0
    assert langid.predict_languages(df, model, min_margin=0.99).where("not rejected").count() == 0


def test_language_of_copies_is_learned_whole(spark, docs):
    rows = [(i, f"the few texts of this label number {i % 3}", "aa") for i in range(3000)]
    rows += [(5000 + i, f"uno dos tres {i % 30} cuatro", "bb") for i in range(3000)]
    # few distinct texts in many copies: every one of them is in the sample (10 rows a label are asked for)
    made = langid.fit_languages(docs(rows), rows_per_language=10).dictionaries
    assert sorted(made["aa"].split(b"\n")) == [b"the few texts of this label number %d" % i for i in range(3)]
    assert len(set(made["bb"].split(b"\n"))) == 10


def test_narrow_language_margins_are_rejected(spark, docs):
    rng = random.Random(2)
    model = langid.LanguageModel({"aa": b"alpha beta gamma delta " * 20, "bb": b"uno dos tres cuatro " * 20})
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxyz0123456789") for _ in range(4000)) + " alpha beta gamma" for _ in range(20)]
    df = docs([(i, t, None) for i, t in enumerate(junk)])
    kept = lambda **k: langid.predict_languages(df, model, **k).where("not rejected").count()
    assert kept() == 0 < kept(noise=0.0)
    assert langid.predict_languages(docs([(1, "alpha gamma beta delta " * 40, None)]), model).where("not rejected").count() == 1


def brute_katz(rows):
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) + ["</s>"]
    data = [(words(t), train) for _, t, train in rows]
    c, b, ctx = Counter(), Counter(), Counter()
    for w, train in data:
        if train:
            c.update(w)
            b.update(zip(["<s>"] + w[:-1], w))
            ctx.update(["<s>"] + w[:-1])
    n, v = sum(c.values()), len(c)
    of = lambda x: np.bincount([min(y, katz.TOP + 2) for y in x.values()] or [0], minlength=katz.TOP + 3)[: katz.TOP + 2]
    uni, d = katz.Unigram(n, v, of(c)), katz.discounts(of(b))
    p1 = lambda w: float(uni.p(np.array([c[w]]))[0])
    after = defaultdict(list)
    for (h, w), k in b.items():
        after[h].append((w, k))

    def p(h, w):
        if h not in after:
            return p1(w)
        mass = sum(d[min(k, katz.TOP + 1)] * k for _, k in after[h]) / ctx[h]
        scale = 1.0 if 1 - mass > 1e-12 else ctx[h] / (ctx[h] + 1) / mass
        if b[h, w]:
            return scale * d[min(b[h, w], katz.TOP + 1)] * b[h, w] / ctx[h]
        return (1 - scale * mass) / max(1 - sum(p1(x) for x, _ in after[h]), 1e-300) * p1(w)

    for h in list(after)[:20]:  # every context sums to one over the words and the unknown word
        if len(after[h]) < v:
            assert abs(sum(p(h, w) for w in [*c, "\0unknown"]) - 1) < 1e-9
    return [(sum(math.log10(p(h, x)) for h, x in zip(["<s>"] + w[:-1], w)),
             sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), len(w), sum(c[x] > 0 for x in w)) for w, _ in data], n


def test_first_words_of_many_texts_are_dealt_out(spark, docs, monkeypatch):
    seen = []
    keep = katz._settle
    monkeypatch.setattr(katz, "_settle", lambda rows, *a: (seen.append(rows), keep(rows, *a))[1])
    rows = [(i, f"w{i % 40}", True) for i in range(400)]
    got = katz.katz_scores(docs([(d, t, None) for d, t, _ in rows]), F.lit(True), 100).collect()
    score, _ = brute_katz(rows)
    assert all(abs(r.score - score[r.doc_id][0]) < 1e-6 for r in got) and len(got) == 400
    parts = {r.part for r in seen[0].where("part >= 0").collect() if (katz.unpack(r.payload)["h"] == katz.BEGIN).any()}
    assert len(parts) > 1


@pytest.mark.parametrize("part_bytes", [12_000_000, 150])  # the second splits frequent contexts
def test_katz_equals_brute_force(spark, docs, part_bytes):
    rng = random.Random(3)
    vocab = ["the", "The", "a"] * 30 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))), i % 4 != 0) for i in range(80)]
    rows += [(500, None, True), (501, "", False), (502, "never seen words here", False), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(d, t, tr, 0.5) for d, t, tr in rows], "doc_id long, text string, train_row boolean, score double")
    got = katz.katz_scores(df, F.col("train_row"), part_bytes).collect()
    want, n = brute_katz(rows)
    key = lambda x: tuple(round(y, 6) for y in x)
    assert sorted((r.doc_id, *key((r.score, r.base_score)), r.n_tokens, r.n_known) for r in got) == sorted(
        (d, *key(w[:2]), *w[2:]) for (d, _, _), w in zip(rows, want))
    assert {r.train_tokens for r in got} == {n}
    assert katz.katz_scores(df.where("false"), F.col("train_row")).count() == 0
    assert {round(r.score, 9) for r in katz.katz_scores(df, F.lit(False)).collect()} == {0.0}


def brute_backoff(rows, order):
    """Scores by the recursion itself: P(w | h) of every token, shorter and shorter contexts."""
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) + ["</s>"]
    grams = [Counter() for _ in range(order + 1)]
    for _, t, train in rows:
        w = ["<s>", *words(t)]
        for n in range(1, order + 1):
            if train:
                grams[n].update(tuple(w[i - n + 1: i + 1]) for i in range(max(1, n - 1), len(w)))
    of = lambda x: np.bincount([min(y, katz.TOP + 2) for y in x.values()] or [0], minlength=katz.TOP + 3)[: katz.TOP + 2]
    total = sum(grams[1].values())
    uni = katz.Unigram(total, len(grams[1]), of(grams[1]))
    d = {n: katz.discounts(of(grams[n])) for n in range(2, order + 1)}
    after = defaultdict(list)
    for n in range(2, order + 1):
        for g, k in grams[n].items():
            after[g[:-1]].append((g[-1], k))

    def p(h, w):
        if not h:
            return float(uni.p(np.array([grams[1][w,]]))[0])
        if h not in after:
            return p(h[1:], w)
        n, count = len(h) + 1, sum(k for _, k in after[h])
        mass = sum(d[n][min(k, katz.TOP + 1)] * k for _, k in after[h]) / count
        scale = 1.0 if 1 - mass > 1e-12 else count / (count + 1) / mass
        if (k := grams[n][(*h, w)]):
            return scale * d[n][min(k, katz.TOP + 1)] * k / count
        return (1 - scale * mass) / max(1 - sum(p(h[1:], x) for x, _ in after[h]), 1e-300) * p(h[1:], w)

    for h in [x for x in after if len(x) == order - 1][:40]:
        if len(after[h]) < len(grams[1]):
            assert abs(sum(p(h, x) for x in [*(g[0] for g in grams[1]), "\0unknown"]) - 1) < 1e-9
    out = []
    for _, t, _ in rows:
        w = ["<s>", *words(t)]
        out.append(sum(math.log10(p(tuple(w[max(0, i - order + 1): i]), w[i])) for i in range(1, len(w))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("part_bytes", [12_000_000, 150])
def test_katz_backs_off_through_every_length(spark, docs, order, part_bytes):
    rng = random.Random(order)
    vocab = ["the", "The", "a"] * 6 + [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))), i % 4 != 0) for i in range(60)]
    rows += [(500, None, True), (501, "", False), (502, "never seen words here the a the", False), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, train_row boolean")
    got = katz.katz_scores(df, F.col("train_row"), part_bytes, order).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == sorted((d, round(s, 6)) for (d, _, _), s in zip(rows, brute_backoff(rows, order)))


def test_the_query_scores_by_three_words(spark):
    got = {r.doc_id: r.score for r in QUERIES["op2_katz"](spark, SF).collect()}
    rows = [(d, t, zlib.crc32(str(d).encode()) % 7 != 2) for d, t in table("documents")[["doc_id", "text"]].itertuples(index=False)][:]
    want = katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string, tr boolean"), F.col("tr"), order=2).collect()
    assert katz.ORDER == 3 and sum(abs(r.score - got[r.doc_id]) > 1e-3 for r in want) > len(want) // 2


def test_bin_completion_packs_everything_and_beats_best_fit():
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(500, 1100, 2000).tolist())
    plan = packing.complete_bins(counts, 2048, nodes=1500)
    used = Counter()
    for b, k in plan:
        assert sum(b) <= 2048
        for s in b:
            used[s] += k
    best_fit = packing._best_fit(dict(counts), 2048)
    assert used == counts and sum(k for _, k in plan) <= sum(k for _, k in best_fit)
    assert packing.complete_bins({}, 10) == [] and packing.complete_bins({3: 4, 7: 4, 10: 1}, 10) and sum(
        k for _, k in packing.complete_bins({3: 4, 7: 4, 10: 1}, 10)) == 5


def _fewest(pieces, capacity):
    best = len(pieces)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for j in {r: j for j, r in enumerate(bins) if r >= pieces[i]}.values():
            go(i + 1, bins[:j] + [bins[j] - pieces[i]] + bins[j + 1:])
        go(i + 1, [*bins, capacity - pieces[i]])

    go(0, [])
    return best


def test_bin_completion_finds_the_fewest_bins():
    rng = np.random.default_rng(5)
    sets = [([17, 16, 15, 12, 11, 10, 10, 9, 7, 7, 3, 3], 30)]  # four are enough; five with the best few fillings only
    for _ in range(1500):
        capacity = int(rng.choice([10, 20, 30, 50, 100]))
        top = max(2, int(capacity * rng.choice([0.4, 0.6, 0.8, 1.0])))
        pieces = rng.integers(1, top + 1, rng.integers(1, 12))
        sets.append((sorted((rng.choice(pieces, len(pieces)) if rng.random() < 0.3 else pieces).tolist(), reverse=True), capacity))
    for pieces, capacity in sets:
        plan, proved = packing.search_bins(Counter(pieces), capacity)
        used = Counter()
        for b, k in plan:
            assert sum(b) <= capacity
            for s in b:
                used[s] += k
        fewest = _fewest(pieces, capacity)
        assert proved and used == Counter(pieces) and sum(k for _, k in plan) == fewest >= packing.least_bins(Counter(pieces), capacity), (pieces, capacity)
    assert not packing.search_bins(Counter(rng.integers(500, 1100, 2000).tolist()), 2048, nodes=2000)[1]


def test_packing_round_trip(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(1, None), (2, ""), (3, "one two three"), (4, "long text " * 1500), (3, "one two three"), (5, "mid size " * 300)]
    df = docs([(d, t, None) for d, t in texts])
    got = packing.pack_documents(df, path, capacity=256, with_ids=True).toPandas()
    tok = Tokenizer.from_file(path)
    whole = {d: tok.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts}
    for d, part in got[got.doc_id != 3].groupby("doc_id"):
        part = part.sort_values("piece")
        assert [i for x in part.ids for i in x] == whole[d] and (part.length[1:] == 256).all()
    assert [list(x) for x in got[got.doc_id == 3].ids] == [whole[3]] * 2
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.length.cumsum() - seq.length).tolist() == seq.offset.tolist() and seq.length.sum() <= 256
    assert packing.pack_documents(df.where("false"), path).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for top in (2, 3, 200, 50_000, 1 << 31, 1 << 60):
        ids = rng.integers(0, top, 700).astype(np.uint64)
        bounds = np.array([0, 1, 1, 350, 700])
        words, cut, odd = simple8b.encode(ids, bounds)
        assert simple8b.decode(words, odd).tolist() == ids.tolist() and len(odd) == 0
        assert simple8b.decode(words[cut[2]: cut[3]]).tolist() == ids[1:350].tolist()
    big = np.array([1, (1 << 64) - 1, 5, 1 << 60], np.uint64)
    words, _, odd = simple8b.encode(big, np.array([0, 4]))
    assert len(odd) == 2 and simple8b.decode(words, odd).tolist() == big.tolist()
    assert len(simple8b.encode(np.ones(600, np.uint64), np.array([0, 600]))[0]) == 10


def test_token_files_keep_order_and_ids(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [(9, "nine words"), (2, None), (5, ""), (4, "Long words " * 4000), (2, "again two")]
    df = docs([(d, t, None) for d, t in texts])
    simple8b.write_files(df, path, str(tmp_path / "f"), block_words=50)
    got = simple8b.read_files(spark, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()
    tok = Tokenizer.from_file(path)
    want = sorted((d, tok.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in texts)
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want and [r.doc_id for r in got] == [2, 2, 4, 5, 9]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    simple8b.write_files(df.where("false"), path, str(tmp_path / "e"))
    assert simple8b.read_files(spark, str(tmp_path / "e")).count() == 0
