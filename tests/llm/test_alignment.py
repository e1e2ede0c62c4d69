import functools
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from survspark.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello world, tokenizers disagree unpredictably.", "  two  blanks \n and\ttabs ", "", None, "naïve café — 東京 🙂 ﬁ", "<|endoftext|> and <s> stay text",
         "▁ is no blank", "a" * 5000, "x\x00y", " ", "\n\n\n", "aaaa baaab " * 40, "Straße über alles é", "def f(x):\n    return x  # ok\n"]


@functools.cache
def _tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    return ta, tb


def _brute(texts):
    """Groups by the set of common ends, token by token, without any cache."""
    ta, tb = _tokenizers()
    letters = {c: b for b, c in al.pair(A, B).a.letters.items()}
    docs = []
    for text in texts:
        if not text:
            docs.append(([], []))
            continue
        a = [(i, bytes(letters[c] for c in ta.id_to_token(i))) for i in ta.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()) for i in tb.encode(text)]
        raw = (" " + text).encode()
        same = b"".join(x for _, x in a) == raw == b"".join(x for _, x in b)
        docs.append((a, b) if same else ([], []))
    out, pairs = [], Counter()
    for a, b in docs:
        ends = [{int(e): i for e, (i, _) in zip(np.cumsum([len(x) for _, x in t]), t)} for t in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for e, i in t.items() if last < e <= c) for t in ends))
            last = c
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        pairs.update(links)
        out.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    top = Counter()
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    return [(na, nb, g, len(ls), sum(pairs[x] == top[x[1]] for x in ls), sum(pairs[x] for x in ls),
             hashlib.sha256(t.encode()).hexdigest() if t else "") for na, nb, g, ls, t in out]


def test_query_equals_brute_force_on_hard_texts(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS * 2)] + [(3, "again", 1), (None, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links int")
    got = al.score_links(al.align_documents(docs, A, B), A, B).collect()
    want = _brute([t for _, t, _ in rows])
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *w[:5], w[5], w[6]) for (i, _, _), w in zip(rows, want)), key=key)


def test_whole_table_equals_brute_force(spark):
    import survspark.llm.common as c

    docs = c.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in al.op13_alignment(spark, "/root/testdata/sf0.001").collect()}
    want = _brute([r.text for r in docs])
    assert got == {r.doc_id: w for r, w in zip(docs, want)}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=" ab\nÀ東🙂.,▁<s>é0", max_size=40), max_size=6))
def test_groups_of_random_texts(texts):
    out = al.pair(A, B).align(texts)
    for i, w in enumerate(_brute(texts)):
        assert (out["n_a"][i], out["n_b"][i], out["n_groups"][i], out["groups_sha256"][i]) == (w[0], w[1], w[2], w[6])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 99)), st.sets(st.integers(1, 99))), max_size=5))
def test_cuts_are_the_common_ends(docs):
    a, b, at = [], [], 0
    bounds = [[0], [0]]
    for x, y in docs:
        a += sorted(at + v for v in x | {100})
        b += sorted(at + v for v in y | {100})
        at += 100
        bounds[0].append(len(a))
        bounds[1].append(len(b))
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    ca, cb = al.shared_cuts(a, b, *(np.array(x, np.int64) for x in bounds))
    want = np.intersect1d(a, b)
    assert a[ca].tolist() == want.tolist() and b[cb].tolist() == want.tolist()


def test_long_intervals_without_cuts_are_leaves():
    a, b = np.append(np.arange(0, 200_000, 2) + 1, 200_001), np.append(np.arange(0, 200_000, 2) + 2, 200_001)
    ca, cb = al.shared_cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert ca.tolist() == [len(a) - 1] and cb.tolist() == [len(b) - 1]


def test_empty_table_and_bound(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert al.score_links(al.align_documents(docs, A, B), A, B).collect() == []
    assert 0 < al.pair_bound(al.pair(A, B)) < 5_000_000


@pytest.mark.parametrize("text", ["one two", "no-cut"])
def test_groups_are_given_as_text(spark, text):
    row = al.align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1
