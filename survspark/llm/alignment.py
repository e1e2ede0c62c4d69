"""Alignment of the token sequences of two tokenizers by divide and conquer at shared cuts.

Both tokenizers write the same bytes, so each token ends at a byte offset.  An interval of tokens is split
at a common end near its middle: starting from its middle A token, that token's end is looked up among the
B ends of the interval by bisect, then the ends beside it, further and further out, until one agrees.  Both
halves are split likewise; an interval without a common end inside is a leaf: one group.  The recursion
runs level by level over all intervals of a slice of documents, so a level is a few array operations.

A link is a pair of an A and a B token that end at one offset.  How often an id pair is linked needs the
whole corpus: each task counts its pairs, Spark adds them up, and the table of pairs goes to every task.
That table is bounded by the vocabularies, not by the corpus: of two tokens that end together one is a
suffix of the other, so there are at most ``pair_bound`` pairs (324,300 for the public ones).

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from blank + text, have no
tokens (zeros, empty groups); special-token strings inside a text are plain text; repeated rows and ids are
documents of their own, null ids stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .tokenizing import PieceCache


_ENTRIES = 300_000  # words that a worker keeps
_SLICE = 1_000_000  # bytes of text aligned at once


class BlankPieces(PieceCache):
    """Byte-level ids of blank + text; special-token strings are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path, keep_blank=True)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        raw = {letter: byte for byte, letter in self.letters.items()}
        added = self.tokenizer.get_added_tokens_decoder()  # never in the ids of plain text
        self.token_bytes = [b"" if i in added else bytes(map(raw.__getitem__, self.tokenizer.id_to_token(i) or ""))
                            for i in range(self.tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return self._whole(" " + text)


class SentencePieces:
    """Sentencepiece ids.  Where no piece of the vocabulary has a blank after another character, merges never
    cross the start of a word, so the ids of a text are those of its words one after the other (``cuts``)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token_bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text), np.uint32).tobytes()


_PROBES = 16  # single probes of an interval before all its ends are looked up at once


def _nearest(a_end: np.ndarray, b_end: np.ndarray) -> int:
    """Place of the A end nearest to the middle that is also a B end (the middle if there is none)."""
    found = np.searchsorted(b_end, a_end)
    hits = np.flatnonzero(b_end[np.minimum(found, len(b_end) - 1)] == a_end)
    middle = len(a_end) // 2
    return int(hits[np.argmin(np.abs(hits - middle))]) if len(hits) else middle


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``a_end``, in ``b_end``) of the tokens that end together, in order.

    ``a_end`` and ``b_end`` rise over the whole slice; document k has the tokens ``a_bounds[k]`` to
    ``a_bounds[k + 1]`` and likewise of B, and its last ends agree.  Each document is one interval at
    first.  An interval (inner tokens from ``al`` to ``ah``, without its own last end) probes its ends from
    the middle outwards; a hit splits it in two."""
    some = np.diff(a_bounds) > 0
    last_a, last_b = a_bounds[1:][some] - 1, b_bounds[1:][some] - 1
    hits_a, hits_b = [last_a], [last_b]
    al, ah, bl, bh = a_bounds[:-1][some], last_a, b_bounds[:-1][some], last_b
    out = np.zeros(len(al), np.int64)  # how far the next probe stands from the middle: 0, 1, -1, 2, -2, ...
    while len(al):
        # no end inside on a side, or all ends probed: a leaf
        n = ah - al
        live = (n > 0) & (bh > bl) & (out <= 2 * (n // 2))
        al, ah, bl, bh, out, n = (x[live] for x in (al, ah, bl, bh, out, n))
        at = al + n // 2 + np.where(out % 2 == 1, (out + 1) // 2, -(out // 2))
        for i in np.flatnonzero(out > _PROBES):  # few: all ends at once, and the one nearest to the middle
            at[i], out[i] = _nearest(a_end[al[i]: ah[i]], b_end[bl[i]: bh[i]]) + al[i], 2 * n[i]
        inside = at < ah
        end = a_end[np.where(inside, at, al)]
        # bisect: b_end rises over the slice, so one search serves all intervals (which stay in order)
        found = np.searchsorted(b_end, end)
        hit = inside & (found >= bl) & (found < bh)
        hit &= b_end[np.minimum(found, len(b_end) - 1)] == end
        hits_a.append(at[hit])
        hits_b.append(found[hit])
        # a hit leaves its left and its right half, a miss goes on with the next probe
        old = np.repeat(np.arange(len(al)), hit + 1)
        right = np.zeros(len(old), bool)
        right[1:] = old[1:] == old[:-1]
        left = hit[old] & ~right
        al, ah, bl, bh, out = (np.where(right, at[old] + 1, al[old]), np.where(left, at[old], ah[old]), np.where(right, found[old] + 1, bl[old]),
                               np.where(left, found[old], bh[old]), np.where(hit[old], 0, out[old] + 1))
    a, b = np.concatenate(hits_a), np.concatenate(hits_b)
    order = np.argsort(a)
    return a[order], b[order]


class Pair:
    """Two tokenizers with the tables that alignment needs; one for each Python worker."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b = BlankPieces(a), SentencePieces(b)
        self.len_a, self.len_b = (np.array([len(x) for x in t.token_bytes], np.int64) for t in (self.a, self.b))
        self.size_a, self.size_b = len(self.len_a), len(self.len_b)
        # an id's text with each sign that may follow it
        self.text = [f"{i}{sign}".encode() for n, signs in ((self.size_a, ",|"), (self.size_b, ",;")) for sign in signs for i in range(n)]

        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _same(self, a: bytes, b: bytes, raw: bytes) -> bool:
        return all(b"".join(map(t.token_bytes.__getitem__, np.frombuffer(x, np.uint32).tolist())) == raw for t, x in ((self.a, a), (self.b, b)))

    def _learn(self, texts: list[list[str]]) -> list[str]:
        """Puts the ids of all words of a slice into ``known``: the new ones are encoded as one text by each tokenizer
        and cut at the words' starts.  Words that begin or end with other white space stay unknown, as
        do all if a tokenizer does not cut there.  Returns the long ones, which are not to be kept."""
        if len(self.known) >= _ENTRIES:
            self.known = dict(list(self.known.items())[: _ENTRIES // 2])  # the oldest are the frequent ones
        new = [w for w in set().union(*texts) if w not in self.known and w and not w[0].isspace() and not w[-1].isspace() and "▁" not in w]
        if not new:
            return []
        text = " ".join(new)
        raw = (" " + text).encode()
        start = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20)  # a word holds no blank
        parts = []
        for tokenizer, size in ((self.a, self.len_a), (self.b, self.len_b)):
            ids = np.frombuffer(tokenizer.whole(text), np.uint32)
            begin = np.concatenate([[0], np.cumsum(size[ids])])
            cut = np.searchsorted(begin, start)
            if begin[-1] != len(raw) or (begin[cut] != start).any() or b"".join(map(tokenizer.token_bytes.__getitem__, ids.tolist())) != raw:
                return []
            packed, cut = ids.tobytes(), [*(4 * cut).tolist(), 4 * len(ids)]
            parts.append([packed[x:y] for x, y in zip(cut, cut[1:])])
        self.known.update(zip(new, zip(*parts)))
        return [w for w in new if len(w) >= 64]

    def _tokens(self, text: str | None, words: list[str]) -> tuple[bytes, bytes]:
        """Ids of both tokenizers: word by word where both cut there, else of the whole text."""
        if not text:
            return b"", b""
        out = list(map(self.known.get, words))
        if out and None not in out:
            a, b = zip(*out)
            return b"".join(a), b"".join(b)
        a, b = self.a.whole(text), self.b.whole(text)
        return (a, b) if self._same(a, b, (" " + text).encode()) else (b"", b"")

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """For each text: counts, the hash and text of its groups, and its links as ``a * size_b + b``."""
        # blanks side by side or at an end could change ids: such texts are encoded whole
        words = [t.split(" ") if t and self.b.cuts and not (t.startswith(" ") or t.endswith(" ") or "  " in t) else [] for t in texts]
        long = self._learn(words)
        tokens = [self._tokens(t, w) for t, w in zip(texts, words)]
        for w in long:
            del self.known[w]
        a_bounds, b_bounds = (np.concatenate([[0], np.cumsum([len(t[k]) // 4 for t in tokens])]).astype(np.int64) for k in (0, 1))
        a, b = (np.frombuffer(b"".join([t[k] for t in tokens]), np.uint32).astype(np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cut_a, cut_b = shared_cuts(a_end, b_end, a_bounds, b_bounds)
        # the text of a document: for each group its A ids, '|', its B ids, ';'
        group_a, group_b = np.searchsorted(cut_a, np.arange(len(a))), np.searchsorted(cut_b, np.arange(len(b)))
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cut_a] = last_b[cut_b] = True
        code = np.empty(len(a) + len(b), np.int64)
        b_before = np.concatenate([[0], cut_b + 1])
        code[np.arange(len(a)) + b_before[group_a]] = a + last_a * self.size_a
        code[np.arange(len(b)) + (cut_a + 1)[group_b] if len(b) else []] = b + 2 * self.size_a + last_b * self.size_b
        link = a[cut_a] * self.size_b + b[cut_b]
        groups = np.searchsorted(cut_a, a_bounds)
        lists = [b"".join(map(self.text.__getitem__, code[x:y].tolist()))[:-1] for x, y in zip(a_bounds[:-1] + b_bounds[:-1], a_bounds[1:] + b_bounds[1:])]
        n_groups = np.diff(groups)
        return {"n_a": np.diff(a_bounds), "n_b": np.diff(b_bounds), "n_groups": n_groups, "n_links": n_groups,
                "groups": lists, "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in lists],
                "links": [link[x:y] for x, y in zip(groups, groups[1:])]}


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    if (a, b) not in _pairs:
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


def pair_bound(p: Pair) -> int:
    """How many id pairs can be linked at all: the shorter token is a suffix of the longer one, and several
    ids may write the same bytes."""
    a, b = Counter(p.a.token_bytes), Counter(p.b.token_bytes)
    return sum(n * sum(b.get(t[i:], 0) for i in range(len(t))) for t, n in a.items()) + \
        sum(n * sum(a.get(t[i:], 0) for i in range(1, len(t))) for t, n in b.items())


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def align_documents(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, with_groups: bool = False) -> DataFrame:
    """Alignment of every whole text: ``SCHEMA``, and the groups as text if asked for.  ``links`` holds
    ``a * |B| + b`` for each link as unsigned 64-bit or, where they fit, 32-bit numbers."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches):
        p = pair(tokenizer_a, tokenizer_b)
        width = link_type(p)
        for batch in (part for whole in batches for part in slices(whole, "text", _SLICE)):
            out = p.align(batch.column("text").to_pylist())
            cols = [batch.column("doc_id"), *[pa.array(out[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                    pa.array(out["groups_sha256"]), pa.array([x.astype(width).tobytes() for x in out["links"]], pa.binary())]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
            if with_groups:
                cols.append(pa.array([x.decode() for x in out["groups"]], pa.string()))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, SCHEMA + ", groups string" * with_groups)


def link_type(p: Pair) -> np.dtype:
    return np.dtype("<u4" if p.size_a * p.size_b < 1 << 32 else "<u8")


def link_counts(aligned: DataFrame, width: np.dtype) -> DataFrame:
    """(pair, n): how many links of the corpus hold each id pair.  A task adds its links up before they travel."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            links = np.frombuffer(b"".join(batch.column("links").to_pylist()), width).astype(np.uint64)
            k, n = np.unique(links, return_counts=True)
            both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)  # as many as there are pairs
            keys, counts = both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i: i + 100_000].astype(np.int64)), pa.array(counts[i: i + 100_000])], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score_links(aligned: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` instead of the links."""
    spark = aligned.sparkSession
    p = pair(tokenizer_a, tokenizer_b)
    width, size_b = link_type(p), p.size_b
    table = link_counts(aligned, width).toArrow()  # one row for an id pair: bounded by the vocabularies
    if table.num_rows > pair_bound(p):
        raise ValueError("more id pairs than two tokenizers that write the same bytes can link")
    keys, n = (np.asarray(table[c].combine_chunks() if table.num_rows else [], np.int64) for c in ("pair", "n"))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    most = np.zeros(size_b, np.int64)
    np.maximum.at(most, keys % size_b, n)
    best = n == most[keys % size_b]
    known = spark.sparkContext.broadcast((keys.astype(np.uint64), n, best))

    def run(batches):
        keys, n, best = known.value
        for batch in batches:
            raw = batch.column("links").to_pylist()
            at = np.searchsorted(keys, np.frombuffer(b"".join(raw), width).astype(np.uint64))
            bounds = np.concatenate([[0], np.cumsum([len(x) // width.itemsize for x in raw])]).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x[at])])[bounds] if len(keys) else bounds for x in (n, best)]
            cols = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(sums[1])), pa.array(np.diff(sums[0])), batch.column("groups_sha256")],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return score_links(stored(align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), a, b), "aligned"), a, b)
