"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts and items are sequences of lower-cased words.  A window of a document as long as an item is
compared with it under edit distance on words.  The CGK random walk (advance the input, or repeat the
symbol, by a random bit of position and symbol) maps edit distance to Hamming distance; symbols sampled
at a few places of the walk form an LSH key, and independent walks and samples repeat until the target
recall.  Windows that share a key with an item are verified exactly.

Windows are aligned by runs of words that they share with an item: within ``share * n`` edits of n words
some run of the item stays whole, so this loses no match.  Items are taken in blocks of bounded size, each
a pass over the documents, so nothing that grows without bound is sent to the tasks.

Defined cases: null and empty texts match nothing; items that are null or shorter than ``min_words``
take no part; equal items are reported each under its id; of equal-distance windows the first is
reported; repeated documents are reported each, by their id; empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shingle_hashes, slices, utf8, word_hashes

_PAD = np.uint64(0x5851F42D4C957F2D)


def walks(windows: np.ndarray, lengths: np.ndarray, reps: int, places: np.ndarray) -> np.ndarray:
    """CGK walks of all windows (padded rows) under ``reps`` random strings, sampled.

    ``places`` (reps, tables, bits) are fractions of the walk, which has three steps for each word.
    Returns one key for each window and (rep, table).
    """
    w, width = windows.shape
    tables, bits = places.shape[1:]
    at = np.zeros((w, reps), np.int64)
    seeds = mix(np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = np.floor(places[None] * (3 * lengths)[:, None, None, None]).astype(np.int64)  # (w, reps, tables, bits)
    key = np.zeros((w, reps, tables), np.uint64)
    rows = np.arange(w)[:, None]
    for j in range(3 * width):
        inside = at < lengths[:, None]
        symbol = np.where(inside, windows[rows, np.minimum(at, width - 1)], _PAD)
        hit = step == j
        if hit.any():
            value = mix(symbol + np.uint64(j))[:, :, None, None] * (2 * np.arange(bits, dtype=np.uint64) + np.uint64(3))
            key += np.where(hit, value, np.uint64(0)).sum(axis=3, dtype=np.uint64)
        at += (mix(symbol ^ (seeds + np.uint64(j * 0x2545F491)))[:, :] & np.uint64(1)).astype(np.int64)
    names = np.arange(reps * tables, dtype=np.uint64).reshape(reps, tables)
    return mix(key + names * np.uint64(0xC2B2AE3D27D4EB4F) + lengths.astype(np.uint64)[:, None, None]).reshape(w, reps * tables)


def edits_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of ``item`` in ``text`` with free ends in the text, if at most ``most``."""
    n, m = len(item), len(text)
    row = np.zeros(m + 1, np.int64)  # row i: edits of item[:i] against a text part that ends at each place
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        new = np.empty(m + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != item[i - 1]))
        row = np.minimum.accumulate(new - steps) + steps  # insertions of text words
        if row.min() > most:
            return None
    k = int(np.argmin(row))
    return (int(row[k]), k) if row[k] <= most else None


@dataclass
class ItemIndex:
    """A block of items: words, shared runs with their places, and LSH keys."""

    ids: list[int]
    words: list[np.ndarray]
    share: float = 0.2
    recall: float = 0.99
    reps: int = 8
    bits: int = 3
    agree: float = 0.6  # share of equal places of two walks at the largest distance that must be found
    runs: dict = field(default_factory=dict)

    def __post_init__(self):
        need = math.log(1 - self.recall) / math.log(1 - self.agree ** self.bits)
        self.tables = max(1, math.ceil(need / self.reps))
        self.places = np.random.default_rng(7).random((self.reps, self.tables, self.bits))
        starts: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            e = self.most(len(w))
            q = max(1, min(4, (len(w) - e) // (e + 1)))
            for j, h in enumerate(shingle_hashes(w, q).tolist()):
                starts.setdefault(q, []).append((h, j, i))
        for q, rows in starts.items():
            h = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(h >> np.uint64(20)).astype(np.int64) & ((1 << 20) - 1)] = True
            self.runs[q] = (h[order], np.array([r[1] for r in rows])[order],
                            np.array([len(self.words[r[2]]) for r in rows])[order], bitmap)
        keys = self.keys(self.words)
        flat = keys.ravel()
        order = np.argsort(flat, kind="stable")
        self.key_sorted, self.key_item = flat[order], np.repeat(np.arange(len(self.words)), keys.shape[1])[order]

    def most(self, n: int) -> int:
        return int(self.share * n)

    def keys(self, seqs: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(s) for s in seqs])
        grid = np.full((len(seqs), int(n.max())), _PAD, np.uint64)
        grid[np.arange(grid.shape[1])[None] < n[:, None]] = np.concatenate(seqs)
        return walks(grid, n, self.reps, self.places)

    def windows(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (document, start, length) of windows that share a run of words, in place, with an item,
        for a slice of documents (``rows`` are their bounds in ``words``)."""
        found = []
        for q, (h, place, length, bitmap) in self.runs.items():
            own = shingle_hashes(words, q)
            at = np.flatnonzero(bitmap[(own >> np.uint64(20)).astype(np.int64) & ((1 << 20) - 1)])
            doc = np.searchsorted(rows, at, side="right") - 1
            at, doc = at[at + q <= rows[doc + 1]], doc[at + q <= rows[doc + 1]]
            a, b = np.searchsorted(h, own[at], "left"), np.searchsorted(h, own[at], "right")
            n = b - a
            at, doc, a, n = at[n > 0], doc[n > 0], a[n > 0], n[n > 0]
            if len(at):
                k = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                found.append(np.stack([length[k], np.repeat(doc, n), np.repeat(at, n) - place[k]], axis=1))
        if not found:
            return np.zeros((0, 3), np.int64)
        return np.unique(np.concatenate(found), axis=0)  # by length: walks of a chunk have like numbers of steps

    def matches(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Best (document, item, edits, first word) for each item found in each document of a slice."""
        spans = self.windows(words, rows)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for a in range(0, len(spans), 2048):
            n, doc, start = spans[a: a + 2048].T
            lo, hi = np.maximum(start, rows[doc]), np.minimum(start + n, rows[doc + 1])
            step = np.arange(int(n.max()))
            at = lo[:, None] + step
            inside = at < hi[:, None]
            grid = np.where(inside, words[np.minimum(at, len(words) - 1)], _PAD)
            keys = walks(grid, n, self.reps, self.places)
            first, last = np.searchsorted(self.key_sorted, keys, "left"), np.searchsorted(self.key_sorted, keys, "right")
            tried = set()
            for i, t in zip(*np.nonzero(last > first)):
                d = int(doc[i])
                for item in np.unique(self.key_item[first[i, t]: last[i, t]]).tolist():
                    w = self.words[item]
                    if (item, i) in tried or len(w) != n[i]:
                        continue
                    tried.add((item, i))
                    if best.get((d, item), (1, 0))[0] == 0 and best[d, item][1] <= start[i] - rows[d]:
                        continue
                    e = self.most(len(w))
                    begin = max(int(start[i]) - e, int(rows[d]))
                    got = edits_within(w, words[begin: min(int(start[i]) + len(w) + e, int(rows[d + 1]))], e)
                    if got:
                        new = (got[0], max(begin + got[1] - len(w) - int(rows[d]), 0))
                        best[d, item] = min(best.get((d, item), new), new)
        return [(d, i, e, s) for (d, i), (e, s) in sorted(best.items())]


def find_contamination(docs: DataFrame, items: DataFrame, share: float = 0.2, recall: float = 0.99, min_words: int = 5,
                       block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, edits, first_word): items that a document holds with at most ``share`` word edits."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    blocks = max(1, -(-items.count() // block_items))
    out = None
    for b in range(blocks):
        # one block of the benchmark; its size is set by block_items
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        hashes, bounds, _, _ = word_hashes(*utf8(pa.array([r["text"] for r in rows], pa.string())))
        seqs = [hashes[x:y] for x, y in zip(bounds, bounds[1:])]
        keep = [i for i, s in enumerate(seqs) if len(s) >= min_words]
        if not keep:
            continue
        index = ItemIndex([rows[i]["item_id"] for i in keep], [seqs[i] for i in keep], share, recall)

        def run(batches, index=index):
            for batch in batches:
                for part in slices(batch, "text"):
                    words, rows, _, _ = word_hashes(*utf8(part.column("text")))
                    ids = part.column("doc_id").to_pylist()
                    got = [(ids[d], index.ids[i], e, s) for d, i, e, s in index.matches(words, rows)]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)],
                                                         names=["doc_id", "item_id", "edits", "first_word"])

        found = docs.mapInArrow(run, "doc_id long, item_id long, edits long, first_word long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits long, first_word long")
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
