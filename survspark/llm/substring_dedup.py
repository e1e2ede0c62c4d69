"""Removal of repeated word sequences by difference-cover anchors.

A difference cover modulo p is a set D of residues in which every difference modulo p occurs.  Two equal
windows of w words, at any two positions of two documents, therefore hold at one common distance (below p)
from their starts a position of the cover in both documents: an anchor, w - p + 1 words long and inside
both windows.  Only anchors at cover positions are hashed and exchanged (3 of 7 positions for w = 13).

Documents are cut into stored blocks of bounded size, which are the unit of exchange: (1) each block sends
the distinct hashes of its anchors; those that two blocks send come back.  (2) A block extends each such
anchor to all windows that hold it and sends their hashes with its smallest document that has them; windows
that a block with a smaller document has come back.  (3) A block removes these, and what repeats inside
itself.  A sequence that very many documents hold costs a row a block, not a row a document or a pair.

Windows are compared by 96 bits of two hashes of their words.

Defined cases: null texts have no words; repeated rows and rows of one ``doc_id`` do not remove each other
(only a smaller id does); rows with a null id stay whole and remove nothing; documents with fewer words than
a window stay; an empty table gives an empty result; extra columns are ignored; a text longer than a block
is a block of its own.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shingle_hashes, removed, shuffle_parts, signed, slices, stored, stored_by, utf8, word_hashes

_OTHER = np.uint64(0xA24BAED4963EE407)
_KEYS = 2_000_000  # hashes that a task sorts, on average


def difference_cover(p: int) -> list[int]:
    """Residues whose differences give every residue modulo ``p``: a smallest such set for small periods,
    else the first s numbers and every s-th one, about 2 sqrt(p)."""
    if p <= 31:
        for k in range(1, p + 1):
            for rest in itertools.combinations(range(1, p), k - 1):
                d = (0, *rest)
                if len({(x - y) % p for x in d for y in d}) == p:
                    return list(d)
    s = int(np.ceil(np.sqrt(p)))
    return sorted({*range(s), *range(0, p, s)})


class Cover:
    """Period and cover for a window length, and the anchors and windows of a block."""

    def __init__(self, window: int = 13, period: int | None = None):
        self.window, self.period = window, period or (window + 1) // 2
        if not 1 <= self.period <= window:
            raise ValueError("the period must not exceed the window")
        self.anchor = window - self.period + 1
        self.at = np.zeros(self.period, bool)
        self.at[difference_cover(self.period)] = True

    def anchors(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the anchors; ``rows`` bounds the documents in ``words``."""
        n = np.diff(rows)
        place = np.arange(len(words)) - np.repeat(rows[:-1], n)
        fits = self.at[place % self.period] & (place + self.anchor <= np.repeat(n, n)) & (np.repeat(n, n) >= self.window)
        start = np.flatnonzero(fits)
        return start, shingle_hashes(words, self.anchor)[start] if len(start) else np.zeros(0, np.uint64)

    def windows(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and both hashes (64 and 32 bits) of every window inside a document."""
        n = np.diff(rows)
        left = np.repeat(rows[1:], n) - np.arange(len(words))
        start = np.flatnonzero(left >= self.window)
        if not len(start):
            return start, np.zeros(0, np.uint64), np.zeros(0, np.int32)
        other = shingle_hashes(mix(words ^ _OTHER), self.window)
        return start, shingle_hashes(words, self.window)[start], (other[start] >> np.uint64(32)).astype(np.uint32).view(np.int32)


BLOCK = "block long, n_words long, ids array<long>, sizes array<long>, texts binary"


def write_blocks(docs: DataFrame, block_bytes: int = 4_000_000) -> DataFrame:
    """Rows of (block, ids, texts): runs of documents of about ``block_bytes``, compressed and stored, so that
    every later pass sees the same blocks; bucketed by block, so that what comes back to a block meets it
    without a shuffle of texts."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        block, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        names = ["block", "n_words", "ids", "sizes", "texts"]
        ids, sizes, texts = [], [], []

        def emit():
            raw = b"".join(texts)
            words = word_hashes(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), lower=False)[0]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                                               pa.array([sizes], pa.list_(pa.int64())), pa.array([pack.compress(raw)], pa.binary())], names=names)

        for part in (p for batch in batches for p in slices(batch, "text", block_bytes)):
            raw, bounds = utf8(part.column("text"))
            size = len(raw)
            if ids and sum(sizes) + size > block_bytes:
                yield emit()
                block, ids, sizes, texts = block + 1, [], [], []
            ids += part.column("doc_id").to_pylist()
            sizes += np.diff(bounds).tolist()
            texts.append(raw.tobytes())
        if ids:
            yield emit()

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored_by(docs.mapInArrow(run, BLOCK), "blocks", "block")


class Block:
    """The words of one stored block; documents without an id have no words to compare."""

    def __init__(self, row: dict):
        import zstandard

        self.block, self.ids, sizes = row["block"], row["ids"], row["sizes"]
        raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, sum(sizes)))
        self.raw = np.frombuffer(raw, np.uint8)
        self.words, self.rows, self.start, self.end = word_hashes(self.raw, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), lower=False)
        known = np.array([i is not None for i in self.ids], bool)
        self.id = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        # words and bounds of the documents that have an id, and where these words stand among all
        n = np.diff(self.rows)
        self.place = np.flatnonzero(np.repeat(known, n))
        self.known_rows = np.concatenate([[0], np.cumsum(n[known])]).astype(np.int64)
        self.known_words = self.words[self.place]
        self.word_id = np.repeat(self.id[known], n[known])


def _arrow(schema: dict, columns) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.values())], names=list(schema))


def _anchor_rows(blocks: DataFrame, cover: Cover) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                h = np.unique(cover.anchors(b.known_words, b.known_rows)[1])
                for i in range(0, len(h), 200_000):
                    cut = h[i: i + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(cut)), pa.array(np.full(len(cut), b.block))], names=["h", "block"])

    return blocks.mapInArrow(run, "h long, block long")


def _columns(batches, names) -> list[np.ndarray] | None:
    got = [[b.column(c).to_numpy() for c in names] for b in batches]
    return [np.concatenate(x) for x in zip(*got)] if got else None


def _met(rows: DataFrame, parts: int) -> DataFrame:
    """(block, h) of the anchors that at least two blocks send."""

    def run(batches):
        got = _columns(batches, ("h", "block"))
        if got is None:
            return
        h, block = got
        order = np.argsort(h, kind="stable")
        h, block = h[order], block[order]
        same = h[1:] == h[:-1]
        keep = np.zeros(len(h), bool)
        keep[1:] |= same
        keep[:-1] |= same
        h, block = h[keep], block[keep]
        for i in range(0, len(h), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(block[i: i + 200_000]), pa.array(h[i: i + 200_000])], names=["block", "h"])

    return rows.repartition(parts, "h").mapInArrow(run, "block long, h long")


def _window_rows(blocks: DataFrame, met: DataFrame, cover: Cover) -> DataFrame:
    """Windows that hold an anchor met elsewhere, once a block with its smallest document."""
    schema = {"h": pa.int64(), "g": pa.int32(), "doc_id": pa.int64(), "block": pa.int64()}

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        for row in left.to_pylist():
            b = Block(row)
            start, h = cover.anchors(b.known_words, b.known_rows)
            hit = np.isin(h, right.column("h").to_numpy().view(np.uint64))
            count = np.zeros(len(b.known_words) + cover.period + 1, np.int64)
            count[start[hit] + 1] = 1
            count = np.cumsum(count)
            at, h, g = cover.windows(b.known_words, b.known_rows)
            keep = count[at + cover.period] > count[at]
            at, h, g = at[keep], h[keep], g[keep]
            doc = b.word_id[at]
            order = np.lexsort((doc, g, h))
            h, g, doc = h[order], g[order], doc[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            return _arrow(schema, (signed(h[first]), g[first], doc[first], np.full(int(first.sum()), b.block)))
        return _arrow(schema, ([], [], [], []))

    return blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(extend, "h long, g int, doc_id long, block long")


def _earlier(rows: DataFrame, parts: int) -> DataFrame:
    """(block, h, g) of the windows that another block has in a smaller document."""

    def run(batches):
        got = _columns(batches, ("h", "g", "doc_id", "block"))
        if got is None:
            return
        h, g, doc, block = got
        order = np.lexsort((doc, g, h))
        h, g, doc, block = (x[order] for x in (h, g, doc, block))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        least = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
        keep = doc > least
        h, g, block = h[keep], g[keep], block[keep]
        for i in range(0, len(h), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i: i + 200_000]) for x in (block, h, g)], names=["block", "h", "g"])

    return rows.repartition(parts, "h").mapInArrow(run, "block long, h long, g int")


def _keys(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    out = np.empty(len(h), [("h", np.uint64), ("g", np.int32)])
    out["h"], out["g"] = h, g
    return out


def _removed_words(b: Block, cover: Cover, gone_h: np.ndarray, gone_g: np.ndarray) -> np.ndarray:
    """Which words of the block are covered by a window that a smaller document has."""
    at, h, g = cover.windows(b.known_words, b.known_rows)
    doc = b.word_id[at]
    order = np.lexsort((doc, g, h))
    hs, gs, ds = h[order], g[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    elsewhere = np.zeros(len(first), bool)
    if len(gone_h):
        maybe = np.flatnonzero(np.isin(hs[first], gone_h))  # the second hash only where the first one agrees
        elsewhere[maybe] = np.isin(_keys(hs[first[maybe]], gs[first[maybe]]), _keys(gone_h, gone_g))
    gone = (ds > ds[first][group]) | elsewhere[group] if len(hs) else np.zeros(0, bool)
    cover_count = np.zeros(len(b.known_words) + 1, np.int64)
    np.add.at(cover_count, at[order][gone], 1)
    np.add.at(cover_count, at[order][gone] + cover.window, -1)
    out = np.zeros(len(b.words), bool)
    out[b.place] = np.cumsum(cover_count)[:-1] > 0
    return out


def kept_texts(b: Block, gone: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one blank."""
    start, end = b.start[~gone], b.end[~gone]
    size = end - start + 1
    done = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(done[-1]), np.uint8)
    at = np.repeat(start - done[:-1], size) + np.arange(len(out))
    out[:] = b.raw[np.minimum(at, max(len(b.raw) - 1, 0))] if len(out) else out
    out[done[1:] - 1] = 0x20
    rows = done[np.concatenate([[0], np.cumsum(~gone)])[b.rows]]
    raw = out.tobytes()
    return [raw[x: max(x, y - 1)] for x, y in zip(rows, rows[1:])]


def remove_repeats(docs: DataFrame, window: int = 13, period: int | None = None, block_bytes: int = 4_000_000,
                   with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and, if asked for, ``kept`` and the removed runs of words as
    ``spans`` (start, end): words covered by a window whose words also start in a smaller ``doc_id`` go."""
    cover = Cover(window, period)
    blocks = write_blocks(docs, block_bytes)
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(shuffle_parts(docs.sparkSession), words // _KEYS + 1)
    met = stored(_met(_anchor_rows(blocks, cover), parts), "met")
    gone = stored(_earlier(_window_rows(blocks, met, cover), parts), "gone")
    removed(met)
    schema = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
    if with_text:
        schema |= {"kept": pa.string(), "spans": pa.list_(pa.list_(pa.int64()))}

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        for row in left.to_pylist():
            b = Block(row)
            out = _removed_words(b, cover, right.column("h").to_numpy().view(np.uint64), right.column("g").to_numpy())
            kept = kept_texts(b, out)
            n_removed = np.diff(np.concatenate([[0], np.cumsum(out)])[b.rows])
            columns = [b.ids, np.diff(b.rows), n_removed, [hashlib.sha256(x).hexdigest() for x in kept]]
            if with_text:
                columns += [[x.decode() for x in kept], [_runs(out[x:y]) for x, y in zip(b.rows, b.rows[1:])]]
            return _arrow(schema, columns)
        return _arrow(schema, [[] for _ in schema])

    return blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<array<bigint>>" * with_text)


def _runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Windows as lists of words, and the smallest document of each.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 13),
v AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS win FROM p),
least_doc AS (SELECT win, min(doc_id) AS first_doc FROM v GROUP BY win),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS j FROM v JOIN least_doc USING (win) WHERE doc_id > first_doc),
per AS (SELECT rid, count(*) AS n_removed, list(j) AS js FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN js IS NULL THEN array_to_string(w, ' ')
                            ELSE array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(js, z[2])), lambda z: z[1]), ' ') END, '')) AS kept_sha256
FROM d LEFT JOIN per USING (rid)"""
