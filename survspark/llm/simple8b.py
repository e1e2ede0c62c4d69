"""Token-id output in a word-aligned Simple-8b format.

Each 64-bit word holds a 4-bit selector and as many ids as fit its 60 payload bits at one width.  A
value over 60 bits is escaped: selector 15 stores its place in the block's list of exceptions.  A file
is a Parquet table of blocks: the words of a run of consecutive documents, with the word and id offset
of every document in it, so a reader decodes a block, or one document of it, with array operations.

Defined cases: a null or empty text is written as its end id alone; documents with the same id follow
each other and keep their own rows; null ids come first; an empty table gives an empty file set; extra
columns are ignored.  A document is never split, so one very long document is a block of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import scratch_path
from .common import shuffle_parts, slices
from .tokenizing import piece_cache

#: The fixed selector table of Simple-8b without the two runs: ids in a word, bits of each.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15


def _widths(ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), np.uint8)
    for b in range(1, 61):
        big = ids >= np.uint64(1 << b)
        if not big.any():
            break
        out += big
    return out


def encode(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack documents ``ids[bounds[i]:bounds[i + 1]]``; no word crosses a document.

    Returns the words, the word bounds of the documents and the exceptions.
    """
    n = len(ids)
    ids = ids.astype(np.uint64)
    width = _widths(ids)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    selector = np.full(n, ESCAPE, np.int8)
    widest, span = width.copy(), 1  # largest width among the next ``span`` ids
    for s in range(len(COUNTS) - 1, -1, -1):
        c = int(COUNTS[s])
        if c > n:
            break
        while span < c:
            k = min(span, c - span)
            widest = np.maximum(widest[: n - span - k + 1], widest[k: n - span + 1]) if k < span else \
                np.maximum(widest[: n - 2 * span + 1], widest[span: n - span + 1])
            span += k
        m = n - c + 1
        fits = (widest[:m] <= BITS[s]) & (room[:m] >= c)
        if not fits.any() and c > 8:
            break
        selector[:m][fits] = s
    step = np.where(selector == ESCAPE, 1, COUNTS[np.minimum(selector, 13)]).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, np.int64)
    sel = selector[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel[sel != ESCAPE]).tolist():
        own = np.flatnonzero(sel == s)
        value = np.zeros(len(own), np.uint64)
        for j in range(int(COUNTS[s])):
            value |= ids[at[own] + j] << np.uint64(int(BITS[s]) * j)
        words[own] |= value
    odd = np.flatnonzero(sel == ESCAPE)
    words[odd] |= np.arange(len(odd), dtype=np.uint64)
    return words, np.searchsorted(at, bounds), ids[at[odd]]


def decode(words: np.ndarray, exceptions: np.ndarray | None = None) -> np.ndarray:
    """The ids of a run of words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(sel == ESCAPE, 1, COUNTS[np.minimum(sel, 13)])
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        own = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[start[own]] = exceptions[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        b = int(BITS[s])
        for j in range(int(COUNTS[s])):
            out[start[own] + j] = (words[own] >> np.uint64(b * j)) & np.uint64((1 << b) - 1)
    return out


BLOCKS = ("file int, block int, first long, n_ids long, words binary, exceptions array<long>, doc_ids array<long>, "
          "doc_word_start array<long>, doc_n_ids array<long>")


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, block_words: int = 65_536) -> None:
    """Tokenise whole texts, add the end id and write blocks in ascending ``doc_id`` order: file k holds the
    k-th range of ids.  The texts are dealt out, as they are smaller than their words, and tokenised once."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    ordered = docs.repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()),
             pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["file", "block", "first", "n_ids", "words", "exceptions", "doc_ids", "doc_word_start", "doc_n_ids"]

    def run(batches):
        from pyspark import TaskContext

        cache, end = piece_cache(tokenizer, False), np.array([end_id], np.uint32)
        file, block, first, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def emit():
            d, n, w = zip(*held)
            starts = np.cumsum([0, *[len(x) for x in w]])[:-1]
            raw = np.concatenate(w).astype("<u8").tobytes()
            row = [file, block, first, int(sum(n)), raw, [], list(d), starts, list(n)]  # token ids need no escape
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in (part for whole in batches for part in slices(whole, "text")):
            ids = [np.concatenate([cache.encode(t.as_py() or ""), end]) for t in batch.column("text")]
            n = np.array([len(x) for x in ids], np.int64)
            words, cut, _ = encode(np.concatenate(ids), np.concatenate([[0], np.cumsum(n)]))
            for d, k, a, b in zip(batch.column("doc_id").to_pylist(), n.tolist(), cut, cut[1:]):
                held.append((d, k, words[a:b]))
                size += int(b - a)
                if size >= block_words:
                    yield emit()
                    block, first, held, size = block + 1, first + sum(x[1] for x in held), [], 0
        if held:
            yield emit()

    ordered.mapInArrow(run, BLOCKS).write.parquet(path)


def read_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: one row for each document with its global start and the crc32 of its ids.

    A block knows its first id within its file; the files' totals, one row for each, give the rest."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    per_file = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = per_file.select("file", F.coalesce(F.sum("n").over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids = decode(np.frombuffer(b["words"], "<u8"), np.array(b["exceptions"], np.uint64)).astype("<u4")
                end = np.cumsum(b["doc_n_ids"])
                cut = np.concatenate([[0], end])
                parts = [ids[x:y] for x, y in zip(cut, cut[1:])]
                cols = [pa.array(b["doc_ids"], pa.int64()), pa.array(b["file_start"] + b["first"] + cut[:-1]), pa.array(b["doc_n_ids"], pa.int64()),
                        pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return blocks.join(F.broadcast(before), "file").mapInArrow(run, schema)  # as many rows as files, one a partition


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token_files")
    write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_files(spark, path)
