"""Removal of repeated byte strings with a sparse suffix array sorted deep-shallow.

Every 100-byte string of a text is represented by its minimizer: the place of the smallest hash of a
24-byte gram in it.  Equal strings have it at the same offset, so the suffixes that start at minimizers
(about one byte in forty) are enough to find every repeat, and a run of neighbouring strings is one row.

1. Rows whose whole surroundings are equal are copies: the earliest is kept, the others are marked.
   Copies within a task are settled before anything is shuffled, so a hot text sends one row a task.
2. What is left of a gram (rows of different surroundings) is sorted: suffixes to the right, and reversed
   prefixes to the left, by deep-shallow sorting - multikey sorting by eight-byte symbols to a shallow
   depth, then blind tries for the groups that still share a long prefix.  The common prefixes of both
   orders give, for every offset, the strings that are equal, and the earliest of each.

Documents are ordered by ``doc_id`` (null first); rows that repeat an id by their place in the table.
Strings never cross documents.  Defined cases: null and empty texts have zero bytes and the hash of the
empty string; texts shorter than the length keep every byte; an empty table gives an empty result; extra
columns are ignored.  A gram and its surroundings are compared by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, signed, slices, stored, utf8

GRAM = 24
SHALLOW = 32
_bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_PLACE = np.uint64((1 << 28) - 1)
_ODD = np.uint64(0xE7037ED1A0B428DB)


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int):
    """Minimizer runs of a slice of texts: (text, place in it, least and largest offset, gram hash, hash of
    the surroundings), where the strings that start ``offset`` bytes before the place share the minimizer."""
    n, span = len(raw), length - GRAM + 1
    empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if n < length:
        return empty
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_bytes[raw] * up[:n], out=total[1:])
    gram = (total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]
    gram ^= gram >> np.uint64(29)
    gram *= _ODD
    low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)  # equal grams: the leftmost
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width:]) if span > width else low
    place = (low & _PLACE).astype(np.int64)  # for each string start
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    if not len(text):
        return empty
    ahead = np.cumsum(np.maximum(size - length + 1, 0))
    start = np.arange(len(text)) - np.repeat(ahead - np.maximum(size - length + 1, 0), np.maximum(size - length + 1, 0)) + bounds[text]
    p = place[start]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    at, a, b = p[first], start[first], start[last] + length
    around = mix((total[b] - total[a]) * down[a] + ((at - a) * 4096 + (b - a)).astype(np.uint64) * _ODD)
    return text[first], at - bounds[text[first]], at - start[last], at - a, gram[at], around


#: ``at`` holds place, least and largest offset and the copy mark in one number, as millions of rows travel.
ROWS = "gram long, around long, doc_id long, uid long, at long"
NAMES = ["gram", "around", "doc_id", "uid", "at"]
_OFFSET = 12  # bits of an offset


def _batch(copy, gram, around, doc, uid, place, least, most):
    at = ((((place << _OFFSET) | least) << _OFFSET | most) << 1) | copy
    zero = np.zeros_like(around)  # a copy needs neither hash any more
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (
        gram, np.where(copy, zero, around), doc, uid, at)], names=NAMES)


def _unbatch(at):
    """(copy, place, least, most) of ``at``."""
    mask = (1 << _OFFSET) - 1
    return (at & 1).astype(bool), at >> (2 * _OFFSET + 1), (at >> (_OFFSET + 1)) & mask, (at >> 1) & mask


def _earliest(gram, around, doc, uid, place):
    """Order of rows by gram, surroundings and position, and which rows begin a (gram, surroundings)."""
    order = np.lexsort((place, uid, doc, around, gram))
    g, a = gram[order], around[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1])
    return order, new


def _anchor_rows(docs: DataFrame, length: int, hold: int = 500_000) -> DataFrame:
    """Anchors of all texts; those that an earlier one in the same task equals are marked as copies and
    need no gram any more (they travel under a hash of their document)."""

    def run(batches):
        held, count = [], 0

        def settle():
            gram, around, doc, uid, place, least, most = (np.concatenate(c) for c in zip(*held))
            dup = np.zeros(len(gram), bool)
            order = np.argsort(around, kind="stable")
            same = around[order][1:] == around[order][:-1]
            some = np.zeros(len(gram), bool)
            some[order[1:][same]] = some[order[:-1][same]] = True
            idx = np.flatnonzero(some)
            order, new = _earliest(gram[idx], around[idx], doc[idx], uid[idx], place[idx])
            dup[idx[order[~new]]] = True
            gram = np.where(dup, signed(mix(uid.astype(np.uint64))), gram)
            for a in range(0, len(gram), 100_000):
                c = slice(a, a + 100_000)
                yield _batch(dup[c], gram[c], around[c], doc[c], uid[c], place[c], least[c], most[c])

        for batch in batches:
            for part in slices(batch, "text"):
                raw, bounds = utf8(part.column("text"))
                text, place, least, most, gram, around = anchors(raw, bounds, length)
                if len(text):
                    held.append((signed(gram), signed(around), part.column("doc_id").to_numpy()[text],
                                 part.column("uid").to_numpy()[text], place, least, most))
                    count += len(text)
                if count >= hold:
                    yield from settle()
                    held, count = [], 0
        if held:
            yield from settle()

    return docs.mapInArrow(run, ROWS)


def _copies_and_rest(rows: DataFrame, parts: int) -> DataFrame:
    """Of the rows of each gram: copies (all but the earliest of equal surroundings), and, where a gram has
    different surroundings, their earliest rows."""

    def run(batches):
        cols = [[] for _ in NAMES]
        for b in batches:
            for c, name in zip(cols, NAMES):
                c.append(b.column(name).to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        gram, around, doc, uid, at = (np.concatenate(c) for c in cols)
        copy, place, least, most = _unbatch(at)
        out = [np.flatnonzero(copy)]
        live = np.flatnonzero(~copy)
        order = live[np.argsort(gram[live], kind="stable")]
        g = gram[order]
        same = np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        idx = order[same[1:] | same[:-1]]  # grams that occur again
        order, new = _earliest(gram[idx], around[idx], doc[idx], uid[idx], place[idx])
        order = idx[order]
        copy[order[~new]] = True
        out.append(order[~new])
        reps = order[new]
        g = gram[reps]
        same = np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        out.append(reps[same[1:] | same[:-1]])
        keep = np.concatenate(out)
        for a in range(0, len(keep), 100_000):
            k = keep[a: a + 100_000]
            yield _batch(copy[k], np.where(copy[k], 0, gram[k]), np.zeros(len(k), np.int64), doc[k], uid[k], place[k], least[k], most[k])

    return rows.repartition(parts, "gram").mapInArrow(run, ROWS)


class BlindTrie:
    """Strings of one length; inner nodes know only a depth and the branching bytes."""

    def __init__(self, width: int):
        self.width, self.root, self.bits = width, None, width * 8

    def common(self, a: bytes, b: bytes) -> int:
        x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        return (self.bits - x.bit_length()) // 8

    def add(self, s: bytes) -> None:
        """Blind descent to some leaf, one comparison, then a branch at the first difference."""
        if self.root is None:
            self.root = s
            return
        node = self.root
        while not isinstance(node, bytes):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        depth = self.common(s, node)
        if depth == self.width:
            return
        parent, step, now = None, None, self.root
        while not isinstance(now, bytes) and now[0] < depth:
            parent, step, now = now, s[now[0]], now[1][s[now[0]]]
        if not isinstance(now, bytes) and now[0] == depth:
            now[1][s[depth]] = s
            return
        branch = (depth, {s[depth]: s, node[depth]: now})
        if parent is None:
            self.root = branch
        else:
            parent[1][step] = branch

    def ordered(self) -> list[bytes]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, bytes):
                out.append(node)
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow_sort(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort equally long byte rows within their groups.

    Returns the order and, for each sorted row, the bytes in common with the one before it (-1 where a
    group begins).
    """
    n, width = rows.shape
    shallow = min(shallow, width // 8 * 8)
    order = np.argsort(group, kind="stable")
    run = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]])) if n else np.zeros(0, np.int64)
    head = np.ascontiguousarray(rows[:, :shallow]).view(">u8").reshape(n, -1)
    for j in range(head.shape[1]):  # multikey: only rows that are still tied take part
        tied = np.zeros(n + 1, bool)
        tied[1:-1] = run[1:] == run[:-1]
        idx = np.flatnonzero(tied[1:] | tied[:-1])
        if not len(idx):
            break
        key = head[order[idx], j].astype(np.uint64)
        sub = np.lexsort((key, run[idx]))
        order[idx], key = order[idx[sub]], key[sub]
        cut = np.zeros(n, bool)
        cut[1:] = run[1:] != run[:-1]
        cut[idx[1:]] |= (key[1:] != key[:-1]) & (idx[1:] == idx[:-1] + 1)
        run = np.cumsum(cut)
    if n:
        start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.append(start, n))
        for a, k in zip(start[size > 1].tolist(), size[size > 1].tolist()):  # deep: blind tries
            own = order[a: a + k]
            held: dict[bytes, list[int]] = {}
            for i, s in zip(own.tolist(), map(bytes, rows[own])):
                held.setdefault(s, []).append(i)
            if len(held) > 1:
                trie = BlindTrie(width)
                for s in held:
                    trie.add(s)
                order[a: a + k] = [i for s in trie.ordered() for i in held[s]]
    common = np.full(n, -1, np.int64)
    for a in range(1, n, 100_000):
        x, y = rows[order[a - 1: a + 99_999][: min(100_000, n - a)]], rows[order[a: a + 100_000]]
        differ = x != y
        common[a: a + 100_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    if n:
        common[1:][group[order][1:] != group[order][:-1]] = -1
    return order, common


def repeated_offsets(around: np.ndarray, gram: np.ndarray, position: np.ndarray, least: np.ndarray, most: np.ndarray,
                     length: int) -> np.ndarray:
    """Boolean (row, offset): the string that starts ``offset`` bytes before the row's place equals one of an
    earlier row of the same gram.  ``around`` holds ``length - GRAM`` bytes before the place and ``length``
    from it; ``position`` ranks the rows."""
    lead = length - GRAM
    n = len(gram)
    right, rc = deep_shallow_sort(np.ascontiguousarray(around[:, lead:]), gram)
    left, lc = deep_shallow_sort(np.ascontiguousarray(around[:, :lead][:, ::-1]), gram)
    out = np.zeros((n, lead + 1), bool)
    cls_r, cls_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(lead + 1):
        own = np.flatnonzero((least <= o) & (o <= most))
        if len(own) < 2:
            continue
        cls_r[right] = np.cumsum(rc < length - o)
        cls_l[left] = np.cumsum(lc < o)
        order = own[np.lexsort((position[own], cls_l[own], cls_r[own]))]
        out[order[1:], o] = (cls_r[order[1:]] == cls_r[order[:-1]]) & (cls_l[order[1:]] == cls_l[order[:-1]])
    return out


def _partial_repeats(rest: DataFrame, docs: DataFrame, length: int, parts: int) -> DataFrame:
    """(uid, start, end) of strings that repeat an earlier one, for rows with different surroundings."""
    lead = length - GRAM
    wanted = rest.groupBy("uid").agg(F.collect_list(F.struct("place", "least", "most", "gram")).alias("rows"))

    def cut(batches):
        names = ["gram", "doc_id", "uid", "place", "least", "most", "bytes"]
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for d, u, t, rows in zip(*[part.column(c).to_pylist() for c in ("doc_id", "uid", "text", "rows")]):
                    raw = bytes(lead) + t.encode() + bytes(length)
                    out += [(r["gram"], d, u, r["place"], r["least"], r["most"], raw[r["place"]: r["place"] + lead + length]) for r in rows]
                if out:
                    types = [pa.int64()] * 6 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    found = docs.join(wanted, "uid").select("doc_id", "uid", "text", "rows").mapInArrow(
        cut, "gram long, doc_id long, uid long, place long, least long, most long, bytes binary")

    def run(batches):
        got = [pa.Table.from_batches([b]) for b in batches]
        if not got:
            return
        t = pa.concat_tables(got).combine_chunks()
        gram, doc, uid, place, least, most = (t[c].to_numpy() for c in ("gram", "doc_id", "uid", "place", "least", "most"))
        around = np.frombuffer(b"".join(t["bytes"].to_pylist()), np.uint8).reshape(len(gram), lead + length)
        position = np.empty(len(gram), np.int64)
        position[np.lexsort((place, uid, doc))] = np.arange(len(gram))
        hit = repeated_offsets(around, gram, position, least, most, length)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)  # offsets a .. b - 1
        yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(place[row] - (b - 1)), pa.array(place[row] - a + length)],
                                         names=["uid", "start", "end"])

    return found.repartition(parts, "gram").mapInArrow(run, "uid long, start long, end long")


def repeated_ranges(docs: DataFrame, length: int = 100, rows_per_task: int = 500_000) -> DataFrame:
    """(uid, start, end) byte ranges, overlapping or not, whose union is what ``docs`` (doc_id, uid, text)
    repeats from earlier places."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, int(size) // (rows_per_task * 30) + 1)
    if not GRAM <= length < 1 << _OFFSET:
        raise ValueError(f"length must be from {GRAM} to {(1 << _OFFSET) - 1}")
    rows = stored(_copies_and_rest(_anchor_rows(docs, length), parts), "anchors")
    shift = lambda n: F.shiftright("at", n)
    mask = (1 << _OFFSET) - 1
    rows = rows.select("gram", "uid", (F.col("at") % 2 == 1).alias("copy"), shift(2 * _OFFSET + 1).alias("place"),
                       shift(_OFFSET + 1).bitwiseAND(mask).alias("least"), shift(1).bitwiseAND(mask).alias("most"))
    whole = rows.where("copy").select("uid", (F.col("place") - F.col("most")).alias("start"),
                                      (F.col("place") - F.col("least") + length).alias("end"))
    return whole.unionByName(_partial_repeats(rows.where("not copy"), docs, length, max(8, parts // 4)))


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): each document without repeated bytes."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
                       F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = repeated_ranges(docs.select("doc_id", "uid", "text"), length).groupBy("uid").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    schema = "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for t, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    raw = t.encode()
                    if not spans:
                        out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                        continue
                    edge = np.zeros(len(raw) + 1, np.int64)
                    ab = np.array([(s["start"], s["end"]) for s in spans])
                    np.add.at(edge, ab[:, 0], 1)
                    np.add.at(edge, ab[:, 1], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
                n, r, s, h, k = zip(*out)
                cols = [part.column("doc_id"), part.column("no_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()),
                        pa.array(s, pa.int64()), pa.array(h, pa.string())] + [pa.array(k, pa.binary())] * with_text
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "no_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)])

    out = docs.join(spans, "uid", "left").select("doc_id", "no_id", "text", "spans").mapInArrow(run, schema)
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
