"""Best-fit packing of documents into token sequences by bin completion.

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) reaches the
driver.  There the bins are completed around the largest remaining piece: all undominated fillings are
enumerated, pruned by the waste that the incumbent still allows, and the best-fit packing is the first
incumbent.  A filling is used as often as the counts allow, then less often, so the plan has a few thousand rows
at any size.  The search ends when the lower bound is met or nothing better is left, or after ``nodes`` entries of
its trees; the column ``fewest`` says which.  Pieces find their place by their rank within their length.

Defined cases: a null or empty text is a piece of one end id; texts with white space only are texts;
repeated ids are documents of their own (and, being alike in id and piece, ordered by their content);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored
from .tokenizing import piece_cache

#: Entries of the search trees after which ``place`` goes on with the best packing so far (some 4 s of the driver).
NODES = 3_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full ones, after a shorter first one."""
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, add the end id and cut documents longer than ``capacity``."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        cache = piece_cache(tokenizer, True)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows = []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.concatenate([cache.encode(t.as_py() or ""), end])
                for k, (s, n) in enumerate(cut_lengths(len(ids), capacity)):
                    part = ids[s: s + n]
                    rows.append((d, k, s, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            cols = list(zip(*rows)) or [()] * (6 if with_ids else 5)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: each bin takes the largest piece that still fits."""
    left, sizes, plan = dict(counts), sorted(counts), []
    while sizes:
        bin_, room = Counter(), capacity
        while True:
            i = bisect.bisect_right(sizes, room) - 1
            while i >= 0 and bin_[sizes[i]] >= left[sizes[i]]:
                i -= 1
            if i < 0:
                break
            k = min(room // sizes[i], left[sizes[i]] - bin_[sizes[i]])
            bin_[sizes[i]] += k
            room -= k * sizes[i]
        uses = min(left[s] // k for s, k in bin_.items() if k)
        plan.append((tuple(sorted(bin_.elements(), reverse=True)), uses))
        for s, k in bin_.items():
            left[s] -= k * uses
        sizes = [s for s in sizes if left[s]]
    return plan


def _best_pair(usable: np.ndarray, have: np.ndarray, room: int) -> tuple[int, int] | None:
    """The pair of pieces with the largest sum that fits."""
    i = np.searchsorted(usable, room - usable, side="right") - 1
    ok = i >= 0
    a, b = usable[ok], usable[i[ok]]
    alone = (a == b) & (have[a] < 2)  # a single piece cannot be its own partner: take the next smaller one
    i = np.where(alone, i[ok] - 1, i[ok])
    a, b = a[i >= 0], usable[i[i >= 0]]
    if not len(a):
        return None
    k = int(np.argmax(a + b))
    return max(int(a[k]), int(b[k])), min(int(a[k]), int(b[k]))


def _dominated(filling: tuple[int, ...], free: np.ndarray, room: int) -> bool:
    """Whether a free piece may take the place of some of the filling's pieces (or of none) that are not larger
    together: the other packing is then no worse, and fuller or with fewer pieces here."""
    sums, some, several = 1, 0, 0  # bit s: sums of any pieces, of one or more, of two or more
    for s in filling:
        several |= some << s
        some |= sums << s
        sums |= sums << s
    rest = room - sum(filling)
    for x in np.flatnonzero(free[: room + 1]).tolist():
        low = max(0, x - rest)
        if (sums >> low) & ((1 << (x - low)) - 1) or (several >> x) & 1:
            return True
    return False


class _Effort:
    """Entries of the search trees visited so far, a leaf counted as 100; past the limit, if there is one, it raises."""

    class Spent(Exception):
        pass

    def __init__(self, most: int | None):
        self.most, self.spent = most, 0

    def add(self, n: int) -> None:
        self.spent += n
        if self.most is not None and self.spent > self.most:
            raise _Effort.Spent


def _fillings(left: np.ndarray, largest: int, room: int, waste: int, effort: _Effort):
    """All undominated fillings of the room beside ``largest`` that waste at most ``waste``, one at a time.

    First some likely ones (the best single piece, pair and triples), then the whole tree, largest pieces first."""
    free = left.copy()
    free[largest] -= 1
    usable = np.flatnonzero(free[: room + 1])
    if not len(usable):
        if room <= waste:
            yield ()
        return
    seen = set()

    def fit(f: tuple[int, ...]) -> bool:
        if f in seen or room - sum(f) > waste:
            return False
        seen.add(f)
        effort.add(100)
        own = free.copy()
        np.subtract.at(own, list(f), 1)
        return not _dominated(f, own, room)

    likely = [(int(usable[-1]),)]
    if p := _best_pair(usable, free, room):
        likely.append(p)
    for c in usable[-16:][::-1].tolist():
        free[c] -= 1
        rest = usable[(usable <= room - c) & (free[usable] > 0)]
        p = _best_pair(rest, free, room - c) if len(rest) else None
        free[c] += 1
        if p:
            likely.append(tuple(sorted((c, *p), reverse=True)))
    for f in sorted(likely, key=lambda f: (room - sum(f), len(f))):
        if fit(f):
            yield f
    sizes = usable[::-1].tolist()
    most = [int(free[s]) for s in sizes]
    after = [0] * (len(sizes) + 1)  # what all pieces from here on hold together
    for i in range(len(sizes) - 1, -1, -1):
        after[i] = after[i + 1] + sizes[i] * most[i]
    # one entry a size: how many of it are taken; a branch that cannot fill the room ends
    stack = [(0, room, ())]
    while stack:
        i, r, f = stack.pop()
        effort.add(1)
        if r - after[i] > waste:
            continue
        while i < len(sizes) and sizes[i] > r:
            i += 1
        if r - after[i] > waste:
            continue
        if i == len(sizes):
            if fit(f):
                yield f
            continue
        k = min(r // sizes[i], most[i])
        stack += [(i + 1, r - n * sizes[i], f + (sizes[i],) * n) for n in range(k + 1)]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A number of bins that no packing goes below: the largest of the dual feasible bounds u(k) of Fekete and
    Schepers, with and without the pieces of up to a threshold (those above its complement fill a bin)."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(s)] for s in sizes], np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for low in (0, *(int(s) for s in sizes[sizes <= capacity // 2])):
        x = np.where(sizes > capacity - low, capacity, np.where(sizes < low, 0, sizes))
        best = max(best, -(-int((x * n).sum()) // capacity))
        for k in range(1, 8):
            whole = (k + 1) * x % capacity == 0
            # k times the rounded size, in bins of k * capacity
            u = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
            best = max(best, -(-int((u * n).sum()) // (k * capacity)))
    return best


def complete_bins(counts: dict[int, int], capacity: int, nodes: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """The packing of ``search_bins``: [(lengths in a bin, times used)], covering every piece."""
    return search_bins(counts, capacity, nodes)[0]


def search_bins(counts: dict[int, int], capacity: int, nodes: int | None = None) -> tuple[list[tuple[tuple[int, ...], int]], bool]:
    """Bin completion on a histogram of lengths: the packing, and whether it is proved to have the fewest bins.

    Branch and bound, depth first: a node completes the bin around the largest remaining piece with one
    undominated filling, used from as many times as the counts (and the waste) allow down to once; below it, bins
    around the same piece take other fillings, as those with this one were counted.  No filling is left out: the
    search goes on until the packing meets the lower bound or no better one is left.  The problem is NP-hard:
    with ``nodes`` the search ends unproved after so many entries of its trees, with the best packing so far."""
    counts = {s: c for s, c in counts.items() if c}
    if not counts:
        return [], True
    incumbent = _best_fit(counts, capacity)
    best = sum(u for _, u in incumbent)
    total = sum(s * c for s, c in counts.items())
    least = least_bins(counts, capacity)
    left = np.zeros(capacity + 1, np.int64)
    left[list(counts)] = list(counts.values())
    path: list[tuple[tuple[int, ...], int]] = []
    bins = waste = 0
    effort = _Effort(nodes)

    def step(bin_: tuple[int, ...], uses: int) -> None:
        nonlocal bins, waste
        np.subtract.at(left, list(bin_), uses)
        bins += uses
        waste += (capacity - sum(bin_)) * uses

    def options(banned: set):
        """(filling with its largest piece, uses) of a node; fillings go to ``banned`` once their uses are through."""
        top = int(np.flatnonzero(left)[-1])
        for f in _fillings(left, top, capacity - top, (best - 1) * capacity - total - waste, effort):
            bin_ = (top, *f)
            if bin_ in banned:
                continue
            uses = min(int(left[s]) // k for s, k in Counter(bin_).items())
            for u in range(uses, 0, -1):
                # the best packing may have improved since
                if waste + (capacity - sum(bin_)) * u <= (best - 1) * capacity - total:
                    yield bin_, u
            banned.add(bin_)

    banned: set = set()
    open_ = [(banned, options(banned))]
    try:
        while open_ and best > least:
            banned, more = open_[-1]
            if len(path) == len(open_):
                done, uses = path.pop()
                step(done, -uses)
            if not (new := next(more, None)):
                open_.pop()
                continue
            effort.add(1)
            path.append(new)
            step(*new)
            some = np.flatnonzero(left)
            if not len(some):
                if bins < best:
                    best, incumbent = bins, list(path)
                continue
            own = {*banned, new[0]} if int(some[-1]) == new[0][0] else set()
            open_.append((own, options(own)))
    except _Effort.Spent:
        return incumbent, False
    return incumbent, True


def place(pieces: DataFrame, capacity: int, nodes: int | None = NODES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length``, and ``fewest``: whether the number of
    sequences is proved to be the smallest possible one."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    plan, fewest = search_bins(counts, capacity, nodes)
    for bin_, uses in plan:
        at = 0
        for s, k in sorted(Counter(bin_).items(), reverse=True):
            slots.setdefault(s, []).append((used[s], base, k, at, uses))
            used[s] += k * uses
            at += k * s
        base += uses
    where = {s: np.array(v, np.int64) for s, v in slots.items()}

    # rank within a length, by hashed buckets: no window holds a whole length
    buckets = max(1, -(-sum(counts.values()) // 50_000))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).alias("bucket")
    keyed = pieces.select("*", bucket)
    ahead = (keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
             .withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(
                 Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("ahead", F.lit(0)).alias("ahead")))
    ranked = (keyed.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(
        "doc_id", "piece", "ids_crc32"))).join(ahead, ["length", "bucket"])
        .withColumn("r", F.col("r") + F.col("ahead") - 1).select(*pieces.columns, "r"))

    def run(batches):
        for batch in batches:
            length, r = batch.column("length").to_numpy(), batch.column("r").to_numpy()
            seq, off = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            for s in np.unique(length):
                own = np.flatnonzero(length == s)
                first, b, k, at, _ = where[int(s)][np.searchsorted(where[int(s)][:, 0], r[own], side="right") - 1].T
                turn = r[own] - first
                seq[own], off[own] = b + turn // k, at + turn % k * s
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)],
                                             names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ranked.drop("r").schema
    return ranked.mapInArrow(run, schema.add("sequence_id", "long").add("offset", "long")).withColumn("fewest", F.lit(fewest))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
                   nodes: int | None = NODES) -> DataFrame:
    """One row for each piece with its sequence and offset (and its ids, if asked for).  ``nodes`` as in ``search_bins``:
    with None the search for fewer sequences goes on until the result is proved."""
    return place(stored(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity, nodes)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
