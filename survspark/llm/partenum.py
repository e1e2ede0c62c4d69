"""Set-similarity join of documents by PartEnum signatures.

A document is the set of its distinct word shingles.  Sets of one size band, with Jaccard similarity at
least ``num / den``, differ in at most k elements, k following from the band.  The hashed feature domain
is cut into n1 first-level partitions of two second-level ones each: with n1 > k / 2, some first-level
partition holds at most one difference, so one of its two subsets of size one agrees in both sets.  Each
subset of a set is one signature (band, place, fingerprint of the elements there); similar sets share at
least one.  Empty subsets, which would all agree, are never signatures: a few spare partitions make up for
them, a set with too many empty subsets adds signatures of further partitionings up to the first in which it
has few, and a set that has none such adds the fingerprints of all its subsets that lack as many elements as a
similar set may lack (these sets are small).

Equal sets are collapsed to classes first (a class is the 64-bit fingerprint of a set).  Each class is
first compared with the smallest one that it shares a signature with; then, round by round, classes of
different components that share a signature and that a safe bound on their difference does not part.  In a
round each component proposes its few closest such pairs by that bound, never all pairs; pairs that verification
has refused are known to the group, more pairs may be proposed with each round, and rounds go on until no component
has one left, so no link between components is lost.  As in Boruvka's trees, components at least halve in a round
where the bound is right.  All comparisons are exact intersections.

Defined cases: null or empty texts, and texts of white space, have an empty set and link with nothing;
texts with fewer words than a shingle are one shingle; repeated rows and ids are documents of their own;
rows with a null id link like others, and a component of only such rows has a null id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, removed, shingle_hashes, signed, slices, small_batches, stored, utf8, word_hashes
from .components import connected_components

_ODD = np.uint64(0xD6E8FEB86659FD93)
_ALL = (1 << 64) - 1


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a column."""
    words, rows, _, _ = word_hashes(*utf8(column))
    out = []
    for a, b in zip(rows, rows[1:]):
        w = words[a:b]
        out.append(np.unique(shingle_hashes(w, min(k, len(w))) if len(w) else w))
    return out


def set_class(s: np.ndarray) -> np.uint64:
    return mix(s.sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * _ODD)[0]


def parity_sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each of 2^m buckets, at least eight times as many as elements in small
    sets and as many in large ones (from 512 elements on).

    Each element that only one of two sets holds flips one bit, so sketches differ in at most as many bits
    as the sets differ in elements: a safe bound.  Halves fold by exclusive or."""
    most = max(len(s), 1)
    bits = max(64, 1 << int(max(min(8 * most, 4096), most) - 1).bit_length())
    return np.packbits((np.bincount(((s >> np.uint64(23)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for i, raw in enumerate(sketches):
        x = np.frombuffer(raw, np.uint64)
        while len(x) > least // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2:]
        out[i] = x
    return out


class Bands:
    """Size bands for a similarity: band t pairs its own sizes with the sizes just above that they may join."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * den // num)))
        self.high = [(b - 1) * den // num for b in self.low[1:]]  # largest partner of each band
        # H = |A u B| - |A n B| <= (den - num) / (den + num) * (|A| + |B|)
        self.k = [(den - num) * 2 * h // (den + num) for h in self.high]
        self._partitions: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> list[int]:
        t = int(np.searchsorted(self.low, n, side="right")) - 1
        out = [t]
        while out[-1] > 0 and self.high[out[-1] - 1] >= n:
            out.append(out[-1] - 1)
        return out

    def few(self, t: int) -> bool:
        """Whether the subsets that lack as many elements as similar sets may lack are few for all sizes of the band."""
        n = self.high[t]
        lack = (self.den - self.num) * n // self.den
        return n <= 64 and sum(math.comb(n, r) for r in range(lack + 1)) <= 20_000

    def partitions(self, t: int) -> tuple[int, int]:
        """(n1, spare): first-level partitions, and how many may go unused.

        Any number of spare ones is exact.  With the least one that also the smallest sets of the band are likely to
        keep to, one partitioning does for most sets; too few cost a set several."""
        if t not in self._partitions:
            need, n = self.k[t] // 2 + 1, self.low[t]
            spare = 2 + need // 16
            for more in range(2, 4 * need):
                n1 = need + more
                unused = 1 - (1 - math.exp(-n / (2 * n1))) ** 2  # share of the first-level partitions with an empty subset
                if n1 * unused + math.sqrt(n1 * unused * (1 - unused)) <= more:
                    spare = more
                    break
            self._partitions[t] = need + spare, spare
        return self._partitions[t]


_LEVELS = 8


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of one set (none where only equal sets can join)."""
    out = []
    for t in bands.of(len(s)):
        if bands.k[t] == 0:
            continue
        n1, spare = bands.partitions(t)
        for level in range(_LEVELS):
            h = s if level == 0 else mix(s ^ np.uint64(level))
            place = ((h >> np.uint64(17)) % np.uint64(2 * n1)).astype(np.int64)
            total = np.zeros(2 * n1, np.uint64)
            np.add.at(total, place, s)
            filled = np.zeros(2 * n1, bool)
            filled[place] = True
            out.append(mix(total * _ODD + np.arange(2 * n1, dtype=np.uint64) + np.uint64((t << 32) + (level << 28)))[filled])
            # first-level partitions with an empty subset; as long as they are no more than the spare ones,
            # an agreeing subset that is not empty exists.  Of two sets the one that stops first has met the other there
            if n1 - int((filled[0::2] & filled[1::2]).sum()) <= spare:
                break
        else:
            if not bands.few(t):
                # a low similarity: too many subsets, so empty subsets of the first partitioning count after all
                place = ((s >> np.uint64(17)) % np.uint64(2 * n1)).astype(np.int64)
                empty = np.setdiff1d(np.arange(2 * n1), place).astype(np.uint64)
                out.append(mix(empty + np.uint64(t << 32)))
                continue
            # what two similar sets share lacks only a few elements of each
            lack = (bands.den - bands.num) * len(s) // bands.den
            whole = s.sum(dtype=np.uint64)
            less = [whole - np.array([sum(map(int, c)) & _ALL for c in itertools.combinations(s.tolist(), r)], np.uint64) for r in range(lack + 1)]
            out.append(mix(np.concatenate(less) * _ODD + np.uint64((t << 32) + (_LEVELS << 28))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _classes(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                cls = np.array([set_class(s) for s in sets], np.uint64)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n), pa.array(signed(cls), mask=n == 0),
                                                  pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary())],
                                                 names=["doc_id", "h", "n_shingles", "cls", "sketch"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, n_shingles long, cls long, sketch binary")


_GROUP = 4096  # classes of a signature that one group compares
_BEST = 2  # pairs that a component proposes in the first round; four times as many in each further one
_REACH = (4, 32)  # neighbours by size that a class meets in the first rounds, when most copies find each other; then all


_COARSE = 64  # bytes of a sketch that all pairs are compared by; what passes is compared by whole sketches


def _coarse(sketches: list[bytes]) -> np.ndarray:
    """All sketches folded to ``_COARSE`` bytes (shorter ones are repeated as zeros and tell by their own words)."""
    out = np.zeros((len(sketches), _COARSE // 8), np.uint64)
    size = np.array([len(x) for x in sketches])
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        bits = np.frombuffer(b"".join([sketches[i] for i in rows]), np.uint64).reshape(len(rows), -1)
        while bits.shape[1] > out.shape[1]:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        out[rows, : bits.shape[1]] = bits
    return out


def _closest(t: dict, num: int, den: int, most: int, reach: int) -> dict[int, list]:
    """The closest pairs, ``component -> [(bound, a, b)]`` (at most ``most`` each), of classes that share a group, lie in
    different components and may be similar.

    ``t`` holds whole groups, ordered by group and size.  Every row meets the s-th row after it in its group, for all
    rows at once, with s up to ``reach`` (0: to the end of the group); no pairs but those that pass are kept."""
    group, cls, comp, n, half, sketches, refused = (t[c] for c in ("group", "cls", "component", "n", "half", "sketch", "refused"))
    size = np.array([len(x) for x in sketches])
    bits = _coarse(sketches)
    best: dict[int, list] = {}
    end = np.searchsorted(group, group, "right")
    rows, s = np.arange(len(group)), 0
    while True:
        s += 1
        rows = rows[rows + s < end[rows]]
        if not len(rows) or (reach and s > reach):
            return best
        other = rows + s
        ok = (comp[rows] != comp[other]) & (half[rows] != half[other]) & (n[rows] * den >= n[other] * num)
        i, j = rows[ok], other[ok]
        limit = (den - num) * (n[i] + n[j]) // (den + num)
        # sketches of one length, or both folded to the coarse length, bound the difference; others need folding
        alike = (size[i] == size[j]) | (np.minimum(size[i], size[j]) >= _COARSE)
        differ = np.where(alike, np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64), 0)
        keep = differ <= limit
        for x, y, d, most_bits in zip(i[keep].tolist(), j[keep].tolist(), differ[keep].tolist(), limit[keep].tolist()):
            if size[x] != size[y] or size[x] > _COARSE:
                one, two = _folded([sketches[x], sketches[y]])
                d = int(np.bitwise_count(one ^ two).sum())
                if d > most_bits:
                    continue
            pair = (min(int(cls[x]), int(cls[y])), max(int(cls[x]), int(cls[y])))
            if pair in refused:
                continue
            for c in (int(comp[x]), int(comp[y])):
                known = best.setdefault(c, [])
                if len(known) < most or (d, *pair) < known[-1]:
                    if (d, *pair) not in known:
                        known.append((d, *pair))
                        known.sort()
                        del known[most:]


def _proposals(open_: DataFrame, refused: DataFrame, sketches: DataFrame, num: int, den: int, parts: int, most: int, reach: int) -> DataFrame:
    """(a, b, full): the closest pairs of classes that each component proposes, at most ``most``; ``full`` where a
    component has that many, so that it may have more.

    Groups of more than ``_GROUP`` classes are split into blocks, and each pair of blocks is a group."""
    count = open_.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / _GROUP).cast("int").alias("blocks"))
    rows = open_.join(count, "sig").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.select("sig", "cls", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("sig", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("half"),
                       "cls", "component").join(sketches, "cls").withColumn("partner", F.lit(None).cast("long"))
    # a refused pair goes to the groups that hold its smaller class
    told = refused.select(F.col("a").alias("cls"), F.col("b").alias("partner")).join(sketches.select(F.col("cls").alias("partner")), "partner", "left_semi")
    rows = rows.unionByName(rows.select("sig", "p", "q", "cls").join(told, "cls"), allowMissingColumns=True)
    rows = rows.repartition(parts, "sig", "p", "q").sortWithinPartitions("sig", "p", "q", "n", "cls")

    def run(batches):
        best, held = {}, None

        def take(t: pa.Table):
            told = pc.is_valid(t["partner"])
            said, t = t.filter(told), t.filter(pc.invert(told))
            if t.num_rows < 2:
                return
            keys = np.stack([t[c].to_numpy() for c in ("sig", "p", "q")])
            group = np.concatenate([[0], np.cumsum((np.diff(keys, axis=1) != 0).any(axis=0))])
            # inside a block any two rows may pair; between two blocks only those across
            half = np.where(keys[1] == keys[2], np.arange(len(group)) + 2, t["half"].to_numpy())
            cols = {c: t[c].to_numpy() for c in ("cls", "component", "n")}
            found = _closest({**cols, "group": group, "half": half, "sketch": t["sketch"].to_pylist(),
                              "refused": set(zip(said["cls"].to_pylist(), said["partner"].to_pylist()))}, num, den, most, reach)
            for c, pairs in found.items():
                best[c] = sorted({*best.get(c, ()), *pairs})[:most]

        def emit():
            out = [(c, *x) for c, pairs in best.items() for x in pairs]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["component", "differ", "a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            # the last group may go on in the next batch
            keys = np.stack([t[c].to_numpy() for c in ("sig", "p", "q")])
            cut = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                take(t.slice(0, cut))
            held = t.slice(cut)
            if len(best) > 100_000:
                yield emit()
        if held is not None:
            take(held)
        if best:
            yield emit()

    found = rows.mapInArrow(run, "component long, differ long, a long, b long")
    order = Window.partitionBy("component").orderBy("differ", "a", "b")
    placed = found.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return placed.groupBy("a", "b").agg((F.max("place") == most).alias("full"))


def _signature_rows(docs: DataFrame, k: int, num: int, den: int, largest: int) -> DataFrame:
    def run(batches):
        bands, seen = Bands(num, den, largest), set()
        for batch in batches:
            for part in slices(batch, "text"):
                sig, cls = [], []
                for s in shingle_sets(part.column("text"), k):
                    c = int(set_class(s)) if len(s) else None
                    if c is None or c in seen:  # copies within a task add nothing
                        continue
                    seen.add(c)
                    sig.append(signatures(s, bands))
                    cls.append(np.full(len(sig[-1]), c, np.uint64))
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sig))), pa.array(signed(np.concatenate(cls)))],
                                                     names=["sig", "cls"])

    return docs.mapInArrow(run, "sig long, cls long")


def _shared(rows: DataFrame, parts: int) -> DataFrame:
    """Signatures that several classes share, with their classes: (sig, cls, first)."""

    def run(batches):
        got = [(b.column("sig").to_numpy(), b.column("cls").to_numpy()) for b in batches]
        if not got:
            return
        sig, cls = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[new], cls[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(start, len(sig)))
        keep = np.repeat(size > 1, size)
        first = np.repeat(cls[start], size)
        for a in range(0, int(keep.sum()), 200_000):
            cut = slice(a, a + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep][cut]) for x in (sig, cls, first)], names=["sig", "cls", "first"])

    # a task sorts its signatures; their number is set by the total, so it is bounded
    return rows.repartition(parts, "sig").mapInArrow(run, "sig long, cls long, first long")


def _id():
    """The id as a join key: null is a value of its own."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id")


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) of ``label`` after more links (a, b) of classes: only the components that these
    join are contracted."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        named = label.select(F.col("node").alias(end), F.col("component").alias("of"))
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    step = stored(connected_components(ends), "joined")
    moved = label.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(step.join(label, "node", "left_anti"))


def _verified(pairs: DataFrame, docs: DataFrame, size: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of classes, and those whose sets are similar enough; ``size``: (cls, at, n), one row of each class."""
    pairs = (pairs.join(size.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a")
             .join(size.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
             .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b"))
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    # one row of each class, found again by its id and the hash of its text
    one = wanted.join(size, "cls").select("at.id", "at.h", "cls")

    def sets(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = shingle_sets(part.column("text"), k)
                keep = [i for i, (s, c) in enumerate(zip(found, part.column("cls").to_pylist()))
                        if len(s) and int(signed(np.array([set_class(s)]))[0]) == c]  # another row may carry the id
                if keep:
                    yield pa.RecordBatch.from_arrays([part.column("cls").take(pa.array(keep)), pa.array(
                        [signed(found[i]) for i in keep], pa.list_(pa.int64()))], names=["cls", "elements"])

    table = stored(docs.select(_id(), "h", "text").join(one, ["id", "h"]).select("cls", "text").mapInArrow(sets, "cls long, elements array<long>")
                   .dropDuplicates(["cls"]), "sets")

    def compare(batches):
        for batch in batches:
            a, b = batch.column("x"), batch.column("y")
            ok = []
            for x, y in zip(a, b):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x.view(np.uint64), y.view(np.uint64), assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = stored(pairs.join(table.select(F.col("cls").alias("a"), F.col("elements").alias("x")), "a")
                   .join(table.select(F.col("cls").alias("b"), F.col("elements").alias("y")), "b")
                   .mapInArrow(compare, "a long, b long"), "links")
    removed(table)
    return pairs, links


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, with_keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked directly or through others, where
    ``den * |A n B| >= num * |A u B|`` links; the component is its smallest ``doc_id``.  ``with_keys`` adds the
    ``xxhash64`` of the text (``h``) and a key of the component that ids, null or repeated, do not
    touch (``component``, null for empty sets)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    classes = stored(_classes(docs, k), "classes")
    total, largest = classes.agg(F.sum("n_shingles"), F.max("n_shingles")).first()
    if not total:
        return classes.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *[F.col("h"), F.col("cls").alias("component")] * with_keys)
    parts = max(8, int(total) // 2_000_000 + 1)
    shared = stored(_shared(_signature_rows(docs, k, num, den, int(largest)), parts), "shared")

    def still_open(rows, label):
        """Signatures that hold several components; of those with the same classes one is enough."""
        named = rows.select("sig", "cls").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        hashes = [F.sum(F.xxhash64(F.lit(i), "cls").cast("decimal(38,0)")).alias(f"f{i}") for i in (1, 2)]
        apart = named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *hashes).where("lo <> hi")
        one = apart.groupBy("f1", "f2").agg(F.min("sig").alias("sig")).select("sig")
        return stored(named.join(one, "sig").select("sig", "cls", "component"), "open")

    size = stored(classes.where("cls is not null").groupBy("cls").agg(F.min(F.struct(_id(), "h")).alias("at"), F.first("n_shingles").alias("n")), "size")
    # 1. each class with the smallest class it shares a signature with: one pair a class
    star = shared.where("cls <> first").groupBy(F.col("cls").alias("b")).agg(F.min("first").alias("a")).select("a", "b")
    tested, links = _verified(star, docs, size, k, num, den)
    label = stored(connected_components(links), "labels")
    open_ = still_open(shared, label)
    removed(shared)
    sketches = stored(classes.join(open_.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(
        F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    # 2. round by round, what groups of several components propose; where all neighbours were met and no component had more
    # pairs than it could propose, every pair that may link two components has been tested
    refused = stored(tested.join(links, ["a", "b"], "left_anti"), "refused")
    most, reaches = _BEST, [*_REACH, 0]
    while True:
        rest = stored(_proposals(open_, refused, sketches, num, den, parts, most, reaches[0]), "rest")
        most *= 4
        some, full = rest.agg(F.count(F.lit(1)), F.max("full")).first()
        done = len(reaches) == 1 and not full
        reaches = reaches[1:] or reaches
        if some:
            tested, more = _verified(rest.select("a", "b"), docs, size, k, num, den)
            if not more.isEmpty():
                label = stored(_merged(label, more), "labels")
            if not done:
                refused = refused.unionByName(stored(rest.select("a", "b").join(more, ["a", "b"], "left_anti"), "refused"))
                before, open_ = open_, still_open(open_, label)
                removed(before)
        if done:
            break
    named = classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = stored(named.select("doc_id", "h", "n_shingles", "component"), "members")
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *["h", "component"] * with_keys)


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)
