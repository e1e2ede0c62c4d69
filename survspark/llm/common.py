"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

SLICE_BYTES = 2_000_000  # text handled at once inside a task; bounds a worker's memory, not what is read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(m)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of the actions inside go when an action ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands Python batches of ``SLICE_BYTES`` (one row at least), unless the session has a limit of its own.

    By default a batch may take 64 MB, and an executor holds it several times over: as Arrow vectors, as the stream
    to Python and in the worker.  Frames are often written after the operator returned, so the limit stays set;
    the operators' results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(SLICE_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and a lost executor
    costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def stored_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """``stored``, bucketed by a column: later joins and groups on it need no shuffle of these rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"survspark_{name}_{path.rsplit('/', 2)[-2]}"
    with _shuffles_removed(spark):
        df.write.bucketBy(shuffle_parts(spark), column).option("path", path).saveAsTable(table)
    return spark.table(table)


def removed(df: DataFrame) -> None:
    """Delete the folder of a ``stored`` table that no later step reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows whose text stays near ``limit`` bytes (one row at least)."""
    col = batch.column(column)
    if len(col) == 0:
        return
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // limit
    cut = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *cut.tolist(), len(size)]
    for a, b in zip(bounds, bounds[1:]):
        yield batch.slice(a, b - a)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column as one array, and the row bounds in it; null is empty."""
    col = pc.fill_null(col, "") if col.null_count else col
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    bounds = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    filled, step = 1, base
    while filled < n:
        k = min(filled, n - filled)
        out[filled: filled + k] = out[:k] * np.uint64(pow(base, filled, 1 << 64))
        filled += k
    return out


_table: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_table.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 200_000)
        _table["up"], _table["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _table["up"], _table["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A fixed random 64-bit value for each byte, letters A-Z sharing those of a-z.
_exact = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_letters = _exact.copy()
_letters[ord("A"): ord("Z") + 1] = _letters[ord("a"): ord("z") + 1]
_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(raw: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered if asked for, hashed to 64 bits in one vectorised pass.

    Returns the hashes, the row bounds in them (``len(rows) + 1``) and each word's byte start and
    end.  One prefix sum over the bytes serves all words, so the cost does not depend on word lengths.
    """
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), z, z
    inside = ~_space[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = np.unique(bounds[1:-1])
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_letters if lower else _exact)[raw] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, bounds), start, end


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (empty if there are fewer)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + words[i: i + m]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions use many times: they are computed once for each row, as the
    optimizer does not copy an expression through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
