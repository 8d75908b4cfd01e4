"""What the operators share: scratch tables, folds, row keys and byte arithmetic."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id) -> Column:
    """crc32(doc_id as text) mod 4; fold 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out(doc_id) -> Column:
    """Whether a document is in fold 2; without an id it is not."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


class Scratch:
    """Tables written to the shared folder of ``spark.checkpoint.dir``; they cut lineage and outlive executors.

    Without the setting a session on one machine (tests) uses a folder under /tmp; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir names no shared folder")
            base = "/tmp/ledgerloom-scratch"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, label: str = "t", block: int = 0) -> DataFrame:
        """Write ``df`` and read it again; ``block`` bounds the bytes of a row group."""
        path = self.path(label)
        out = df.write.option("compression", "zstd")
        (out.option("parquet.block.size", block) if block else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{label}"

    def free(self, *labels_or_paths: str) -> None:
        """Delete scratch tables and let Spark drop the shuffles that nothing refers to any more."""
        for path in labels_or_paths:
            self._delete(path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop_all(self, but: str | None = None) -> None:
        """Delete every scratch table except the folder ``but``."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return
        for s in fs.listStatus(p):
            if but is None or s.getPath().getName() != but.rstrip("/").rsplit("/", 1)[1]:
                fs.delete(s.getPath(), True)

    def result(self, df: DataFrame) -> DataFrame:
        """Write the final rows, delete everything else, and read them again."""
        path = self.path("result")
        df.write.option("compression", "zstd").parquet(path)
        self.drop_all(but=path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within, Arrow batches have at most ``rows`` rows; for tables of large rows that are written within, too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tasks_for(spark: SparkSession, df: DataFrame, least: int = 1) -> int:
    """A shuffle width that follows the session's setting and the cores at hand."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def give_back() -> None:
    """Return a worker's free memory to the system: else Arrow's pool and the C library keep the most that any earlier batch took, also while other stages run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def giving_back(f):
    """Decorator: a function of one group's table after which free memory is returned."""

    def one(table):
        out = f(table)
        give_back()
        return out

    return one


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_B = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_B**i and _B**-i modulo 2**64 for i < n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for b in (_B, pow(_B, -1, 1 << 64)):
            p = np.ones(size, dtype=U)
            k = 1
            while k < size:  # doubling
                p[k : 2 * k] = p[:k] * U(pow(b, k, 1 << 64))
                k *= 2
            out.append(p)
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def byte_codes(seed: int = 7) -> np.ndarray:
    """A random odd 64-bit code for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


class RollingHash:
    """Hashes of any byte range of a buffer in constant time each: polynomial over random byte codes, then mixed with the length."""

    def __init__(self, data: np.ndarray, seed: int = 7):
        n = len(data)
        self.p, self.inv = powers(n + 1)
        self.sum = np.zeros(n + 1, dtype=U)
        np.cumsum(byte_codes(seed)[data] * self.p[:n], out=self.sum[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def windows(self, q: int) -> np.ndarray:
        """Hash of every q-byte window, by its start."""
        n = len(self.sum) - 1
        if n < q:
            return np.zeros(0, dtype=U)
        return mix((self.sum[q:] - self.sum[: n - q + 1]) * self.inv[: n - q + 1])


def spans(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges offsets[i] .. offsets[i]+lengths[i]-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    o, n, e = offsets[keep], lengths[keep], ends[keep]
    out[0] = o[0]
    out[e[:-1]] = o[1:] - (o[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its rows; null rows are empty."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """Runs of rows (a, b) holding at most ``limit`` bytes, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes for which the 256-entry table ``inside`` is true; runs end with their row."""
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    m = inside[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    start = m.copy()
    start[1:] &= ~m[:-1] | first[1:n]
    end = m.copy()
    end[:-1] &= ~m[1:] | first[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offsets, s, side="right") - 1


def arrow_udf(returns: str):
    """Decorator: a scalar function over one Arrow column."""
    import pyarrow as pa

    def make(f):
        f.__annotations__ = {next(iter(f.__code__.co_varnames[:1])): pa.Array, "return": pa.Array}
        return F.arrow_udf(f, returns)

    return make


def table_print(df: DataFrame, text: str) -> DataFrame:
    """df with _p, a fingerprint of its text by which equal texts can be joined."""
    return df.withColumn("_p", text_print(F.col(text)))


def text_print(c: Column) -> Column:
    return F.concat_ws(":", F.length(c), F.xxhash64(c), F.hash(c))


def free_name(names, wish: str) -> str:
    """``wish``, with underscores in front until no column has that name (names are compared without case)."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def hashed_bitmap(ids: DataFrame, column: str):
    """A function from a long column to whether its hash is among those of ``ids``: 2**24 bits, so 2 MB at any size; null is not."""
    import pyarrow as pa

    slot = F.pmod(F.xxhash64(column), F.lit(1 << 24))
    words = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32768).cast("int").alias("w")).agg(F.bitmap_construct_agg((F.col("s") % 32768).cast("long")).alias("b")).collect()
    bitmap = np.zeros((512, 4096), dtype=np.uint8)
    for r in words:
        bitmap[r["w"]] = np.frombuffer(r["b"], dtype=np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bitmap.ravel())

    def test(at: pa.Array) -> pa.Array:
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & (at >= 0))

    test.__annotations__ = {"at": pa.Array, "return": pa.Array}
    probe = F.arrow_udf(test, "boolean")
    return lambda c: probe(F.when(c.isNotNull(), F.pmod(F.xxhash64(c), F.lit(1 << 24))))
