"""What the text operators share: reading tables, cutting a corpus into batches, hashing byte strings in numpy.

Several operators work in rounds between *batches* (groups of whole documents, a few MB each) and *buckets* (ranges of
hash values): a batch sends each bucket one row holding a packed array with each of its distinct keys once, the bucket
answers each batch with one row, and the batch meets the answers with its texts again. A key that occurs in every
document therefore costs one entry per batch, so a hot key never makes a large group; and every round is an ordinary
Spark shuffle, so lost executors are recomputed.
"""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id that stands for a null id: it ranks after all others.
NO_ID = np.iinfo(np.int64).max
U = np.uint64
#: Spark's setting by which a query's shuffle files go when it ends, and not some time after the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; a temporary one only where that setting is absent (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="barloom-ckpt-"))


def batch_count(docs: DataFrame, target_bytes: int, text: str = "text") -> tuple[int, int]:
    """How many batches of about target_bytes the texts make (at least enough to keep the cores busy), and all bytes."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(total / target_bytes), min(math.ceil(total / 65536), 2 * cores)), total


def in_batches(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(batch, id, text, kept columns): the batch follows from the id alone, so it is the same in every round."""
    return docs.select(
        F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("batch"),
        F.coalesce(F.col(key).cast("long"), F.lit(int(NO_ID))).alias("id"),
        F.col(text).cast("string").alias("text"),
        *([F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []),
    )


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many _ after it as it takes to differ from those taken (Spark's names ignore case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def texts_of(tab: pa.Table, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in one array, and where each text starts and ends in it (null: empty)."""
    col = tab.column(text)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    arr = arr.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def pieces(starts: np.ndarray, ends: np.ndarray, limit: int):
    """Index ranges [i, j) of consecutive texts of about limit bytes together, at least one text each."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * U(2) + U(1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        m = (0x9E3779B97F4A7C15 + 8 * seed) | 5
        size = max(n, 1 << 20)
        up, down = np.full(size, m, np.uint64), np.full(size, pow(m, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[seed] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


class PrefixHash:
    """Polynomial hashes of all prefixes of a byte array: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        up, self.down = _pow(len(data) + 1, seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(seed)[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the substrings (not yet mixed)."""
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def every(self, k: int) -> np.ndarray:
        """Hash of the k bytes at each place."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[: max(n, 0)]) * self.down[: max(n, 0)] if n > 0 else np.zeros(0, np.uint64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start, start+1, ... of the given lengths."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


def groups_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    i = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == wanted, i, -1)


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a byte array of texts, A-Z lower-cased: their places and 64-bit hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1):
        lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        full = np.flatnonzero(ends > starts)
        begin[starts[full]] = inside[starts[full]]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        stop[ends[full] - 1] = inside[ends[full] - 1]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.text = np.searchsorted(starts[full], self.begin, "right") - 1  # index among the texts that aren't empty
        self.text = full[self.text] if len(full) else self.text
        length = self.end - self.begin
        self.hash = mix(PrefixHash(lower, seed).of(self.begin, length) + length.astype(np.uint64) * U(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.text, np.arange(len(starts)))  # per text: index of its first word
        self.count = np.searchsorted(self.text, np.arange(len(starts)), "right") - self.first


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def squeezed(a: np.ndarray) -> bytes:
    """Packed and compressed, with the length before it."""
    raw = packed(a)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueezed(tab: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True), dtype) for x in tab.column(name).to_pylist()]


def tidy(out):
    """The same; memory that is free again goes back to the machine first."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library
    return out


def released(run):
    """The function over a task's batches; workers serve many tasks, so free memory goes back after each batch."""

    def wrapped(batches):
        for out in run(batches):
            yield out
            tidy(None)
        tidy(None)

    return wrapped


def blobs(tab: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in tab.column(name).to_pylist()]


def joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def forgetful(df: DataFrame) -> DataFrame:
    """The same. Broadcasts and what else Spark keeps of past plans go once the driver's garbage is collected, so it is now, not at the next full heap."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: df written as a table in the shared checkpoint folder, and read again. The write's shuffle files go at its end."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/barloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Saved tables that nothing will read again are removed."""
    for files, spark in [(t.inputFiles(), t.sparkSession) for t in tables]:
        if files:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def planes(a: np.ndarray) -> bytes:
    """squeezed(), byte by byte of all numbers: the high ones are mostly 0."""
    return squeezed(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T))


def unplaned(raw: np.ndarray, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def rising(a: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, by planes."""
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def unrisen(raw: np.ndarray, dtype) -> np.ndarray:
    return np.cumsum(unplaned(raw, dtype), dtype=dtype)
