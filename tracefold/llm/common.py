"""Helpers shared by the training-text operators.

Words are maximal runs of characters other than the ASCII white space
(U+0020, U+0009 to U+000D); ``bytes.split()`` cuts a UTF-8 text at exactly
those characters.  All helpers take a missing text as having no words.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tracefold-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later stages then start from files that survive a lost executor.
    """
    return kept(df)[0]


_written: list[str] = []


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut``, with the table's path, for those that drop it when done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracefold-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table written by ``kept`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as decimal text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def one_blas_thread() -> None:
    """Lets numpy's matrix products use one thread, as a task has one core; several would only spin on small matrices."""
    import ctypes
    import pathlib

    for lib in (pathlib.Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if (limit := getattr(ctypes.CDLL(str(lib)), name, None)) is not None:
                limit(1)
                break


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece has about ``most`` bytes of text and at most ``rows`` rows (one at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + most, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def sweep(spark: SparkSession) -> int:
    """Remove all tables that ``cut`` and ``kept`` wrote; for callers that have stored their results."""
    paths = list(_written)
    _written.clear()
    for path in paths:
        discard(spark, path)
    return len(paths)


#: A-Z to a-z, everything else unchanged, also on UTF-8 bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound of entries."""

    def __init__(self, most: int = 300_000):
        import xxhash

        self.most, self._hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self._hash(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
