"""Shared helpers of the training-data operators: tables, shared storage, hashing, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; bytes.split() splits at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process
    (tests) gets a folder of its own; a cluster has to name one, since its machines do not see each other's disks."""
    global _own_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dir


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors, and gives
    the optimizer a measured size, so that it broadcasts this side only when the size allows it."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch of texts, at most (but for one longer text).
MOST_ROWS, MOST_BYTES = 500, 4_000_000


def bounded_batches(spark: SparkSession, rows: int = MOST_ROWS, size: int = MOST_BYTES) -> None:
    """Lower the session's Arrow batches to so many rows and bytes: texts are long, and a batch of them is held by the JVM
    and again by the Python worker of each task. The session keeps this, since plans read it only when they run."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def release_memory() -> None:
    """Give memory that this worker has freed back to its machine: it is kept for other tasks, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over the batches of a task, with its memory given back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release_memory()

    return run


def blank_if_null(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def partitions_for(spark: SparkSession, mb: float, per_mb: float = 32) -> int:
    """Shuffle partitions for so many MB: never below the session's setting, and growing with the data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(mb / per_mb) + 1)


# --- hashing inside tasks -------------------------------------------------------------------------------------------

_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that low and high bits are both usable."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n consecutive values (none if there are fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    a = np.zeros(m, np.uint64)
    for j in range(n):
        a = a * BASE + h[j : j + m]
    return mixed(a)
