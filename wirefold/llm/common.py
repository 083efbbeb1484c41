"""Shared helpers of the training-data operators: bounded batches, tables, scratch space, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.session import _monkey_patch_RDD

#: Texts are hashed in blocks of about this many bytes (one text may exceed it).
BLOCK_BYTES = 1 << 20

#: How rows of whole texts travel: few rows in a vector of the Parquet reader (its buffers grow with the longest texts and
#: stay), and Arrow batches bounded by bytes (one row may exceed it).
BOUNDS = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_MARK = "spark.wirefold.bounded"


def text_session(spark: SparkSession) -> SparkSession:
    """A copy of the session, with its settings, that reads texts in bounded batches; the session itself is not changed."""
    if spark.conf.get(_MARK, None):
        return spark
    out = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    _monkey_patch_RDD(spark)  # RDD.toDF stays with the caller's session
    for k, v in BOUNDS.items():
        out.conf.set(k, v)
    out.conf.set(_MARK, "true")
    return out


def settle(spark: SparkSession) -> None:
    """Give the session itself the bounds that it has no settings for: for a program whose session handles whole texts only.

    A frame keeps the reader settings of the session that made it, so a program
    that hands its own frames to the operators calls this.
    """
    own = spark.conf.getAll
    for k, v in BOUNDS.items():
        if k not in own:
            spark.conf.set(k, v)


def bounded(df: DataFrame) -> DataFrame:
    """The same frame in a ``text_session`` of its session."""
    spark = text_session(df.sparkSession)
    if spark is df.sparkSession:
        return df
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over bounded batches; a worker gives its free memory back when a task ends."""

    def tidy(batches):
        yield from run(batches)
        _give_back()

    return bounded(df).mapInArrow(tidy, schema)


def _give_back() -> None:
    """Workers live on from stage to stage: what a task has freed returns to the system (where the C library can be told)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


class Scratch:
    """A folder of intermediate tables in the store that all executors share.

    The place is ``spark.checkpoint.dir`` of the session.  Where that is unset,
    a session in one process (a local test) uses a temporary folder of this
    machine; a cluster is an error, as its executors would not see each other's
    files.  What is written there survives the loss of any executor.  ``drop``
    deletes a table early; the rest goes when the Python process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = text_session(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="wirefold-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        self.root = f"{base.rstrip('/')}/wirefold-{label}-{uuid.uuid4().hex[:12]}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads the written table."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(self.path(name)), True)

    def release(self) -> None:
        """Let Spark delete shuffle files of finished steps now, not when the driver next happens to collect garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _close(self) -> None:
        try:
            self._fs.delete(self._path(self.root), True)
        except Exception:  # the JVM may be gone by now
            pass


def blocks(values: list, size_of, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``values`` whose sizes sum to about ``limit``."""
    start = held = 0
    for i, v in enumerate(values):
        n = size_of(v)
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(values):
        yield start, len(values)


# --- word and shingle hashes -------------------------------------------------

_U = np.uint64
_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_ROLE = (_RNG.randint(0, 2**63, 16, dtype=np.int64).astype(_U) << _U(1)) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POW = np.ones(1, _U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.cumprod(np.concatenate([np.ones(1, _U), np.full(max(n, 64) * 2, _STEP, _U)]))
    return _POW[:n]


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased (bytes.lower touches nothing else)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+` in order, and each text's number of words."""
    if not texts:
        return np.empty(0, _U), np.empty(0, np.int64)
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    # a word starts where a non-space follows a space or the start
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.empty(0, _U), np.zeros(len(texts), np.int64)
    body = np.flatnonzero(~space)
    stops = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    sizes = stops - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    within = np.arange(len(body)) - np.repeat(first, sizes)
    terms = _BYTE[raw[body]] * _powers(int(sizes.max()))[within]
    hashes = mix(np.add.reduceat(terms, first) + sizes.astype(_U) * _STEP)
    at = np.searchsorted(starts, ends)
    return hashes, np.diff(np.concatenate([[0], at]))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; order counts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    total = np.zeros(n, _U)
    for j in range(width):
        total += mix(words[j : j + n] + _ROLE[j]) * _ROLE[(j + 7) % 16]
    return mix(total)


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Of each text its sorted distinct shingle hashes.

    A text of fewer than ``width`` words has its whole sequence as one shingle;
    a text without words has the empty set.
    """
    for lo, hi in blocks(texts, len):
        words, counts = word_hashes(texts[lo:hi])
        grams = window_hashes(words, width)
        at = 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(grams[at : at + n - width + 1])
            elif n:
                own = words[at : at + n]
                yield mix((mix(own + _ROLE[:n]) * _ROLE[8 : 8 + n]).sum(keepdims=True) + _ROLE[n : n + 1])
            else:
                yield np.empty(0, _U)
            at += n
