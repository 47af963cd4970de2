"""What the operators of this subpackage share: tables, staged results and rolling word hashes."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators, so that ids stay 64-bit integers in Arrow batches; results carry null again.
NULL_ID = -(2**63)

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 2**64)
_RNG = np.random.default_rng(20240501)
#: A random 64-bit value for each byte.
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Bytes of a row group of a written table, which a task holds until it is full.
ROW_GROUP = 16 << 20
#: Bytes of a batch of rows on its way to Python: an executor holds several at once, outside its heap, and texts may be long.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package (elsewhere it is installed or sent with --py-files), in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    env.setdefault("PYTHONPATH", root)


def trimmed(batches: Iterator) -> Iterator:
    """The batches, and after the last one free memory back to the system: Python workers outlive a task, and an executor has several."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # of the GNU C library
            ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only where it is unset and all run in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        at = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        shared_dir.own = at
    return at


_scratch: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go at the end, but for those kept, on which what is returned must rest alone."""
    folder = f"{shared_dir(spark)}/skyloom-{uuid.uuid4().hex}"
    token = _scratch.set((*_scratch.get(), folder))
    try:
        yield
    finally:
        _scratch.reset(token)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, at: str | None = None, keep: bool = False) -> DataFrame:
    """Write df to a table in the shared folder and read it again: lineage ends here, and lost executors cost no recomputation.

    keep: the table outlives the innermost scratch().
    """
    spark = df.sparkSession
    folders = _scratch.get()[:-1] if keep else _scratch.get()
    path = at or f"{folders[-1] if folders else shared_dir(spark)}/skyloom-{uuid.uuid4().hex}/{name}"
    df.write.mode("error").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = 1000) -> DataFrame:
    """left joined with right, whose keys come once, without a task that gets all rows of a frequent key. left is a written table.

    Keys with over a quarter of a partition's share of left, of which there are at most four for each partition, meet right by
    broadcast of their rows; all other rows meet it by a shuffle.
    """
    most = max(least, left.count() // (4 * partitions(left.sparkSession)))
    hot = left.groupBy(key).count().where(F.col("count") > most).select(F.col(key).alias("_hot"))
    # four keys for each partition at most; from Arrow: rows would start Python workers of another kind beside those of the operators
    hot = left.sparkSession.createDataFrame(hot.toArrow(), hot.schema)
    few = F.broadcast(right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_semi"))
    rest = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_anti").join(right.hint("merge"), key, how)
    often = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_semi").join(few, key, how)
    return rest.unionByName(often)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_in(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_out(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long, never null), text (never null) and the columns named; other columns play no part."""
    return docs.select(id_in("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pow(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_MULT, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the words joined by single spaces, and the byte at which each word begins."""
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.append(gaps, len(raw))
    power, inverse = _pow(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=run[1:])
    return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(_MULT)
        h += words[j : j + n]
    return mix(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x
