"""Reading tables, cutting lineage through the shared folder, and byte-level word scanning."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Fixed: the same characters, and the letters A to Z, for SQL translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that setting is absent and the session is local.

    On a cluster without that setting there is no folder that executors share, and this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            found = made.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            found = tempfile.mkdtemp(prefix="rasterloom-shared-")
            spark.sparkContext.setCheckpointDir(found)
    return found


#: Spark's setting to remove an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: what follows doesn't repeat what came before.

    The files outlive any executor and go when the application ends. What the write itself has shuffled goes with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch of rows on its way to Python; a batch holds one row at least.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let batches on their way to Python end at BATCH_BYTES, so that long texts don't come by the ten thousand.

    This lowers a setting of the session, spark.sql.execution.arrow.maxBytesPerBatch, unless it is lower already.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = float(now[:-1]) * scale[now[-1]] if now[-1:] in scale else float(now or 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(numbers: Column, join) -> Column:
    """The running sums (or the like, by join) of an array: each pass joins what stands twice as far back."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30)]), lambda step: step < F.size(numbers))
    return F.aggregate(steps, numbers, lambda sums, step: F.transform(sums, lambda x, i: F.when(i >= step, join(x, F.get(sums, i - step))).otherwise(x)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of two."""
    return mix(left * _ODD + right)


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    blank = IS_SPACE[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate(([0], edge))
    if len(data) and not blank[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: differences of a running polynomial sum, finalised with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers_upto(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return combine((total[ends] - total[starts]) * down[starts], (ends - starts).astype(np.uint64))


def batches_of(texts: list[bytes], limit: int):
    """Ranges of texts with about limit bytes each, one text at least."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > limit:
            yield first, k
            first, size = k, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a newline after each as one byte array, and the offset at which each begins (and the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return data, at
