"""Shared helpers: scratch tables in the cluster's shared folder, and word hashing with numpy."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts, as a Java character class body and as bytes.
SPACE = r"\x20\x09-\x0D"
NOT_SPACE = f"[^{SPACE}]+"
_SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
IS_WORD = np.ones(256, bool)
IS_WORD[list(_SPACE_BYTES)] = False

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may do without."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _fallback:
        holder = tempfile.TemporaryDirectory(prefix="cladeframe-")
        atexit.register(holder.cleanup)
        _fallback.append(f"file://{holder.name}")
    return _fallback[0]


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive the loss of executors.

    Tables that the returned DataFrame still reads stay until the driver exits; drop() removes the others at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_remove_quietly, spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")


def _remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark._jsc is not None and spark._jsc.sc() is not None and not spark._jsc.sc().isStopped():
            _remove(spark, path)
    except Exception:  # the gateway may be gone while Python exits
        pass


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows that a Python function gets at once; an Arrow batch may have ten thousand long texts.
SLICE = 1000


def in_slices(run):
    """run for mapInArrow over slices of the batches; a worker gives memory back when its partition ends."""

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield batch.slice(at, SLICE)

    def wrapped(batches):
        try:
            yield from run(sliced(batches))
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Returns memory that Python no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- hashing

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 2**64)
_STEP = 1 << 18
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 2 * _STEP)
        both = []
        for base in (_MULT, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the maximal runs of word bytes."""
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = is_word[data]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand. Works in bounded pieces."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _STEP, "right")))
        piece = data[base : ends[to - 1]]
        power, inverse = _power_tables(len(piece))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * power[: len(piece)], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def hash_words(text: str | None, is_word: np.ndarray = IS_WORD) -> np.ndarray:
    """Hashes of the words of a text whose A-Z are lower-cased."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    return hash_spans(data, *word_bounds(data, is_word))


def stable_unit(*cols) -> F.Column:
    """A pseudorandom double in [0, 1) from the columns, the same on each run."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(1 << 53))
