"""What the text operators share: reading, recovery points, and numpy over the bytes of whole texts.

Texts reach Python as Arrow batches. ``chunks`` cuts a batch into runs of whole documents of a few MB, so that memory
depends on the longest document and not on the batch. A null text counts as empty throughout.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 21
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only where that is unset and the master is
    local, as in tests, one is made up."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="arbolex-"))
    return context.getCheckpointDir()


_made: dict[str, list[str]] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for a table between two steps. Results are lazy, so it stays until the session's
    folders are dropped: by ``drop_work`` once its results are no longer needed, or else when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(drop_work, spark)
    path = f"{shared_folder(spark)}/arbolex-{app}/{name}-{uuid.uuid4().hex}"
    _made[app].append(path)
    return path


def drop_work(spark: SparkSession) -> None:
    """Deletes the tables between steps that this session has written; what still reads them fails afterwards."""
    context = spark.sparkContext
    try:
        for path in _made.get(context.applicationId, []):
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        _made.get(context.applicationId, []).clear()
    except Exception:  # noqa: BLE001  (at the end of Python the session may be gone, and with it the way to its folders)
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and cuts its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once a session, so that they need not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="arbolex-")) / f"{package.name}.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def trim() -> None:
    """Gives free memory back to the system. Python workers live on from stage to stage, beside those of other tasks, and
    would keep what their largest step took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another libc
        pass


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class Chunk:
    """Whole documents: their row numbers within the batch, their bytes end to end, and where each begins and ends."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.rows)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a text column into runs of whole documents of at most ``limit`` bytes, or one longer document."""
    data, off = text_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield Chunk(range(lo, hi), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """Words of a chunk by byte position; those of document k are first[k] to first[k + 1] - 1."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def runs(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of true bytes; none crosses from one document into the next."""
    n = len(inside)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    at = offsets[:-1][offsets[:-1] < n]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[at] = inside[at]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = at[at > 0] - 1
    end[last] = inside[last]
    s = np.flatnonzero(start)
    return Words(s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets))


def words(chunk: Chunk) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~SPACE[chunk.data], chunk.offsets)


# Polynomial hashes modulo 2**64: an odd base has an inverse, so that a run's hash does not depend on where it stands.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _power(_BASE, len(values)), dtype=U64, out=out[1:])
    return out


def run_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs from start to end - 1 of the values summed in ``prefix``."""
    return mixed((prefix[end] - prefix[start]) * _power(_INVERSE, len(prefix))[start])


def word_hashes(chunk: Chunk, w: Words, table: np.ndarray = BYTE_VALUES) -> np.ndarray:
    return run_hashes(prefix_sums(table[chunk.data]), w.start, w.end)


def ngram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive values; len(values) - n + 1 of them, or none."""
    if len(values) < n:
        return np.zeros(0, U64)
    at = np.arange(len(values) - n + 1)
    return run_hashes(prefix_sums(values), at, at + n)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[k]:first[k + 1]]; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
