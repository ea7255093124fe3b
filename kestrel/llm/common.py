"""Helpers shared by the training-data operators.

Every operator selects the columns it needs by name, so extra columns of the
input (also ones whose names the operator uses internally) never reach it.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir, ensure_worker_path

#: Rows handled at once inside a task: bounds the Python objects alive, not the input.
SLICE_ROWS = 1024
#: UTF-8 bytes of text handled at once (a single longer text is its own slice).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_worker_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor sees."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, with a
    short lineage whose files survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of each step when it has ended, not with the driver's garbage. What
#: runs later (an iterator over a frame) must not read them any more: it is written first.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session has these settings inside, and its own ones again behind."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def buckets(spark: SparkSession) -> int:
    """Bits of the numbers of a shuffle's buckets."""
    return min(max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()), 16)


def discard(*frames: DataFrame) -> None:
    """Removes the folders of :func:`written` frames that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("llm-"):
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, most_rows: int = 0, most_bytes: int = 0) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice holds at most ``SLICE_ROWS`` rows and
    about ``SLICE_BYTES`` of the text in column number ``text`` (or as many as given).
    Order is kept. After the last slice, memory is given back."""
    most_rows, most_bytes = most_rows or SLICE_ROWS, most_bytes or SLICE_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + most_bytes, side="right"))
            to = min(max(to, at + 1), at + most_rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    give_back()


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Returns memory that nothing uses any more to the system. Workers live on through later
    steps, also such as run without Python, and would keep it beside what those need."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


_HOLDER: list = [None, None]


def hold(owner: str, release: Callable[[], None]) -> None:
    """Says that ``owner``'s tasks keep words in this worker from now on. What another
    operator has kept here is released, so a worker holds one such memory at a time."""
    if _HOLDER[0] not in (None, owner):
        _HOLDER[1]()
        give_back()
    _HOLDER[:] = owner, release


#: Unseen words whose values are computed at once: bounds the arrays of their n-grams.
NEW_WORDS = 16_384


class WordTable:
    """Values of words, computed in bulk for unseen words and kept per worker.

    ``compute(words) -> array (len(words), width)``. Memory is bounded: past
    ``limit`` words the table starts anew, which costs time, not results."""

    def __init__(self, width: int, compute: Callable[[list], np.ndarray], limit: int = 400_000,
                 dtype=np.float32):
        self.width, self.compute, self.limit, self.dtype = width, compute, limit, dtype
        self._reset()

    def _reset(self) -> None:
        self.slot: dict = {}
        self.values = np.zeros((1024, self.width), self.dtype)

    def slots(self, words: list) -> np.ndarray:
        """Row numbers in ``values`` of ``words`` (valid until the next call)."""
        new = [w for w in dict.fromkeys(words) if w not in self.slot]
        if new and len(self.slot) + len(new) > self.limit and self.slot:
            self._reset()
            new = list(dict.fromkeys(words))
        if new:
            at = len(self.slot)
            need = at + len(new)
            if need > len(self.values):
                grown = np.zeros((max(need, 2 * len(self.values)), self.width), self.dtype)
                grown[:at] = self.values[:at]
                self.values = grown
            for i in range(0, len(new), NEW_WORDS):
                some = new[i:i + NEW_WORDS]
                self.values[at + i:at + i + len(some)] = self.compute(some).reshape(len(some), self.width)
            self.slot.update(zip(new, range(at, need)))
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run sums to 0."""
    out = np.zeros((len(lengths),) + values.shape[1:], np.float64)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full] = np.add.reduceat(values.astype(np.float64, copy=False), starts, axis=0)
    return out


def ragged(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``words`` in one array, and each word's length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), lengths


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x


def ngram_hashes(words: list[bytes], sizes: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of each word (no n-gram crosses words).

    Returns (hashes, index of the word of each hash); in no special order."""
    data, lengths = ragged(words)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))   # bytes up to the word's end
    out, own = [], []
    wide = data.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * _MIX + wide[i:len(data) - n + 1 + i]
            ok = left[:len(data) - n + 1] >= n
            out.append(mixed(h[ok]))
            own.append(owner[:len(data) - n + 1][ok])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(own)
