"""Byte-level helpers that the operators run inside Arrow batches.

All of them work on a *chunk*: a list of UTF-8 byte strings of about half a megabyte in total, so that the memory of a
task does not depend on the number of documents. A document is never cut: one longer than the limit is a chunk alone.
White space is ASCII 9-13 and 32, as in ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
BATCH_ROWS = 2_048
BROADCAST_ROWS = 200_000  # of two whole numbers each, a few megabytes

_rng = np.random.default_rng(20240601)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """STEP**i (or its inverse) for i < n, modulo 2**64; kept and grown as needed."""
    key = "inv" if inverse else "pow"
    if key not in _pow or len(_pow[key]) < n:
        base = np.uint64(pow(int(STEP), -1, 1 << 64)) if inverse else STEP
        _pow[key] = _powers(base, max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1)))
    return _pow[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(items: list, texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Cut parallel lists into runs of at most ``limit`` bytes of text (one longer text makes a run of its own)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield items[lo:i], texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield items[lo:], texts[lo:]


class Chunk:
    """A chunk's bytes, one 10 after each document, with the words found in it.

    ``first[d]`` is the offset of document d; ``starts``/``ends`` bound the words, ``word_first[d]:word_first[d+1]``
    are those of document d. ``words`` are 64-bit hashes, of the A-Z lower-cased words if ``lower``.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        self.lens = np.fromiter(map(len, texts), np.int64, self.n)
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.first = np.concatenate(([0], np.cumsum(self.lens + 1)))
        a = LOWER[self.raw] if lower else self.raw
        space = SPACE[a]
        turn = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(a) and not space[0]:
            turn = np.concatenate(([0], turn))
        self.starts, self.ends = turn[0::2], turn[1::2]
        self.word_first = np.searchsorted(self.starts, self.first)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[a] * powers(len(a)))))
        self.words = self.span_hash(self.starts, self.ends)

    def span_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        return mix((self.prefix[hi] - self.prefix[lo]) * powers(len(self.raw) + 1, True)[lo] + (hi - lo).astype(np.uint64))

    @property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_first))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of every run of ``size`` words; a document of fewer words gives one run of all of them."""
        w, first = self.words, self.word_first
        n, count = len(w), np.diff(first)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size):
            total = total * SHINGLE_STEP + w[j : j + len(total)]
        doc = self.word_doc
        inside = doc[: len(total)] == doc[size - 1 :] if len(total) else np.zeros(0, bool)
        docs, out = [doc[: len(total)][inside]], [mix(total[inside])]
        for d in np.flatnonzero((count > 0) & (count < size)):
            h = np.uint64(count[d])
            with np.errstate(over="ignore"):
                for x in w[first[d] : first[d + 1]]:
                    h = h * SHINGLE_STEP + x
            docs.append(np.array([d]))
            out.append(mix(np.array([h ^ STEP], np.uint64)))
        return np.concatenate(docs), np.concatenate(out)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, hash, has a word) of every line, cut at 10 only."""
        end = np.flatnonzero(self.raw == 10)
        start = np.concatenate(([0], end[:-1] + 1))
        doc = np.searchsorted(self.first, start, "right") - 1
        n_words = np.searchsorted(self.starts, end) - np.searchsorted(self.starts, start)
        return doc, self.span_hash(start, end), n_words > 0


def repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (group, value): does the pair stand at an earlier place, and does it stand anywhere else."""
    order = np.lexsort((value, group))  # stable: places rise within equal pairs
    g, v = group[order], value[order]
    same = np.concatenate(([False], (g[1:] == g[:-1]) & (v[1:] == v[:-1]))) if len(g) else np.zeros(0, bool)
    earlier, anywhere = np.zeros(len(g), bool), np.zeros(len(g), bool)
    earlier[order] = same
    anywhere[order] = same | np.concatenate((same[1:], [False])) if len(g) else same
    return earlier, anywhere


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The text column as UTF-8 byte strings; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Unset, a temporary folder serves where all run on one machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file:///tmp/{os.environ.get('USER', 'spark')}-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs reuse it and survive lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_few(table: DataFrame) -> DataFrame:
    """Broadcast a written table of narrow rows if it has at most ``BROADCAST_ROWS``; otherwise Spark joins it by shuffling."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def drop_tables(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Delete tables made by ``written`` that no result depends on any more."""
    for t in tables:
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches, giving back to the system afterwards what the task had in memory: Python workers stay for
    the next tasks, and what they hold meanwhile counts for the executor. ``run`` gets at most ``BATCH_ROWS`` rows at a time, as
    texts of a whole batch of Spark's, taken out as Python objects, are some tens of megabytes a task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS))
        give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now, for the disk; it does so only once the driver
    collects garbage. Called once or twice in a query, after its largest shuffles."""
    gc.collect()
    spark._jvm.System.gc()
