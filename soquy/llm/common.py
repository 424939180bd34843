"""What several corpus operators share: tables on the way, text bytes, rolling hashes.

Everything here works on whole batches of texts with numpy; Spark deals the batches.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 18
"""Texts are hashed in chunks of about so many bytes; a longer text is a chunk of its own."""


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names that folder; where it is unset, the warehouse,
    which a cluster shares as well, takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts the lineage, and what was
    written survives the loss of any executor."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables on the way to a result. ``clear`` removes their files once the result is itself stored,
    so that steps in a row do not pile up what they no longer need."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame) -> DataFrame:
        self.tables.append(stored(df))
        return self.tables[-1]

    def clear(self) -> None:
        for table in self.tables:
            spark, files = table.sparkSession, table.inputFiles()
            if files:
                folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.tables = []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that few texts are held twice."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Returns to the system what this process has freed; workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(run: Callable) -> Callable:
    """A task function over batches that gives memory back before it begins and once it has ended."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [first, end) of texts of about ``limit`` bytes together."""
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if k > first and total + size > limit:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9DDFEA08EB382D69
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, np.uint64), BASE_INVERSE: np.ones(1, np.uint64)}


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64."""
    have = _powers[base]
    if len(have) < count:
        steps = np.full(max(count, 2 * len(have)), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:count]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte value times base**position, one longer than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal bytes have equal hashes wherever they stand."""
    raw = (prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, len(prefix))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[0::2], edges[1::2]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as disjoint ranges in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def words(texts: list[bytes], word_bytes: np.ndarray):
    """The words of several texts: their hashes, bounds in the joined bytes, and the number of the
    text each belongs to. ``word_bytes`` has 256 booleans; A-Z count as a-z."""
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    starts, ends = spans(word_bytes[data])
    hashed = span_hashes(prefix_hashes(data), starts, ends)
    return hashed, starts, ends, np.searchsorted(ends_of_text, starts, side="right")


def hidden(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns on the way that no column of the frame has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
