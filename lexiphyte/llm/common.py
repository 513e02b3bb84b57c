"""Plumbing shared by the corpus operators: durable tables, text buffers and vectorised hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes, so that its temporaries stay near 100 MB.
SLICE_BYTES = 2 << 20
#: Rows of texts that Spark hands to Python at a time, and bytes of them after which workers give freed memory back.
BATCH_ROWS, GIVE_BACK_BYTES = 1_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where none is set."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        place = tempfile.mkdtemp(prefix="lexiphyte-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote and that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def frequent(words: DataFrame, column: str, most: int, size: int) -> Column:
    """A condition for the most frequent rows of ``words`` (by ``n``): at most ``most``, none over ``size`` bytes.

    Counts fall into classes of an eighth of an octave; only the classes' sizes come to the driver.
    """
    step, short = F.floor(F.log2("n") * 8).cast("int"), F.octet_length(column) <= size
    sizes = {r[0]: r[1] for r in words.where(short).groupBy(step.alias("s")).count().collect()}
    least, held = 10**6, 0
    for s in sorted(sizes, reverse=True):
        held += sizes[s]
        if held > most:
            break
        least = s
    return short & (step >= least)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made in here hand BATCH_ROWS rows at most to Python at a time: both sides of the pipe hold a batch of whole
    texts, twice while it grows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return memory that this process has freed to the system; its allocators would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their heaps and return what is free to the system; they would keep what earlier
    work made them grow to. As many tasks as there are cores, so that each idle executor gets some; no result depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """``run`` with freed memory given back between batches and at both ends: workers outlive tasks and stages, and what
    each of them keeps adds up within an executor."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = GIVE_BACK_BYTES
        for batch in batches:
            if seen >= GIVE_BACK_BYTES:
                give_back()
                seen = 0
            seen += batch.nbytes
            yield batch
            del batch

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(released(batches))
        give_back()

    return tidied


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer row stands alone and stays whole."""
    if not batch.num_rows:
        return
    _, ends = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20_11).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n modulo 2**64, and those of its inverse."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_class(kind: str) -> np.ndarray:
    """Which bytes belong to words: ``alnum`` (digits, a-z, all beyond ASCII) or ``solid`` (all but ASCII white space)."""
    b = np.arange(256)
    if kind == "solid":
        return ~((b == 32) | ((b >= 9) & (b <= 13)))
    return ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122)) | (b >= 128)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of every word and, for each row, the number of words before it."""
    m = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1] | edge[1:-1]
    last[:-1] &= ~m[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial over random byte weights by prefix sums, then mixed."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def words(data: np.ndarray, ends: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of the rows, and each row's first word (and, last, their number)."""
    data = lowered(data)
    starts, stops, row = word_bounds(data, ends, word_class(kind))
    return span_hashes(data, starts, stops), row


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row ends."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), pa.int32()), pa.array(values, kind))
