"""What the training-data operators share: choosing columns, reading Arrow text, blocks of bounded size."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import ship_package

BLOCK_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def position(df: DataFrame, name: str) -> int:
    """Where a column stands: the exact spelling wins over one that differs in case, the first over repeats."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if same(c):
                return i
    raise ValueError(f"no column {name!r} among {df.columns}")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` (or less, if the session says so).

    A batch stands in memory several times: in the JVM's growing vectors, in the stream and
    in the Python worker. Spark's own bound of 64 MB fits one row of many megabytes, not
    thousands of ordinary texts per running task.
    """
    if size_in_bytes(spark.conf.get(BATCH_CONF, "64m")) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def size_in_bytes(text: str) -> int:
    """A size as Spark's settings write it ("64m", "67108864b"); unlimited ones are the largest."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", text.lower())
    size = int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else -1
    return size if size > 0 else 1 << 62


def by_position(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``_0``, ``_1``, ...: extra columns with clashing names
    never make a reference ambiguous."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **names: str) -> DataFrame:
    """``df`` cut down to ``new=old`` columns."""
    return by_position(df).select(*[F.col(f"_{position(df, old)}").alias(new) for new, old in names.items()])


def kept_rows(df: DataFrame, name: str, condition: Callable[[Column], Column]) -> DataFrame:
    """Rows of ``df``, with its columns as they are, whose column ``name`` meets ``condition``."""
    return by_position(df).where(condition(F.col(f"_{position(df, name)}"))).toDF(*df.columns)


def few_by_hash(df: DataFrame, *columns: str, count: int) -> DataFrame:
    """``count`` rows (all, if fewer) with the smallest hashes of ``columns``, ordered by them.

    Rows are thinned by the hash before they are sorted, so that all tasks together, and
    not each of them, send about that many to the driver.
    """
    share = min(1.0, (2 * count + 100) / max(df.count(), 1))
    hashed = df.withColumn("_hash", F.xxhash64(*columns))
    thin = hashed.where(F.pmod("_hash", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return thin.orderBy(F.pmod("_hash", F.lit(1 << 30)), "_hash").limit(count).drop("_hash")


def texts_of(column: pa.Array) -> Iterator[str]:
    """Python strings one at a time; null reads as empty."""
    for value in column:
        yield value.as_py() or ""


def byte_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive texts, about ``size`` bytes a block and one text at least.

    A null text has no bytes. The bytes are a view on Arrow's buffer where the layout allows it.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(int(np.searchsorted(at, at[start] + size, side="right")) - 1, start + 1)
        yield whole[at[start] : at[end]], at[start : end + 1] - at[start]
        start = end


class Memo:
    """Results by key in one Python worker; at most ``entries`` stay from block to block.

    A key that a later block asks for again is kept. Of those that one block only has asked
    for, the oldest make room: words that occur once do not keep out those that come back.
    """

    def __init__(self, entries: int) -> None:
        self.entries = entries
        self.of: dict[str, object] = {}
        self.once: dict[str, None] = {}  # learned, and not asked for since; oldest first

    def missing(self, asked: set[str]) -> set[str]:
        """The keys of a block that have to be learned."""
        once = self.once
        for key in [k for k in asked if k in once]:
            del once[key]
        new = asked.difference(self.of)
        if len(self.of) + len(new) > self.entries and 2 * len(new) > len(asked):
            self.of.clear()  # it fits these texts no more
            once.clear()
            return asked
        return new

    def learn(self, found: dict[str, object]) -> None:
        """Hold what was learned, all of it until ``settle``."""
        self.of.update(found)
        self.once.update(dict.fromkeys(found))

    def settle(self) -> None:
        """Make room again at the end of a block."""
        over = len(self.of) - self.entries
        if over > 0:
            for key in list(islice(self.once, max(over, len(self.once) // 2))):
                del self.once[key], self.of[key]


#: What operators keep in this Python worker from task to task, by operator, and how to let go of it.
_KEPT: dict[str, Callable[[], object]] = {}


def lean(run: Callable[[Iterator], Iterator], owner: str, drop: Callable[[], object] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, after which the worker gives its free memory back to the system.

    Workers live on and serve other operators. What those kept between tasks (``drop`` lets
    go of it) goes when this one starts; buffers that this one freed go when it ends.
    """

    def inner(batches: Iterator) -> Iterator:
        for other in [o for o in _KEPT if o != owner]:
            _KEPT.pop(other)()
        if drop is not None:
            _KEPT[owner] = drop
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    inner.__annotations__ = dict(getattr(run, "__annotations__", {}))
    return inner
