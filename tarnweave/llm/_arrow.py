"""Text columns as flat byte arrays, for numpy steps inside Spark tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes that one numpy step works on at most; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


#: Rows of an Arrow batch of long texts.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` in a session of its own that sends ``BATCH_ROWS`` texts at once to Python, for each batch is held several times over.

    All other settings are the caller's, whose own session stays as it is.
    """
    spark, name = df.sparkSession, f"texts_{uuid.uuid4().hex}"
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.createGlobalTempView(name)
    try:
        return own.table(f"{own.conf.get('spark.sql.globalTempDatabase')}.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def release() -> None:
    """Give the memory of a task that is done back; its worker waits for the next task meanwhile."""
    pa.default_memory_pool().release_unused()


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets as int64) of a string or binary column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    start, n = column.offset, len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[start : start + n + 1] if n else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, but of one row at least."""
    n, a = len(bounds) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def ascii_lower(flat: np.ndarray) -> np.ndarray:
    """A copy with A-Z made a-z, other bytes as they are."""
    return flat + (((flat >= 65) & (flat <= 90)).astype(np.uint8) << 5)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values, so that all bits of a key count."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
