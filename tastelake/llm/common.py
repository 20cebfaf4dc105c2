"""Small helpers shared by the text operators: reading, Arrow slices, digests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task handles at once; longer single texts come alone.
SLICE_BYTES = 4 << 20
#: White space of the word contracts: blank and the control characters 9 to 13.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds Arrow batches by rows, as texts may be very long; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def texts(df: DataFrame) -> DataFrame:
    """doc_id and text only; a null text is empty."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def words(text: str = "text"):
    """Words of ``[^ \\t-\\r]+`` as an array, inside the JVM; null has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS, -1), "")


def lower_ascii(text: str = "text"):
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column`` (string, binary or list)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(column)
        ends = np.asarray(offsets_of(col))[1:]
        width = 8 if pa.types.is_list(col.type) else 1
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else int(offsets_of(col)[0])
            stop = int(np.searchsorted(ends, base + limit // width, side="right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(col: pa.Array) -> np.ndarray:
    """Offsets of a string, binary or list array, of its own rows only."""
    if pa.types.is_list(col.type):
        return np.asarray(col.offsets)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[col.offset : col.offset + len(col) + 1]


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and the n + 1 offsets from 0."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets_of(col).astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] places, one after another."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - counts), counts)
