"""Helpers that the corpus operators share: shared storage, Arrow batches, hash splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import written

#: Bytes that split words in the contracts ``[^\x20\x09-\x0D]+``.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    return written(df, label, keep, **options)


def attach(left: DataFrame, right: DataFrame, on: list[str], label: str, row_bytes: int | Column, most_bytes: int = 64 << 20, how: str = "left") -> DataFrame:
    """Join a small table that is written first: broadcast while its measured size stays below ``most_bytes``, shuffled beyond.

    ``row_bytes`` is what a row takes at most, or an expression of it where rows hold arrays or texts.
    """
    kept = materialise(right, label)
    size = kept.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes).alias("b")).first()["b"] or 0
    return left.join(F.broadcast(kept) if size <= most_bytes else kept, on, how)


def fresh_name(wanted: str, *frames: DataFrame) -> str:
    """A column name like ``wanted`` that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def crc_bucket(column: str | Column, modulus: int) -> Column:
    """crc32 of the value's decimal text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column) % modulus


def as_long(column: str) -> Column:
    return F.col(column).cast("long").alias(column)


def slices(batch: pa.RecordBatch, text: int = 1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about ``most`` bytes of text, one row at least: bounds a worker's memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def payloads(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, null as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i] - 1``, one after another."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
