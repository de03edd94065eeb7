"""Helpers that the operators share: inputs, the shared folder, Arrow batches, word caches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelnet.operators.settle import discard, new_path, remove, shared_dir, stored

__all__ = ["as_text", "batch_of", "discard", "in_order", "new_path", "parts_for", "release", "remove", "rows_of", "shared_dir", "slices", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(c: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def rows_of(batches: Iterable[pa.RecordBatch], *names: str, most_chars: int = 1 << 19) -> Iterator[list[tuple]]:
    """Lists of rows of about most_chars characters; the last name is the text column."""
    out, chars = [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                out.append(row)
                chars += len(row[-1] or "") + 64
                if chars >= most_chars:
                    yield out
                    out, chars = [], 0
    if out:
        yield out
    release()


def slices(batches: Iterable[pa.RecordBatch], text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most 256 rows, cut where they hold about most_bytes of text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(size):
            if i > at and (held + n > most_bytes or i - at == 256):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < len(size):
            yield batch.slice(at)


def release() -> None:
    """Give memory that a worker has freed back to the system; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def in_order(df: DataFrame, parts: int, *keys) -> DataFrame:
    """df range-partitioned and sorted by keys: partition k holds what comes before partition k + 1."""
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def parts_for(df: DataFrame, bytes_each: int = 32 << 20, most: int = 1 << 15, text: str = "text") -> int:
    """Partitions of about bytes_each bytes of text, at most `most` (larger ones then), from one aggregate over all rows."""
    total = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return min(most, max(1, -(-int(total) // bytes_each)))
