"""Texts of Arrow batches as flat bytes, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text handled together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def sliced(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes in a text column, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < len(size):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts (null: empty), and where each text begins, with the end."""
    whole = pc.fill_null(texts, pa.scalar("", texts.type)).cast(pa.large_binary())
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = whole.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def strings(raw: np.ndarray, at: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``flat``; marked texts become null."""
    mask = None if missing is None or not missing.any() else pa.array(~missing).buffers()[1]
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)), mask)


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in added}
    return pa.RecordBatch.from_pydict(kept | added)


def map_frames(df: DataFrame, column: str, rows: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType, limit: int = 4 * BLOCK_BYTES) -> DataFrame:
    """As ``mapInPandas``, but frames hold at most ``limit`` bytes in a column (or one row), however many rows a batch has."""
    arrow = to_arrow_schema(schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in rows(part.to_pandas() for batch in batches for part in sliced(batch, column, limit)):
            yield pa.RecordBatch.from_pandas(frame, arrow, preserve_index=False)

    return df.mapInArrow(mapped, schema)


def map_slices(df: DataFrame, column: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, pa.Array]]], added: StructType, limit: int = BLOCK_BYTES) -> DataFrame:
    """df with columns that ``rows`` makes of slices of at most ``limit`` bytes in a column; they replace those of their names."""
    kept = df.drop(*added.names)
    schema = StructType(kept.schema.fields + added.fields)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sliced(batch, column, limit):
                    held.append(part)
                    yield part

        for made in rows(parts()):
            yield with_columns(held.pop(), made).select(schema.names)

    return kept.mapInArrow(mapped, schema)
