"""Record batches cut by the bytes of their texts, so that a task's memory does not depend on
how many rows Spark puts into a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Where each text starts in the data of its array, and where the last ends."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    found = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    return found[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def data_of(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts, one after another, and where each starts in them; no nulls."""
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return b"", offsets - offsets[0]
    return data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes(), offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have ``most`` bytes together, or that are a single row."""
    if not batch.num_rows:
        return
    ends = offsets_of(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last
