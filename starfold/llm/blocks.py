"""Blocks of an Arrow batch whose texts are some megabytes together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 500_000


def _valid(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def texts(batch: pa.RecordBatch, name: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """(rows, their texts as UTF-8 one after the other, where each text ends). Null is empty; a text is never split.

    Bytes that are not UTF-8 become replacement characters.
    """
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    whole = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        data, ends = bytes(whole[offsets[i] : offsets[j]]), offsets[i + 1 : j + 1] - offsets[i]
        if not _valid(data):
            parts = [bytes(whole[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace").encode() for k in range(i, j)]
            data, ends = b"".join(parts), np.cumsum([len(x) for x in parts])
        yield batch.slice(i, j - i), data, np.asarray(ends)
        i = j
