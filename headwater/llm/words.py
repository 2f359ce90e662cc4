"""Words of whole text columns at once: bytes are classed by a table, Arrow numbers the words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP_BYTES = 1 << 21  # of text cut at once, but for a single longer one
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORD, SPACE, BREAK = 0, 1, 2


def classes(space: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte: part of a word, between words, or between pieces."""
    found = np.full(256, WORD, np.uint8)
    found[list(space)] = SPACE
    found[list(breaks)] = BREAK
    return found


def steps(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in portions of about STEP_BYTES of column `text`."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        portion = (np.cumsum(sizes) - sizes) // STEP_BYTES
        edges = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            if end > begin:
                yield batch.slice(begin, end - begin)


def cut(column: pa.Array, kinds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in them, row of each word, whether it begins a piece).

    A-Z are lower-cased; NULL texts have no words; no word or piece crosses rows.
    """
    column = pa.compute.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    edges = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = LOWER[np.frombuffer(body, np.uint8)[edges[0] : edges[-1]]] if body is not None else np.empty(0, np.uint8)
    edges = edges.astype(np.int64) - int(edges[0])
    kind = kinds[data]
    inside = kind == WORD
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = edges[:-1][edges[:-1] < len(data)]
    begins[first] = inside[first]
    at = np.flatnonzero(begins)
    if not len(at):
        return [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    before = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    offsets = np.append(before[at] - 1, before[-1]).astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = strings.dictionary_encode()
    row = np.searchsorted(edges, at, side="right") - 1
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = np.diff(row) > 0
    if (kind == BREAK).any():
        new[1:] |= np.diff(np.cumsum(kind == BREAK, dtype=before.dtype)[at]) > 0
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64), row, new
