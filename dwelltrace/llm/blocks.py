"""Blocks of documents and the packed columns they send each other.

Several operators gather documents into blocks of some megabytes, send one compact message per
block and bucket instead of one row per item, and join the answers back to the block. Both sides
of that join read the documents, so a block is named by a hash of what is in it: if the two
readings should differ, names do not meet and the join fails loudly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Some byte strings as one, compressed."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, "<u8", n, 8)).astype(int)
    return [raw[b:e] for b, e in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def planes(numbers: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones: packs better."""
    width = numbers.dtype.itemsize
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def arrow_batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[name for name, _ in fields]
    )


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches cut down, for texts may be long."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples."""
    for batch in in_slices(batches, 128):
        yield from zip(*(column.to_pylist() for column in batch.columns))


def in_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Rows that come sorted by a column, one list for each of its values."""
    group: list[tuple] = []
    for row in rows_of(batches):
        if group and row[key] != group[0][key]:
            yield group
            group = []
        group.append(row)
    if group:
        yield group
