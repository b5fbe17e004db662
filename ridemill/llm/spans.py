"""Arrow string columns as flat numpy arrays: bytes, code points, words, ragged copies."""

from __future__ import annotations

import ctypes
import gc
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, SPACE, OTHER, UNSURE = 1, 2, 3, 0, 4
#: The code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def release() -> None:
    """Give memory back that earlier work of this Python worker has freed but its allocators still hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The reverse of ``flat``, without a copy of the bytes."""
    if pa.types.is_large_binary(kind) or pa.types.is_large_string(kind):
        offsets = offsets.astype(np.int64)
    else:
        offsets = offsets.astype(np.int32)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def slices(batch: pa.RecordBatch, text: str, most_bytes: int):
    """Runs of rows of at most ``most_bytes`` of text each (one row may exceed it)."""
    _, offsets = flat(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the byte position of each."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), np.arange(len(data), dtype=np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.uint32)
    many = np.flatnonzero(points >= 0xC0)
    lead, place = points[many], at[many]
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    value = lead & np.array([0, 0, 0x1F, 0x0F, 0x07], np.uint32)[size]
    for k in (1, 2, 3):
        more = size > k
        value[more] = value[more] << 6 | (data[place[more] + k] & 0x3F)
    points[many] = value
    return points, at


@cache
def classes() -> np.ndarray:
    """Letter, number, space or other for each code point.

    Classes that differ between an old and the present Unicode version are UNSURE: the
    tokenizer library may know them either way, so texts with them are left to it.
    """
    table = np.full(0x110000, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(0x20000):
        char = chr(point)
        major = unicodedata.category(char)[0]
        if old(char)[0] == major and old(char) != "Cn":
            table[point] = kinds.get(major, OTHER)
    table[0x180E] = UNSURE
    table[list(WHITE_SPACE)] = SPACE
    return table


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(point).isalpha() for point in range(0x110000)), bool, 0x110000)


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i] + sizes[i]``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run without ASCII white space, and the number of such runs per text."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = (data != 32) & ((data < 9) | (data > 13))
    begins = np.zeros(len(data) + 1, bool)
    begins[0] = True
    begins[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | begins[1:]
    starts = np.flatnonzero(start)
    end = np.ones(len(data) + 1, bool)
    end[:-1] = ~solid[1:] | begins[1:]
    end[-1] = False
    ends = np.flatnonzero(end & solid) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))
