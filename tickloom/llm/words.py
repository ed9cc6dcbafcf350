"""Exact word numbers within a block of texts, and pieces of a block put together again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tickloom.llm.bytetext import word_hashes


def ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges ``start .. start + size - 1`` in order, and the range of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ahead = np.cumsum(sizes) - sizes
    return np.arange(len(owner)) - ahead[owner] + starts[owner], owner


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word, equal for equal words only, and one place of each number.

    Words are told apart by 64-bit hashes, which are then held against the bytes; if two words
    share a hash, numbers come from the bytes themselves.
    """
    hashes = word_hashes(data, starts, ends)
    _, lead, ids = np.unique(hashes, return_index=True, return_inverse=True)
    sizes, first = ends - starts, starts[lead[ids]]
    same = np.array_equal(sizes, sizes[lead[ids]])
    if same:
        at, owner = ranges(starts, sizes)
        same = np.array_equal(data[at], data[at + (first - starts)[owner]])
    if same:
        return ids, lead
    table: dict[bytes, int] = {}
    lead, out = [], np.empty(len(starts), np.int64)
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        word = data[s:e].tobytes()
        if word not in table:
            table[word] = len(lead)
            lead.append(i)
        out[i] = table[word]
    return out, np.array(lead, np.int64)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, gap: bytes = b"") -> np.ndarray:
    """The given pieces of ``data`` one after the other, each followed by ``gap``."""
    step = sizes + len(gap)
    at, owner = ranges(starts, sizes)
    place = np.cumsum(step) - step
    out = np.zeros(int(step.sum()), np.uint8)
    out[at - starts[owner] + place[owner]] = data[at]
    for i, byte in enumerate(gap):
        out[place + sizes + i] = byte
    return out


def strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The given pieces of ``data`` as a string column."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(
        len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(gathered(data, starts, sizes).tobytes())
    ).cast(pa.string())
