"""Whole texts as byte arrays: words, word hashes and shingles of many rows at once, with NumPy.

Every function takes the bytes of a block of rows and the row offsets into them, so one call
handles thousands of texts. A null text is an empty one. Memory is about 40 bytes for each byte
of a block; a block holds at least one whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: white space that ends a word where words are runs of anything else
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: letters, digits and everything beyond ASCII (after lower-casing)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each row into them; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, data = column.buffers()
    if raw is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (one row at least): first, end, bytes, offsets."""
    data, offsets = text_view(batch.column(column))
    low, rows = 0, len(batch)
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix; bytes count from 1 so that zeros are seen."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each row (one more: all words).

    ``word`` says for each byte value whether it belongs to a word. Words end with their row.
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges + 1]
    ends[edges - 1] = inside[edges]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, the same wherever the word stands."""
    total = prefix_hash(data)
    _, down = powers(len(data) + 1)
    return mixed((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the first shingle of each row.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    rows = len(first) - 1
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    total = np.zeros(len(words), np.uint64)
    short = np.repeat(counts < k, counts)
    left = np.repeat(first[1:], counts) - np.arange(len(words))  # words to the row's end
    step = np.uint64(1)
    for j in range(k):
        step = np.uint64((int(step) * int(BASE)) % (1 << 64))
        ahead = np.zeros(len(words), np.uint64)
        if len(words) > j:
            ahead[:len(words) - j] = words[j:]
        ahead[left <= j] = 0
        total += ahead * step
    keep = left >= k
    heads = np.flatnonzero((counts > 0) & (counts < k))
    keep[first[heads]] = True
    total[short] += np.uint64(0xD6E8FEB86659FD93) * np.minimum(left, k).astype(np.uint64)[short]
    assert rows == len(begin) - 1
    return mixed(total[keep]), begin
