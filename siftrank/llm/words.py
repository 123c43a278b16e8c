"""Words and shingles of texts as 64-bit numbers, for whole Arrow columns.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z
lower-cased. No byte of a longer UTF-8 character falls into these ranges, so
bytes give the same words as characters do. Columns are worked through in
slices of a few megabytes, cut between rows; a longer row is a slice by itself.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[0x41:0x5B] += np.uint64(0x20)
_FOLD += np.uint64(1)

# Odd multipliers, fixed so that equal words get equal numbers on all machines.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the information of each number over all of its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_slices(
    column: pa.Array, size: int = SLICE_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column: the first row, the bytes, and where each row's begin.

    The last array has one entry more than the slice has rows. A null is an empty text.
    """
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        text = data[offsets[first] : offsets[last]]
        yield first, text, offsets[first : last + 1] - offsets[first]
        first = last


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice: its first row, the words' numbers, and where each row's begin."""
    for first, text, rows in row_slices(column):
        yield first, *_slice_words(text, rows)


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each run of ``values`` that begins at one of ``starts``."""
    lengths = np.diff(np.append(starts, len(values)))
    power = np.cumprod(np.full(lengths.max(), _BASE, dtype=np.uint64))
    return mixed(
        np.add.reduceat(values * power[np.arange(len(values)) - np.repeat(starts, lengths)], starts)
    )


def _slice_words(text: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _WORD_BYTE[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = rows[:-1]
    ends = ends[ends < len(text)]
    begins[ends] |= inside[ends]
    at = np.searchsorted(np.flatnonzero(begins), rows)
    starts = np.flatnonzero(begins[inside])
    if not len(starts):
        return np.empty(0, dtype=np.uint64), at
    return run_hashes(_FOLD[text[inside]], starts), at


def row_shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles of one text.

    Fewer words make one shingle of them all, no words none.
    """
    if not len(words):
        return words
    n = min(n, len(words))
    size = len(words) - n + 1
    total = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        total += words[k : k + size] * _STEPS[k]
    return np.unique(mixed(total + np.uint64(n)))
