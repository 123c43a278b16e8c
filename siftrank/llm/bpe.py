"""Byte-level byte-pair encoding: pre-tokens, merging, and vocabulary files."""

import base64
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa

from siftrank.llm.words import row_slices, run_hashes

# White space as the pre-token pattern has it. A pre-token never
# reaches beyond such a piece, so pieces can be looked up as wholes.
_SPACE_CODES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
_SPACE_CODES += [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = "".join(map(chr, _SPACE_CODES))
PIECES = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER_SPACE = re.compile("|".join(chr(c) for c in _SPACE_CODES if c > 0x7F).encode())
_OTHER_SPACE_LEADS = np.zeros(256, dtype=bool)
_OTHER_SPACE_LEADS[[chr(c).encode()[0] for c in _SPACE_CODES if c > 0x7F]] = True
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[c for c in _SPACE_CODES if c < 0x80]] = True
_PIECE_SLICE = 1 << 20


def distinct_pieces(
    column: pa.Array,
) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """For each slice of a text column: its first row, the distinct pieces of its rows,
    which of them follow each other, and where each row's begin.

    Pieces are told apart by 64-bit numbers of their bytes.
    """
    for first, text, rows in row_slices(column, _PIECE_SLICE):
        if not len(text):
            yield first, [], np.empty(0, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
            continue
        starts = np.flatnonzero(_piece_starts(text, rows))
        numbers = run_hashes(text.astype(np.uint64) + np.uint64(1), starts)
        _, at, which = np.unique(numbers, return_index=True, return_inverse=True)
        ends = np.append(starts[1:], len(text))
        data = text.tobytes()
        spans = zip(starts[at].tolist(), ends[at].tolist(), strict=True)
        pieces = [data[a:b].decode() for a, b in spans]
        yield first, pieces, which, np.searchsorted(starts, rows)


def _piece_starts(text: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which bytes begin a piece: the pattern ``PIECES`` on all rows at once."""
    begins, ends = np.zeros((2, len(text)), dtype=bool)
    begins[rows[:-1][rows[:-1] < len(text)]] = True
    ends[rows[1:][rows[1:] > 0] - 1] = True
    space = _IS_SPACE[text]
    after_space, after_blank = np.zeros((2, len(text)), dtype=bool)
    after_space[1:] = space[:-1]
    after_blank[1:] = text[:-1] == 0x20
    after_space &= ~begins
    before_word = np.zeros(len(text), dtype=bool)
    before_word[:-1] = ~space[1:]
    before_word &= ~ends
    starts = begins | np.where(space, before_word | ~after_space, after_space & ~after_blank)
    # rows with white space beyond ASCII go by the pattern itself
    data = text.tobytes() if _OTHER_SPACE_LEADS[text].any() else b""
    hits = [m.start() for m in _OTHER_SPACE.finditer(data)]
    for row in np.unique(np.searchsorted(rows, hits, side="right") - 1):
        low, high = rows[row], rows[row + 1]
        starts[low:high] = False
        at = low
        for piece in PIECES.findall(data[low:high].decode()):
            starts[at] = True
            at += len(piece.encode())
    return starts


def gathered(
    values: np.ndarray, offsets: np.ndarray, order: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The lists that ``order`` names, one after the other, and where each ends."""
    lengths = (offsets[1:] - offsets[:-1])[order]
    ends = np.cumsum(lengths)
    index = np.arange(ends[-1] if len(ends) else 0)
    index += np.repeat(offsets[:-1][order] - (ends - lengths), lengths)
    return values[index], ends


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in .json vocabularies, by rule: printable
    ones for themselves, the others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_merges(path: str) -> list[tuple[bytes, bytes]]:
    """The merges of a .json vocabulary, best first."""
    with open(path, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    letters = _byte_letters()
    pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
    return [tuple(bytes(letters[c] for c in side) for side in pair) for pair in pairs]


def read_special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a .tiktoken vocabulary with their ids."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merged(word: bytes, rank) -> list[bytes]:
    """The symbols left of ``word`` after merging, lowest rank first, then leftmost.

    ``rank(left, right)`` is a pair's rank or None. Candidates wait in a heap; symbols
    are a linked list, in which a merge joins a symbol with its right neighbour.
    """
    n = len(word)
    symbols: list[bytes | None] = [word[k : k + 1] for k in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for k in range(n - 1):
        r = rank(symbols[k], symbols[k + 1])
        if r is not None:
            heap.append((r, k))
    heapify(heap)
    while heap:
        r, k = heappop(heap)
        left = symbols[k]
        if left is None or (right_at := after[k]) == n:
            continue
        if rank(left, symbols[right_at]) != r:
            continue
        symbols[k] = left = left + symbols[right_at]
        symbols[right_at] = None
        after[k] = follower = after[right_at]
        if follower < n:
            before[follower] = k
            if (r := rank(left, symbols[follower])) is not None:
                heappush(heap, (r, k))
        if (previous := before[k]) >= 0 and (r := rank(symbols[previous], left)) is not None:
            heappush(heap, (r, previous))
    return [s for s in symbols if s is not None]
