"""Column-wise Burrows-Wheeler transform and common prefixes of many strings.

The strings are rows aligned in columns.  From the last column to the first,
one symbol of every string is inserted per round: the round's transform is the
column of symbols in the order of what follows them, and a stable sort of it
gives the order and the common prefixes of the next column.  Suffixes are
compared within a column only (a positional transform), so a round costs time
and memory in proportion to the strings, not to all suffixes so far; callers
align strings so that whatever may match stands in the same columns.

The columns wait in a sequential external file and are read once, in order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np


def write_columns(pieces: list[bytes], first: np.ndarray, width: int):
    """(file, type): the aligned symbols as small codes (0: none), last column
    first, in a temporary file that is gone when closed."""
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    kind = np.uint8 if len(used) < 256 else np.uint16    # UTF-8 has 243 different bytes
    code = np.zeros(256, kind)
    code[used] = np.arange(1, len(used) + 1)
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths - first, lengths)
    table = np.zeros((width, n), kind)
    table[width - 1 - column, row] = code[data]
    out = tempfile.TemporaryFile()
    table.tofile(out)
    out.seek(0)
    return out, kind


def _range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a:b]) for each a < b."""
    cuts = np.empty(2 * len(a), np.int64)
    cuts[::2], cuts[1::2] = a, b
    return np.minimum.reduceat(np.append(values, values.dtype.type(0)), cuts)[::2]


def columns(pieces: list[bytes], first: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column, last first: (column, rows in the order of their
    suffixes from that column, common prefix of each with the one before).
    A suffix ends where its string ends; strings may leave columns empty on
    either side, and an empty place matches nothing."""
    n = len(pieces)
    depth = np.uint8 if width < 256 else np.uint32
    order, lcp = np.arange(n), np.zeros(n, depth)
    file, kind = write_columns(pieces, first, width)
    with file:
        for column in range(width - 1, -1, -1):
            bwt = np.fromfile(file, kind, n)[order]
            by = np.argsort(bwt, kind="stable")
            symbol = bwt[by]
            deeper = np.zeros(n, depth)
            same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)) + 1
            deeper[same] = 1 + _range_min(lcp, by[same - 1] + 1, by[same] + 1)
            order, lcp = order[by], deeper
            yield column, order, lcp
