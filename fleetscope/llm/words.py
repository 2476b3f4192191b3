"""Words of byte texts as arrays: places and hashes, without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are held as numbers at once.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size, tables = max(n, SLICE + SLICE // 4), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size + 1, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers


class Words:
    """Words of some texts: runs of ASCII letters and digits and of bytes past
    ASCII, A-Z folded.  ``start`` and ``end`` are places in ``data``; ``text``
    is the number of the text; ``hash`` depends on the word's bytes only."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts).lower()
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.concatenate(([0], _IN_WORD[raw].view(np.int8), [0]))
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power_tables(len(raw) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)],
                                                                  dtype=np.uint64)))
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text = np.searchsorted(np.cumsum(sizes), self.start, side="right")

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (k - 1 fewer than words)."""
        return shingles(self.hash, k)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:n].copy()
    for i in range(1, k):
        h *= np.uint64(_BASE)
        h += hashes[i:n + i]
    return mix(h)


def parts(text: bytes, overlap: int, limit: int = SLICE) -> Iterator[tuple[bytes, int]]:
    """(part, number of its first word): a long text in parts that end between
    words and share ``overlap`` words with the part before."""
    at = first = 0
    while True:
        stop = at + limit
        while stop < len(text) and _IN_WORD[text[stop]] and _IN_WORD[text[stop - 1]]:
            stop += 1
        part = text[at:stop]
        yield part, first
        if stop >= len(text):
            return
        start = Words([part]).start
        keep = min(overlap, len(start) - 1) if len(start) else 0
        first += len(start) - keep
        at = at + int(start[-keep]) if keep else stop
