"""Words of whole texts as 64-bit hashes, a batch at a time, with numpy.

A word is a maximal run of characters other than space and \\x09-\\x0D, with A-Z lowered. In UTF-8 these bytes only
ever stand for themselves, so the work is done on bytes: a word's polynomial hash is a difference of prefix sums.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 20  # bytes worked on at once; a longer text is one slice of its own


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _series(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


BYTE = _series(256)
BYTE[ord("A"):ord("Z") + 1] = BYTE[ord("a"):ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
STEP = U(0xD1342543DE82EF95)
BACK = U(pow(int(STEP), -1, 1 << 64))
PLACE = _series(64) | U(1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 1), base, U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[name] = np.multiply.accumulate(steps)
        if n > 8 * SLICE:
            del _powers[name]  # not kept for the odd very long text
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def piece_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each raw[start:end], pieces in ascending order; capital letters count as small ones; never 0."""
    if not len(start):
        return np.zeros(0, U)
    low, n = start[0], int(end[-1] - start[0])
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE[raw[low:low + n]] * _power("step", STEP, n + 1)[:n], out=sums[1:])
        return mix((sums[end - low] - sums[start - low]) * _power("back", BACK, n + 1)[start - low]) | U(1)


class Words:
    """Words of a few texts: hash, text (index in the batch), start and end byte (in the slice's buffer)."""

    def __init__(self, first: int, last: int, raw: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.raw = first, last, raw
        n = len(raw)
        gap = SPACE[raw]
        edge = np.ones(n + 1, bool)
        edge[1:n] = gap[:-1]
        edge[offsets] = True  # a text's first byte follows a gap, and its last byte precedes one
        starts = np.flatnonzero(~gap & edge[:n])
        after = np.ones(n + 1, bool)
        after[:n] = gap
        after[offsets] = True
        ends = np.flatnonzero(~gap & after[1:]) + 1
        self.start, self.end = starts, ends
        self.text = np.searchsorted(offsets, starts, "right") - 1
        self.counts = np.bincount(self.text, minlength=last - first)
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, U)
            np.cumsum(BYTE[raw] * _power("step", STEP, n + 1)[:n], out=sums[1:])
            self.hash = mix((sums[ends] - sums[starts]) * _power("back", BACK, n + 1)[starts])

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        inside = np.flatnonzero(self.text[:n] == self.text[k - 1:])
        with np.errstate(over="ignore"):
            total = self.hash[:n] * PLACE[0]
            for j in range(1, k):
                total += self.hash[j:n + j] * PLACE[j]
            return inside, mix(total[inside])

    def shingle_sets(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(text, sorted distinct hashes of its runs of k words); a shorter text has its whole sequence as one."""
        first, hashes = self.runs(k)
        cuts = np.searchsorted(first, self.at)
        for i in range(self.last - self.first):
            own = hashes[cuts[i]:cuts[i + 1]]
            if len(own):
                own = np.sort(own)
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif self.counts[i]:
                with np.errstate(over="ignore"):
                    seq = self.hash[self.at[i]:self.at[i + 1]]
                    own = mix(np.sum(seq * PLACE[:len(seq)], keepdims=True, dtype=U) + U(len(seq)))
            yield self.first + i, own


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Words]:
    """Words of a string column, some texts at a time."""
    raw, at = text_bytes(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Words(i, j, raw[at[i]:at[j]], at[i:j + 1] - at[i])
        i = j
