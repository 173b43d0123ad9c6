"""Adaptive range coder of token ids, many blocks at a time.

Every block starts from nothing and is coded alone; numpy works on one id of each of many blocks at once. Three
predictions share a step's interval: the id seen last after the same two ids, the id seen last after the same one,
and the ids of the block so far by frequency, over a floor for unseen ids. The share of the first two follows their
confidence in this place and how often they came true in the block of late; the third has the rest.

A block is: number of ids (4 bytes), CRC-32 of the ids as 4-byte integers (4 bytes), 16-bit words of the code.
"""
from __future__ import annotations

import zlib

import numpy as np

LIMIT = 1 << 16  # ids are below this
ORDER1, ORDER2 = 10, 11  # bits of the tables of predictions
TOP = 7  # highest confidence
PACE = 32  # ids after which a block's weights follow its hits
WEIGHT = 512  # of an id seen, against 1 for each id of the floor
SHIFT = 9  # its logarithm
REFRESH = (64, 256, 1024)  # places where the order-0 sample is taken anew; then every SAMPLE ids
SAMPLE = 1024  # ids in it, at most
U = np.uint64
#: Odds of a prediction by its confidence, times how often its order came true of late.
ODDS1 = np.array([0.02, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0])
ODDS2 = np.array([0.02, 1.0, 3.0, 6.0, 10.0, 16.0, 24.0, 40.0])
_NEXT = np.array([1] * 8 + [2, 3, 4, 5, 6, 7, 7, 7], np.int32)  # confidence after a miss, after a hit
_IDS = np.arange(LIMIT, dtype=np.int64)
_H1 = (_IDS * 40503 >> 4) & ((1 << ORDER1) - 1)
_H2 = (_IDS * 60493 >> 5) & ((1 << ORDER2) - 1)
_H2_BEFORE = (_IDS * 48271 >> 3) & ((1 << ORDER2) - 1)


class _Model:
    """Predictions and their weights, a row for each block. An entry is an id and its confidence."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.base1, self.base2, self.rows = lane << ORDER1, lane << ORDER2, lane * (TOP + 1)
        self.of1 = np.zeros(lanes << ORDER1, np.int32)
        self.of2 = np.zeros(lanes << ORDER2, np.int32)
        self.hits1 = np.zeros(lanes, np.int64)
        self.hits2 = np.zeros(lanes, np.int64)
        self.true1 = np.full(lanes, 0.25)
        self.true2 = np.full(lanes, 0.25)
        self.h1 = np.zeros(lanes, np.int64)
        self.h2 = np.zeros(lanes, np.int64)
        self.next2 = np.zeros(lanes, np.int64)
        self.steps = 0
        self.seen(0)

    def seen(self, sample: int) -> None:
        """The order-0 sample has so many ids now."""
        self.floor = LIMIT + WEIGHT * sample  # mass of order 0
        self.weigh()

    def weigh(self) -> None:
        """Mass of a prediction by block and confidence."""
        self.mass1 = (np.outer(self.true1, ODDS1 * self.floor).astype(np.int64) + 1).ravel()
        self.mass2 = (np.outer(self.true2, ODDS2 * self.floor).astype(np.int64) + 1).ravel()

    def predict(self, k: int):
        """(id after two, its mass, id after one, its mass) for the first k blocks."""
        self.at1 = self.base1[:k] + self.h1[:k]
        self.at2 = self.base2[:k] + self.h2[:k]
        v1, v2 = self.of1.take(self.at1), self.of2.take(self.at2)
        self.c1, self.c2 = v1 & TOP, v2 & TOP
        return (v2 >> 3, self.mass2.take(self.rows[:k] + self.c2), v1 >> 3, self.mass1.take(self.rows[:k] + self.c1))

    def learn(self, k: int, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        entry = x << 3
        self.of2[self.at2] = entry + _NEXT.take(self.c2 + hit2 * 8)
        self.of1[self.at1] = entry + _NEXT.take(self.c1 + hit1 * 8)
        self.hits2[:k] += hit2
        self.hits1[:k] += hit1
        self.h2[:k] = self.next2[:k] ^ _H2.take(x)
        self.next2 = _H2_BEFORE.take(x)
        self.h1[:k] = _H1.take(x)
        self.steps += 1
        if self.steps % PACE == 0:
            for true, hits in ((self.true1, self.hits1), (self.true2, self.hits2)):
                true += (hits / PACE - true) / 2
                hits[:] = 0
            self.weigh()


def _sorted_sample(ids: np.ndarray, upto: int) -> np.ndarray:
    return np.sort(ids[:, max(0, upto - SAMPLE):upto], axis=1)


def _segments(longest: int):
    cuts = [0, *(r for r in REFRESH if r < longest), *range(REFRESH[-1] + SAMPLE, longest, SAMPLE)]
    return list(zip(cuts, [*cuts[1:], longest])) if longest else []


def _lanes(sizes: list[int]):
    """(order, sizes in that order, blocks longer than each place): longest first, so active blocks come first."""
    size = np.array(sizes)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    return order, size, np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded form of each block of ids."""
    if not blocks:
        return []
    order, size, active = _lanes([len(b) for b in blocks])
    lanes, longest = len(blocks), len(active)
    ids = np.zeros((lanes, longest), np.int32)
    for row, b in enumerate(order):
        ids[row, :size[row]] = blocks[b]
    model = _Model(lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    width = 2 * longest + 8
    out = np.zeros(lanes * width, np.uint16)
    used = np.arange(lanes) * width

    def emit(rows):
        was = low[rows]
        out[used[rows]] = was >> U(48)
        used[rows] += 1
        low[rows] = was << U(16)
        span[rows] <<= U(16)

    def carry(rows):
        at = used[rows] - 1
        while len(at):
            out[at] += np.uint16(1)
            at = at[out[at] == 0] - 1

    for a, b in _segments(longest):
        k0 = int(active[a])
        part = ids[:k0, a:b]
        sample = _sorted_sample(ids[:k0], a)
        n = sample.shape[1]
        if n:  # ids of the sample below this one, and times it is there
            row = np.arange(k0, dtype=np.int32)[:, None]
            flat = (row * LIMIT + sample).ravel()
            key = (row * LIMIT + part).ravel()
            left = np.searchsorted(flat, key)
            runs = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            length = np.zeros(len(flat) + 1, np.int32)
            length[runs] = np.diff(np.append(runs, len(flat)))
            seen = length[left] * (np.append(flat, -1)[left] == key)
            cum0 = (left.reshape(part.shape) - row * n) * WEIGHT + part
            freq0 = seen.reshape(part.shape) * WEIGHT + 1
            del flat, key, left, seen, runs, length
        else:
            cum0, freq0 = part, np.ones_like(part)
        cum0, freq0 = np.ascontiguousarray(cum0.T, np.int32), np.ascontiguousarray(freq0.T, np.int32)
        part = np.ascontiguousarray(part.T)
        model.seen(n)
        for i in range(b - a):
            k = int(active[a + i])
            x = part[i, :k]
            g2, m2, g1, m1 = model.predict(k)
            hit2, hit1 = g2 == x, g1 == x
            both = m1 + m2
            cum = np.where(hit2, 0, np.where(hit1, m2, both + cum0[i, :k]))
            freq = np.where(hit2, m2, np.where(hit1, m1, freq0[i, :k]))
            step = span[:k] // (both + model.floor).view(U)
            old = low[:k].copy()
            now = old + step * cum.view(U)
            low[:k] = now
            span[:k] = step = step * freq.view(U)
            over = (now < old).nonzero()[0]
            if len(over):
                carry(over)
            rows = (step < U(1 << 48)).nonzero()[0]
            while len(rows):
                emit(rows)
                rows = rows[span[rows] < U(1 << 48)]
            model.learn(k, x, hit2, hit1)
    lane = np.arange(lanes)
    for _ in range(4):
        emit(lane)
    coded: list[bytes] = [b""] * lanes
    for row, b in enumerate(order):
        own = ids[row, :size[row]].astype("<u4").tobytes()
        coded[b] = (len(own) // 4).to_bytes(4, "little") + zlib.crc32(own).to_bytes(4, "little") + \
            out[row * width:used[row]].astype("<u2").tobytes()
    return coded


class _Inverse:
    """Finds the id of an order-0 code. Each id of the sorted sample has WEIGHT codes of its own and the floor one for
    each id, so a table by WEIGHT codes is off by one at most."""

    def __init__(self, sample: np.ndarray):
        k, self.n = sample.shape
        n = self.n
        if not n:
            return
        self.flat = sample.ravel()
        ends = sample.astype(np.int64) + WEIGHT * np.arange(1, n + 1) + 1  # first code after each id
        self.cells = (LIMIT >> SHIFT) + n + 1
        cell = (ends + (WEIGHT - 1)) >> SHIFT
        counts = np.bincount((cell + np.arange(k)[:, None] * (self.cells + 1)).ravel(),
                             minlength=k * (self.cells + 1)).reshape(k, -1)
        self.table = np.cumsum(counts, axis=1, dtype=np.int32).ravel()
        self.ends = np.append(ends.ravel(), 1 << 40)
        edge = np.ones((k, n), bool)
        edge[:, 1:] = sample[:, 1:] != sample[:, :-1]
        first = np.maximum.accumulate(np.where(edge, np.arange(n, dtype=np.int32), 0), axis=1)
        after = np.full((k, n), n, np.int32)
        after[:, :-1] = np.minimum.accumulate(np.where(edge, np.arange(n, dtype=np.int32), n)[:, ::-1], axis=1)[:, ::-1][:, 1:]
        self.first, self.length = first.ravel(), (after - first).ravel()

    def find(self, rows: np.ndarray, t: np.ndarray):
        """(id, first code, number of codes)."""
        n = self.n
        if not n:
            return t, t, np.ones_like(t)
        j = self.table.take(rows * (self.cells + 1) + (t >> SHIFT)).astype(np.int64)
        base = rows * n
        more = (self.ends.take(base + j) <= t) & (j < n)
        j += more
        sits = base + np.minimum(j, n - 1)
        own = self.flat.take(sits)
        start = self.first.take(sits).astype(np.int64) * WEIGHT + own
        inside = (j < n) & (t >= start)
        return (np.where(inside, own, t - WEIGHT * j), np.where(inside, start, t),
                np.where(inside, WEIGHT * self.length.take(sits) + 1, 1))


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that does not have its checksum is an error."""
    if not coded:
        return []
    order, size, active = _lanes([int.from_bytes(c[:4], "little") for c in coded])
    lanes, longest = len(coded), len(active)
    words = [np.frombuffer(c, "<u2", offset=8) for c in coded]
    width = max(len(w) for w in words) + 8
    code = np.zeros((lanes, width), np.uint16)
    for row, b in enumerate(order):
        code[row, :len(words[b])] = words[b]
    code = code.ravel()
    model = _Model(lanes)
    at = np.arange(lanes) * width
    value, span = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    for _ in range(4):
        value = (value << U(16)) | code[at]
        at += 1
    ids = np.zeros((longest, lanes), np.int32)
    for a, b in _segments(longest):
        k0 = int(active[a])
        inverse = _Inverse(_sorted_sample(np.ascontiguousarray(ids[max(0, a - SAMPLE):a, :k0].T), a - max(0, a - SAMPLE)))
        model.seen(inverse.n)
        for i in range(a, b):
            k = int(active[i])
            g2, m2, g1, m1 = model.predict(k)
            both = m1 + m2
            total = (both + model.floor).view(U)
            step = span[:k] // total
            t = np.minimum(value[:k] // step, total - U(1)).view(np.int64)
            hit2 = t < m2
            x = np.where(hit2, g2, g1)
            cum = np.where(hit2, 0, m2)
            freq = np.where(hit2, m2, m1)
            rest = (t >= both).nonzero()[0]
            if len(rest):
                x0, cum0, freq0 = inverse.find(rest, t[rest] - both[rest])
                x[rest] = x0
                cum[rest] = both[rest] + cum0
                freq[rest] = freq0
            value[:k] -= step * cum.view(U)
            span[:k] = step = step * freq.view(U)
            rows = (step < U(1 << 48)).nonzero()[0]
            while len(rows):
                places = at[rows]
                value[rows] = (value[rows] << U(16)) | code[places]
                at[rows] = places + 1
                now = span[rows] << U(16)
                span[rows] = now
                rows = rows[now < U(1 << 48)]
            ids[i, :k] = x
            model.learn(k, x, g2 == x, g1 == x)
    rows = np.ascontiguousarray(ids.T)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for row, b in enumerate(order):
        own = rows[row, :size[row]].astype("<u4")
        if zlib.crc32(own.tobytes()) != int.from_bytes(coded[b][4:8], "little"):
            raise ValueError("a block does not have its checksum")
        out[b] = own
    return out
