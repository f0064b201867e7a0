"""Texts as runs of numbers, one run per distinct piece between separators, worked out once and kept.

The pieces of a block of texts are found, hashed and looked up by whole-array
operations; only pieces that were never seen are handed to ``learn``. A hash
only finds a candidate: the bytes of every piece are compared with those that
were learned, and what differs is learned on its own.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import threading
import time
from collections.abc import Callable

import numpy as np

from lexora.llm.common import spread

_BASE = 0x2545F4914F6CDD1D
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
BLOCK = 1 << 19  # bytes whose pieces are looked up at once
COMPARED = 1 << 14  # pieces whose bytes are compared at once


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n, or more, of an odd number modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        out, size = [], 1 << max(20, n.bit_length())
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.ones(size, np.uint64)
            step, filled = base, 1
            while filled < size:
                a[filled : 2 * filled] = a[:filled] * np.uint64(step)
                step, filled = step * step % (1 << 64), 2 * filled
            out.append(a)
        _POWERS[:] = [(out[0], out[1])]
    return _POWERS[0]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= up[: len(data)]
    np.cumsum(values, out=sums[1:])
    x = (sums[ends] - sums[starts]) * down[starts]
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


_HELD: dict[object, object] = {}
_LOCK = threading.RLock()


def held(key, make: Callable[[], object], idle: float | None = None):
    """make(), kept by the worker for the next task that asks for key; only one thing is kept, as workers go from stage to stage. idle: seconds without use after which it goes too."""
    with _LOCK:
        if key not in _HELD:
            _HELD.clear()
            gc.collect()  # what was kept may refer to itself
            _give_back()
            _HELD[key] = make()
            if idle is not None:
                threading.Thread(target=_watch, args=(key, idle, sys.getrefcount(_HELD[key])), daemon=True).start()
        return _HELD[key]


def _watch(key, idle: float, alone: int) -> None:
    """Lets go of what is kept under key when nothing else refers to it for so long."""
    used = time.monotonic()
    while True:
        time.sleep(idle / 4)
        with _LOCK:
            if key not in _HELD:
                return
            if sys.getrefcount(_HELD[key]) > alone:
                used = time.monotonic()
            elif time.monotonic() - used >= idle:
                _HELD.clear()
                gc.collect()
                _give_back()
                return


def _give_back() -> None:
    """Free memory goes back to the system, where the C library can do that."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


class _Growing:
    """An array that doubles."""

    def __init__(self, kind) -> None:
        self.values, self.used = np.zeros(1 << 12, kind), 0

    def add(self, new: np.ndarray) -> int:
        """The place of the first new value."""
        at = self.used
        if at + len(new) > len(self.values):
            grown = np.zeros(max(2 * len(self.values), at + len(new)), self.values.dtype)
            grown[:at] = self.values[:at]
            self.values = grown
        self.values[at : at + len(new)] = new
        self.used = at + len(new)
        return at


class HashIndex:
    """64-bit keys to numbers from 0, by open addressing on whole arrays."""

    def __init__(self, bits: int = 16) -> None:
        self.keys = _Growing(np.uint64)
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.slots = bits, np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[slot]
        known = self.keys.values
        wrong = np.flatnonzero((out >= 0) & (known[out] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (known[out[wrong]] != keys[wrong])]
        return out

    def _place(self, codes: np.ndarray) -> None:
        slot = (self.keys.values[codes] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(codes):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = codes[free]
            left = self.slots[slot] != codes
            codes, slot = codes[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of new, distinct keys."""
        codes = np.arange(len(keys), dtype=np.int32) + np.int32(self.keys.add(keys))
        if 2 * self.keys.used > 1 << self.bits:
            self._clear((4 * self.keys.used).bit_length())
            codes_all = np.arange(self.keys.used, dtype=np.int32)
            self._place(codes_all)
        else:
            self._place(codes)
        return codes


class PieceTable:
    """What ``learn`` gave for each distinct piece. learn: pieces (bytes) to (all numbers, how many each piece has). most: pieces kept before the table is emptied. frugal: free memory goes back after each batch, which takes some time."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind, separators: bytes = b" ", most: int = 500_000, frugal: bool = False) -> None:
        self.learn, self.kind, self.most, self.frugal = learn, kind, most, frugal
        self.separates = np.zeros(256, bool)
        self.separates[list(separators)] = True
        self.forget()

    def forget(self) -> None:
        self.index, self.flat, self.raw = HashIndex(), _Growing(self.kind), _Growing(np.uint8)
        self.at, self.size, self.raw_at, self.raw_size = _Growing(np.int64), _Growing(np.int32), _Growing(np.int64), _Growing(np.int32)

    def _store(self, pieces: list[bytes]) -> None:
        flat, sizes = self.learn(pieces)
        ends = np.cumsum(sizes)
        self.at.add(self.flat.add(flat) + ends - sizes), self.size.add(sizes)
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.raw_at.add(self.raw.add(np.frombuffer(b"".join(pieces), np.uint8)) + np.cumsum(lengths) - lengths), self.raw_size.add(lengths)

    def _codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = slice_hashes(data, starts, ends)
        codes = self.index.find(hashes)
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            if self.index.keys.used > self.most:
                self.forget()
                codes[:], missing = -1, np.arange(len(codes))
            _, first, own = np.unique(hashes[missing], return_index=True, return_inverse=True)
            new, raw = missing[first], data.tobytes()
            self._store([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            codes[missing] = self.index.add(hashes[new])[own]
        same = self._same(codes, data, starts, ends - starts)
        if same.all():
            return codes
        # equal hashes of different pieces
        raw, codes = data.tobytes(), codes.copy()
        for k in np.flatnonzero(~same).tolist():
            self._store([raw[starts[k] : ends[k]]])
            codes[k] = self.index.keys.add(np.array([0], np.uint64))  # in the arrays, but not to be found
        return codes

    def _same(self, codes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes that were learned for its code; some pieces at a time, as each byte takes two places."""
        same = lengths == self.raw_size.values[codes]
        for at in range(0, len(codes), COMPARED):
            own = at + np.flatnonzero(same[at : at + COMPARED])
            if len(own):
                n = lengths[own]
                differs = self.raw.values[spread(self.raw_at.values[codes[own]], n)] != data[spread(starts[own], n)]
                if differs.any():
                    same[own] = np.add.reduceat(differs, np.cumsum(n) - n) == 0
        return same

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts, how many each text has); texts must not be bound by more than their pieces."""
        if not texts:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        flat, sizes, at, held = [], [], 0, 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= BLOCK or k + 1 == len(texts):
                f, n = self._block(texts[at : k + 1])
                flat.append(f), sizes.append(n)
                at, held = k + 1, 0
        if self.frugal and sum(map(len, texts)) >= BLOCK:
            _give_back()
        return np.concatenate(flat), np.concatenate(sizes)

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        between = self.separates[data]
        inside = ~between
        starts = np.flatnonzero(inside & np.concatenate([[True], between[:-1]]))
        ends = np.flatnonzero(between & np.concatenate([[False], inside[:-1]]))
        begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
        bounds = np.searchsorted(starts, begin)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        # a long text is cut between pieces; each part is read before the table may be emptied
        cuts = np.unique(np.concatenate([np.searchsorted(starts, np.arange(0, len(data), BLOCK)), [len(starts)]])) if len(data) > 2 * BLOCK else np.array([0, len(starts)])
        flat, lengths = [], []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            base = starts[i]
            codes = self._codes(data[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base)
            n = self.size.values[codes].astype(np.int64)
            flat.append(self.flat.values[spread(self.at.values[codes], n)]), lengths.append(n)
        total = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])[bounds]
        return np.concatenate(flat), np.diff(total)
