"""Elias-Fano coding of rising numbers in numpy, read in place from mapped files."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def write_arrays(path: str, arrays: dict[str, np.ndarray], **facts: object) -> None:
    """Arrays and facts in one file that appears whole or not at all, whoever writes it again."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps({"arrays": head, "facts": facts}).encode()
    text += b" " * (-len(text) % 8)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (-a.nbytes % 8))
    os.replace(part, path)


def open_arrays(path: str) -> tuple[dict[str, np.ndarray], dict]:
    m = np.asarray(np.memmap(path, np.uint8, "r")).view(np.ndarray)
    n = int.from_bytes(m[:8].tobytes(), "little")
    head = json.loads(m[8 : 8 + n].tobytes())
    out = {}
    for k, (kind, size, at) in head["arrays"].items():
        dtype = np.dtype(kind)
        out[k] = m[8 + n + at : 8 + n + at + size * dtype.itemsize].view(dtype)
    return out, head["facts"]


def pick(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) of each word."""
    x, r, at = x.copy(), r.astype(np.int64), np.zeros(len(x), np.int64)
    for w in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(x & _U((1 << w) - 1)).astype(np.int64)
        over = r >= n
        r -= np.where(over, n, 0)
        x = np.where(over, x >> _U(w), x)
        at += np.where(over, w, 0)
    return at


class EliasFano:
    """Rising numbers: the low bits packed, the high parts in unary, with a count of zeros for each 512 bits."""

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, bits: int, n: int):
        self.low, self.high, self.zeros, self.bits, self.n = low, high, zeros, bits, n
        self.buckets = int(zeros[-1])

    @staticmethod
    def build(values: np.ndarray, universe: int, bits: int | None = None) -> tuple[dict[str, np.ndarray], dict]:
        """values: rising, below universe. bits: low ones, if they aren't to be chosen for space."""
        n, values = len(values), values.astype(np.uint64)
        bits = max(0, (universe // max(1, n)).bit_length() - 1) if bits is None else bits
        top = (values >> _U(bits)).astype(np.int64)
        ones = top + np.arange(n)
        size = -(-(n + (universe >> bits) + 2) // 512) * 512
        unary = np.zeros(size, np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        zeros = np.concatenate(([0], np.cumsum(512 - np.bitwise_count(high).reshape(-1, 8).sum(1, dtype=np.int64))))
        low = np.zeros(-(-n * bits // 64) + 1, np.uint64)
        if bits and n:
            v, at = values & _U((1 << bits) - 1), np.arange(n, dtype=np.uint64) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            first = np.concatenate(([True], word[1:] != word[:-1]))
            starts = np.flatnonzero(first)
            low[word[starts]] |= np.bitwise_or.reduceat(v << shift, starts)
            over = np.flatnonzero(shift + _U(bits) > _U(64))
            low[word[over] + 1] |= v[over] >> (_U(64) - shift[over])
        return {"low": low, "high": high, "zeros": zeros}, {"bits": bits, "n": n}

    def lows(self, j: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(j), np.uint64)
        at = j.astype(np.uint64) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        v = self.low[word] >> shift
        over = shift + _U(self.bits) > _U(64)
        rest = np.where(over, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((_U(64) - shift) & _U(63)), _U(0))
        return (v | rest) & _U((1 << self.bits) - 1)

    def _select(self, r: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the r-th zero (or one)."""
        counts = np.arange(len(self.zeros)) * 512 - self.zeros if ones else self.zeros
        block = np.searchsorted(counts, r, side="right") - 1
        r = r - counts[block]
        words = self.high[block[:, None] * 8 + np.arange(8)]
        if not ones:
            words = ~words
        n = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        k = (n <= r[:, None]).sum(1)
        row = np.arange(len(r))
        return block * 512 + k * 64 + pick(words[row, k], r - np.where(k > 0, n[row, k - 1], 0))

    def access(self, j: np.ndarray) -> np.ndarray:
        """The numbers at places j."""
        return (self._select(j, True) - j).astype(np.uint64) << _U(self.bits) | self.lows(j)

    def all(self) -> np.ndarray:
        """The numbers, in order."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        place = np.arange(self.n)
        return (ones - place).astype(np.uint64) << _U(self.bits) | self.lows(place)

    def bucket(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the numbers of a high part begin and end: the unary part points there."""
        before = np.full(len(top), -1, np.int64)  # place of the zero before the bucket
        some = top > 0
        before[some] = self._select(top[some] - 1, False)
        at = before + 1
        rest = ~self.high[at >> 6] >> (at & 63).astype(np.uint64)  # the next zero is mostly in the same word
        after = at + np.bitwise_count((rest & (~rest + _U(1))) - _U(1))
        far = np.flatnonzero(rest == 0)
        after[far] = self._select(top[far], False)
        return at - top, after - top

    def find(self, v: np.ndarray) -> np.ndarray:
        """Place of each number, or -1: a successor search in its bucket of high parts."""
        v = v.astype(np.uint64)
        top = (v >> _U(self.bits)).astype(np.int64)
        out = np.full(len(v), -1, np.int64)
        todo = np.flatnonzero(top < self.buckets)
        if not self.n or not len(todo):
            return out
        top, want = top[todo], v[todo] & _U((1 << self.bits) - 1)
        at, high = self.bucket(top)
        end = high.copy()
        open_ = np.flatnonzero(at < end)
        while len(open_):  # the bucket's low bits rise: halve it
            mid = (at[open_] + end[open_]) >> 1
            less = self.lows(mid) < want[open_]
            at[open_] = np.where(less, mid + 1, at[open_])
            end[open_] = np.where(less, end[open_], mid)
            open_ = open_[at[open_] < end[open_]]
        inside = np.flatnonzero(at < high)
        hit = inside[self.lows(at[inside]) == want[inside]]
        out[todo[hit]] = at[hit]
        return out
