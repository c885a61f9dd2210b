"""Elias-Fano coding of monotone sequences, read in bulk with numpy.

A value's low bits are packed; its high bits are a unary bit vector with the number of ones
before each 64-bit word beside it, from which ones and zeros are selected. Reading takes
arrays of places or values, never one at a time.
"""

from __future__ import annotations

import numpy as np

from .vector import U

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
# The place of the k-th one in a byte, at byte * 8 + k.
_PLACE = np.argsort(1 - _BITS.astype(np.int8), axis=1, kind="stable").astype(np.uint8).ravel()
# A one in each byte of a word, and masks of every other bit, pair and half byte.
_EACH, _TOP = U(0x0101010101010101), U(0x8080808080808080)
_STEPS = 4
_BIT, _PAIR, _HALF = U(0x5555555555555555), U(0x3333333333333333), U(0x0F0F0F0F0F0F0F0F)


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays that hold non-decreasing whole numbers from 0."""
    values = values.astype(U)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(1, n)).bit_length() - 1)
    bits = np.zeros((top >> low) + n + 1, np.uint8)
    bits[(values >> U(low)).astype(np.int64) + np.arange(n)] = 1
    bits = np.pad(bits, (0, -len(bits) % 64))
    high = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.zeros(len(high) + 1, np.int64)
    np.cumsum(bits.reshape(-1, 64).sum(axis=1), out=ones[1:])
    packed = np.zeros(n * low // 64 + 2, "<u8")
    if low:
        at = np.arange(n) * low
        word, shift = at >> 6, (at & 63).astype(U)
        part = values & U((1 << low) - 1)
        np.bitwise_or.at(packed, word, part << shift)
        over = (at & 63) + low > 64
        np.bitwise_or.at(packed, word[over] + 1, part[over] >> (U(64) - shift[over]))
    return {"low": packed, "high": high, "ones": ones.astype(np.min_scalar_type(n)), "shape": np.array([n, low], "<i8")}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.low, self.high, self.ones = (arrays[prefix + k] for k in ("low", "high", "ones"))
        self.n, self.bits = (int(x) for x in arrays[prefix + "shape"])
        zeros = np.arange(len(self.ones)) * 64 - self.ones.astype(np.int64)
        self.zeros = zeros.astype(np.min_scalar_type(64 * len(zeros)))

    def _select(self, k: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the k-th ones (zeros if flipped); fastest for k in order."""
        before = self.zeros if flip else self.ones
        word = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        rest = k.astype(U) - before[word].astype(U)
        held = self.high[word]
        if flip:
            held = ~held
        # Byte i of ``ahead`` counts the ones of bytes 0 to i.
        ahead = held - ((held >> U(1)) & _BIT)
        ahead = (ahead & _PAIR) + ((ahead >> U(2)) & _PAIR)
        ahead = ((ahead + (ahead >> U(4))) & _HALF) * _EACH
        # Bytes that end before the one sought.
        passed = ((((rest * _EACH) | _TOP) - ahead) & _TOP) >> U(7)
        shift = ((passed * _EACH) >> U(56)) << U(3)
        rest -= ((ahead << U(8)) >> shift) & U(255)
        byte = (held >> shift) & U(255)
        return word * 64 + shift.astype(np.int64) + _PLACE[((byte << U(3)) + rest).astype(np.int64)]

    def _next(self, k: np.ndarray, at: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the ones (zeros if flipped) after the k-th, which stand at ``at``."""
        held = self.high[at >> 6]
        if flip:
            held = ~held
        # The bits behind ``at``, lowest first.
        rest = held >> (at & 63).astype(U) >> U(1)
        after = at + 1 + np.bitwise_count(~rest & (rest - U(1)))
        far = np.flatnonzero(rest == 0)
        if len(far):
            after[far] = self._select(k[far] + 1, flip)
        return after

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U)
        # A shift by 64 is undefined, so the upper part goes in two steps.
        both = (self.low[word] >> shift) | ((self.low[word + 1] << U(1)) << (U(63) - shift))
        return both & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = self._select(i, False) - i
        return (high.astype(U) << U(self.bits)) | self._low(i)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i and at the places after them."""
        at = self._select(i, False)
        after = self._next(i, at, False)
        return ((at - i).astype(U) << U(self.bits)) | self._low(i), ((after - i - 1).astype(U) << U(self.bits)) | self._low(i + 1)

    def next_geq(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value >= x, n if there is none."""
        begin, end = self._run(x)
        low, open_ = x & U((1 << self.bits) - 1), np.flatnonzero(begin < end)
        begin[open_] = self._first(begin[open_], end[open_], low[open_])
        return begin

    def place(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that is x, -1 if there is none."""
        found = np.full(len(x), -1)
        begin, end = self._run(x)
        # Behind the last run the high bits are larger.
        open_ = np.flatnonzero((begin < end) & ((x >> U(self.bits)).astype(np.int64) <= self._last()))
        begin, end, low = begin[open_], end[open_], x[open_] & U((1 << self.bits) - 1)
        # Short runs are gone through, long ones halved.
        long = end - begin > _STEPS
        at = begin.copy()
        at[long] = self._first(begin[long], end[long], low[long])
        inside = np.flatnonzero(at < end)
        while len(inside):
            held = self._low(at[inside])
            same = inside[held == low[inside]]
            found[open_[same]] = at[same]
            inside = inside[held < low[inside]]
            at[inside] += 1
            inside = inside[at[inside] < end[inside]]
        return found

    def _last(self) -> int:
        """The last high bits that can be looked for."""
        return len(self.high) * 64 - self.n - 1

    def _run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values with the high bits of x begin and end."""
        high = np.minimum((x >> U(self.bits)).astype(np.int64), self._last())
        # They stand between two zeros.
        k = np.maximum(high - 1, 0)
        at = self._select(k, True)
        begin, end = at - k, at.copy()
        some = high > 0
        begin[~some] = 0
        if some.all():
            end = self._next(k, at, True)
        else:
            end[some] = self._next(k[some], at[some], True)
        return begin, end - high

    def _first(self, begin: np.ndarray, end: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Places of the first low bits >= ``low`` in runs, their ends if there are none."""
        most = int((end - begin).max()) if len(begin) else 0
        for _ in range(most.bit_length()):
            # An empty run stays as it is.
            middle = np.minimum((begin + end) >> 1, self.n - 1)
            less = (self._low(middle) < low) & (begin < end)
            begin, end = np.where(less, middle + 1, begin), np.where(less, end, middle)
        return begin
