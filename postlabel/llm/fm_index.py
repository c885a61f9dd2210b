"""A bidirectional FM-index over a sorted list of distinct words, searched for many words in step.

The words stand between delimiters: ``$ w0 $ w1 $ ... $``. A delimiter is smaller than every
letter, and the one before a word with a smaller number comes first, so the suffix that begins
at the delimiter before word i has rank i, and the ranks of all words with a common beginning
are an interval. The second index is over the reversed words. A pattern has an interval in
both; adding a letter at either end takes one look at one of the two wavelet matrices and keeps
the intervals in step, as the letters smaller than the added one are counted in the same look.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DELIMITER = 0


class WaveletMatrix:
    """Counts of each symbol, and of the smaller ones, before any place of a sequence."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(1 << bits)
        nowhere = np.zeros(len(every), np.int64)
        self.base = np.zeros(len(every), np.int64)
        self.base = self.count(every, nowhere, nowhere)[0]

    def count(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """How often each symbol stands before lo and before hi, and how many smaller ones between."""
        less = np.zeros(len(symbol), np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            bit = ((symbol >> level) & 1).astype(bool)
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            less += np.where(bit, (hi - b) - (lo - a), 0)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return lo - self.base[symbol], hi - self.base[symbol], less

    def present(self, lo: np.ndarray, hi: np.ndarray):
        """All symbols that stand between lo and hi: (interval, symbol), then as ``count`` gives them."""
        which, symbol, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            left = (hi - b) - (lo - a)
            which, symbol, less = np.tile(which, 2), np.concatenate([2 * symbol, 2 * symbol + 1]), np.concatenate([less, less + left])
            lo, hi = np.concatenate([lo - a, zeros + a]), np.concatenate([hi - b, zeros + b])
            there = hi > lo
            which, symbol, less, lo, hi = which[there], symbol[there], less[there], lo[there], hi[there]
        return which, symbol, lo - self.base[symbol], hi - self.base[symbol], less


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of a delimited text by what stands from there to the next delimiter, then by place."""
    n = len(text)
    ends = np.flatnonzero(text == DELIMITER)
    end = np.repeat(ends, np.diff(ends, prepend=-1))
    rank, step, longest = text.astype(np.int64), 1, int(np.diff(ends).max(initial=1))
    place = np.arange(n)
    while step <= longest:
        key = rank * (int(rank.max()) + 1) + rank[np.minimum(place + step, end)]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


@dataclass
class Side:
    """An index that patterns grow in at one end."""

    wavelet: WaveletMatrix
    before: np.ndarray  # symbols of the text smaller than each

    @classmethod
    def of(cls, words: list[np.ndarray], bits: int) -> Side:
        text = np.concatenate([np.append(DELIMITER, w) for w in words] + [[DELIMITER]]).astype(np.int64)
        order = suffix_order(text)
        last = text[order - 1]
        # Nothing stands before the first delimiter; its row is the first.
        last[0] = (1 << bits) - 1
        counts = np.bincount(text, minlength=1 << bits)
        return cls(WaveletMatrix(last, bits), np.cumsum(counts) - counts)


@dataclass
class States:
    """Patterns on their way: their query, how much of it is read, interval here and first row there."""

    query: np.ndarray
    read: np.ndarray
    lo: np.ndarray
    size: np.ndarray
    other: np.ndarray

    def take(self, which: np.ndarray) -> States:
        return States(self.query[which], self.read[which], self.lo[which], self.size[which], self.other[which])

    @staticmethod
    def joined(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("query", "read", "lo", "size", "other")))


class Bidirectional:
    """The index of sorted, distinct, not empty words, given as Python strings."""

    def __init__(self, words: list[str]) -> None:
        codes = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in words]
        self.alphabet = np.unique(np.concatenate(codes))
        # One symbol for the delimiter, one that stands for letters of queries that no word has.
        self.bits = int(len(self.alphabet) + 2).bit_length()
        own = [np.searchsorted(self.alphabet, c) + 1 for c in codes]
        self.size = len(words)
        self.forward = Side.of(own, self.bits)
        backward = [own[i][::-1] for i in sorted(range(len(words)), key=lambda i: words[i][::-1])]
        self.backward = Side.of(backward, self.bits)

    def symbols(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, len(self.alphabet) + 1)

    def grown(self, side: Side, states: States, symbol: np.ndarray) -> States:
        """Patterns with one more symbol at the end that this side grows at; the empty ones go."""
        lo, hi, less = side.wavelet.count(symbol, states.lo, states.lo + states.size)
        grown = States(states.query, states.read + 1, side.before[symbol] + lo, hi - lo, states.other + less)
        return grown.take(np.flatnonzero(hi > lo))

    def one_error(self, queries: list[str], exact_end: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word number) of all words that differ from a query by one inserted, deleted or replaced letter.

        With ``exact_end`` the second half of the query is matched exactly, from the delimiter
        after it backwards, and the error is looked for across the first; else the first half is
        matched forwards and the error is across the second. A pair may come more than once.
        """
        side = self.forward if exact_end else self.backward
        if not queries:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order = -1 if exact_end else 1
        own = [self.symbols(q)[::order] for q in queries]
        length = np.array([len(q) for q in own])
        first = np.cumsum(length) - length
        letters = np.append(np.concatenate(own), DELIMITER)
        exact = length - length // 2 if exact_end else length // 2
        n = len(queries)
        clean = States(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size + 1), np.zeros(n, np.int64))
        done, wrong = [], []
        while len(clean.query):
            half = clean.read >= exact[clean.query]
            done.append(clean.take(np.flatnonzero(half)))
            clean = clean.take(np.flatnonzero(~half))
            clean = self.grown(side, clean, letters[first[clean.query] + clean.read])
        clean = States.joined(done)
        while len(clean.query):
            here = clean.read < length[clean.query]
            following = np.where(here, letters[np.minimum(first[clean.query] + clean.read, len(letters) - 1)], -1)
            which, symbol, lo, hi, less = side.wavelet.present(clean.lo, clean.lo + clean.size)
            letter = (symbol != DELIMITER) & (symbol <= len(self.alphabet))
            which, symbol, lo, hi, less = which[letter], symbol[letter], lo[letter], hi[letter], less[letter]
            step = States(clean.query[which], clean.read[which], side.before[symbol] + lo, hi - lo, clean.other[which] + less)
            wrong.append(step)  # inserted
            replaced = step.take(np.flatnonzero(here[which] & (symbol != following[which])))
            replaced.read = replaced.read + 1
            deleted = clean.take(np.flatnonzero(here))
            deleted.read = deleted.read + 1
            wrong += [replaced, deleted]
            clean = step.take(np.flatnonzero(symbol == following[which]))
            clean.read = clean.read + 1
        found, states = [], States.joined(wrong) if wrong else clean
        while len(states.query):
            over = states.read >= length[states.query]
            ended = states.take(np.flatnonzero(over))
            ended = self.grown(side, ended, np.full(len(ended.query), DELIMITER))
            found.append((ended.query, ended.lo if exact_end else ended.other))
            states = states.take(np.flatnonzero(~over))
            states = self.grown(side, states, letters[first[states.query] + states.read])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
