"""Token ids of many texts at once: cut by character classes in numpy, each distinct word encoded once.

A byte-level BPE tokenizer cuts a text by a pattern before any merge, so the ids of a text are
those of its words in a row. The public tokenizers' pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

only looks at classes of characters, so its cuts follow from where the class changes. A space
belongs to what stands behind it; of more white space in a row only the last is cut off, unless
it ends the text; an apostrophe alone before one of seven endings takes the ending with it.
Any other pattern is applied text by text.

Words are told apart by 64-bit hashes of their bytes. A worker remembers the ids of words in a
few flat arrays of bounded size.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from .vector import prefix_hash, span_hash

SPACE, LETTER, NUMBER, OTHER = range(4)
# Words remembered before a worker starts anew: some 30 bytes each.
REMEMBERED = 1 << 20

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point; made once by each worker."""
    if not _classes:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = m.span()
                # The surrogates are missing from the string.
                table[[i + 0x800 * (i >= 0xD800) for i in range(a, b)]] = kind
        _classes.append(table)
    return _classes[0]


def word_starts(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pattern's words start, of texts given as code points with the offsets between them."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begins = first[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # Runs of one class: where they begin and end, and whether they end their text.
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    space = kind[start] == SPACE
    inner = space & ~first[end]
    blank = codes[end - 1] == 0x20
    # The last white space before something else is a word of its own, or part of it if a space.
    begins[end[inner] - 1] = True
    begins[end[inner & blank]] = False
    # An apostrophe alone, to which no space belongs, with letters behind it.
    joined = np.zeros(n + 1, bool)
    joined[end[inner & blank]] = True
    mark = start[(kind[start] == OTHER) & (end - start == 1) & (codes[start] == 0x27) & ~joined[start] & ~first[end]]
    if len(mark):
        padded = np.append(codes, [0, 0])
        one, two = padded[mark + 1], padded[mark + 2]
        inside = np.append(first, True)[mark + 2]
        two = np.where(inside, 0, two)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        mark, size = mark[size > 0], size[size > 0]
        begins[mark + 1] = False
        behind = mark + 1 + size
        more = behind[(behind < n)]
        more = more[~first[more] & (kind[np.minimum(more, n - 1)] == LETTER)]
        begins[more] = True
    return np.flatnonzero(begins)


class WordIds:
    """Ids of texts from a byte-level BPE tokenizer's file, by distinct words.

    With ``added``, a text that holds one of the tokenizer's added tokens is encoded by the
    tokenizer as a whole, which cuts it at them first; without, they are plain text.
    """

    def __init__(self, path: str, pattern: str | None, added: bool, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder().values() if added else []
        self.added = [t.content.encode() for t in tokens]
        self.pattern = regex.compile(pattern) if pattern else None
        self.end = end
        self.forget()

    def forget(self) -> None:
        self.hashes, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.array([self.end], np.uint32)

    def _cut(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words, in bytes."""
        text = data.tobytes().decode("utf-8", "replace")
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if self.pattern is None:
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            starts = word_starts(codes, np.searchsorted(lead, offs))
            starts = lead[starts]
            ends = np.append(starts[1:], len(data))
            return starts, ends
        lead = np.append(lead, len(data))
        at = np.searchsorted(lead, offs)
        spans = [m.span() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for m in self.pattern.finditer(text, a, b)]
        starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
        return lead[starts], lead[ends]

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes new words (of sorted hashes) and adds them to what is remembered."""
        words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.array([len(x) for x in found], np.int64)
        first = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.first, self.size = (np.insert(x, at, y) for x, y in ((self.hashes, hashes), (self.first, first), (self.size, size)))

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end token, and the offsets between texts."""
        starts, ends = self._cut(data, offs)
        sums, inverse = prefix_hash(data)
        codes, distinct = pd.factorize(span_hash(sums, inverse, starts, ends))
        if len(self.hashes) + len(distinct) > REMEMBERED:
            self.forget()
        new = np.arange(len(distinct))
        if len(self.hashes):
            near = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            new = np.flatnonzero(self.hashes[near] != distinct)
        if len(new):
            one = np.empty(len(distinct), np.int64)
            one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            new = new[np.argsort(distinct[new])]
            self._learn(data, distinct[new], starts[one[new]], ends[one[new]])
        at = np.searchsorted(self.hashes, distinct)[codes]
        # The end of a text is one more word, the pool's first.
        text = np.searchsorted(starts, offs[1:])
        first, size = np.insert(self.first[at], text, 0), np.insert(self.size[at], text, 1)
        place = np.cumsum(size) - size
        ids = self.pool[np.repeat(first - place, size) + np.arange(int(size.sum()))]
        bounds = np.append(0, (place + size)[text + np.arange(len(text))])
        return self._with_added(data, offs, ids, bounds)

    def _with_added(self, data, offs, ids, bounds):
        """Texts with added tokens anew, as the tokenizer does them whole."""
        raw = data.tobytes() if self.added else b""
        if not any(x in raw for x in self.added):
            return ids, bounds
        parts = []
        for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            if any(x in raw[a:b] for x in self.added):
                whole = self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids
                parts.append(np.array([*whole, self.end], np.uint32))
            else:
                parts.append(ids[bounds[i] : bounds[i + 1]])
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
