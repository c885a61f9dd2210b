"""Personal data in texts: fixed patterns, and a linear-chain conditional random field beside them.

The patterns find addresses in their usual form (email, ip, card, phone). The field labels words
by their shapes and finds what is written otherwise, as ``(743) 555-0142`` or
``jane (at) example.org``. It is trained on a small labelled table, by the likelihood of its
lines, and decoded by Viterbi over many stretches in step.

A word is *marked* if it holds a digit, an at sign or an opening bracket. The field looks at
stretches of marked words with the word before and after each; all other words carry no personal
data by definition, so stretches between them are chains of their own and the best labelling
of each is part of the best one of the whole text. A span of the field counts if what it holds
is well formed (``PLAIN``) and if it does not touch a span of a pattern.

Positions are code points.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .language_id import marginals
from .store import read
from .vector import lookup, text_chunks, word_bounds

KINDS = ("email", "ip", "card", "phone")
# Outside, and the first and each further word of a span of each kind.
LABELS = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))
FEATURES = 1 << 14
STEPS = 150
RATE = 0.5
PENALTY = 1e-4
NEVER = -1e4

# One line a row, spans between marks: the whole table the field is trained on.
LABELLED = (
    "please call ⟦phone:(743) 555-0142⟧ before noon",
    "call ⟦phone:743-555-0142⟧ or write",
    "phone ⟦phone:(212) 555-9911⟧, ask for the desk",
    "our number is ⟦phone:212.555.9911⟧.",
    "tel ⟦phone:415 555 2671⟧ or come by",
    "reach them at ⟦phone:415/555-2671⟧ today",
    "fax ⟦phone:(030) 901820⟧ only",
    "ring ⟦phone:030 901 8201⟧ now",
    "dial ⟦phone:0049 30 9018201⟧ from abroad",
    "mobile ⟦phone:0171-5550142⟧, evenings",
    "text ⟦phone:(617)555-0188⟧ for news",
    "and ⟦phone:(508) 555-7312⟧ and then",
    "was ⟦phone:508-555-7312⟧ was",
    "la ⟦phone:(917) 555-4471⟧ une",
    "der ⟦phone:917-555-4471⟧ und",
    "el ⟦phone:1-800-555-0199⟧ de",
    "toll free ⟦phone:1 800 555 0199⟧ all day",
    "write to ⟦email:jane.roe (at) example.org⟧ soon",
    "write to ⟦email:jane.roe [at] mail.example.com⟧, please",
    "mail ⟦email:jroe(at)example.org⟧ or call",
    "mail ⟦email:j.roe[at]example.com⟧ or call",
    "send it to ⟦email:max.moe (at) example (dot) net⟧ today",
    "send it to ⟦email:max [at] example [dot] org⟧ today",
    "the box ⟦email:info42 (at) mail.example.net⟧ is read",
    "und ⟦email:anna_lee{at}example.org⟧ und",
    "los ⟦email:pat.kim<at>example.com⟧ en",
    "is ⟦email:sam @ example.org⟧ the",
    "is ⟦email:lee.7 @ mail3.example.com⟧ the",
    "to ⟦email:kim@example[.]org⟧ and",
    "to ⟦email:kim.9@example(dot)com⟧ and",
    "host ⟦ip:192[.]0[.]2[.]17⟧ answered",
    "from ⟦ip:198(.)51(.)100(.)7⟧ came",
    "server ⟦ip:203[dot]0[dot]113[dot]9⟧ is down",
    "the ⟦ip:10[.]20[.]30[.]40⟧, then",
    "de ⟦ip:172.16[.]9.1⟧ la",
    "at ⟦ip:192 . 0 . 2 . 44⟧ again",
    "card ⟦card:4539.1488.0343.6467⟧ was charged",
    "visa ⟦card:4539/1488/0343/6467⟧ expired",
    "pay with ⟦card:4485_2757_4230_8327⟧ now",
    "no ⟦card:5425.2334.3010.9903⟧ on file",
    "das ⟦card:2223/0031/2200/3222⟧ ist",
    "les ⟦card:3782.822463.10005⟧ de",
    "account ⟦card:3782 822463 10005⟧ closed",
    "on 2024-01-05 it rained",
    "from 01/05/2024 to 03/05/2024 it rained",
    "on 05.01.2024, at 10:30, they met",
    "in 1998 and 2003 the team won",
    "between 1990-1995 it grew",
    "see section 4.0. of the license",
    "version 3. of the terms",
    "python 3.13.1 and spark 4.1.2 are used",
    "pages 12-14 and 112-118 (see table 3)",
    "it cost 1,299.00 or 1.299,00 in all",
    "a total of 12 345 678 rows",
    "score 3-1 after 90 minutes",
    "order 20240105 was sent",
    "ticket 555-12 is open",
    "isbn 978-3-16-148410-0 is out",
    "f95017526fc608ad71587f8ea5418b66ff2e6d38",
    "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1### that",
    "key 9233A8ECF7C5B09FE5949719B6B82BC439E9329B!! is",
    "he said (as ever) that it was (so far) fine",
    "the list [1] and the note [23] agree",
    "if a < b then c > d and x[0] = 7",
    "room 12 on floor 3, building 44",
    "at 10:30 or 22:45 or 7 pm",
    "about 50 % of 1000 and 25 of 300",
    "the year 2020 (and 2021) was long",
    "call f(x) with x @ 3 and y",
    "follow @someone or @some_one2 there",
    "it is 21.5 degrees at 48.2082 north",
    "1 2 3 4 5 6 7 8 9 10",
    "10 20 30 40 50 and 100 200 300",
    "table | 12 | 345 | 6789 | 10 |",
    "serial 1234-5678 and part 12-3456-789",
    "build 20.04.1.2345 passed",
    "the range 0-9 and a-z (both)",
    "law 1234/2019 and act 56/1987",
    "ratio 16:9 or 4:3 (old)",
    "the 1st, 2nd and 3rd of 100",
)

MARKED = lookup(b"0123456789@[({<")
_MARK = re.compile(r"⟦(\w+):([^⟧]*)⟧")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUNS = re.compile(r"[0-9]+|[A-Z]+|[^\W\d_A-Z]+")

# --- patterns -----------------------------------------------------------------
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A stretch of digits that does not begin an address holds none, so only its begin is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def small_parts(address: str) -> bool:
    return all(len(p) < 4 and int(p or 0) < 256 for p in (x.lstrip("0") for x in address.split(".")))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind and start.

    Per kind from left to right, without overlaps; what fails its test is dropped, not tried again.
    """
    found, over, at = [], 0, text.find("@")
    while at >= 0:
        # What stands before an at sign up to the last match cannot hold another one.
        start = at
        while start > over and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            over = domain.end()
            found.append((0, start, over))
        at = text.find("@", max(at + 1, over))
    found += [(1, *m.span()) for m in IP.finditer(text) if small_parts(m.group())]
    for m in CARD.finditer(text):
        digits = "".join(DIGITS.findall(m.group()))
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m.group())) <= 15]
    return found


# --- the field ----------------------------------------------------------------


def _bucket(n: int) -> str:
    return str(n) if n < 12 else "12-15" if n < 16 else "16-19" if n < 20 else "more"


def word_features(word: str) -> list[str]:
    """The word's shapes, with and without lengths, its digits and signs, without those around it."""
    core = word.strip(".,;:!?%$&*#\"'|")
    exact, loose = [], []
    last = 0
    for m in _RUNS.finditer(core[:200]):
        exact.append(core[last : m.start()])
        loose.append(core[last : m.start()])
        kind = "d" if m.group()[0].isdigit() else "X" if "A" <= m.group()[0] <= "Z" else "x"
        exact.append(f"{kind}{_bucket(len(m.group()))}" if kind == "d" else kind)
        loose.append(kind)
        last = m.end()
    tail = core[last:200]
    digits = sum(c.isdigit() and c.isascii() for c in core)
    out = [f"s{''.join(exact)}{tail}", f"l{''.join(loose)}{tail}", f"d{_bucket(digits)}", f"n{_bucket(len(core))}", f"a{core[:1] in '(+0' if core else ''}"]
    out += [f"c{c}" for c in "@.-/()[]_<{" if c in core]
    lower = core.lower()
    if re.search(r"[\[({<](?:at|@)[\])}>]", lower):
        out.append("at")
    if re.search(r"[\[({<](?:dot|\.)[\])}>]", lower):
        out.append("dot")
    if word != core:
        out.append(f"e{word[-1:]}")
    return out


def _ids(place: str, features: Sequence[str]) -> list[int]:
    return [zlib.crc32(f"{place}{f}".encode("utf-8", "surrogatepass")) % FEATURES for f in features]


def feature_ids(word: str) -> tuple[list[int], list[int], list[int]]:
    """Hashed features of a word for itself, for the word after it and for the word before it."""
    features = word_features(word)
    return tuple(_ids(place, features) for place in ("=", "<", ">"))


def allowed_moves() -> np.ndarray:
    """Where one label may follow another: the inside of a span only its own begin or inside."""
    n = len(LABELS)
    moves = np.ones((n, n), bool)
    for j in range(2, n, 2):
        moves[:, j] = False
        moves[[j - 1, j], j] = True
    return moves


def stretches(marked: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of words that the field looks at, within texts (``first`` as in ``word_bounds``)."""
    n = len(marked)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = marked
    if n:
        same = text[1:] == text[:-1]
        inside[2:-1] |= marked[:-1] & same
        inside[1:-2] |= marked[1:] & same
    starts = inside[1:-1] & (~inside[:-2] | np.append(True, text[1:] != text[:-1])[:n])
    ends = inside[1:-1] & (~inside[2:] | np.append(text[1:] != text[:-1], True)[:n])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


@dataclass
class Field:
    weights: np.ndarray  # by feature and label
    moves: np.ndarray  # log weights by label and next label

    def scores(self, words: list[str], at: list[int], limits: list[tuple[int, int]]) -> np.ndarray:
        """Log weights of the labels of words ``at``; a word's neighbours count within the limits of its text."""
        seen: dict[str, int] = {}
        table: list[np.ndarray] = [np.zeros((3, len(LABELS)))]

        def number(i: int, lo: int, hi: int) -> int:
            if not lo <= i < hi:
                return 0
            if words[i] not in seen:
                seen[words[i]] = len(table)
                table.append(np.stack([self.weights[x].sum(axis=0) for x in feature_ids(words[i])]))
            return seen[words[i]]

        own = [(number(i, lo, hi), number(i - 1, lo, hi), number(i + 1, lo, hi)) for i, (lo, hi) in zip(at, limits, strict=True)]
        rows = np.array(own, np.int64).reshape(-1, 3)
        stacked = np.stack(table)
        return stacked[rows[:, 0], 0] + stacked[rows[:, 1], 1] + stacked[rows[:, 2], 2]


def viterbi(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of all chains, step by step over all of them; before and after a chain stands O.

    ``first`` holds the index of each chain's first word and the end. Ties go to the label that
    comes first.
    """
    labels = np.zeros(len(scores), np.int64)
    length = np.diff(first)
    chains = np.argsort(-length, kind="stable")
    length, head = length[chains], first[:-1][chains]
    alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    best = np.empty_like(scores)
    back = np.zeros(scores.shape, np.int8)
    for t, n in enumerate(alive):
        at = head[:n] + t
        if t == 0:
            best[at] = moves[0] + scores[at]
            continue
        paths = best[at - 1][:, :, None] + moves
        back[at] = paths.argmax(axis=1)
        best[at] = paths.max(axis=1) + scores[at]
    state = np.zeros(len(length), np.int64)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = head[:n] + t
        ending = length[:n] == t + 1
        state[:n][ending] = (best[at[ending]] + moves[:, 0]).argmax(axis=1)
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


def parsed(line: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of the labelled table as its text and (kind, start, end) of its spans."""
    text, spans, last = "", [], 0
    for m in _MARK.finditer(line):
        text += line[last : m.start()]
        spans.append((KINDS.index(m.group(1)), len(text), len(text) + len(m.group(2))))
        text += m.group(2)
        last = m.end()
    return text + line[last:], spans


@lru_cache(maxsize=4)
def train(table: tuple[str, ...] = LABELLED) -> Field:
    """Weights from labelled lines, by full-batch adaptive gradient steps on their likelihood."""
    size = len(LABELS)
    words, at, truth, limits, chains = [], [], [], [], [0]
    for line in table:
        text, spans = parsed(line)
        found = list(_WORD.finditer(text))
        lo = len(words)
        words += [m.group() for m in found]
        marked = np.array([any(c in "0123456789@[({<" for c in m.group()) for m in found], bool)
        for a, b in zip(*stretches(marked, np.array([0, len(found)])), strict=True):
            # O before and after, as in decoding.
            at += [-1, *range(lo + a, lo + b), -1]
            limits += [(lo, len(words))] * (b - a + 2)
            for m in [None, *found[a:b], None]:
                kind = next(((k, s) for k, s, e in spans if m and s < m.end() and m.start() < e), None)
                truth.append(0 if kind is None else 1 + 2 * kind[0] + (m.start() > kind[1]))
            chains.append(len(at))
    n, first, truth = len(at), np.array(chains), np.array(truth)
    outside = np.array(at) < 0
    lists = [[] if i < 0 else feature_ids(words[i])[0] + (feature_ids(words[i - 1])[1] if i > lo else []) + (feature_ids(words[i + 1])[2] if i + 1 < hi else []) for i, (lo, hi) in zip(at, limits, strict=True)]
    counts = np.array([len(x) for x in lists])
    flat, owner = np.array([f for x in lists for f in x]), np.repeat(np.arange(n), counts)
    moves = allowed_moves()
    weights, switch = np.zeros((FEATURES, size)), np.zeros((size, size))
    seen_w, seen_s = np.full(weights.shape, 1e-8), np.full(switch.shape, 1e-8)
    there = np.zeros((size, size))
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    np.add.at(there, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    for _ in range(STEPS):
        scores = np.zeros((n, size))
        np.add.at(scores, owner, weights[flat])
        scores[outside, 1:] = NEVER
        found, pairs = marginals(scores, first, np.where(moves, np.exp(switch), 0))
        found[np.arange(n), truth] -= 1
        slope = PENALTY * weights
        np.add.at(slope, flat, found[owner] / len(first))
        seen_w += slope**2
        weights -= RATE * slope / np.sqrt(seen_w)
        slope = np.where(moves, (pairs - there) / len(first) + PENALTY * switch, 0)
        seen_s += slope**2
        switch -= RATE * slope / np.sqrt(seen_s)
    return Field(weights.astype(np.float32), np.where(moves, switch, NEVER))


# --- spans of the field -------------------------------------------------------
_AT = re.compile(r"\s*(?:[\[({<]\s*(?:at|AT|@)\s*[\])}>]|@)\s*")
_DOT = re.compile(r"\s*(?:[\[({<]\s*(?:dot|DOT|\.)\s*[\])}>])\s*|\s+\.\s+")
_EDGE = {
    "email": re.compile(r"[A-Za-z0-9_%+-].*[A-Za-z0-9]", re.DOTALL),
    "ip": re.compile(r"[0-9].*[0-9]", re.DOTALL),
    "card": re.compile(r"[0-9].*[0-9]", re.DOTALL),
    "phone": re.compile(r"(?:\([0-9]|[+0-9]).*[0-9]", re.DOTALL),
}
# What the text of a span must be, once other spellings of signs are undone.
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[\x20./_-]?[0-9]){12,18}"),
    "phone": re.compile(r"\+?[\x20()./0-9-]+"),
}


def well_formed(kind: str, text: str) -> bool:
    if kind in ("email", "ip"):
        text = _DOT.sub(".", text)
    if kind == "email":
        text = _AT.sub("@", text)
    if not PLAIN[kind].fullmatch(text):
        return False
    digits = "".join(DIGITS.findall(text))
    if kind == "ip":
        return small_parts(text)
    if kind == "card":
        return luhn(digits)
    return kind == "email" or 7 <= len(digits) <= 15


def field_spans(words: list[tuple[int, int, int]], text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) from the labels of words in a row (label, start, end), if well formed."""
    found: list[list[int]] = []
    for label, start, end in words:
        if label and label % 2:
            found.append([label // 2, start, end])
        elif label:
            found[-1][2] = end
    out = []
    for kind, start, end in found:
        m = _EDGE[KINDS[kind]].search(text, start, end)
        if m and well_formed(KINDS[kind], m.group()):
            out.append((kind, *m.span()))
    return out


def _labelled(field: Field, data, offs, starts, ends, first):
    """{text: [(label, start byte, end byte), ...]} of the words in stretches, with their labels."""
    sums = np.concatenate([[0], np.cumsum(MARKED[data])])
    begin, end = stretches(sums[ends] > sums[starts], first)
    if not len(begin):
        return {}
    text = np.searchsorted(first, begin, "right") - 1
    words: list[str] = []
    at, limits, chains = [], [], [0]
    for a, b, d in zip(begin.tolist(), end.tolist(), text.tolist(), strict=True):
        # One more word on either side, as what stands beside a word counts.
        lo, hi = max(a - 1, int(first[d])), min(b + 1, int(first[d + 1]))
        base = len(words)
        words += [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
        at += range(base + a - lo, base + b - lo)
        limits += [(base, len(words))] * (b - a)
        chains.append(len(at))
    labels = viterbi(field.scores(words, at, limits), np.array(chains), field.moves).tolist()
    out: dict[int, list] = {}
    for a, b, d, c in zip(begin.tolist(), end.tolist(), text.tolist(), chains, strict=False):
        if any(labels[c : c + b - a]):
            out.setdefault(d, []).extend(zip(labels[c : c + b - a], starts[a:b].tolist(), ends[a:b].tolist(), strict=True))
    return out


def _found(field: Field, column: str):
    names = ("kind", "start", "end", "by_pattern")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            texts = rows.field(column).cast(pa.string())
            for a, b, data, offs in text_chunks(texts):
                starts, ends, first = word_bounds(data, offs)
                labelled = _labelled(field, data, offs, starts, ends, first)
                sums = np.concatenate([[0], np.cumsum(MARKED[data])])[offs]
                spans: list[list] = [[], [], [], []]
                counts = np.zeros(b - a + 1, np.int32)
                for d in np.flatnonzero(np.diff(sums)).tolist():
                    raw = data[offs[d] : offs[d + 1]]
                    text = raw.tobytes().decode("utf-8", "replace")
                    own = pattern_spans(text)
                    every = [(*x, True) for x in own]
                    if d in labelled:
                        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        placed = [(k, int(points[s - offs[d]]), int(points[e - offs[d]])) for k, s, e in labelled[d]]
                        every += [(*x, False) for x in field_spans(placed, text) if not any(s < x[2] and x[1] < e for _, s, e in own)]
                    for k, s, e, base in sorted(every):
                        for part, value in zip(spans, (KINDS[k], s, e, base), strict=True):
                            part.append(value)
                    counts[d + 1] = len(every)
                flat = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(spans, kinds, strict=True)], names=names)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), lists], names=["row", "spans"])

    return run


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("by_pattern", T.BooleanType())]))


def find_private(docs: DataFrame, text: str = "text", labelled: Sequence[str] = LABELLED) -> DataFrame:
    """Spans of personal data in every text.

    Returns row (a struct of all columns, whatever their names) and spans: kind, start, end and
    whether a pattern found it, by kind in the order of ``KINDS``, then start. Null and empty texts
    have none; no rows give none. ``labelled`` is the table the field is trained on, lines with
    spans between marks; it is read on the driver, so keep it to some hundreds of lines. Whole texts
    are searched, each in one task; equal rows are found alike.
    """
    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("spans", SPANS)])
    return rows.mapInArrow(_found(train(tuple(labelled)), text), schema)


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``find_private``'s rows with the text, each stretch of spans replaced by its first one's kind."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = F.col(f"row.`{text}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state, s):
        new = s["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring(whole, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(new, piece).otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    def end(state):
        return F.concat(state["out"], F.substring(whole, (state["at"] + 1).cast("int"), F.length(whole)))

    return found.withColumn("redacted", F.aggregate(ordered, start, step, end))


# --- query --------------------------------------------------------------------


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["by_pattern"])

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )
