"""Against exact weighted similarity of every window with every item."""

import random
import re
from collections import Counter

from postlabel.llm.decontaminate import match_benchmark

DOCS = "doc_id long, text string, kept string"


def words(text):
    return re.findall(r"[0-9a-z\x80-￿]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def brute(docs, items):
    known = {i: words(t) for i, t in items if words(t)}
    sets = {i: grams(w, min(5, len(w))) for i, w in known.items()}
    held = Counter(g for s in sets.values() for g in set(s))

    def weight(g):
        return 1 + (len(known) // held.get(g, 1)).bit_length()

    out = {}
    for doc, text, _ in docs:
        w, found = words(text), []
        for i, s in sets.items():
            n, two = len(known[i]), Counter(s)
            for at in range(len(w) - n + 1):
                one = Counter(grams(w[at : at + n], min(5, n)))
                both = set(one) | set(two)
                if 100 * sum(weight(g) * min(one[g], two[g]) for g in both) >= 75 * sum(weight(g) * max(one[g], two[g]) for g in both):
                    found.append(i)
                    break
        out[doc] = sorted(found)
    return out


def ours(spark, docs, items):
    got = match_benchmark(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    return {r.row.doc_id: r.item_ids for r in got.collect()}


def test_against_every_window(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(4, 40)]
    items = [x for x in items if len(x[1].split()) > 2] + [(99, None), (98, "..")]
    docs = []
    for i in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if i % 2:
            copy = rng.choice(items[:-2])[1].split()
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "zz"
            at = rng.randint(0, len(text))
            text[at:at] = copy
        docs.append((i, ", ".join(text).upper(), None))
    expected = brute(docs, items)
    assert sum(map(bool, expected.values())) > 10
    assert ours(spark, docs, items) == expected


def test_nulls_and_empty_tables(spark):
    docs = [(1, None, None), (2, "", None), (None, "a b c d e f g", None), (3, "x " * 9000 + "a B c-d e f g", None), (4, "a b", None)]
    items = [(7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b"), (8, None)]
    assert ours(spark, docs, items) == {1: [], 2: [], None: [7], 3: [7], 4: []}
    assert ours(spark, docs, []) == {1: [], 2: [], None: [], 3: [], 4: []}
    assert ours(spark, [], items) == {}


def test_block_index_misses_nothing_within_the_radius():
    import numpy as np

    from postlabel.llm import decontaminate
    from postlabel.llm.decontaminate import BLOCKS, RADIUS, BlockIndex

    rng = np.random.default_rng(5)
    items = rng.integers(0, 256, (300, 8), dtype=np.uint8)
    windows = items[rng.integers(0, 300, 500)].copy()
    for row in windows:
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    differ = np.bitwise_count(windows[:, None] ^ items[None])
    for reach in (0, 1, RADIUS // BLOCKS):
        before, decontaminate.PAIRS = decontaminate.PAIRS, 5000
        try:
            found = [(first + w, i) for first, ws, it in BlockIndex(items, reach).candidates(windows) for w, i in zip(ws.tolist(), it.tolist())]
        finally:
            decontaminate.PAIRS = before
        assert len(found) == len(set(found))
        assert set(found) == set(map(tuple, np.argwhere((differ <= reach).any(axis=2)).tolist()))
        near = set(map(tuple, np.argwhere(differ.sum(axis=2, dtype=int) <= reach * BLOCKS + BLOCKS - 1).tolist()))
        assert near <= set(found) and len(near) > 3
    assert list(BlockIndex(items[:0], 2).candidates(windows)) and not any(len(w) for _, w, _ in BlockIndex(items[:0], 2).candidates(windows))
