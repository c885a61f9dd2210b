"""Documents shorter than an item against exact weighted similarity, and a benchmark in many slices."""

import random
from collections import Counter

from test_decontaminate import DOCS, grams, ours, words

from postlabel.llm import decontaminate


def brute(docs, items):
    known = {i: words(t) for i, t in items}
    sets = {i: Counter(grams(w, min(5, len(w)))) for i, w in known.items()}
    held = Counter(g for s in sets.values() for g in s)

    def weight(counts):
        return sum(n * (1 + (len(known) // held.get(g, 1)).bit_length()) for g, n in counts.items())

    out = {}
    for doc, text, _ in docs:
        w = words(text)
        found = set()
        for i, two in sets.items():
            n = len(known[i])
            for at in range(max(1, len(w) - n + 1)):
                one = Counter(grams(w[at : at + n], min(5, n)))
                if 100 * weight(one & two) >= 75 * weight(one | two) > 0:
                    found.add(i)
        out[doc] = sorted(found)
    return out


def benchmark(rng, n):
    vocabulary = [f"w{i}" for i in range(200)]
    shared = [rng.choice(vocabulary) for _ in range(8)]
    return [(i, " ".join([*(shared if i % 3 else []), *(rng.choice(vocabulary) for _ in range(rng.randint(12, 40)))])) for i in range(n)]


def test_truncated_items(spark):
    rng = random.Random(5)
    items = benchmark(rng, 40)
    docs = [(0, " ".join(f"u{i}" for i in range(18)), None)]
    items.append((1000, " ".join(f"u{i}" for i in range(20))))
    for i in range(1, 60):
        copy = rng.choice(items)[1].split()
        cut = rng.randint(0, len(copy) // 2)
        docs.append((i, " ".join(copy[cut:] if i % 2 else copy[: len(copy) - cut]), None))
    expected = brute(docs, items)
    assert expected[0] == [1000] and 10 < sum(map(bool, expected.values())) < 60
    assert ours(spark, docs, items) == expected


def test_slices_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    items = benchmark(rng, 40)
    docs = []
    for i in range(60):
        copy = rng.choice(items)[1].split()
        edits = rng.randint(0, 3)
        copy[len(copy) - edits :] = ["zz"] * edits
        docs.append((i, " ".join(copy), None))

    def found():
        got = decontaminate.match_benchmark(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
        return {r.row.doc_id: (r.item_ids, r.similarity) for r in got.collect()}

    whole = found()
    assert {d: x for d, (x, _) in whole.items()} == brute(docs, items) and len({s for _, s in whole.values()}) > 5
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 2000)
    monkeypatch.setattr(decontaminate, "SHARD_SHINGLES", 1)
    assert found() == whole
