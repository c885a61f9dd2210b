"""Against exact similarity of all pairs."""

import random
import re

from postlabel.llm.minhash_dedup import components, near_duplicates

SCHEMA = "doc_id long, text string, band long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(rows):
    sets = {d: shingles(t) for d, t, _ in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d), find(d) == d) for d in sets}


def test_against_all_pairs(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 120))] for _ in range(25)]
    rows = []
    for i in range(220):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 50)}"
        rows.append((i * 3, " ".join(words).upper() if i % 7 == 0 else "\n".join(words), i))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_short_empty_null_and_repeated(spark):
    rows = [(5, "One two", 0), (3, "one  TWO", 0), (4, "", 0), (1, None, 0), (2, " \n", 0), (9, "one two three", 0),
            (7, "a b c d e f", 0), (7, "a b c d e f", 0), (6, "Ä b c d e f", 0), (8, "ä b c d e f", 0)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 10 and {tuple(r) for r in got} == brute(rows)


def test_null_ids_and_no_rows(spark):
    rows = [(None, "a b c d e f", 0), (None, "a b c d e f", 0), (2, "a b c d e f", 0)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (2, 2, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(300, 340)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(300, 340)}}
