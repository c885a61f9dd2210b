"""The index against plain search, near words against all pairs, forms and roots, odd rows."""

import random

import numpy as np
import pytest

import oracle
from postlabel.llm import spelling_variants
from postlabel.llm.fm_index import Bidirectional, WaveletMatrix, suffix_order
from postlabel.llm.spelling_variants import OP13_SQL, group_variants, near_words, op13_spelling_variants, with_planted_slips


def apart(a, b):
    """True if one code point inserted, deleted or replaced makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def random_words(rng, count, letters="abcé"):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(count)})


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 13, 200)
    wavelet = WaveletMatrix(symbols, 4)
    lo, hi, c = rng.integers(0, 100, 50), rng.integers(100, 200, 50), rng.integers(0, 13, 50)
    before_lo, before_hi, less = wavelet.count(c, lo, hi)
    for i in range(50):
        assert before_lo[i] == (symbols[: lo[i]] == c[i]).sum() and before_hi[i] == (symbols[: hi[i]] == c[i]).sum()
        assert less[i] == (symbols[lo[i] : hi[i]] < c[i]).sum()
    which, symbol, _, _, less = wavelet.present(lo, hi)
    assert {(w, s) for w, s in zip(which.tolist(), symbol.tolist())} == {(i, s) for i in range(50) for s in set(symbols[lo[i] : hi[i]].tolist())}
    assert all(n == (symbols[lo[w] : hi[w]] < s).sum() for w, s, n in zip(which, symbol, less))


def test_suffix_order():
    text = np.array([0, 1, 2, 1, 0, 1, 2, 2, 0, 2, 0])
    ends = [i for i, x in enumerate(text) if x == 0]
    whole = {i: text[i : min(e for e in ends if e >= i) + 1].tolist() for i in range(len(text))}
    assert suffix_order(text).tolist() == sorted(whole, key=lambda i: (whole[i], i))


@pytest.mark.parametrize("seed", range(4))
def test_index_against_all_pairs(seed):
    """Either half alone finds the pairs that have it in common; both find all."""
    rng = random.Random(seed)
    words = random_words(rng, 400)
    index, queries = Bidirectional(words), [*random_words(rng, 200, "abcéz"), *words]
    found = {}
    for exact_end in (False, True):
        q, w = index.one_error(queries, exact_end)
        found[exact_end] = {(queries[i], words[j]) for i, j in zip(q.tolist(), w.tolist())}
    expected = {(a, b) for a in queries for b in words if apart(a, b)}
    assert found[False] | found[True] == expected
    assert all(b.startswith(a[: len(a) // 2]) for a, b in found[False]) and all(b.endswith(a[len(a) // 2 :]) for a, b in found[True])


def test_near_words_in_many_cells(spark, monkeypatch):
    """A third of the words have one beginning; small shards make a grid of its shard."""
    rng = random.Random(11)
    words = sorted({*random_words(rng, 500), *("abcabc" + w for w in random_words(rng, 250))})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    expected = {(a, b) for a in words for b in words if apart(a, b)}
    for size in (1 << 14, 64):
        monkeypatch.setattr(spelling_variants, "SHARD_WORDS", size)
        rows = near_words(table).collect()
        assert {(r.word, r.near) for r in rows} == expected and len(rows) == len(expected)
        assert all(words[r.n] == r.word and words[r.near_n] == r.near for r in rows)


def brute(counts, factor=5):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if apart(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= factor * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    return out


def test_forms_and_roots(spark):
    counts = {"abcdefgh": 700, "abcdefg": 130, "abcdef": 5, "abcdefgx": 26, "xbcdefgh": 130, "xbcdefgy": 20, "lonely": 9, "abcde": 99, "seldom": 4, "ääääää": 5, "äääääb": 25, "äääääa": 25}
    rows = [(w,) for w, n in counts.items() for _ in range(n)] + [(None,), ("",)]
    got = {r.word: r for r in group_variants(spark.createDataFrame(rows, "word string")).collect()}
    expected = brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert {w: (r.form, r.n, r.n_near, r.form_n) for w, r in got.items()} == expected
    assert got["abcdef"].form == "abcdefg" and got["abcdef"].root == "abcdefgh" == got["xbcdefgy"].root
    assert got["ääääää"].form == "äääääa" and got["lonely"].root == "lonely"


def test_slips(spark):
    import zlib

    rows = [(i, "Étoile ÉCOLES naïveté×abc") for i in range(400)] + [(None, "Étoile"), (7, None)]
    got = sorted(r.word for r in with_planted_slips(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    expected = ["Étoile"]
    for i in range(400):
        for run in ("Étoile", "École".replace("cole", "coles"), "naïveté×abc"):
            h = zlib.crc32(f"{i}:{run}".encode())
            expected.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run)
    assert got == sorted(expected)


def test_empty_and_clashing(spark):
    assert group_variants(spark.createDataFrame([], "word string")).count() == 0
    rows = spark.createDataFrame([("variant", "x", 1)] * 6, "word string, root string, n int")
    assert [tuple(r) for r in group_variants(rows).collect()] == [("variant", None, "variant", 6, 0, None)]


def test_query_against_sql(spark, sf):
    got = oracle.spark_rows(op13_spelling_variants(spark, sf))
    assert oracle.difference(got, oracle.sql_rows(oracle.connect(sf), OP13_SQL)) is None
