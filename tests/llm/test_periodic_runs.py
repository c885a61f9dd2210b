"""Runs against brute force over all periods, tiles against one pass, long texts, odd rows."""

import random
from array import array

import oracle
from postlabel.llm.periodic_runs import OP12_SQL, drop_periodic_runs, op12_periodic_runs, solve, z_function
from postlabel.llm.vector import CHUNK_BYTES


def brute(words):
    """Every (start, period, length), by trying all periods and all places."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= 3 * q and j - i + q >= 6 and not any(q % p == 0 and words[i : i + q - p] == words[i + p : i + q] for p in range(1, q)):
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted((s, q, length) for s, length, q in found)


def kept(words, runs):
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_text(rng):
    words = []
    while len(words) < rng.randrange(1, 900):
        block = [rng.choice("abcde") + str(rng.randrange(rng.choice((1, 3, 300)))) for _ in range(rng.choice((1, 2, 5, 15, 16, 17, 31, 33, 64, 90)))]
        words += (block * rng.randrange(1, 9))[: rng.randrange(1, 500)]
    return words


def check(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.row.doc_id: r for r in drop_periodic_runs(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words = (text or "").split()
        runs = brute(words)
        assert [tuple(r) for r in rows[i].runs] == runs, i
        assert rows[i].n_words == len(words) and rows[i].kept_text == kept(words, runs)


def test_against_brute_force(spark):
    rng = random.Random(5)
    check(spark, [" ".join(random_text(rng)) for _ in range(150)])


def test_many_equal_words_and_long_periods(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(50)}" for _ in range(300)]
    texts = ["a " * 3000, "a b " * 900, " ".join(long * 5), " ".join(long[:257] * 4), " ".join(["x"] * 40 + long * 4 + ["x"] * 40), "a " * 5, "a " * 6]
    check(spark, [*texts, None, "", " \t\n", "word"])


def test_text_longer_than_a_chunk(spark):
    rng = random.Random(7)
    base = [f"word{rng.randrange(10**6)}" for _ in range(100_000)]
    text = " ".join([*base, *base[:9000] * 4, *base])
    assert len(text) > CHUNK_BYTES
    docs = spark.createDataFrame([(1, text), (2, "q " * 10)], "doc_id long, text string")
    rows = {r.row.doc_id: r for r in drop_periodic_runs(docs).collect()}
    # Five copies of the 9,000 words stand in a row, the last of them the last part's beginning.
    assert [tuple(r) for r in rows[1].runs] == [(100_000, 9000, 45_000)]
    assert rows[2].kept_text == "q" and rows[1].n_words == 236_000
    assert rows[1].kept_text.split() == [*base, *base[:9000], *base[9000:]]


def test_z_function_and_tiles():
    rng = random.Random(8)
    for _ in range(50):
        words = array("i", [rng.randrange(3) for _ in range(rng.randrange(0, 40))])
        n = len(words)
        assert list(z_function(words)) == [next((k for k in range(n - i) if words[k] != words[i + k]), n - i) for i in range(n)]
    size = 16
    for _ in range(60):
        block = [rng.randrange(4) for _ in range(rng.randrange(16, 32))]
        words = array("i", (block * 9)[: 6 * size])
        for q, a, b in solve(words, size):
            cut = 2 * size
            assert all(words[i] == words[i + q] for i in range(cut - a, cut + b))
            assert a == cut or words[cut - a - 1] != words[cut - a - 1 + q]
            assert b == cut or cut + b + q == len(words) or words[cut + b] != words[cut + b + q]


def test_odd_rows(spark):
    schema = "doc_id long, text string, runs string, row string, `a.b` int"
    rows = [(None, "a " * 8, None, "r", 1), (1, "b c", "x", None, None), (1, "b c", "x", None, None), (2, None, None, None, None)]
    got = drop_periodic_runs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.row.doc_id or 0, r.kept_text, r.row.runs, r.row["a.b"]) for r in got if r.row.doc_id != 2) == [(0, "a", None, 1), (1, "b c", "x", None), (1, "b c", "x", None)]
    assert drop_periodic_runs(spark.createDataFrame([], schema)).count() == 0


def test_query_against_sql(spark, sf):
    got = oracle.spark_rows(op12_periodic_runs(spark, sf))
    assert oracle.difference(got, oracle.sql_rows(oracle.connect(sf), OP12_SQL)) is None
