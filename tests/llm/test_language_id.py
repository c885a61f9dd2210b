"""Held-out accuracy, words of mixed texts, and forward-backward against enumeration."""

import itertools

import numpy as np

from postlabel.llm import language_id
from postlabel.llm.language_id import fit, identify, marginals, op3_language_id


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_of_mixed_text():
    english, german = "the quick house over there with many things", "der schnelle baum ueber dem dach mit vielen dingen"
    model = fit([("de", german)] * 20 + [("en", english)] * 20)
    found, _ = model.words([f"{english} {german} {english}"])
    n, m = len(english.split()), len(german.split())
    expected = ["en"] * n + ["de"] * m + ["en"] * n
    assert [model.labels[i] for i in found.argmax(axis=1)] == expected


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 3, 7, 8])
    scores, switch = rng.normal(size=(8, 3)), np.exp(rng.normal(size=(3, 3)))
    expected, pairs = np.zeros((8, 3)), np.zeros((3, 3))
    for a, b in zip(first[:-1], first[1:]):
        total, own, both = 0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = np.exp(sum(scores[a + i, y] for i, y in enumerate(path)))
            p *= np.prod([switch[x, y] for x, y in zip(path[:-1], path[1:])])
            total += p
            for i, y in enumerate(path):
                own[i, y] += p
            for x, y in zip(path[:-1], path[1:]):
                both[x, y] += p
        expected[a:b], pairs = own / total, pairs + both / total
    found, together = marginals(scores, first, switch)
    assert np.allclose(found, expected) and np.allclose(together, pairs)


def test_nulls_no_letters_and_no_labels(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, "en", None), (2, "123 !", "en", None), (None, "the house", None, None), (3, "", None, None)]
    rows += [(10 + i, "the house of the things" if i % 2 else "der baum und das dach", "en" if i % 2 else "de", "") for i in range(20)]
    got = {r.row.doc_id: (r.lang_pred, r.row.score) for r in identify(spark.createDataFrame(rows, schema)).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == "und" and got[None][0] == "en" and got[11] == ("en", "")
    assert {r.lang_pred for r in identify(spark.createDataFrame(rows[:4], schema).drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert identify(spark.createDataFrame([], schema)).count() == 0


def test_blocks_give_the_same_as_one_pass(monkeypatch):
    rng = np.random.default_rng(3)
    first = np.array([0, 1, 1, 40, 57, 64, 200, 208])
    scores, switch = 3 * rng.normal(size=(208, 4)), np.exp(2 * rng.normal(size=(4, 4)))
    switch[1, 2] = 0
    whole, pairs = marginals(scores, first, switch)
    for size in (1, 2, 7, 8, 64, 199):
        monkeypatch.setattr(language_id, "BLOCK", size)
        found, together = marginals(scores, first, switch)
        assert np.allclose(found, whole) and np.allclose(together, pairs), size
    assert np.isclose(pairs.sum(), 208 - 6) and np.allclose(whole.sum(axis=1), 1)


def test_a_long_text_costs_what_short_ones_do():
    import time

    rng = np.random.default_rng(4)
    scores, switch = rng.normal(size=(400_000, 4)), np.exp(rng.normal(size=(4, 4)))
    seconds = []
    for first in (np.arange(0, 400_001, 500), np.array([0, 400_000])):
        start = time.process_time()
        found, _ = marginals(scores, first, switch)
        seconds.append(time.process_time() - start)
        assert np.isfinite(found).all()
    assert seconds[1] < 6 * seconds[0], seconds


def test_text_longer_than_a_chunk(spark):
    text = "the quick house over there with many things " * 20_000
    assert len(text) > language_id.CHUNK
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house of the things", "en"), ("der baum und das dach", "de")] * 10)]
    got = {r.row.doc_id: (r.lang_pred, r.n_words) for r in identify(spark.createDataFrame([*rows, (99, text, None)], "doc_id long, text string, lang string")).collect()}
    assert got[99] == ("en", 160_000) and got[0][0] == "en" and got[1][0] == "de"
