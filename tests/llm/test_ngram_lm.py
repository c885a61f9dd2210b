"""Against a plain dictionary model, and by its sums to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from postlabel.llm.elias_fano import EliasFano, encode
from postlabel.llm.ngram_lm import DISCOUNT, Model, _packed, _unpacked, in_order, op9_ngram_lm, score, train

SCHEMA = "doc_id long, text string, score string"


def test_elias_fano_reads_and_searches():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (1, 5), (1000, 3), (1000, 10**15), (5000, 10**4), (5, 2**62)):
        values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        coded = EliasFano(encode(values))
        assert (coded.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top + 1, 300).astype(np.uint64), np.array([0, top, 2 * top + 5], np.uint64)])
        assert (coded.next_geq(asked) == np.searchsorted(values, asked)).all()


def test_elias_fano_places_values():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 0), (1, 5), (1000, 3), (5000, 10**4), (5, 2**62)):
        values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        coded = EliasFano(encode(values))
        asked = np.concatenate([values, values + np.uint64(1), np.array([0, top, 2 * top + 5], np.uint64)])
        at = np.searchsorted(values, asked)
        there = np.append(values, np.uint64(2**63))[at] == asked
        assert (coded.place(asked) == np.where(there, at, -1)).all()


def test_elias_fano_reads_neighbours_and_long_runs():
    rng = np.random.default_rng(4)
    # Far apart, close together, equal, and both kinds in turn.
    for values in (rng.integers(0, 10**12, 900), rng.integers(0, 300, 4000), np.full(500, 7), np.concatenate([np.arange(3000), rng.integers(10**9, 10**10, 40)])):
        values = np.sort(values).astype(np.uint64)
        coded = EliasFano(encode(values))
        here, after = coded.get_two(np.arange(len(values) - 1))
        assert (here == values[:-1]).all() and (after == values[1:]).all()
        assert (coded.place(values) == np.searchsorted(values, values)).all()


def test_rows_sort_by_all_columns():
    rng = np.random.default_rng(5)
    for n, top in ((0, 3), (1, 3), (2000, 5), (2000, 1 << 40)):  # the last don't fit one number
        columns = [np.concatenate([rng.integers(-1, top, n), [-1] * (n > 9), [top - 1] * (n > 9)]) for _ in range(2)]
        order, new = in_order(*columns)
        assert (order == np.lexsort(columns[::-1])).all()
        rows = list(zip(*(x[order].tolist() for x in columns), strict=True))
        assert new.tolist() == [i == 0 or rows[i - 1] != r for i, r in enumerate(rows)]


def test_blocks_take_no_more_bytes_than_their_numbers_need():
    columns = [np.arange(0, 70_000, 7), np.arange(10_000) % 251, np.ones(10_000, np.int64), np.linspace(-3, 0, 10_000).astype("<f4")]
    block = _packed(columns)
    assert all((a == b).all() for a, b in zip(_unpacked(block), columns, strict=True))
    assert np.frombuffer(block, "<i8", 2).tolist() == [10_000, 10_000 * 7]
    wide = [np.array([3, 1 << 40]), np.array([1 << 33, 0]), np.array([70_000, 1])]
    assert all((a == b).all() for a, b in zip(_unpacked(_packed(wide)), wide, strict=True))


def test_only_successors_are_not_searched(spark, monkeypatch):
    model = train(spark.createDataFrame([("a b c d e",)], "text string"), 3, 1)
    asked, place = [], EliasFano.place
    monkeypatch.setattr(EliasFano, "place", lambda self, x: asked.append(len(x)) or place(self, x))
    for text, found in (("a b c d e", 5 + 4), ("a c b", 0)):
        data, ends, n = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 0
        for at, shard, context, word, *_ in list(model.walk(data, ends, 3))[1:]:
            n += int((model.find(3 if n else 2, shard, context, word)[0] >= 0).sum())
        assert n == found
    assert sum(asked) == 0


def test_ngrams_are_looked_up_in_order():
    rng = np.random.default_rng(3)
    shard, context, word = rng.integers(0, 4, 3000), rng.integers(0, 9, 3000), rng.integers(-1, 9, 3000)
    one, back = Model(2, 2)._distinct(shard, context, word)
    rows = np.stack([shard, context, word], axis=1)
    assert (rows[one][back] == rows).all()
    found = list(map(tuple, rows[one].tolist()))
    assert found == sorted(set(found))


def toks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class Plain:
    """The same model in dictionaries, without quantisation."""

    def __init__(self, texts, order, least=2):
        self.grams = {n: Counter(tuple(t[i - n : i]) for t in map(toks, texts) for i in range(n, len(t) + 1)) for n in range(1, order + 1)}
        self.kept = {n: {g for g, c in x.items() if n == 1 or c >= least} for n, x in self.grams.items()}
        self.total, self.size, self.order = sum(self.grams[1].values()), len(self.grams[1]), order
        self.after = {n: {} for n in self.grams}
        for n in self.grams:
            for g in self.kept[n]:
                self.after[n].setdefault(g[:-1], []).append(g)

    def p(self, gram):
        if len(gram) == 1:
            return (self.grams[1][gram] + 0.1) / (self.total + 0.1 * (self.size + 1))
        n, context = len(gram), gram[:-1]
        if context not in self.kept[n - 1]:
            return self.p(gram[1:])
        of = self.grams[n - 1][context]
        rest = 1 - sum((self.grams[n][g] - DISCOUNT) / of for g in self.after[n].get(context, ()))
        own = (self.grams[n][gram] - DISCOUNT) / of if gram in self.kept[n] else 0
        return own + rest * self.p(gram[1:])

    def log(self, text):
        t = toks(text)
        return sum(math.log10(self.p(tuple(t[max(0, i + 1 - self.order) : i + 1]))) for i in range(len(t)))


@pytest.mark.parametrize("order", [2, 3])
def test_against_dictionaries(spark, sf, order):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(900001, None, ""), (900002, "", ""), (900003, "Zzz zzz qqq", ""), (None, "the of", "")]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, SCHEMA), order).collect()}
    held = {d: d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows}
    plain = Plain([t for d, t, _ in rows if not held[d]], order)
    assert len(got) == len(rows) and any(held.values())
    gain = 0
    for doc, text, _ in rows:
        row, t = got[doc], toks(text)
        base = sum(math.log10(plain.p((w,))) for w in t)
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[doc], len(t), plain.total)
        assert row.n_known == sum((w,) in plain.grams[1] for w in t)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert abs(row.score - plain.log(text)) < 0.02 * len(t)  # half a step of the codebook each
        gain += (row.score - row.base_score) * held[doc]
    assert gain > 0


def test_plain_model_sums_to_one():
    plain = Plain(["a b a b c", "a b c c", "b a b"], 3)
    for context in [("a",), ("b",), ("a", "b"), ("z", "b"), ("c", "c")]:
        words = [*plain.grams[1], ("unknown",)]
        assert sum(plain.p(context + w) for w in words) == pytest.approx(1)


def test_no_rows_and_all_held_out(spark):
    assert score(spark.createDataFrame([], SCHEMA)).count() == 0
    row = score(spark.createDataFrame([(None, "a b", "")], SCHEMA)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_query_keeps_every_trigram(spark, sf, monkeypatch):
    monkeypatch.setattr("postlabel.llm.ngram_lm.SHARD_NGRAMS", 20_000)  # several shards
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    plain = Plain([t for d, t in rows if zlib.crc32(str(d).encode()) % 10], 3, least=1)
    assert any(c == 1 for c in plain.grams[3].values())
    got = {r.doc_id: r.score for r in op9_ngram_lm(spark, sf).collect()}
    for doc, text in rows:
        assert abs(got[doc] - plain.log(text)) < 0.02 * len(toks(text))
