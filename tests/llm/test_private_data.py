"""Patterns against plain search, Viterbi against enumeration, unseen lines, long texts, odd rows."""

import itertools
import random
import re

import numpy as np

from postlabel.llm.private_data import KINDS, LABELLED, NEVER, allowed_moves, find_private, luhn, op11_private_data, parsed, pattern_spans, redact, stretches, train, viterbi
from postlabel.llm.vector import CHUNK_BYTES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Lines whose numbers and names are not in the labelled table.
UNSEEN = (
    "ask ⟦phone:(305) 555-2290⟧ for it",
    "thtion ⟦phone:305-555-2290⟧ ndwhst",
    "or ⟦phone:702.555.8846⟧, they",
    "to ⟦email:omar.ek (at) example.net⟧ and",
    "to ⟦email:lucy[at]mail7.example.org⟧ and",
    "to ⟦email:tom (at) example (dot) com⟧ and",
    "node ⟦ip:198[.]18[.]0[.]44⟧ fell",
    "with ⟦card:4716.1083.9971.5307⟧ then",
    "in 1987, 1992 and 2011 (again) it won 4-2",
    "section 7.2. of version 2.0.1, see [12] and (3)",
    "7c211433f02071597741e6ff5a8ea34789abbf43",
    "on 2019-11-30 at 18:45 for 19.99 each",
)


def plain(text):
    """The contract's patterns, word for word."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_patterns_against_plain_search():
    rng = random.Random(3)
    pieces = ["a.b", "@", "x@y.z", "1.2.3.4", "1.2.3.4.5.6", "256.1.1.1", "0007.0.0.1", "+1 (743) 555-3824", "+", "4068516892505468", "4068 5168-9250 5468", " ", "-", ".", "é", "+1234567", "@a.b@c.d", "9", "..", "(", "\n", "A%b_c-d@e-f.g"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pattern_spans(text) == plain(text), text


def test_long_digits_and_letters_take_linear_time():
    text = "1" * 200_000 + " " + "a" * 200_000 + " " + "a." * 100_000 + "@ " + "@" * 100_000 + "+1" * 50_000
    assert pattern_spans(text) == []


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(4)
    first = np.array([0, 3, 4, 8, 8])
    scores = rng.normal(size=(8, 4))
    moves = rng.normal(size=(4, 4))
    moves[2, 3] = NEVER
    got = viterbi(scores, first, moves)
    for a, b in zip(first[:-1], first[1:]):
        def value(path):
            steps = [0, *path, 0]
            return sum(scores[a + i, y] for i, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(steps[:-1], steps[1:]))

        assert tuple(got[a:b]) == max(itertools.product(range(4), repeat=b - a), key=value) if b > a else True
    assert allowed_moves()[0].tolist() == [True, True] + [False, True] * 3 + [False]


def test_stretches():
    marked = np.array([0, 0, 1, 0, 0, 0, 1, 1, 0, 1], bool)
    begin, end = stretches(marked, np.array([0, 3, 3, 9, 10]))
    assert list(zip(begin.tolist(), end.tolist())) == [(1, 3), (5, 9), (9, 10)]
    assert [x.tolist() for x in stretches(np.zeros(0, bool), np.array([0]))] == [[], []]


def spans_of(spark, lines):
    rows = [(i, line) for i, line in enumerate(lines)]
    found = find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.row.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found}


def test_labelled_and_unseen_lines(spark):
    for lines, least in ((LABELLED, 1.0), (UNSEEN, 1.0)):
        texts, truth = zip(*(parsed(x) for x in lines))
        got = spans_of(spark, texts)
        right = sum(got[i] == [(KINDS[k], s, e) for k, s, e in spans] for i, spans in enumerate(truth))
        wrong = [(texts[i], got[i]) for i, spans in enumerate(truth) if got[i] != [(KINDS[k], s, e) for k, s, e in spans]]
        assert right >= least * len(lines), wrong


def test_pattern_spans_stay_and_redaction(spark):
    text = "é mail a.b@c.de, +1 (743) 555-3824%%% or (743) 555-3824!!"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = redact(find_private(rows)).first()
    assert [(s.kind, text[s.start : s.end], s.by_pattern) for s in r.spans] == [("email", "a.b@c.de", True), ("phone", "+1 (743) 555-3824", True), ("phone", "(743) 555-3824", False)]
    assert r.redacted == "é mail [email], [phone]%%% or [phone]!!"


def test_whole_table_against_plain_search(spark, sf):
    """Base counts and spans of every document; what the field adds touches none of them."""
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op11_private_data(spark, sf).collect():
        base = plain(texts[r.doc_id])
        lines = [f"{KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(lines).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in range(4)]
        every = r.spans.split(",") if r.spans else []
        assert set(lines) <= set(every)


def test_text_longer_than_a_chunk(spark):
    filler = "étude 12 of the house (old) " * 90_000
    text = filler + "a.b@c.de (743) 555-3824 "
    assert len(text.encode()) > CHUNK_BYTES
    got = spans_of(spark, [text, "x", text[-30:]])
    n = len(filler)
    assert got[0] == [("email", n, n + 8), ("phone", n + 9, n + 23)] and got[1] == []


def test_odd_rows(spark):
    schema = "doc_id long, text string, spans string, row int"
    rows = [(None, "a@b.c", None, 1), (1, None, "x", None), (1, "", "x", None), (1, None, "x", None)]
    got = redact(find_private(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.row.doc_id or 0, len(r.spans), r.redacted or "-") for r in got) == [(0, 1, "[email]"), (1, 0, "-"), (1, 0, "-"), (1, 0, "-")]
    assert find_private(spark.createDataFrame([], schema)).count() == 0


def test_training_is_repeatable():
    assert np.array_equal(train(LABELLED).weights, train.__wrapped__(LABELLED).weights)
