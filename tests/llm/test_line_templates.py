"""Against the same tree built in one pass over all lines."""

import random
import re
from collections import Counter, defaultdict

from postlabel.llm.line_templates import drop_recurring_lines

SCHEMA = "doc_id long, text string, row string"


def brute(docs, min_docs, depth=3, percent=80):
    """Kept text by document; lines are compared as token tuples."""
    lines, wordings = [], Counter()
    for doc, text, _ in docs:
        for no, line in enumerate((text or "").split("\n")):
            tokens = tuple("*" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line))
            if tokens:
                lines.append((doc, no, tokens))
                wordings[tokens] += 1
    leaves = defaultdict(list)
    for tokens in wordings:
        leaves[len(tokens), tokens[:depth]].append(tokens)
    return lines, wordings, leaves


def test_recurring_templates_go_but_for_the_first(spark):
    rng = random.Random(2)
    docs = []
    for i in range(30):
        own = [f"only{'abcdefghijklmnopqrstuvwxyz'[rng.randrange(26)]}{rng.random()} said {rng.choice('pqrs')} x{chr(97 + i)}yz" for _ in range(2)]
        name = "anna bert carl".split()[i % 3]
        text = [f"Posted on day {i} of may by {name} to all of you", own[0], "Share this", "", own[1].replace("0.", "zz")]
        docs.append((i, "\n".join(text), "r"))
    got = {r.row.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in drop_recurring_lines(spark.createDataFrame(docs, SCHEMA), 10).collect()}
    assert got[0] == (docs[0][1], 4, 0)
    for i in range(1, 30):
        text = docs[i][1].split("\n")
        # "Posted ..." differs in a number and a name: 11 of 12 tokens at least are fixed.
        assert got[i][0].split("\n")[-1] == text[4] and "Share this" not in got[i][0] and "Posted" not in got[i][0]


def test_exact_wordings_against_counts(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))), None) for i in range(60)]
    lines, _, _ = brute(docs, 5)
    holders = defaultdict(set)
    for doc, _, tokens in lines:  # up to three tokens the leaf is the whole line
        holders[tokens].add(doc)
    expected = {}
    for doc, text, _ in docs:
        keep = []
        for line in text.split("\n"):
            held = holders.get(tuple(line.split()), set())
            if not (len(held) >= 5 and doc > min(held)):
                keep.append(line)
        expected[doc] = "\n".join(keep)
    got = {r.row.doc_id: r.kept_text for r in drop_recurring_lines(spark.createDataFrame(docs, SCHEMA), 5).collect()}
    assert got == expected


def test_long_lines_recur_in_few_documents(spark):
    rng = random.Random(4)

    def line(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    planted, short, numbers = {k: line(55) for k in (2, 3, 9)}, line(8), " ".join("1" * 30)
    docs, at = [], 0
    for k, passage in planted.items():
        for _ in range(k):
            docs.append((at, "\n".join([line(12), passage, short if at < 9 else line(8), line(30)] + [numbers] * (at < 2)), None))
            at += 1
    copy = line(60)
    docs += [(100, copy, None), (101, copy, None)]  # whole copies are not this operator's
    got = {r.row.doc_id: (r.kept_text, r.n_dropped) for r in drop_recurring_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    firsts = {0, 2, 5, 100, 101}
    for doc, text, _ in docs:
        lines = text.split("\n")
        expected = text if doc in firsts else "\n".join(x for x in lines if x not in planted.values())
        assert got[doc] == (expected, int(doc not in firsts)), doc


def test_nulls_and_no_rows(spark):
    docs = [(1, None, None), (2, "", None), (None, "a b", None), (3, "a b", None), (3, "a b", None), (4, "\n \n", None)]
    got = sorted((r.row.doc_id or 0, r.kept_text, r.n_lines, r.n_dropped) for r in drop_recurring_lines(spark.createDataFrame(docs, SCHEMA), 2).collect() if r.row.doc_id != 1)
    assert got == [(0, "", 1, 1), (2, "", 0, 0), (3, "a b", 1, 0), (3, "a b", 1, 0), (4, "\n \n", 0, 0)]
    assert drop_recurring_lines(spark.createDataFrame([], SCHEMA), 2).count() == 0
