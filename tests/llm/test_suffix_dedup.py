"""Against a brute force over every 50-byte window."""

import hashlib
import random

from postlabel.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, at long"


def brute(rows, span=50):
    least = {}
    for doc, text, _ in rows:
        data = (text or "").encode()
        for i in range(len(data) - span + 1):
            key = data[i : i + span]
            least[key] = min(least.get(key, doc), doc)
    out = {}
    for doc, text, _ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - span + 1):
            if least[data[i : i + span]] < doc:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.setdefault(doc, []).append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def ours(spark, rows):
    out = {}
    for r in suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {k: sorted(v) for k, v in out.items()}


def test_against_every_window(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(20, 140))) for _ in range(40)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))), i) for i in range(120)]
    assert ours(spark, rows) == brute(rows)


def test_runs_edges_nulls_and_repeated_rows(spark):
    rows = [
        (9, "x" * 3000, 0), (4, "x" * 49, 0), (5, "x" * 50, 0), (6, "y" + "x" * 51, 0), (1, None, 0), (2, "", 0),
        (7, "y" + "x" * 51, 0), (7, "y" + "x" * 51, 1), (7, "z" * 60, 2), (8, "é" * 25, 0), (3, "é" * 25 + "q", 0),
    ]
    assert ours(spark, rows) == brute(rows)


def test_no_rows_and_null_id(spark):
    assert ours(spark, []) == {}
    got = ours(spark, [(None, "k" * 80, 0), (3, "k" * 80, 0)])
    assert got[3][0][1] == 0 and got[None][0][1] == 80
