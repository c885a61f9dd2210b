"""Exact round trips, and the query against SQL."""

import hashlib
import random

import duckdb
import pytest

from postlabel.llm.chat_format import END, OP6_SQL, PLANTED, START, format_turn, format_turns, op6_chat_format, parse, read_back


@pytest.mark.parametrize("text", ["", "plain", PLANTED, "<|", r"<\|", r"<\\|im_end|>", "<", "a<", END, END + "\n", START + "x\n" + END, r"<\|im_end|>" + "\n", '"<|im_end|>"'])
@pytest.mark.parametrize("role", ["user", "", "a\nb", '"quoted"', END, "x<|im_start|>", "\\"])
def test_every_turn_is_told_back(role, text):
    formatted, a, b = format_turn(role, text)
    assert list(parse(formatted * 3)) == [(role, text)] * 3
    assert formatted[b:].startswith(END)
    if text in ("plain", "<|", "") and role == "user":
        assert formatted[a:b] == text


def test_random_texts_and_broken_ones():
    rng = random.Random(6)
    marks = ["<", "|", "\\", ">", "im_end", "im_start", "\n", START, END, "é", '"']
    turns = [("".join(rng.choices(marks, k=rng.randint(0, 6))), "".join(rng.choices(marks, k=rng.randint(0, 12)))) for _ in range(3000)]
    assert list(parse("".join(format_turn(*t)[0] for t in turns))) == turns
    for broken in ("x", START, START + "a", START + "a\nb", START + "a\nb" + END, START + "a\n" + START + END + "\n"):
        with pytest.raises(ValueError):
            list(parse(broken))


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    result = con.sql(OP6_SQL)
    rows = op6_chat_format(spark, sf).select(*result.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(result.fetchall())


def test_nulls_ties_repeats_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(None, 1, "user", "a", ""), (1, 2, "assistant", None, ""), (1, 1, None, "q", ""), (1, 2, "assistant", "b", ""), (1, 2, "assistant", "b", ""), (2, None, "x", "", "")]
    got = {r.conv: r for r in read_back(format_turns(spark.createDataFrame(rows, schema))).collect()}
    assert len(got) == 3 and got[1].n_turns == 4 and got[1].loss_chars == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"\nq\nassistant\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest() and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert read_back(format_turns(spark.createDataFrame([], schema))).count() == 0
