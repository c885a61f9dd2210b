"""Text expressions against Python's own str and re."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions import text as tx

PATTERNS = {
    name: value
    for name, value in vars(fixed).items()
    if name
    in {
        "NEWS_SOURCE", "SCORE_UPDATE", "RESULT_LINE", "YEAR",
        "OPINIONATED_QUESTION", "QUOTE_OPENER", "BOLD_CLAIM", "HEDGES",
    }
}
PATTERNS |= {f"opinion {i}": p for i, p in enumerate(fixed.OPINION_MARKERS)}
PATTERNS |= {f"judgment {i}": p for i, p in enumerate(fixed.JUDGMENTS)}

# Words of the patterns between characters that regex dialects disagree about.
PIECES = (
    "is was overrated best than better should be win will never the greatest ever not beat "
    "proves point letting embarrassing i stop can't why does fire him [Daily] [2] - 1 2 3-1 7–1 "
    "2018 1999 x2020 is. é isé éis _is 1is ́ ٠١ ⅕ ² : \"   "
    "  　 \x85 \x1c \x0b ​ ﻿   \r \n \t ( ) team first player what a lol"
).split(" ") + [" ", "  ", " ", "\n", "\x1c"]


def _texts(n=1500):
    import random

    rng = random.Random(7)
    texts = ["", " ", "\n"]
    for _ in range(n):
        texts.append("".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 9))))
    return texts


def test_patterns_find_what_python_finds(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    names = list(PATTERNS)
    rows = df.select("i", *[F.col("t").rlike(tx.java_regex(PATTERNS[n])).alias(f"c{k}") for k, n in enumerate(names)]).collect()
    hits = 0
    for row in rows:
        for k, name in enumerate(names):
            want = re.search(PATTERNS[name], texts[row["i"]]) is not None
            hits += want
            assert row[f"c{k}"] == want, (name, texts[row["i"]])
    assert hits > 500


def test_alternation_is_any_of_its_patterns(spark):
    texts = _texts(400)
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    for i, found in df.select("i", tx.matches_any(F.col("t"), fixed.JUDGMENTS)).collect():
        assert found == any(re.search(p, texts[i]) for p in fixed.JUDGMENTS)


def test_year_count(spark):
    texts = _texts(400) + ["2018 2019 2020", "2018,2019", "12018 20190", "1899 1900"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    for i, n in df.select("i", tx.count_matches(F.col("t"), fixed.YEAR)).collect():
        assert n == len(re.findall(fixed.YEAR, texts[i]))


def test_strip_and_length_agree_on_every_bmp_character(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}a{c}b{c}" for c in chars]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = df.select(
        "i", tx.strip_ws(F.col("t")), F.length("t"), tx.collapse_ws(F.col("t"))
    ).collect()
    for i, stripped, n, collapsed in got:
        assert stripped == texts[i].strip()
        assert n == len(texts[i])
        assert collapsed == " ".join(texts[i].split())


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=30), min_size=1, max_size=40))
def test_scalars_on_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    c = F.col("t")
    rows = df.select(
        "i",
        tx.collapse_ws(c).alias("collapsed"),
        tx.head_segment(c).alias("head"),
        tx.preview(c, 5, ellipsis=True).alias("shown"),
        tx.count_char(c, "a").alias("n"),
        tx.ends_with_question(c).alias("q"),
    ).collect()
    for r in rows:
        t = texts[r["i"]]
        assert r["collapsed"] == " ".join(t.split())
        assert r["head"] == t.split("--")[0].strip()
        assert r["shown"] == t[:5] + ("..." if len(t) > 5 else "")
        assert r["n"] == t.count("a")
        assert r["q"] == t.strip().endswith("?")


def test_compose_text(spark):
    rows = [("T", "body"), ("T", ""), ("T", "[deleted]"), ("T", "[removed]")]
    df = spark.createDataFrame(rows, "a STRING, b STRING")
    got = [r[0] for r in df.select(tx.compose_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["T -- body", "T", "T", "T"]


def test_keywords_are_substrings_and_count_once(spark):
    df = spark.createDataFrame([("an album; xg xg formation",)], "t STRING")
    c = F.col("t")
    row = df.select(
        tx.contains_any(c, ["bum"]).alias("any"),
        tx.keyword_hits(c, fixed.ANALYTICAL_TERMS).alias("hits"),
    ).first()
    assert row["any"] and row["hits"] == 2


def test_threads(spark):
    rows = [("Match Thread: A v B", 900), ("[FT] A 1-0 B", None), ("Busy", 151), ("Quiet", 150), (None, None)]
    df = spark.createDataFrame(rows, "title STRING, n INT")
    got = df.select(
        tx.is_match_thread(F.col("title")), tx.is_discussion(F.col("title"), F.col("n"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, False), (True, False), (False, True), (False, False), (False, False)
    ]
