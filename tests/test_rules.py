import pytest

from postlabel.operators import report, rules
from queries.base import PLANTED, PLANTED_ROWS

SCHEMA = "ex_id BIGINT, ordinal BIGINT, text STRING, source STRING"


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(PLANTED_ROWS, SCHEMA)


def test_every_branch_fires(spark, planted):
    got = {r["ex_id"]: r["note"] for r in rules.label_posts(planted).collect()}
    assert got == {-i: note for i, (_, note) in enumerate(PLANTED, start=1)}
    fired = {note for _, note in PLANTED}
    assert fired == {r.note for r in rules.DEFAULT_RULES}
    assert len(rules.DEFAULT_RULES) == 30


def test_labels_follow_notes(planted):
    label_of = {}
    for r in rules.DEFAULT_RULES:
        label_of.setdefault(r.note, r.label)
    for r in rules.label_posts(planted).collect():
        assert r["label"] == label_of[r["note"]]


def test_word_boundaries_are_unicode(spark):
    texts = [
        ("éis the best team around the whole place", "short_opinion"),
        ("This is the best team around", "opinion_marker"),
        ("This is the best team around", "opinion_marker"),
        ("éshould go now", "short_opinion"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "ex_id INT, text STRING")
    got = {r["ex_id"]: r["note"] for r in rules.label_posts(df).collect()}
    assert got == {i: note for i, (_, note) in enumerate(texts)}


def test_null_text_is_skipped_and_null_source_is_a_post(spark):
    rows = [(1, None, "post"), (2, "Midfield depth wins titles", None)]
    df = spark.createDataFrame(rows, "ex_id INT, text STRING, source STRING")
    got = {r["ex_id"]: (r["label"], r["note"]) for r in rules.label_posts(df).collect()}
    assert got == {1: ("skip", "null_text"), 2: ("hot_take", "short_opinion")}
    assert [r["ex_id"] for r in rules.labelable(rules.label_posts(df)).collect()] == [2]


def test_first_match_is_head_of_all_matches(planted):
    both = rules.label_all_matches(rules.label_posts(planted))
    for r in both.collect():
        assert r["matches"][0] == r["note"]


def test_audit_differs_where_phrases_differ(spark):
    filler = "x" * 1600
    rows = [
        (1, "match events | via espn " + filler),
        (2, "[Wire] this should count"),
        (3, "a promo code inside"),
        (4, "Two tickets available"),
    ]
    df = spark.createDataFrame(rows, "ex_id INT, text STRING")
    diff = rules.ruleset_diff(df, rules.EXCLUSION_RULES, rules.AUDIT_RULES).collect()
    assert {tuple(r) for r in diff} == {
        ("match_thread_body", None, 1), (None, "news_post", 1), ("commercial", None, 1)
    }


def test_reports(planted):
    firing = {(r["label"], r["note"]): r["rows"] for r in report.rule_firing(rules.label_posts(planted)).collect()}
    assert firing[("ALL", "ALL")] == len(PLANTED)
    assert firing[("skip", "ALL")] == sum(note in {r.note for r in rules.EXCLUSION_RULES} for _, note in PLANTED)
    lines = {r["line"]: r["rows"] for r in report.skip_report(rules.skip_reason(planted)).collect()}
    assert lines["Total skipped"] + lines["Total kept"] == len(PLANTED)
    assert lines["too_long_article"] == 2


def test_shadowing_equals_the_lists_of_matches(spark, planted):
    """Rules under other names, so that the two of one note are told apart; a null text counts nowhere."""
    named = [rules.Rule(f"{i}", r.label, r.test, r.over, r.under) for i, r in enumerate(rules.DEFAULT_RULES, start=1)]
    rows = planted.unionByName(spark.createDataFrame([(-900, -900, None, "post")], SCHEMA))
    pairs, use = {}, {i: [0, 0, 0] for i in range(1, 31)}
    for r in rules.label_all_matches(planted, named).collect():
        first, *rest = (int(x) for x in r["matches"])
        use[first][0] += 1
        use[first][1] += 1
        for i in rest:
            pairs[first, i] = pairs.get((first, i), 0) + 1
            use[i][0] += 1
            use[i][2] += rules.DEFAULT_RULES[first - 1].label != rules.DEFAULT_RULES[i - 1].label
    matched = rules.match_bits(rows)
    got = report.shadowing(matched).collect()
    assert {(r["rule_no"], r["hidden_no"]): r["rows"] for r in got} == pairs
    for r in got:
        a, b = rules.DEFAULT_RULES[r["rule_no"] - 1], rules.DEFAULT_RULES[r["hidden_no"] - 1]
        assert (r["rule"], r["hidden"], r["other_label"]) == (a.note, b.note, a.label != b.label)
    listed = report.rule_use(matched).collect()
    assert {r["rule_no"]: [r["matches"], r["decides"], r["relabelled"]] for r in listed} == use
    assert all(r["hidden"] == r["matches"] - r["decides"] and r["never_decides"] == (r["decides"] == 0) for r in listed)


def test_a_rule_that_never_decides_is_named(spark):
    mine = (rules.Rule("any", "analysis"), rules.Rule("never first", "reaction", over=3), rules.Rule("no match", "skip", over=99))
    df = spark.createDataFrame([(1, "abcd"), (2, "B")], "ex_id INT, text STRING")
    got = {r["rule"]: (r["matches"], r["decides"], r["relabelled"], r["never_decides"]) for r in report.rule_use(rules.match_bits(df, mine), mine).collect()}
    assert got == {"any": (2, 2, 0, False), "never first": (1, 0, 1, True), "no match": (0, 0, 0, True)}
    assert report.shadowing(rules.match_bits(df.limit(0), mine), mine).count() == 0
    with pytest.raises(ValueError):
        rules.match_bits(df, mine * 30)


def test_sets_of_rules_are_counted_not_texts(planted, capsys):
    report.shadowing(rules.match_bits(planted)).explain()
    plan = capsys.readouterr().out
    assert "PythonUDF" not in plan and plan.count("Generate explode") == 1
    # The explode stands above the counts of sets.
    assert plan.index("Generate explode") < plan.index("keys=[bits")


def test_label_does_not_depend_on_partitions(planted):
    want = sorted(map(tuple, rules.label_posts(planted).select("ex_id", "note").collect()))
    for n in (1, 3, 8):
        got = rules.label_posts(planted.repartition(n)).select("ex_id", "note").collect()
        assert sorted(map(tuple, got)) == want


def test_cascade_is_planned_once(planted, capsys):
    rules.labelable(rules.label_posts(planted)).select("ex_id", "label").explain()
    plan = capsys.readouterr().out
    assert plan.count("tickets available") == 1
    assert "PythonUDF" not in plan and "Exchange" not in plan


def test_own_rules(spark):
    mine = (
        rules.Rule("long", "analysis", over=3),
        rules.Rule("has b", "reaction", lambda p: p.lower.contains("b")),
    )
    df = spark.createDataFrame([(1, "abcd"), (2, "B"), (3, "c")], "ex_id INT, text STRING")
    got = rules.label_posts(df, mine).orderBy("ex_id").select("label", "note").collect()
    assert [tuple(r) for r in got] == [("analysis", "long"), ("reaction", "has b"), (None, None)]


def test_guards_let_every_match_through(spark):
    """Texts made of the patterns' own words, so that most patterns match some of them."""
    import random
    import re

    from pyspark.sql import functions as F

    from postlabel import fixed

    patterns = [*fixed.OPINION_MARKERS, *fixed.JUDGMENTS, fixed.HEDGES]
    guards = [*rules.OPINION_GUARDS, *rules.JUDGMENT_GUARDS, rules.HEDGE_GUARD]
    rng = random.Random(3)
    pieces = [w for p in patterns for w in re.findall(r"[a-z' ]+", p.replace(r"\b", "|").replace(r"\s+", " "))]
    pieces += ["deserves to", "proves", "can't", "can’t", "doesn't", "x", ".", "\n", "i stop", "we can't", "why is", "how can"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    df = rules.text_features(spark.createDataFrame([(t,) for t in texts], "text STRING"))
    df = df.withColumn("source", F.lit("post"))
    post = rules._post()
    guarded = [rules._finds(p, g)(post).alias(f"c{i}") for i, (p, g) in enumerate(zip(patterns, guards, strict=True))]
    found = [0] * len(patterns)
    for row in df.select("tl", *guarded).collect():
        for i, pattern in enumerate(patterns):
            want = re.search(pattern, row["tl"]) is not None
            found[i] += want
            assert row[f"c{i}"] == want, (pattern, row["tl"])
    assert min(found) > 0, found
