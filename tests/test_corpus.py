import pytest

from postlabel.operators import corpus, report
from postlabel.plans import weak_label_job


def _examples(spark, rows):
    return spark.createDataFrame(rows, "ex_id BIGINT, ordinal BIGINT, text STRING, source STRING")


def test_dedupe_keeps_the_first_whatever_the_partitions(spark):
    # A third of all rows is one text.
    rows = [(i, 1000 - i, "hot" if i % 3 == 0 else f"t{i % 50}", "post") for i in range(600)]
    want = {}
    for ex_id, ordinal, text, _ in rows:
        want[text] = min(want.get(text, (10**9, 0)), (ordinal, ex_id))
    for n in (1, 3, 8):
        got = corpus.dedupe_text(_examples(spark, rows).repartition(n)).collect()
        assert {r["text"]: (r["ordinal"], r["ex_id"]) for r in got} == want
        assert len(got) == len(want)


def test_union_keeps_input_order(spark):
    a = _examples(spark, [(1, 5, "same", "post")])
    b = _examples(spark, [(2, 1, "same", "post")])
    kept = corpus.dedupe_text(corpus.union_all(a, b), corpus.INPUT_ORDER).collect()
    assert [r["ex_id"] for r in kept] == [1]


@pytest.fixture(scope="module")
def labelled(spark):
    sizes = {"analysis": 79, "hot_take": 80, "reaction": 80}
    rows = []
    for label, n in sizes.items():
        for i in range(n):
            rows.append((len(rows), len(rows), "x" * (i % 7 + 1) + f"{label}{i}", label))
    return spark.createDataFrame(rows, "ex_id BIGINT, ordinal BIGINT, text STRING, label STRING")


def test_split_sizes(labelled):
    split = corpus.stratified_split(labelled)
    sizes = {(r["split"], r["label"]): r["rows"] for r in report.split_sizes(split).collect()}
    assert [sizes[(s, "ALL")] for s in corpus.SPLITS] == [167, 36, 36]
    assert [sizes[("train", n)] for n in ("analysis", "hot_take", "reaction")] == [55, 56, 56]
    assert {sizes[(s, n)] for s in ("val", "test") for n in ("analysis", "hot_take", "reaction")} == {12}
    assert sizes[("ALL", "ALL")] == 239
    assert all(r["shared"] == 0 for r in corpus.split_overlap(split).collect())


def test_split_is_stable(labelled):
    want = sorted(map(tuple, corpus.stratified_split(labelled).select("ex_id", "split").collect()))
    got = corpus.stratified_split(labelled.repartition(5)).select("ex_id", "split").collect()
    assert sorted(map(tuple, got)) == want
    other = corpus.stratified_split(labelled, seed=7).select("ex_id", "split").collect()
    assert sorted(map(tuple, other)) != want


def test_overlap_is_found(spark):
    rows = [(1, "a", "train"), (1, "b", "val"), (2, "c", "train"), (3, "c", "test")]
    df = spark.createDataFrame(rows, "ex_id BIGINT, text STRING, split STRING")
    got = {r["kind"]: (r["keys"], r["shared"]) for r in corpus.split_overlap(df).collect()}
    assert got == {"id": (3, 1), "text": (3, 1)}


def test_caps(labelled):
    rows = labelled.collect()
    capped = corpus.cap_preferring(labelled, 10).collect()
    by_label = {}
    for r in capped:
        by_label.setdefault(r["label"], []).append(r)
    assert {k: len(v) for k, v in by_label.items()} == {"analysis": 10, "hot_take": 10, "reaction": 10}
    longest = sorted((r for r in rows if r["label"] == "analysis"), key=lambda r: (-len(r["text"]), r["ordinal"]))
    assert {r["ex_id"] for r in by_label["analysis"]} == {r["ex_id"] for r in longest[:10]}
    assert {r["ex_id"] for r in by_label["reaction"]} == set(range(159, 169))
    random = corpus.cap_random(labelled, 10).groupBy("label").count().collect()
    assert {r["count"] for r in random} == {10}
    assert corpus.cap_random(labelled, 10**6).count() == 239
    assert corpus.cap_preferring(labelled, 10**6).count() == 239


def test_a_cap_beyond_the_pruning_equals_one_below(spark, labelled):
    from postlabel.operators import ranking

    small = {r["ex_id"] for r in corpus.cap_preferring(labelled, 50).collect()}
    before = spark.conf.get(ranking.PRUNING)
    spark.conf.set(ranking.PRUNING, "1")
    try:
        assert {r["ex_id"] for r in corpus.cap_preferring(labelled, 50).collect()} == small
    finally:
        spark.conf.set(ranking.PRUNING, before)


def test_several_reviews_of_a_row(spark, labelled):
    rows = [
        (0, "a", "2024-01-01 00:00:00", "change", "reaction"), (0, "b", "2024-01-02 00:00:00", "confirm", None),
        (1, "a", "2024-01-01 00:00:00", "drop", None), (1, "b", "2024-01-01 00:00:00", "change", "reaction"),
        (2, "a", "2024-01-01 00:00:00", "confirm", None), (2, "a", "2024-01-01 00:00:00", "drop", None),
        (3, "a", None, "drop", None), (3, "a", "2024-01-01 00:00:00", "change", "hot_take"),
        (4, "a", "2024-01-01 00:00:00", "change", None), (4, "a", "2024-01-01 00:00:00", "change", None),
        (5, "a", "2024-01-01 00:00:00", "what", None), (5, "b", "2023-01-01 00:00:00", "change", "reaction"),
        (None, "a", "2024-01-01 00:00:00", "drop", None),
    ]
    reviews = spark.createDataFrame(rows, "ex_id BIGINT, reviewer STRING, reviewed_at STRING, decision STRING, label STRING")
    reviews = reviews.withColumn("reviewed_at", reviews["reviewed_at"].cast("timestamp"))
    for n in (1, 7):
        resolved = {r["ex_id"]: (r["decision"], r["label"]) for r in corpus.resolve_reviews(reviews.repartition(n)).collect()}
        assert resolved == {
            0: ("confirm", None), 1: ("change", "reaction"), 2: ("drop", None), 3: ("change", "hot_take"),
            4: ("confirm", None), 5: ("change", "reaction"),
        }
        got = corpus.apply_reviews(labelled, reviews.repartition(n)).collect()
        assert len(got) == len({r["ex_id"] for r in got}) == 238
        assert {r["ex_id"]: r["label"] for r in got if r["ex_id"] < 6} == {0: "analysis", 1: "reaction", 3: "hot_take", 4: "analysis", 5: "reaction"}
    conflicts = {r["ex_id"]: (r["reviews"], r["decisions"], r["labels"]) for r in corpus.review_conflicts(reviews).collect()}
    assert set(conflicts) == {0, 1, 2, 3, 5} and conflicts[0] == (2, ["change", "confirm"], ["reaction"])


def test_context_prefixes(spark):
    from postlabel import fixed

    sources = ["post", "post_older", None, fixed.MATCH_THREAD_COMMENT, fixed.DISCUSSION_COMMENT, fixed.DISCUSSION_COMMENT_OLDER]
    df = spark.createDataFrame([(s, "T", "x") for s in sources] + [(fixed.MATCH_THREAD_COMMENT, " ", "x")], "source STRING, title STRING, text STRING")
    plain = [r["text"] for r in corpus.add_context_prefix(df).collect()]
    assert plain == ["Standalone post: x"] * 3 + ["Match thread comment: x"] + ["Discussion comment: x"] * 2 + ["Match thread comment: x"]
    titled = [r["text"] for r in corpus.add_context_prefix(df, title="title").collect()]
    assert titled == ["Standalone post: x"] * 3 + ["Match thread comment: T -- x"] + ["Discussion comment: T -- x"] * 2 + ["Match thread comment: x"]


def test_reviews(spark, labelled):
    reviews = spark.createDataFrame(
        [(0, None, "confirm"), (1, "reaction", "change"), (2, None, "drop")],
        "ex_id BIGINT, label STRING, decision STRING",
    )
    got = {r["ex_id"]: (r["label"], r["status"]) for r in corpus.apply_reviews(labelled, reviews).collect()}
    assert len(got) == 238 and 2 not in got
    assert got[0] == ("analysis", "reviewed")
    assert got[1] == ("reaction", "reviewed")
    assert got[3] == ("analysis", "pre-labeled")


def test_unknown_and_valid_labels(spark):
    df = spark.createDataFrame([("analysis",), ("meh",), ("meh",), (None,)], "label STRING")
    assert {tuple(r) for r in corpus.unknown_labels(df).collect()} == {("meh", 2), (None, 1)}
    assert [tuple(r) for r in corpus.valid_label(df).collect()] == [("analysis", 0)]


def test_balance_counts_absent_labels(spark):
    df = spark.createDataFrame([("analysis",)] * 60 + [("hot_take",)] * 20, "label STRING")
    got = {r["label"]: tuple(r)[1:] for r in report.balance_check(df).collect()}
    assert got == {
        "analysis": (60, 0.75, True, False), "hot_take": (20, 0.25, False, True),
        "reaction": (0, 0.0, False, True),
    }


def test_distribution(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label STRING")
    assert [tuple(r) for r in report.distribution(df, "label").collect()] == [("a", 3, 75.0), ("b", 1, 25.0)]


def test_weak_label_job_conserves_rows(spark, sf):
    from queries.base import examples, turns

    a, b = examples(spark, sf), turns(spark, sf)
    job = weak_label_job(a, b, cap=10**6)
    kept = job.count()
    from postlabel.operators import rules

    united = corpus.dedupe_text(corpus.union_all(a, b), corpus.INPUT_ORDER)
    skipped = rules.label_posts(united).where("label = 'skip'").count()
    assert kept + skipped == a.union(b.select(*a.columns)).select("text").distinct().count()
    keys = [r["shuffle_key"] for r in job.collect()]
    assert keys == sorted(keys)


def test_split_by_hash_is_about_right(spark):
    ids = spark.range(20000).withColumnRenamed("id", "ex_id")
    counts = {r["split"]: r["count"] for r in corpus.split_by_hash(ids).groupBy("split").count().collect()}
    assert abs(counts["train"] / 20000 - 0.70) < 0.02
    assert abs(counts["val"] / 20000 - 0.15) < 0.02


def test_context_prefix_and_blank(spark):
    df = spark.createDataFrame(
        [("hi", "match_thread_comment"), ("yo", "post"), (" \n", "post")], "text STRING, source STRING"
    )
    got = [r["text"] for r in corpus.add_context_prefix(corpus.non_blank(df)).collect()]
    assert got == ["Match thread comment: hi", "Standalone post: yo"]
    renamed = corpus.rename_columns(df, {"text": "post"})
    assert renamed.columns == ["post", "source"]
