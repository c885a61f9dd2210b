import dataclasses
from datetime import datetime, timedelta

import pytest

from postlabel import fixed
from postlabel.operators import collect
from postlabel.plans import jobs

ANCHOR = datetime(2024, 6, 30)
POSTS = "id STRING, created_utc TIMESTAMP, title STRING, selftext STRING, num_comments INT"
COMMENTS = "id STRING, post_id STRING, created_utc TIMESTAMP, body STRING"


def _ago(days):
    return ANCHOR - timedelta(days=days)


def test_window_bounds():
    bounds = collect.window_bounds(ANCHOR)
    assert bounds[0] == ("last 7 days", _ago(7), ANCHOR)
    assert [b[0] for b in bounds] == [w[0] for w in fixed.FIRST_PASS_WINDOWS]
    assert bounds[3][1:] == (_ago(180), _ago(90))


def test_boundary_belongs_to_one_window(spark):
    df = spark.createDataFrame([("a", _ago(7)), ("b", ANCHOR), ("c", _ago(180)), ("d", _ago(-1))], "id STRING, created_utc TIMESTAMP")
    got = {(r["id"], r["window_no"]) for r in collect.assign_windows(df, collect.window_bounds(ANCHOR)).collect()}
    assert got == {("a", 1), ("b", 0)}


def test_newest_per_window_and_id_dedupe(spark):
    rows = [(f"p{i}", ANCHOR - timedelta(hours=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id STRING, created_utc TIMESTAMP")
    bounds = collect.window_bounds(ANCHOR, (("day", 0, 1), ("week", 0, 7)))
    newest = collect.newest_per_window(df, bounds, 20)
    assert {r["id"] for r in newest.collect()} == {f"p{i}" for i in range(20)}
    assert newest.count() == 40
    once = collect.dedupe_id(newest).collect()
    assert len(once) == 20 and {r["window_no"] for r in once} == {0}


@pytest.fixture(scope="module")
def archive(spark):
    posts = []
    for i in range(12):
        posts.append((f"m{i:02}", _ago(1) - timedelta(minutes=i), f"Match Thread: game {i}", "", 5))
    for i in range(10):
        posts.append((f"d{i}", _ago(2) - timedelta(minutes=i), f"Discussion number {i} about the long season ahead", "body text", 151 + i))
    posts.append(("quiet", _ago(2), "Quiet", "", 150))
    posts.append(("old", _ago(300), "An old discussion with many many comments below", " x\ny ", 301))
    comments = []
    for post in ["m00", "m11", "d0", "old"]:
        for i in range(40):
            comments.append((f"{post}c{i:02}", post, _ago(0) - timedelta(minutes=i), f"comment {i} of {post} " + "word " * (30 if post == "old" else 10)))
    comments.append(("gone", "m00", ANCHOR, "[deleted]"))
    comments.append(("tiny", "m00", ANCHOR, "too short"))
    return spark.createDataFrame(posts, POSTS), spark.createDataFrame(comments, COMMENTS)


def test_threads_have_quotas(archive):
    threads = jobs.threads_of(archive[0], ANCHOR).collect()
    match = [r["post_id"] for r in threads if r["source"] == "match_thread_comment"]
    discuss = [r["post_id"] for r in threads if r["source"] == "discussion_comment"]
    assert sorted(match) == [f"m{i:02}" for i in range(8)]
    assert sorted(discuss) == [f"d{i}" for i in range(6)]


def test_comments_of_chosen_threads(archive):
    rows = jobs.collect_comments(*archive, ANCHOR).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r["id"])
    # The tombstone and the short comment are among the newest 25, then dropped.
    assert sorted(by["match_thread_comment"]) == [f"m00c{i:02}" for i in range(23)]
    assert sorted(by["discussion_comment"]) == [f"d0c{i:02}" for i in range(15)]


def test_a_pass_may_ask_for_more_comments(spark):
    posts = spark.createDataFrame([("m", _ago(1), "Match Thread: Reds v Blues", "", 500)], POSTS)
    rows = [(f"c{i:03}", "m", ANCHOR - timedelta(minutes=i), f"A comment of forty characters at least, no {i:03}") for i in range(90)]
    more = dataclasses.replace(jobs.FIRST_PASS, threads={"match_comments": 50})
    comments = spark.createDataFrame(rows, COMMENTS)
    assert jobs.collect_comments(posts, comments, ANCHOR, more).count() == 50
    assert jobs.collect_comments(posts, comments, ANCHOR).count() == fixed.MATCH_THREAD_COMMENTS


def test_extra_pass(archive):
    rows = jobs.collect_corpus(*archive, ANCHOR, jobs.EXTRA_PASS).collect()
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    assert len(sources["discussion_comment_older"]) == 20
    assert [r["text"] for r in sources["post_older"]] == ["An old discussion with many many comments below -- x\ny"]


def test_corpus_drops_repeated_texts(spark, archive):
    posts, comments = archive
    twin = spark.createDataFrame([("twin", _ago(3), "Discussion number 0 about the long season ahead", "body text", 0)], POSTS)
    once = jobs.collect_corpus(posts, comments, ANCHOR).collect()
    twice = jobs.collect_corpus(posts.union(twin), comments, ANCHOR).collect()
    assert sorted(r["id"] for r in once) == sorted(r["id"] for r in twice)


def test_empty_inputs(spark):
    posts, comments = spark.createDataFrame([], POSTS), spark.createDataFrame([], COMMENTS)
    assert jobs.collect_corpus(posts, comments, ANCHOR).count() == 0
