"""The three jobs: collect a corpus, label it weakly, evaluate two models on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.text import collapse_ws, compose_text, not_tombstone, strip_ws
from postlabel.operators import corpus
from postlabel.operators.collect import (
    comments_for_threads,
    dedupe_id,
    min_length,
    newest_per_thread,
    newest_per_window,
    newest_threads,
    pick_threads,
    window_bounds,
)
from postlabel.operators.metrics import align, class_report, compare_models, model_comparison
from postlabel.operators.rules import DEFAULT_RULES, Rule, label_posts, labelable

COLLECTED_ORDER = ("part", "kind", "group_no", "thread_no", "rank", "id")
COLLECTED = (*COLLECTED_ORDER, "text", "source")


@dataclass(frozen=True)
class Pass:
    """What one collection pass fetches and keeps."""

    windows: Sequence[tuple[str, int, int]]
    post_source: str
    clean: Callable[[Column], Column]
    unique_ids: bool
    min_post: int
    strict: bool
    thread_windows: Sequence[tuple[str, int, int]]
    threads: dict
    min_comment: int


FIRST_PASS = Pass(
    windows=fixed.FIRST_PASS_WINDOWS,
    post_source=fixed.POST,
    clean=collapse_ws,
    unique_ids=True,
    min_post=fixed.MIN_POST_LENGTH,
    strict=False,
    thread_windows=(("threads", 0, fixed.THREAD_DAYS),),
    threads={},
    min_comment=fixed.MIN_POST_LENGTH,
)

# The second pass keeps inner newlines, does not look for repeated ids, has strict
# limits and takes no match threads.
EXTRA_PASS = Pass(
    windows=fixed.EXTRA_PASS_WINDOWS,
    post_source=fixed.POST_OLDER,
    clean=strip_ws,
    unique_ids=False,
    min_post=fixed.MIN_POST_LENGTH,
    strict=True,
    thread_windows=fixed.EXTRA_PASS_WINDOWS[:2],
    threads=dict(
        match_threads=0,
        discussions=fixed.EXTRA_THREADS,
        min_comments=fixed.EXTRA_MIN_COMMENTS,
        keywords=fixed.EXTRA_MATCH_THREAD_KEYWORDS,
        discussion_source=fixed.DISCUSSION_COMMENT_OLDER,
        discussion_comments=fixed.EXTRA_COMMENTS,
    ),
    min_comment=fixed.MIN_EXTRA_COMMENT_LENGTH,
)


def windowed_posts(posts: DataFrame, anchor: datetime, what: Pass = FIRST_PASS) -> DataFrame:
    """The newest posts of each window with their composed text, before the length filter."""
    newest = newest_per_window(posts, window_bounds(anchor, what.windows))
    if what.unique_ids:
        newest = dedupe_id(newest)

    def clean(name):
        return what.clean(F.coalesce(F.col(name), F.lit("")))

    return newest.withColumn("text", compose_text(clean("title"), clean("selftext"))).withColumn(
        "source", F.lit(what.post_source)
    )


def collect_posts(posts: DataFrame, anchor: datetime, what: Pass = FIRST_PASS) -> DataFrame:
    rows = windowed_posts(posts, anchor, what)
    return rows.where(min_length(F.col("text"), what.min_post, what.strict)).select(
        F.lit(0).alias("part"),
        F.lit(0).alias("kind"),
        F.col("window_no").alias("group_no"),
        F.lit(0).alias("thread_no"),
        "rank",
        "id",
        "text",
        "source",
    )


def threads_of(posts: DataFrame, anchor: datetime, what: Pass = FIRST_PASS) -> DataFrame:
    """The chosen threads of a pass; few rows, as every window has a fixed quota."""
    picked = [
        pick_threads(newest_threads(posts, after, before), **what.threads).withColumn(
            "period", F.lit(i)
        )
        for i, (_, after, before) in enumerate(window_bounds(anchor, what.thread_windows))
    ]
    return corpus.union_all(*picked).drop("input_no")


def fetched_comments(
    posts: DataFrame, comments: DataFrame, anchor: datetime, what: Pass = FIRST_PASS
) -> DataFrame:
    """The newest comments of the chosen threads, before cleaning and filters."""
    # The most that any row's ``k`` can be, as ``pick_threads`` sets it.
    most = max(
        what.threads.get("match_comments", fixed.MATCH_THREAD_COMMENTS),
        what.threads.get("discussion_comments", fixed.DISCUSSION_COMMENTS),
    )
    tagged = comments_for_threads(comments, threads_of(posts, anchor, what))
    return newest_per_thread(tagged, most).withColumn("text", what.clean(F.coalesce("body", F.lit(""))))


def collect_comments(
    posts: DataFrame, comments: DataFrame, anchor: datetime, what: Pass = FIRST_PASS
) -> DataFrame:
    rows = fetched_comments(posts, comments, anchor, what).where(
        min_length(F.col("text"), what.min_comment, what.strict) & not_tombstone(F.col("text"))
    )
    # Match threads come before discussions, periods and threads in their order.
    kind = F.when(F.col("source") == fixed.MATCH_THREAD_COMMENT, 0).otherwise(1)
    return rows.select(
        F.lit(1).alias("part"),
        kind.alias("kind"),
        F.col("period").alias("group_no"),
        "thread_no",
        "rank",
        "id",
        "text",
        "source",
    )


def collect_corpus(
    posts: DataFrame, comments: DataFrame, anchor: datetime, what: Pass = FIRST_PASS
) -> DataFrame:
    """Posts, then comments, each text once. ``COLLECTED_ORDER`` is the order collected in."""
    rows = collect_posts(posts, anchor, what).unionByName(
        collect_comments(posts, comments, anchor, what)
    )
    return corpus.dedupe_text(rows, COLLECTED_ORDER)


def weak_label_job(
    *inputs: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    cap: int = fixed.CAP_PER_LABEL,
    prefer_longest: bool = True,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Union, dedupe, label, drop skipped, cap, shuffle.

    Inputs have ex_id, ordinal, text and source. ``prefer_longest`` keeps the longest
    analysis posts and the first of the other labels, else the cap is random.
    """
    united = corpus.dedupe_text(corpus.union_all(*inputs), corpus.INPUT_ORDER)
    kept = labelable(label_posts(united, rules))
    if prefer_longest:
        capped = corpus.cap_preferring(kept, cap, corpus.INPUT_ORDER)
    else:
        capped = corpus.cap_random(kept, cap, seed)
    return corpus.shuffle(
        capped.select("ex_id", "text", "label", "source", F.col("note").alias("notes")), seed
    )


@dataclass(frozen=True)
class Evaluation:
    report: DataFrame
    baseline_report: DataFrame
    comparison: DataFrame


def evaluate(
    baseline: DataFrame,
    model: DataFrame,
    truth: DataFrame,
    name: str,
    labels: Sequence[str] = fixed.LABELS,
) -> Evaluation:
    """Class reports of the model and of the baseline, and their comparison on the same rows."""
    return Evaluation(
        class_report(align(model, truth), labels),
        class_report(align(baseline, truth), labels),
        model_comparison(compare_models(baseline, model, truth), name),
    )
