"""Collection over tables: windows, threads and their comments."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.text import is_discussion, is_match_thread
from postlabel.operators.ranking import first_rows, top_per_group

Bounds = Sequence[tuple[str, datetime, datetime]]


def window_bounds(
    anchor: datetime, spec: Sequence[tuple[str, int, int]] = fixed.FIRST_PASS_WINDOWS
) -> Bounds:
    """(label, after, before) of each window, counted back from the anchor."""
    return [
        (name, anchor - timedelta(days=older), anchor - timedelta(days=newer))
        for name, newer, older in spec
    ]


def bounds_table(spark: SparkSession, bounds: Bounds) -> DataFrame:
    rows = [(i, *b) for i, b in enumerate(bounds)]
    return spark.createDataFrame(
        rows, "window_no INT, window STRING, after TIMESTAMP, before TIMESTAMP"
    )


def _at(moment: datetime) -> Column:
    """A literal that compares with timestamps with or without a zone."""
    return F.lit(moment.isoformat(sep=" "))


def _within(ts: Column, after: datetime, before: datetime) -> Column:
    return (ts > _at(after)) & (ts <= _at(before))


def _window_structs(ts: Column, bounds: Bounds) -> Column:
    """The windows a time lies in; the lower bound is exclusive, the upper inclusive."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    _within(ts, after, before),
                    F.struct(F.lit(i).alias("window_no"), F.lit(name).alias("window")),
                )
                for i, (name, after, before) in enumerate(bounds)
            ]
        )
    )


def assign_windows(df: DataFrame, bounds: Bounds, ts: str = "created_utc") -> DataFrame:
    """One row per (row, window it lies in), without a join.

    The enclosing range is also given as a plain filter, which reaches the scan.
    """
    column = F.col(ts)
    oldest, newest = min(b[1] for b in bounds), max(b[2] for b in bounds)
    return df.where(_within(column, oldest, newest)).select(
        "*", F.inline(_window_structs(column, bounds))
    )


def newest_per_window(
    df: DataFrame,
    bounds: Bounds,
    k: int = fixed.POSTS_PER_WINDOW,
    ts: str = "created_utc",
    id_col: str = "id",
) -> DataFrame:
    """The newest k rows of each time window; ``rank`` is their order."""
    order = [F.col(ts).desc(), F.col(id_col)]
    windows = assign_windows(df, bounds, ts)
    return top_per_group(windows, ["window_no", "window"], order, k, spread_by=[id_col])


def dedupe_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """A row seen in several windows stays in the first of them."""
    order = [F.col("window_no"), F.col("rank")]
    return top_per_group(df, [id_col], order, 1, rank="_seen").drop("_seen")


def min_length(col: Column, n: int, strict: bool = False) -> Column:
    """At least n characters, or more than n when strict."""
    return F.length(col) > n if strict else F.length(col) >= n


def add_provenance(df: DataFrame, source: str) -> DataFrame:
    """Constant source and an empty label for the annotator."""
    return df.withColumn("label", F.lit("")).withColumn("source", F.lit(source))


def newest_threads(
    posts: DataFrame, after: datetime, before: datetime, k: int = fixed.POSTS_PER_WINDOW
) -> DataFrame:
    """The newest k posts of a period, k rows at most."""
    created = F.col("created_utc")
    period = posts.where(_within(created, after, before)).select(
        "id", "created_utc", "title", "num_comments"
    )
    return first_rows(period, [created.desc(), F.col("id")], k, ["id"])


def pick_threads(
    newest: DataFrame,
    match_threads: int = fixed.MATCH_THREADS,
    discussions: int = fixed.DISCUSSION_THREADS,
    min_comments: int = fixed.DISCUSSION_MIN_COMMENTS,
    keywords: Sequence[str] = fixed.MATCH_THREAD_KEYWORDS,
    discussion_source: str = fixed.DISCUSSION_COMMENT,
    match_comments: int = fixed.MATCH_THREAD_COMMENTS,
    discussion_comments: int = fixed.DISCUSSION_COMMENTS,
) -> DataFrame:
    """The first match and discussion threads: (post_id, source, thread_no, k).

    At most ``match_threads + discussions`` rows.
    """
    title = F.col("title")
    match = is_match_thread(title, keywords)
    busy = is_discussion(title, F.col("num_comments"), min_comments, keywords)
    kinds = newest.select(
        F.col("id").alias("post_id"),
        "created_utc",
        F.when(match, F.lit(fixed.MATCH_THREAD_COMMENT))
        .when(busy, F.lit(discussion_source))
        .alias("source"),
    ).where("source IS NOT NULL")
    is_match = F.col("source") == fixed.MATCH_THREAD_COMMENT
    quota = F.when(is_match, F.lit(match_threads)).otherwise(F.lit(discussions))
    ranked = top_per_group(
        kinds,
        ["source"],
        [F.col("created_utc").desc(), F.col("post_id")],
        max(match_threads, discussions),
        rank="thread_no",
    )
    return ranked.where(F.col("thread_no") <= quota).select(
        "post_id",
        "source",
        "thread_no",
        F.when(is_match, F.lit(match_comments)).otherwise(F.lit(discussion_comments)).alias("k"),
    )


def newest_per_thread(df: DataFrame, max_k: int) -> DataFrame:
    """The newest comments of each thread: as many as the row's ``k``, ``max_k`` at most."""
    order = [F.col("created_utc").desc(), F.col("id")]
    ranked = top_per_group(df, ["source", "post_id"], order, max_k, spread_by=["id"])
    return ranked.where(F.col("rank") <= F.col("k"))


def comments_for_threads(comments: DataFrame, threads: DataFrame) -> DataFrame:
    """Comments of chosen threads only, tagged with the kind of thread.

    ``threads`` comes from ``pick_threads`` and has a few rows by construction. Spark sees
    that size and broadcasts it, so the comments are filtered where they are read; no hint
    forces this on a caller's larger table.
    """
    return comments.join(threads, "post_id")
