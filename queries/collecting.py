"""Windows, threads, comments and the collection job."""

from datetime import datetime

from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.operators import collect, corpus, report
from postlabel.plans import jobs

from .base import ANCHOR, COMMENTS_SQL, POSTS_SQL, comments, posts, query, table

# The given events span 30 days.
EVENT_WINDOWS = (
    ("last day", 0, 1),
    ("1-7 days ago", 1, 7),
    ("7-15 days ago", 7, 15),
    ("15-30 days ago", 15, 30),
)
# Event windows that overlap: an event of the last day lies in both.
OVERLAPPING = (("last day", 0, 1), ("last week", 0, 7))

_WINDOW_ROWS = """(VALUES (0, 'last 7 days', 0, 7), (1, '7-30 days ago', 7, 30),
  (2, '30-90 days ago', 30, 90), (3, '90-180 days ago', 90, 180))"""
_EXTRA_ROWS = """(VALUES (0, '270-365 days ago', 270, 365), (1, '180-270 days ago', 180, 270),
  (2, '365-540 days ago', 365, 540))"""


def _windowed(rows, relation, ts, anchor):
    return f"""SELECT w.window_no, w.window_name, s.*, {anchor} - to_days(w.older) AS after_ts,
    {anchor} - to_days(w.newer) AS before_ts
  FROM {relation} s JOIN {rows} AS w(window_no, window_name, newer, older)
    ON s.{ts} > {anchor} - to_days(w.older) AND s.{ts} <= {anchor} - to_days(w.newer)"""


ANCHOR_SQL = "TIMESTAMP '2024-06-30 00:00:00'"
_EVENT_ANCHOR = "(SELECT max(ts) FROM events)"
_EVENT_ROWS = """(VALUES (0, 'last day', 0, 1), (1, '1-7 days ago', 1, 7),
  (2, '7-15 days ago', 7, 15), (3, '15-30 days ago', 15, 30))"""
_OVERLAP_ROWS = "(VALUES (0, 'last day', 0, 1), (1, 'last week', 0, 7))"


def newest_event(events) -> datetime:
    return events.agg(F.max("ts")).first()[0]


@query(
    f"""WITH {POSTS_SQL},
hits AS ({_windowed(_WINDOW_ROWS, "posts", "created_utc", ANCHOR_SQL)}
  UNION ALL {_windowed(_EXTRA_ROWS, "posts", "created_utc", ANCHOR_SQL)})
SELECT window_name AS period, strftime(after_ts, '%Y-%m-%d') AS after_day,
       strftime(before_ts, '%Y-%m-%d') AS before_day, CAST(count(*) AS BIGINT) AS rows
FROM hits GROUP BY ALL"""
)
def window_bounds(spark, sf):
    spec = fixed.FIRST_PASS_WINDOWS + fixed.EXTRA_PASS_WINDOWS
    bounds = collect.window_bounds(ANCHOR, spec)
    counted = (
        collect.assign_windows(posts(spark, sf), bounds)
        .groupBy("window_no", "window")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return collect.bounds_table(spark, bounds).join(counted, ["window_no", "window"]).select(
        F.col("window").alias("period"),
        F.date_format("after", "yyyy-MM-dd").alias("after_day"),
        F.date_format("before", "yyyy-MM-dd").alias("before_day"),
        "rows",
    )


@query(
    f"""SELECT window_no, event_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT window_no, event_id,
    row_number() OVER (PARTITION BY window_no ORDER BY ts DESC, event_id) AS rank
  FROM ({_windowed(_EVENT_ROWS, "events", "ts", _EVENT_ANCHOR)})) WHERE rank <= 100"""
)
def newest_per_window(spark, sf):
    events = table(spark, sf, "events")
    bounds = collect.window_bounds(newest_event(events), EVENT_WINDOWS)
    newest = collect.newest_per_window(events, bounds, ts="ts", id_col="event_id")
    return newest.select("window_no", "event_id", "rank")


@query(
    f"""SELECT window_no, event_id FROM (
  SELECT window_no, event_id, row_number() OVER (PARTITION BY event_id ORDER BY window_no) AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY window_no ORDER BY ts DESC, event_id) AS rank
        FROM ({_windowed(_OVERLAP_ROWS, "events", "ts", _EVENT_ANCHOR)})) WHERE rank <= 500)
WHERE seen = 1"""
)
def dedupe_id(spark, sf):
    events = table(spark, sf, "events")
    bounds = collect.window_bounds(newest_event(events), OVERLAPPING)
    newest = collect.newest_per_window(events, bounds, 500, ts="ts", id_col="event_id")
    return collect.dedupe_id(newest, "event_id").select("window_no", "event_id")


def _first_posts(clean):
    return f"""newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_no ORDER BY created_utc DESC, id) AS rank
    FROM ({_windowed(_WINDOW_ROWS if clean else _EXTRA_ROWS, "posts", "created_utc", ANCHOR_SQL)}))
  WHERE rank <= 100),
cleaned AS (SELECT window_no, window_name, rank, id, {_clean("title", clean)} AS title,
              {_clean("selftext", clean)} AS selftext FROM newest),
windowed AS (
  SELECT window_no, window_name, rank, id,
    CASE WHEN selftext IN ('', '[deleted]', '[removed]') THEN title
         ELSE title || ' -- ' || selftext END AS text FROM cleaned)"""


def _clean(column, collapse):
    if collapse:
        return f"trim(regexp_replace(coalesce({column}, ''), '<WS>+', ' ', 'g'))"
    return f"trim(coalesce({column}, ''), '<TRIM>')"


_FIRST_KEYS = (
    r"match thread|post match|pre-match|post-match|half time|half-time|\[ft\]|ft \||ft:"
)
_EXTRA_KEYS = r"match thread|post match|\[ft\]|ft \||starting xi"
THREADS_SQL = f"""threads AS (
  SELECT * FROM (
    SELECT post_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY created_utc DESC, post_id)
             AS INTEGER) AS thread_no,
           CASE source WHEN 'match_thread_comment' THEN 25 ELSE 15 END AS k, 0 AS period
    FROM (SELECT id AS post_id, created_utc,
            CASE WHEN regexp_matches(lower(title), '{_FIRST_KEYS}') THEN 'match_thread_comment'
                 WHEN coalesce(num_comments, 0) > 150 THEN 'discussion_comment' END AS source
          FROM (SELECT * FROM posts WHERE created_utc > {ANCHOR_SQL} - to_days(30)
                AND created_utc <= {ANCHOR_SQL} ORDER BY created_utc DESC, id LIMIT 100))
    WHERE source IS NOT NULL)
  WHERE thread_no <= CASE source WHEN 'match_thread_comment' THEN 8 ELSE 6 END)"""


def _extra_threads(period, newer, older):
    return f"""SELECT * FROM (
    SELECT id AS post_id, 'discussion_comment_older' AS source,
      CAST(row_number() OVER (ORDER BY created_utc DESC, id) AS INTEGER) AS thread_no, 20 AS k,
      {period} AS period
    FROM (SELECT * FROM posts WHERE created_utc > {ANCHOR_SQL} - to_days({older})
          AND created_utc <= {ANCHOR_SQL} - to_days({newer}) ORDER BY created_utc DESC, id LIMIT 100)
    WHERE coalesce(num_comments, 0) > 300 AND NOT regexp_matches(lower(title), '{_EXTRA_KEYS}'))
  WHERE thread_no <= 4"""


EXTRA_THREADS_SQL = (
    f"threads AS ({_extra_threads(0, 270, 365)} UNION ALL {_extra_threads(1, 180, 270)})"
)


def _fetched(collapse):
    return f"""fetched AS (
  SELECT *, {_clean("body", collapse)} AS text FROM (
    SELECT c.id, c.body, t.*,
      CAST(row_number() OVER (PARTITION BY t.source, t.post_id ORDER BY c.created_utc DESC, c.id)
        AS INTEGER) AS rank
    FROM comments c JOIN threads t USING (post_id))
  WHERE rank <= k)"""


@query(f"WITH {POSTS_SQL},\n{THREADS_SQL}\nSELECT post_id, source, thread_no, k FROM threads")
def pick_threads(spark, sf):
    return jobs.threads_of(posts(spark, sf), ANCHOR).select("post_id", "source", "thread_no", "k")


@query(f"WITH {POSTS_SQL},\n{EXTRA_THREADS_SQL}\nSELECT post_id, source, thread_no, k, period FROM threads")
def pick_threads_extra(spark, sf):
    return jobs.threads_of(posts(spark, sf), ANCHOR, jobs.EXTRA_PASS).select(
        "post_id", "source", "thread_no", "k", "period"
    )


@query(
    f"""WITH {POSTS_SQL},
{COMMENTS_SQL},
{THREADS_SQL}
SELECT c.id, t.post_id, t.source FROM comments c JOIN threads t USING (post_id)"""
)
def comments_for_threads(spark, sf):
    threads = jobs.threads_of(posts(spark, sf), ANCHOR)
    tagged = collect.comments_for_threads(comments(spark, sf), threads)
    return tagged.select("id", "post_id", "source")


@query(
    f"""WITH {COMMENTS_SQL}
SELECT id, post_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY created_utc DESC, id) AS rank
  FROM comments) WHERE rank <= 3"""
)
def newest_per_thread(spark, sf):
    every = comments(spark, sf).withColumn("source", F.lit("any")).withColumn("k", F.lit(3))
    return collect.newest_per_thread(every, 3).select("id", "post_id", "rank")


@query(
    f"""WITH {POSTS_SQL},
{_first_posts(True)}
SELECT window_name AS period, CAST(count(*) AS BIGINT) AS fetched,
  CAST(count(*) FILTER (WHERE length(text) >= 40) AS BIGINT) AS kept FROM windowed GROUP BY 1"""
)
def window_yield(spark, sf):
    rows = jobs.windowed_posts(posts(spark, sf), ANCHOR)
    counted = report.window_yield(rows, ["window"], collect.min_length(F.col("text"), 40))
    return counted.withColumnRenamed("window", "period")


@query(
    f"""WITH {POSTS_SQL},
{COMMENTS_SQL},
{THREADS_SQL},
{_fetched(True)}
SELECT source, post_id, CAST(count(*) AS BIGINT) AS fetched,
  CAST(count(*) FILTER (WHERE length(text) >= 40 AND text NOT IN ('[deleted]', '[removed]'))
    AS BIGINT) AS kept FROM fetched GROUP BY source, post_id"""
)
def thread_yield(spark, sf):
    rows = jobs.fetched_comments(posts(spark, sf), comments(spark, sf), ANCHOR)
    kept = collect.min_length(F.col("text"), 40) & ~F.col("text").isin(*fixed.TOMBSTONES)
    return report.window_yield(rows, ["source", "post_id"], kept)


def _corpus_sql(collapse):
    first = collapse
    limit = "length(text) >= 40" if first else "length(text) > 40"
    comment_limit = "length(text) >= 40" if first else "length(text) > 100"
    source = "post" if first else "post_older"
    return f"""WITH {POSTS_SQL},
{COMMENTS_SQL},
{_first_posts(first)},
{THREADS_SQL if first else EXTRA_THREADS_SQL},
{_fetched(first)},
rows_all AS (
  SELECT 0 AS part, 0 AS kind, window_no AS group_no, 0 AS thread_no, rank, id, text, '{source}' AS source FROM windowed
  WHERE {limit}
  UNION ALL
  SELECT 1, CASE source WHEN 'match_thread_comment' THEN 0 ELSE 1 END, period, thread_no,
    rank, id, text, source FROM fetched
  WHERE {comment_limit} AND text NOT IN ('[deleted]', '[removed]'))
SELECT id, text, source FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY part, kind, group_no, thread_no, rank, id) AS copy
  FROM rows_all) WHERE copy = 1"""


@query(_corpus_sql(True))
def collect_corpus(spark, sf):
    rows = jobs.collect_corpus(posts(spark, sf), comments(spark, sf), ANCHOR)
    return rows.select("id", "text", "source")


@query(_corpus_sql(False))
def collect_corpus_extra(spark, sf):
    rows = jobs.collect_corpus(posts(spark, sf), comments(spark, sf), ANCHOR, jobs.EXTRA_PASS)
    return rows.select("id", "text", "source")


@query(
    f"""WITH {POSTS_SQL},
{COMMENTS_SQL}
SELECT source, CAST(count(*) AS BIGINT) AS rows FROM (
  SELECT 'post' AS source FROM posts UNION ALL SELECT 'discussion_comment' FROM comments)
GROUP BY source"""
)
def source_breakdown(spark, sf):
    both = corpus.union_all(
        collect.add_provenance(posts(spark, sf).select("id"), fixed.POST),
        collect.add_provenance(comments(spark, sf).select("id"), fixed.DISCUSSION_COMMENT),
    )
    return report.source_breakdown(both)
