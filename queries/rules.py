"""The rule cascade and its audits."""

import re

from pyspark.sql import functions as F

from postlabel.operators import report, rules
from postlabel.plans import weak_label_job as weak_labels

from .base import (
    EXAMPLES_SQL,
    LABEL_SQL,
    NOTE_SQL,
    TURNS_SQL,
    cascade_sql,
    examples,
    features_sql,
    query,
    turns,
)

LABELLED = f"WITH {EXAMPLES_SQL},\n{cascade_sql('examples')}\n"
TURNS_LABELLED = f"WITH {TURNS_SQL},\n{cascade_sql('turns')}\n"
AUDIT_SQL = r"""CASE
  WHEN n > 1500 AND regexp_matches(tl, 'auto-refreshing|line-ups|starting xi|subs:|substitution, ') THEN 'match_thread_body'
  WHEN n > 1000 AND contains(tl, 'match stats') AND contains(tl, 'possession') AND contains(tl, 'shots on goal') THEN 'post_match_thread_body'
  WHEN n < 300 AND regexp_matches(t, '^\[[^\n]{1,60}\]<WS>') THEN 'news_post'
  WHEN regexp_matches(tl, 'tickets available|for sale|ebay|pixel cleaning') THEN 'commercial'
  WHEN n < 300 AND starts_with(tl, 'match thread:') THEN 'match_thread_header'
  WHEN n > 5000 THEN 'too_long_article'
  WHEN n > 500 AND contains(tl, 'what to watch this week') THEN 'schedule_post' END"""
AUDITED = f"""WITH {EXAMPLES_SQL},
{features_sql("examples")},
audited AS (SELECT ex_id, text, {AUDIT_SQL} AS skip_reason FROM feats)
"""


@query(LABELLED + "SELECT ex_id, source, label, note FROM labelled")
def label_posts(spark, sf):
    return rules.label_posts(examples(spark, sf)).select("ex_id", "source", "label", "note")


@query(TURNS_LABELLED + "SELECT ex_id, source, label, note FROM labelled")
def label_comments(spark, sf):
    return rules.label_posts(turns(spark, sf)).select("ex_id", "source", "label", "note")


@query(
    LABELLED
    + """SELECT label, note, CAST(count(*) AS BIGINT) AS rows FROM labelled GROUP BY label, note
UNION ALL SELECT label, 'ALL', count(*) FROM labelled GROUP BY label
UNION ALL SELECT 'ALL', 'ALL', count(*) FROM labelled"""
)
def rule_firing(spark, sf):
    return report.rule_firing(rules.label_posts(examples(spark, sf)))


# The exclusions are compared as a list, in SQL one flag at a time.
@query(
    f"""WITH {EXAMPLES_SQL},
{features_sql("examples")}
SELECT ex_id, concat_ws('>',
  CASE WHEN n > 1500 AND regexp_matches(tl, 'auto-refreshing|line-ups|starting xi|match events \\| via espn|subs:|substitution, |corner\\. assisted by') THEN 'match_thread_body' END,
  CASE WHEN n > 1000 AND contains(tl, 'match stats') AND contains(tl, 'possession') AND contains(tl, 'shots on goal') THEN 'post_match_thread_body' END,
  CASE WHEN n < 300 AND regexp_matches(t, '^\\[[^\\n]{{1,60}}\\]<WS>') AND NOT regexp_matches(tl, 'overrated|underrated|should|best|worst|hate|love|better|terrible|fire him|sack him|disgrace|brilliant|awful|amazing|pathetic') THEN 'news_post' END,
  CASE WHEN regexp_matches(tl, 'tickets available|for sale|ebay|promo code|affiliate|pixel cleaning') THEN 'commercial' END,
  CASE WHEN n < 300 AND starts_with(tl, 'match thread:') THEN 'match_thread_header' END,
  CASE WHEN n > 5000 THEN 'too_long_article' END,
  CASE WHEN n > 500 AND contains(tl, 'what to watch this week') THEN 'schedule_post' END,
  CASE WHEN source = 'match_thread_comment' THEN 'match_thread_comment' END,
  CASE WHEN n < 120 THEN 'short_opinion' END,
  CASE WHEN n < 200 THEN 'short_default' END,
  'long_default') AS matches
FROM feats"""
)
def label_all_matches(spark, sf):
    shown = (
        *rules.EXCLUSION_RULES,
        rules.REACTION_RULES[0],
        rules.FALLBACK_RULES[1],
        *rules.FALLBACK_RULES[3:],
    )
    matched = rules.label_all_matches(examples(spark, sf), shown)
    return matched.select("ex_id", F.array_join("matches", ">").alias("matches"))


# Each WHEN of the cascade on its own.
_EVERY = ",\n  ".join(
    f"CASE WHEN {condition} THEN '{note}' END"
    for condition, note in re.findall(r"WHEN (.*?) THEN '(\w+)'", NOTE_SQL, re.DOTALL)
)


@query(
    f"""WITH {EXAMPLES_SQL},
{features_sql("examples")}
SELECT ex_id, concat_ws('>', {_EVERY}, 'long_default') AS matches FROM feats"""
)
def every_matching_rule(spark, sf):
    matched = rules.label_all_matches(examples(spark, sf))
    return matched.select("ex_id", F.array_join("matches", ">").alias("matches"))


# Rules by number, with the conditions of the cascade as a list of flags.
_CONDITIONS = re.findall(r"WHEN (.*?) THEN '(\w+)'", NOTE_SQL, re.DOTALL)
_NUMBERED = ", ".join(f"({i}, '{note}')" for i, (_, note) in enumerate([*_CONDITIONS, ("", "long_default")], start=1))
FIRED_SQL = f"""WITH {EXAMPLES_SQL},
{features_sql("examples")},
rules AS (SELECT rule_no, note, {LABEL_SQL} AS label FROM (VALUES {_NUMBERED}) AS r(rule_no, note)),
flags AS (SELECT ex_id, [{", ".join(f"({condition})" for condition, _ in _CONDITIONS)}, TRUE] AS f FROM feats),
fired AS (SELECT ex_id, list_filter(range(1, len(f) + 1), lambda i: f[i]) AS r FROM flags)
"""


@query(
    FIRED_SQL
    + """SELECT CAST(d.rule_no AS INTEGER) AS rule_no, d.note AS rule, CAST(h.rule_no AS INTEGER) AS hidden_no, h.note AS hidden,
  CAST(count(*) AS BIGINT) AS rows, d.label <> h.label AS other_label
FROM (SELECT r[1] AS d, unnest(r[2:]) AS h FROM fired) AS p
JOIN rules d ON d.rule_no = p.d JOIN rules h ON h.rule_no = p.h GROUP BY ALL"""
)
def rule_shadowing(spark, sf):
    return report.shadowing(rules.match_bits(examples(spark, sf)))


@query(
    FIRED_SQL
    + """SELECT CAST(q.rule_no AS INTEGER) AS rule_no, q.note AS rule, q.label, CAST(count(p.ex_id) AS BIGINT) AS matches,
  CAST(count(*) FILTER (WHERE p.d = q.rule_no) AS BIGINT) AS decides,
  CAST(count(*) FILTER (WHERE p.d < q.rule_no) AS BIGINT) AS hidden,
  CAST(count(*) FILTER (WHERE p.d < q.rule_no AND d.label <> q.label) AS BIGINT) AS relabelled,
  count(*) FILTER (WHERE p.d = q.rule_no) = 0 AS never_decides
FROM rules q LEFT JOIN (SELECT ex_id, r[1] AS d, unnest(r) AS m FROM fired) AS p ON p.m = q.rule_no
LEFT JOIN rules d ON d.rule_no = p.d GROUP BY ALL"""
)
def rule_use(spark, sf):
    return report.rule_use(rules.match_bits(examples(spark, sf)))


@query(AUDITED + "SELECT ex_id, skip_reason FROM audited")
def skip_reason(spark, sf):
    return rules.skip_reason(examples(spark, sf)).select("ex_id", "skip_reason")


@query(
    AUDITED
    + """SELECT skip_reason AS line, CAST(count(*) AS BIGINT) AS rows FROM audited
  WHERE skip_reason IS NOT NULL GROUP BY 1
UNION ALL SELECT 'Total skipped', count(skip_reason) FROM audited
UNION ALL SELECT 'Total kept', count(*) - count(skip_reason) FROM audited"""
)
def skip_report(spark, sf):
    return report.skip_report(rules.skip_reason(examples(spark, sf)))


@query(
    AUDITED
    + """SELECT ex_id, CAST(length(text) AS INTEGER) AS length, substr(text, 1, 100) AS preview
FROM audited WHERE skip_reason = 'too_long_article'"""
)
def overlong_listing(spark, sf):
    return report.overlong_listing(rules.skip_reason(examples(spark, sf)), "ex_id")


@query(
    f"""WITH {EXAMPLES_SQL},
{cascade_sql("examples")},
both_sets AS (
  SELECT CASE WHEN label = 'skip' THEN note END AS note_a, {AUDIT_SQL} AS note_b
  FROM (SELECT l.label, l.note, f.n, f.t, f.tl FROM labelled l JOIN feats f USING (ex_id)))
SELECT note_a, note_b, CAST(count(*) AS BIGINT) AS rows FROM both_sets
WHERE note_a IS DISTINCT FROM note_b GROUP BY note_a, note_b"""
)
def ruleset_diff(spark, sf):
    return rules.ruleset_diff(examples(spark, sf), rules.EXCLUSION_RULES, rules.AUDIT_RULES)


WEAK_SQL = f"""WITH {EXAMPLES_SQL},
{TURNS_SQL},
united AS (
  SELECT 0 AS input_no, * FROM examples UNION ALL SELECT 1 AS input_no, * FROM turns),
single AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY input_no, ordinal) AS copy
                 FROM united) WHERE copy = 1),
keyed AS (SELECT input_no * 1000000000 + ordinal AS ordinal, ex_id, text, source, input_no
          FROM single),
{cascade_sql("keyed")}
"""


@query(
    WEAK_SQL
    + """SELECT ex_id, text, label, source, note AS notes, md5('42:' || ex_id) AS shuffle_key FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY
    CASE WHEN label = 'analysis' THEN -length(text) ELSE 0 END, ordinal) AS rn
  FROM labelled WHERE label <> 'skip') WHERE rn <= 80"""
)
def weak_label_job(spark, sf):
    return weak_labels(examples(spark, sf), turns(spark, sf))


@query(
    WEAK_SQL.replace("SELECT conv_id * 1000 + turn AS ex_id", "SELECT 1000000000000 + conv_id * 1000 + turn AS ex_id")
    + """SELECT ex_id, text, label, source, note AS notes, md5('42:' || ex_id) AS shuffle_key FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || ex_id), ex_id) AS rn
  FROM labelled WHERE label <> 'skip') WHERE rn <= 80"""
)
def weak_label_job_random(spark, sf):
    # Documents and turns are numbered apart, as a cap by id needs ids of its own.
    offset = turns(spark, sf).withColumn("ex_id", F.col("ex_id") + F.lit(10**12))
    return weak_labels(examples(spark, sf), offset, prefer_longest=False)
