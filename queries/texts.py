"""Scalar functions and predicates, over whole tables."""

from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions import text as tx
from postlabel.functions.labels import decode_label, encode_label, parse_response
from postlabel.functions.scores import argmax, score_struct, softmax
from postlabel.operators import collect, corpus, metrics, rules

from .base import (
    EXAMPLES_SQL,
    GOLD_SQL,
    LOGITS_SQL,
    PARSED_SQL,
    POSTS_SQL,
    PREDICTED_SQL,
    RESPONSES_SQL,
    TURNS_SQL,
    cascade_sql,
    documents,
    examples,
    features_sql,
    gold,
    logits,
    posts,
    query,
    responses,
    rule_predictions,
    scored,
    table,
    turns,
)

FEATURES = f"WITH {EXAMPLES_SQL},\n{features_sql('examples')}\n"


def _features(spark, sf):
    return rules.text_features(examples(spark, sf))


@query(
    r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '<WS>+', ' ', 'g')) AS text "
    "FROM documents"
)
def collapse_ws(spark, sf):
    return documents(spark, sf).select("doc_id", tx.collapse_ws(F.col("text")).alias("text"))


@query(f"WITH {EXAMPLES_SQL} SELECT ex_id, trim(text, '<TRIM>') AS text FROM examples")
def strip_ws(spark, sf):
    return examples(spark, sf).select("ex_id", tx.strip_ws(F.col("text")).alias("text"))


@query(
    r"""SELECT page_id,
       CASE WHEN body IN ('', '[deleted]', '[removed]') THEN url ELSE url || ' -- ' || body END AS text
FROM (SELECT page_id, url, CASE page_id % 5 WHEN 1 THEN '[deleted]' WHEN 2 THEN '[removed]'
             WHEN 3 THEN '' ELSE html END AS body FROM pages)"""
)
def compose_text(spark, sf):
    kind = F.col("page_id") % 5
    body = (
        F.when(kind == 1, "[deleted]")
        .when(kind == 2, "[removed]")
        .when(kind == 3, "")
        .otherwise(F.col("html"))
    )
    return table(spark, sf, "pages").select(
        "page_id", tx.compose_text(F.col("url"), body).alias("text")
    )


@query(FEATURES + "SELECT ex_id, t, tl, CAST(n AS INTEGER) AS n FROM feats")
def text_features(spark, sf):
    return _features(spark, sf).select("ex_id", "t", "tl", "n")


@query(FEATURES + "SELECT ex_id, head FROM feats")
def head_segment(spark, sf):
    return _features(spark, sf).select("ex_id", tx.head_segment(F.col("t")).alias("head"))


@query(FEATURES + "SELECT ex_id, substr(tl, 1, 100) AS head FROM feats")
def prefix(spark, sf):
    return _features(spark, sf).select("ex_id", tx.prefix(F.col("tl")).alias("head"))


@query(
    FEATURES
    + """SELECT ex_id, CAST(length(t) - length(replace(t, '|', '')) AS INTEGER) AS pipes,
       CAST(length(t) - length(replace(t, chr(10), '')) AS INTEGER) AS newlines FROM feats"""
)
def count_char(spark, sf):
    return _features(spark, sf).select(
        "ex_id",
        tx.count_char(F.col("t"), "|").alias("pipes"),
        tx.count_char(F.col("t"), "\n").alias("newlines"),
    )


@query(
    FEATURES
    + r"""SELECT ex_id, CAST(len(list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'),
         lambda w: regexp_full_match(w, '(19|20)\p{Nd}\p{Nd}'))) AS INTEGER) AS years FROM feats"""
)
def count_matches(spark, sf):
    return _features(spark, sf).select(
        "ex_id", tx.count_matches(F.col("t"), fixed.YEAR).alias("years")
    )


_TERMS_SQL = " + ".join(
    f"CAST(contains(tl, '{w}') AS INTEGER)"
    for w in (
        "xg|expected goals|possession %|pressing intensity|progressive passes|formation|high line"
        "|tactical|per 90|pass completion|win rate|underlying numbers|statistically"
        "|since records began|all-time|historically|according to|data shows|coefficient"
        "|financial fair play|transfer fee record|inflation adjusted"
    ).split("|")
)


@query(FEATURES + f"SELECT ex_id, {_TERMS_SQL} AS hits FROM feats")
def keyword_hits(spark, sf):
    return _features(spark, sf).select(
        "ex_id", tx.keyword_hits(F.col("tl"), fixed.ANALYTICAL_TERMS).alias("hits")
    )


@query(
    f"""WITH {EXAMPLES_SQL},
{cascade_sql("examples")}
SELECT ex_id, label, CAST(CASE label WHEN 'analysis' THEN 0 WHEN 'hot_take' THEN 1
  WHEN 'reaction' THEN 2 ELSE -1 END AS INTEGER) AS label_id FROM labelled"""
)
def encode_labels(spark, sf):
    labelled = rules.label_posts(examples(spark, sf))
    return labelled.select(
        "ex_id", "label", F.coalesce(encode_label(F.col("label")), F.lit(-1)).alias("label_id")
    )


@query(
    """SELECT vec_id, CASE label WHEN 0 THEN 'analysis' WHEN 1 THEN 'hot_take'
  WHEN 2 THEN 'reaction' END AS label FROM embeddings"""
)
def decode_labels(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", decode_label(F.col("label")).alias("label")
    )


@query(
    f"""WITH {EXAMPLES_SQL}
SELECT ex_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END
  AS shown, substr(text, 1, 100) AS cut FROM examples"""
)
def preview(spark, sf):
    text = F.col("text")
    return examples(spark, sf).select(
        "ex_id",
        tx.preview(text, 200, ellipsis=True).alias("shown"),
        tx.preview(text, 100).alias("cut"),
    )


@query("SELECT doc_id, text, '' AS label, 'post' AS source FROM documents")
def add_provenance(spark, sf):
    return collect.add_provenance(documents(spark, sf).select("doc_id", "text"), fixed.POST)


@query("SELECT item_id AS ex_id, text AS post FROM benchmark")
def rename_columns(spark, sf):
    return corpus.rename_columns(
        table(spark, sf, "benchmark"), {"item_id": "ex_id", "text": "post"}
    )


@query(
    f"""WITH {LOGITS_SQL}
SELECT ex_id, round(pa, 4) AS analysis, round(ph, 4) AS hot_take, round(pr, 4) AS reaction
FROM scored"""
)
def softmax_scores(spark, sf):
    p = softmax(F.col("scores"))
    return logits(spark, sf).select(
        "ex_id", *[F.round(F.get(p, F.lit(i)), 4).alias(n) for i, n in enumerate(fixed.LABELS)]
    )


@query(f"WITH {LOGITS_SQL} SELECT ex_id, predicted_id FROM scored")
def argmax_scores(spark, sf):
    return logits(spark, sf).select("ex_id", argmax(F.col("scores")).alias("predicted_id"))


@query(
    f"""WITH {LOGITS_SQL}
SELECT ex_id, predicted AS predicted_label, round(confidence, 4) AS confidence,
       round(pa, 4) AS score_analysis, round(ph, 4) AS score_hot_take,
       round(pr, 4) AS score_reaction FROM scored"""
)
def score_record(spark, sf):
    record = scored(spark, sf).select("ex_id", score_struct(F.col("p")).alias("r"))
    return record.select(
        "ex_id",
        "r.predicted_label",
        "r.confidence",
        *[F.col("r.all_scores")[n].alias(f"score_{n}") for n in fixed.LABELS],
    )


@query(f"WITH {RESPONSES_SQL},\n{PARSED_SQL}\nSELECT ex_id, raw, label FROM parsed")
def parse_answers(spark, sf):
    return responses(spark, sf).select("ex_id", "raw", parse_response(F.col("raw")).alias("label"))


# --- predicates ---------------------------------------------------------------


@query(
    """SELECT count(*) FILTER (WHERE length(text) >= 40) AS at_least_40,
       count(*) FILTER (WHERE length(text) > 40) AS over_40,
       count(*) FILTER (WHERE length(text) > 100) AS over_100 FROM conversations"""
)
def min_length(spark, sf):
    text = F.col("text")
    return table(spark, sf, "conversations").agg(
        F.count_if(collect.min_length(text, 40)).alias("at_least_40"),
        F.count_if(collect.min_length(text, 40, strict=True)).alias("over_40"),
        F.count_if(collect.min_length(text, 100, strict=True)).alias("over_100"),
    )


@query(f"WITH {POSTS_SQL} SELECT id FROM posts WHERE selftext NOT IN ('[deleted]', '[removed]')")
def not_tombstone(spark, sf):
    return posts(spark, sf).where(tx.not_tombstone(F.col("selftext"))).select("id")


@query(
    f"""WITH {POSTS_SQL}
SELECT id, regexp_matches(lower(title), 'match thread|post match|pre-match|post-match|half time|half-time|\\[ft\\]|ft \\||ft:') AS first_pass,
  regexp_matches(lower(title), 'match thread|post match|\\[ft\\]|ft \\||starting xi') AS extra_pass
FROM posts"""
)
def is_match_thread(spark, sf):
    title = F.col("title")
    return posts(spark, sf).select(
        "id",
        tx.is_match_thread(title).alias("first_pass"),
        tx.is_match_thread(title, fixed.EXTRA_MATCH_THREAD_KEYWORDS).alias("extra_pass"),
    )


@query(
    f"""WITH {POSTS_SQL}
SELECT id, coalesce(num_comments, 0) > 150 AND NOT regexp_matches(lower(title), 'match thread|post match|pre-match|post-match|half time|half-time|\\[ft\\]|ft \\||ft:') AS first_pass,
  coalesce(num_comments, 0) > 300 AND NOT regexp_matches(lower(title), 'match thread|post match|\\[ft\\]|ft \\||starting xi') AS extra_pass
FROM posts"""
)
def is_discussion(spark, sf):
    title, n = F.col("title"), F.col("num_comments")
    return posts(spark, sf).select(
        "id",
        tx.is_discussion(title, n).alias("first_pass"),
        tx.is_discussion(
            title, n, fixed.EXTRA_MIN_COMMENTS, fixed.EXTRA_MATCH_THREAD_KEYWORDS
        ).alias("extra_pass"),
    )


@query(
    FEATURES
    + """SELECT ex_id FROM feats WHERE regexp_matches(tl, 'overrated|underrated|bum|trash|goat|greatest ever|best ever|worst ever|most overrated|genuinely think|unpopular|controversy|hot take|i mean come on|genuinely believe|couldn''t even|has no business|got their asses kicked|shameful|disgusting|braindead')"""
)
def contains_any(spark, sf):
    hit = tx.contains_any(F.col("tl"), fixed.OPINION_KEYWORDS)
    return _features(spark, sf).where(hit).select("ex_id")


@query(
    FEATURES
    + r"""SELECT ex_id,
  regexp_matches(t, '^\[[^\n]{1,60}\]<WS>') AS sourced,
  regexp_matches(t, '<LB>\[\p{Nd}+\][<WSI>\-–]+\p{Nd}+') AS scored,
  regexp_matches(tl, '<LB>(deserves?|should|has to|needs to|must)<RB>')
    OR regexp_matches(tl, '<LB>(better|worse|best|worst)<WS>+than<RB>') AS judged
FROM feats"""
)
def matches_any(spark, sf):
    return _features(spark, sf).select(
        "ex_id",
        tx.matches_any(F.col("t"), [fixed.NEWS_SOURCE]).alias("sourced"),
        tx.matches_any(F.col("t"), [fixed.SCORE_UPDATE]).alias("scored"),
        tx.matches_any(F.col("tl"), fixed.JUDGMENTS[1:3]).alias("judged"),
    )


@query(
    f"""WITH {EXAMPLES_SQL},
{TURNS_SQL}
SELECT source, ex_id FROM (SELECT * FROM turns UNION ALL SELECT * FROM examples)
WHERE ends_with(trim(text, '<TRIM>'), '?')"""
)
def ends_with_question(spark, sf):
    both = turns(spark, sf).unionByName(examples(spark, sf))
    return both.where(tx.ends_with_question(F.col("text"))).select("source", "ex_id")


@query(
    f"""WITH {EXAMPLES_SQL},
{cascade_sql("examples")}
SELECT ex_id, label FROM labelled WHERE label <> 'skip'"""
)
def labelable(spark, sf):
    return rules.labelable(rules.label_posts(examples(spark, sf))).select("ex_id", "label")


@query(
    f"""WITH {EXAMPLES_SQL},
{cascade_sql("examples")}
SELECT ex_id, label, CAST(CASE label WHEN 'analysis' THEN 0 WHEN 'hot_take' THEN 1 ELSE 2 END
  AS INTEGER) AS label_id FROM labelled WHERE label IN ('analysis', 'hot_take', 'reaction')"""
)
def valid_label(spark, sf):
    labelled = rules.label_posts(examples(spark, sf)).select("ex_id", "label")
    return corpus.valid_label(labelled)


@query(
    f"WITH {RESPONSES_SQL},\n{PARSED_SQL}\nSELECT ex_id, label FROM parsed WHERE label IS NOT NULL"
)
def parseable(spark, sf):
    parsed = responses(spark, sf).select("ex_id", parse_response(F.col("raw")).alias("label"))
    return metrics.parseable(parsed)


@query(
    f"""WITH {POSTS_SQL}
SELECT id FROM posts WHERE length(trim(selftext, '<TRIM>')) > 0"""
)
def non_blank(spark, sf):
    return corpus.non_blank(posts(spark, sf), "selftext").select("id")


@query(
    f"""WITH {PREDICTED_SQL}
SELECT ex_id, label, predicted FROM predicted WHERE predicted <> label"""
)
def wrong_predictions(spark, sf):
    pairs = metrics.align(rule_predictions(spark, sf), gold(spark, sf))
    return metrics.wrong_predictions(pairs).select("ex_id", "label", "predicted")


# Turns as texts of all sources, with the conversation's first turn as the title of its thread.
_PLACED_SQL = f"""{TURNS_SQL},
placed AS (
  SELECT t.ex_id, t.text, CASE (t.ex_id // 1000) % 5 WHEN 0 THEN t.source WHEN 1 THEN 'post' WHEN 2 THEN 'post_older'
    WHEN 3 THEN 'discussion_comment' ELSE 'discussion_comment_older' END AS source, o.text AS title
  FROM turns t LEFT JOIN conversations o ON o.conv_id = t.ex_id // 1000 AND o.turn = 0)"""


def _placed(spark, sf):
    kind = F.floor(F.col("ex_id") / 1000) % 5
    source = (
        F.when(kind == 0, F.col("source"))
        .when(kind == 1, fixed.POST)
        .when(kind == 2, fixed.POST_OLDER)
        .when(kind == 3, fixed.DISCUSSION_COMMENT)
        .otherwise(fixed.DISCUSSION_COMMENT_OLDER)
    )
    titles = table(spark, sf, "conversations").where("turn = 0")
    titles = titles.select(F.col("conv_id").alias("thread"), F.col("text").alias("title"))
    rows = turns(spark, sf).withColumn("thread", F.floor(F.col("ex_id") / 1000))
    return rows.withColumn("source", source).join(titles, "thread", "left")


_PREFIX_SQL = """CASE WHEN source = 'match_thread_comment' THEN 'Match thread comment:'
  WHEN starts_with(source, 'discussion_comment') THEN 'Discussion comment:' ELSE 'Standalone post:' END"""


@query(
    f"""WITH {_PLACED_SQL}
SELECT ex_id, source, {_PREFIX_SQL} || ' ' || text AS text FROM placed"""
)
def add_context_prefix(spark, sf):
    return corpus.add_context_prefix(_placed(spark, sf)).select("ex_id", "source", "text")


@query(
    f"""WITH {_PLACED_SQL}
SELECT ex_id, {_PREFIX_SQL} || ' ' || CASE WHEN source IN ('post', 'post_older') OR title IS NULL OR trim(title, '<TRIM>') = '' THEN ''
  ELSE title || ' -- ' END || text AS text FROM placed"""
)
def add_thread_title(spark, sf):
    return corpus.add_context_prefix(_placed(spark, sf), title="title").select("ex_id", "text")


@query(
    f"""WITH {GOLD_SQL}
SELECT label, CAST(count(*) AS BIGINT) AS rows FROM gold GROUP BY label
HAVING label NOT IN ('analysis', 'reaction')"""
)
def unknown_gold_labels(spark, sf):
    return corpus.unknown_labels(gold(spark, sf), ("analysis", "reaction"))
