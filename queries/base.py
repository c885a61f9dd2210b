"""The registry, the tables' bindings to posts and comments, and the SQL they share.

Every SQL text is written by hand against the given tables; none is printed from the
library's rules.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.labels import parse_response
from postlabel.functions.scores import softmax
from postlabel.operators.model import rule_baseline
from postlabel.sources import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL when there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = spell(sql)
        return fn

    return register


# --- SQL shorthands -----------------------------------------------------------
_NOT_WORD = r"[^\p{L}\p{N}_]"
_GAP_END = r"[^\p{L}\p{N}_\n]"
SHORTHANDS = {
    "<TRIM>": fixed.TRIM_CHARS,
    "<WS>": r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]",
    "<WSI>": r"\s\x0b\x1c-\x1f\x{85}\p{Z}",
    "<LB>": f"(?:^|{_NOT_WORD})",
    "<RB>": f"(?:$|{_NOT_WORD})",
    # A gap of at most 30 (40) characters between two whole words.
    "<G30>": f"(?:{_GAP_END}|{_GAP_END}[^\\n]{{0,28}}{_GAP_END})",
    "<G40>": f"(?:{_GAP_END}|{_GAP_END}[^\\n]{{0,38}}{_GAP_END})",
    "<H30>": f"(?:[^\\n]{{0,29}}{_GAP_END})",
}


def spell(sql: str) -> str:
    for short, text in SHORTHANDS.items():
        sql = sql.replace(short, text)
    return sql


# --- planted rows -------------------------------------------------------------


def _cut(text: str, n: int) -> str:
    return (text * (n // len(text) + 1))[:n]


# (text, note): together they fire every branch of the cascade.
PLANTED = [
    ("Starting XI: " + _cut("midfield ", 1600), "match_thread_body"),
    (
        "Match stats. Possession 50, Shots on goal 3. " + _cut("passing ", 1000),
        "post_match_thread_body",
    ),
    ("[Daily Wire] Club appoints new coach", "news_post"),
    ("Two tickets available near the north stand", "commercial"),
    ("Match Thread: Reds vs Blues", "match_thread_header"),
    (_cut("prose ", 5100), "too_long_article"),
    ("What to watch this week. " + _cut("kickoff ", 520), "schedule_post"),
    ("This league is the best in the world", "match_thread_comment"),
    ("Reds [2] - 1 Blues - Novak 55'", "score_update"),
    ("Germany 7-1 Curacao", "result_line"),
    ("Novak becomes captain for the night", "historic_moment_factoid"),
    ("Reds fans celebrating in the square all night", "fan_moment"),
    ("Watching that final minute aged me ten years", "personal_reaction"),
    ("WHAT A goal from the halfway mark", "short_exclamation"),
    (
        "Their expected goals trend tells the story. " + _cut("number ", 330),
        "long_analytical",
    ),
    ("League goals |a|b|c|d|\n---\n" + _cut("row ", 500), "statistical_table"),
    (_cut("words ", 1100), "long_form_post"),
    (
        "In 2018, 2019 and 2020 the pattern held. " + _cut("detail ", 400),
        "multi_season_comparison",
    ),
    ("Novak will never lift a trophy", "opinion_marker"),
    ("Novak the GOAT of this era", "opinion_keyword"),
    ("Which keeper had more saves?", "opinionated_question"),
    ('Novak: "The problem here: nobody runs"', "pundit_quote_opinion"),
    ("The keeper was poor again tonight", "judgment_assertion"),
    ("My team plays on Sunday morning again", "first_person_opinion"),
    ("Where do you sit at the stadium?", "discussion_question"),
    ("Look at him run down that wing", "short_exclamation"),
    ("Midfield depth wins titles", "short_opinion"),
    (
        "The bench clearly tired after the break while the visitors kept running at the back "
        "four and nobody tracked the runner at all",
        "soft_opinion",
    ),
    (
        "The bench tired after the break while the visitors kept running at the back four and "
        "nobody tracked the runner at all, again",
        "short_default",
    ),
    (_cut("plain sentence ", 260), "long_default"),
    ("[Daily Wire] Novak should be captain", "opinion_marker"),
    (_cut("x", 1000), "long_default"),
    (_cut("x", 1001), "long_form_post"),
    (_cut("x", 5000), "long_form_post"),
    (_cut("x", 5001), "too_long_article"),
    (_cut("x", 119), "short_opinion"),
    (_cut("x", 120), "short_default"),
    (_cut("x", 199), "short_default"),
    (_cut("x", 200), "long_default"),
    ("  \n" + _cut("x", 119) + " \t", "short_opinion"),
    ("An album night with the crowd singing", "opinion_keyword"),
    ("A[2]-1 shown on the board", "short_opinion"),
    # What the audit of exclusions does not know.
    ("Match events | via ESPN " + _cut("midfield ", 1600), "match_thread_body"),
    ("Corner. Assisted by Novak. " + _cut("passing ", 1600), "match_thread_body"),
    ("A promo code for the club shop", "commercial"),
    ("Affiliate link to the club shop", "commercial"),
    ("[Daily Wire] A brilliant signing, says the coach", "short_opinion"),
    ("  Who starts in goal on Sunday?\n", "discussion_question"),
    (_cut("long words ", 320) + " right?\t", "long_default"),
    ("Kick-off at noon? No.", "short_opinion"),
]
PLANTED_ROWS = [
    (
        -i,
        -i,
        text,
        fixed.MATCH_THREAD_COMMENT if note == fixed.MATCH_THREAD_COMMENT else fixed.POST,
    )
    for i, (text, note) in enumerate(PLANTED, start=1)
]
_PLANTED_SQL = ",\n".join(
    "({}, {}, '{}', '{}')".format(i, o, t.replace("'", "''"), s) for i, o, t, s in PLANTED_ROWS
)

# --- tables -------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/documents.parquet", "doc_id")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as posts, and the planted rows under negative ids."""
    planted = spark.createDataFrame(
        PLANTED_ROWS, "ex_id BIGINT, ordinal BIGINT, text STRING, source STRING"
    )
    return (
        documents(spark, sf)
        .select(
            F.col("doc_id").alias("ex_id"),
            F.col("doc_id").alias("ordinal"),
            "text",
            F.lit(fixed.POST).alias("source"),
        )
        .unionByName(planted)
    )


EXAMPLES_SQL = f"""examples AS (
  SELECT doc_id AS ex_id, doc_id AS ordinal, text, 'post' AS source FROM documents
  UNION ALL
  SELECT ex_id, ordinal, text, source FROM (VALUES
{_PLANTED_SQL}) AS p(ex_id, ordinal, text, source))"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """All conversation turns; an assistant's turn plays the match thread comment."""
    spread = read_table(spark, f"{sf}/conversations.parquet", "conv_id", "turn")
    return spread.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ex_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"),
        "text",
        F.when(F.col("role") == "assistant", fixed.MATCH_THREAD_COMMENT)
        .otherwise(fixed.POST)
        .alias("source"),
    )


TURNS_SQL = """turns AS (
  SELECT conv_id * 1000 + turn AS ex_id, conv_id * 1000 + turn AS ordinal, text,
         CASE WHEN role = 'assistant' THEN 'match_thread_comment' ELSE 'post' END AS source
  FROM conversations)"""


# Documents as an archive of posts over 540 days before the anchor, conversations as the
# comments of the thread with the same number.
ANCHOR = datetime(2024, 6, 30)


def posts(spark: SparkSession, sf: str) -> DataFrame:
    doc, text = F.col("doc_id"), F.col("text")
    line = F.substring_index(text, "\n", 1)
    ago = (doc * 48271) % 46656000
    return documents(spark, sf).select(
        F.concat(F.lit("p"), doc.cast("string")).alias("id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-06-30 00:00:00")) - ago).alias(
            "created_utc"
        ),
        F.concat(
            F.when(doc % 11 == 0, "Match Thread: ").when(doc % 11 == 5, "[FT] ").otherwise(""), line
        ).alias("title"),
        F.when(doc % 13 == 3, "[removed]")
        .when(doc % 13 == 7, "[deleted]")
        .otherwise(F.substr(text, F.length(line) + 2))
        .alias("selftext"),
        F.when(doc % 17 != 0, F.col("n_chars") % 700).cast("int").alias("num_comments"),
    )


def comments(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        F.concat_ws("_", conv.cast("string"), turn.cast("string")).alias("id"),
        F.concat(F.lit("p"), conv.cast("string")).alias("post_id"),
        F.timestamp_seconds(
            F.unix_timestamp(F.lit("2024-06-29 00:00:00")) + (turn * 7919) % 86400
        ).alias("created_utc"),
        F.when((conv + turn) % 9 == 4, "[deleted]").otherwise(F.col("text")).alias("body"),
    )


POSTS_SQL = r"""posts AS (
  SELECT 'p' || doc_id AS id,
         TIMESTAMP '2024-06-30 00:00:00' - to_seconds((doc_id * 48271) % 46656000) AS created_utc,
         CASE doc_id % 11 WHEN 0 THEN 'Match Thread: ' WHEN 5 THEN '[FT] ' ELSE '' END
           || split_part(text, chr(10), 1) AS title,
         CASE doc_id % 13 WHEN 3 THEN '[removed]' WHEN 7 THEN '[deleted]'
           ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS selftext,
         CASE WHEN doc_id % 17 <> 0 THEN n_chars % 700 END AS num_comments
  FROM documents)"""
COMMENTS_SQL = r"""comments AS (
  SELECT conv_id || '_' || turn AS id, 'p' || conv_id AS post_id,
         TIMESTAMP '2024-06-29 00:00:00' + to_seconds((turn * 7919) % 86400) AS created_utc,
         CASE WHEN (conv_id + turn) % 9 = 4 THEN '[deleted]' ELSE text END AS body
  FROM conversations)"""


# --- labelled data and predictions --------------------------------------------


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents under the three labels."""
    label = (
        F.when(F.col("toxic") == 1, "reaction")
        .when(F.col("quality") == 1, "analysis")
        .otherwise("hot_take")
    )
    return (
        documents(spark, sf)
        .join(table(spark, sf, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("ex_id"),
            F.col("doc_id").alias("ordinal"),
            "text",
            F.lit(fixed.POST).alias("source"),
            label.alias("label"),
        )
    )


GOLD_SQL = """gold AS (
  SELECT d.doc_id AS ex_id, d.doc_id AS ordinal, d.text, 'post' AS source,
         CASE WHEN l.toxic = 1 THEN 'reaction' WHEN l.quality = 1 THEN 'analysis'
              ELSE 'hot_take' END AS label
  FROM documents d JOIN labels l USING (doc_id))"""


def rule_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rule_baseline(gold(spark, sf).drop("label")).select("ex_id", "label")


# An answer of every kind.
PLANTED_ANSWERS = [
    (-1, "analysis"),
    (-2, " HOT_TAKE. "),
    (-3, "I would say reaction"),
    (-4, "reaction, not analysis"),
    (-5, "hot take"),
    (-6, ""),
    (-7, None),
]


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """All assistant turns as raw answers, and one of every kind under negative ids."""
    said = table(spark, sf, "conversations").where("role = 'assistant'")
    planted = spark.createDataFrame(PLANTED_ANSWERS, "ex_id BIGINT, raw STRING")
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ex_id"), F.col("text").alias("raw")).unionByName(planted)


def parse_sql(raw: str) -> str:
    return f"""CASE WHEN contains(lower(trim({raw})), 'analysis') THEN 'analysis'
              WHEN contains(lower(trim({raw})), 'hot_take') THEN 'hot_take'
              WHEN contains(lower(trim({raw})), 'reaction') THEN 'reaction' END"""


RESPONSES_SQL = """responses AS (
  SELECT conv_id * 1000 + turn AS ex_id, text AS raw FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT * FROM (VALUES (-1, 'analysis'), (-2, ' HOT_TAKE. '), (-3, 'I would say reaction'),
    (-4, 'reaction, not analysis'), (-5, 'hot take'), (-6, ''), (-7, NULL)))"""
PARSED_SQL = f"""parsed AS (
  SELECT ex_id, raw, {parse_sql("raw")} AS label FROM responses)"""


def answer(text: Column) -> Column:
    """What a careless reader of a whole text would answer; some of it names no label."""
    n = F.length(text)
    return (
        F.when(text.contains("|"), "reaction, not analysis")
        .when(text.contains("!!"), " HOT_TAKE. ")
        .when(text.rlike("[0-9]"), "I would say reaction")
        .when(n > 2500, "Analysis.")
        .when(n > 1200, "a reaction")
        .when(n > 500, "hot_take")
        .when(n > 200, "hot take")
        .when(n > 60, "")
    )


ANSWERED_SQL = f"""answers AS (
  SELECT ex_id, CASE WHEN contains(text, '|') THEN 'reaction, not analysis'
    WHEN contains(text, '!!') THEN ' HOT_TAKE. ' WHEN regexp_matches(text, '[0-9]') THEN 'I would say reaction'
    WHEN length(text) > 2500 THEN 'Analysis.' WHEN length(text) > 1200 THEN 'a reaction'
    WHEN length(text) > 500 THEN 'hot_take' WHEN length(text) > 200 THEN 'hot take'
    WHEN length(text) > 60 THEN '' END AS raw FROM gold),
answered AS (SELECT ex_id, {parse_sql("raw")} AS label FROM answers)"""


def answer_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The labels that the answers to the gold texts name."""
    return gold(spark, sf).select("ex_id", parse_response(answer(F.col("text"))).alias("label"))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Three scores per vector: the whole of it projected on three fixed vectors of weight.

    Weights are 10 at every third place, from the first, second or third on, and 0 elsewhere.
    """

    def project(start: int):
        part = F.filter("embedding", lambda x, i: i % 3 == start)
        return F.aggregate(part, F.lit(0.0), lambda total, x: total + x.cast("double") * 10)

    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ex_id"),
        F.element_at(
            F.array(*[F.lit(name) for name in fixed.LABELS]), (F.col("label") % 3 + 1).cast("int")
        ).alias("label"),
        F.array(*[project(i) for i in range(3)]).alias("scores"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).withColumn("p", softmax(F.col("scores")))


LOGITS_SQL = """logits AS (
  SELECT vec_id AS ex_id,
         CASE label % 3 WHEN 0 THEN 'analysis' WHEN 1 THEN 'hot_take' ELSE 'reaction' END AS label,
         list_sum([CAST(x AS DOUBLE) * 10 FOR x, i IN embedding IF i % 3 = 1]) AS a,
         list_sum([CAST(x AS DOUBLE) * 10 FOR x, i IN embedding IF i % 3 = 2]) AS h,
         list_sum([CAST(x AS DOUBLE) * 10 FOR x, i IN embedding IF i % 3 = 0]) AS r
  FROM embeddings),
scored AS (
  SELECT ex_id, label, exp(a - m) / s AS pa, exp(h - m) / s AS ph, exp(r - m) / s AS pr,
         CASE WHEN a = m THEN 'analysis' WHEN h = m THEN 'hot_take' ELSE 'reaction' END AS predicted,
         CASE WHEN a = m THEN 0 WHEN h = m THEN 1 ELSE 2 END AS predicted_id,
         greatest(exp(a - m), exp(h - m), exp(r - m)) / s AS confidence
  FROM (SELECT *, exp(a - m) + exp(h - m) + exp(r - m) AS s
        FROM (SELECT *, greatest(a, h, r) AS m FROM logits)))"""


# --- the cascade in SQL -------------------------------------------------------
_OPINION_WORDS = (
    "overrated|underrated|should|best|worst|hate|love|better|terrible|fire him|sack him"
    "|disgrace|brilliant|awful|amazing|pathetic"
)
NOTE_SQL = rf"""CASE
  WHEN n > 1500 AND regexp_matches(tl, 'auto-refreshing|line-ups|starting xi|match events \| via espn|subs:|substitution, |corner\. assisted by') THEN 'match_thread_body'
  WHEN n > 1000 AND contains(tl, 'match stats') AND contains(tl, 'possession') AND contains(tl, 'shots on goal') THEN 'post_match_thread_body'
  WHEN n < 300 AND regexp_matches(t, '^\[[^\n]{{1,60}}\]<WS>') AND NOT regexp_matches(tl, '{_OPINION_WORDS}') THEN 'news_post'
  WHEN regexp_matches(tl, 'tickets available|for sale|ebay|promo code|affiliate|pixel cleaning') THEN 'commercial'
  WHEN n < 300 AND starts_with(tl, 'match thread:') THEN 'match_thread_header'
  WHEN n > 5000 THEN 'too_long_article'
  WHEN n > 500 AND contains(tl, 'what to watch this week') THEN 'schedule_post'
  WHEN source = 'match_thread_comment' THEN 'match_thread_comment'
  WHEN n < 180 AND regexp_matches(t, '<LB>\[\p{{Nd}}+\][<WSI>\-–]+\p{{Nd}}+') THEN 'score_update'
  WHEN n < 150 AND regexp_matches(head, '^[\p{{L}}\p{{N}}_<WSI>\[\]()]+\p{{Nd}}[\-–]\p{{Nd}}[\p{{L}}\p{{N}}_<WSI>]+$') THEN 'result_line'
  WHEN n < 350 AND regexp_matches(tl, 'becomes|scored|makes history|first (player|team|country|time)|only (player|team)|sets|breaks|equalled')
    AND NOT regexp_matches(tl, 'xg|possession|pass completion|per 90|tactical') THEN 'historic_moment_factoid'
  WHEN n < 600 AND regexp_matches(tl, 'fans celebrating|fans before|comforting after|show love|tribute|farewell|retirement|retired from the beautiful game') THEN 'fan_moment'
  WHEN n < 300 AND regexp_matches(tl, '^(seeing|watching|just saw|witnessing)') THEN 'personal_reaction'
  WHEN n < 80 AND regexp_matches(tl, 'what a|oh my|holy|lmao|wtf|lol|incredible|unreal|this is insane|can t believe') THEN 'short_exclamation'
  WHEN n > 350 AND regexp_matches(tl, 'xg|expected goals|possession %|pressing intensity|progressive passes|formation|high line|tactical|per 90|pass completion|win rate|underlying numbers|statistically|since records began|all-time|historically|according to|data shows|coefficient|financial fair play|transfer fee record|inflation adjusted') THEN 'long_analytical'
  WHEN n > 500 AND ((contains(t, '---') AND length(t) - length(replace(t, '|', '')) > 4) OR length(t) - length(replace(t, chr(10), '')) > 6)
    AND regexp_matches(tl, 'season|goals|assists|league|world cup|top scorer') THEN 'statistical_table'
  WHEN n > 1000 AND NOT regexp_matches(t, '^\[[^\n]{{1,60}}\]<WS>')
    AND NOT regexp_matches(substr(tl, 1, 100), 'official|confirmed|signing|transfer|appointed') THEN 'long_form_post'
  WHEN n > 400 AND len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '(19|20)\p{{Nd}}\p{{Nd}}'))) >= 3 THEN 'multi_season_comparison'
  WHEN regexp_matches(tl, '<LB>is<G30>(overrated|underrated|the best|the worst|elite|trash|a bum)<RB>')
    OR regexp_matches(tl, '<LB>will never<RB>')
    OR regexp_matches(tl, '<LB>(should|deserves? to) (be|have|win|get)<RB>')
    OR regexp_matches(tl, '^(honestly|actually|unpopular opinion|hot take|controversial take)')
    OR regexp_matches(tl, '<LB>(change my mind|fight me|prove me wrong)<RB>')
    OR regexp_matches(tl, '<LB>(can we please|why (is|does|did|are|can)|how (is|does|can))<RB>')
    OR regexp_matches(tl, '<LB>(am i the only one|does anyone else|seriously though)<RB>')
    OR regexp_matches(tl, '<LB>the greatest<G30>ever<RB>')
    OR regexp_matches(tl, '<LB>(fire|sack) (him|the|our)<RB>') THEN 'opinion_marker'
  WHEN regexp_matches(tl, 'overrated|underrated|bum|trash|goat|greatest ever|best ever|worst ever|most overrated|genuinely think|unpopular|controversy|hot take|i mean come on|genuinely believe|couldn''t even|has no business|got their asses kicked|shameful|disgusting|braindead') THEN 'opinion_keyword'
  WHEN n < 250 AND ends_with(t, '?') AND regexp_matches(tl, '<LB>(best|worst|greatest|better|should|could|would|overrated|underrated|deserve|ever|most|more)<RB>') THEN 'opinionated_question'
  WHEN n < 500 AND (starts_with(t, '"') OR regexp_matches(t, '^[\p{{L}}\p{{N}}_<WSI>\[\]]+:<WS>*"'))
    AND regexp_matches(tl, '<LB>(better|best|worst|never|always|should|must|think|believe|right now|the problem|the issue|doesn[^\n]t deserve)<RB>') THEN 'pundit_quote_opinion'
  WHEN regexp_matches(tl, '<LB>(is|was|were|are)<G40>(good|bad|poor|great|terrible|awful|brilliant|embarrassing|shameful|pathetic|incredible|class|clinical|dominant)<RB>')
    OR regexp_matches(tl, '<LB>(better|worse|best|worst)<WS>+than<RB>')
    OR regexp_matches(tl, '<LB>(deserves?|should|has to|needs to|must)<RB>')
    OR regexp_matches(tl, '<LB>(letting|allowing|conceding)<H30>(embarrassing|bad|poor|should)')
    OR regexp_matches(tl, '<LB>(not|never|no way|can[^\n]t believe)<G30>(win|beat|score|compete)<RB>')
    OR regexp_matches(tl, '<LB>(as good as|as bad as|same as|comparable to)<RB>')
    OR regexp_matches(tl, '<LB>proves?<G40>(point|right|wrong|theory)<RB>')
    OR regexp_matches(tl, '^(i|we) (stop|stopped|hate|love|can[^\n]t)') THEN 'judgment_assertion'
  WHEN n < 400 AND regexp_matches(tl, '^(i |we |my |honestly |actually |tbh |imo |in my )') THEN 'first_person_opinion'
  WHEN n < 300 AND ends_with(t, '?') THEN 'discussion_question'
  WHEN n < 120 AND regexp_matches(tl, '^(what a|oh my|holy|lmao|wtf|lol|incredible|unreal|this is|look at|just saw|haha)') THEN 'short_exclamation'
  WHEN n < 120 THEN 'short_opinion'
  WHEN n < 400 AND regexp_matches(tl, '<LB>(i think|i believe|honestly|actually|feel like|seems like|looks like|clearly|obviously|definitely|absolutely)<RB>') THEN 'soft_opinion'
  WHEN n < 200 THEN 'short_default'
  ELSE 'long_default' END"""
LABEL_SQL = """CASE
  WHEN note IN ('match_thread_body', 'post_match_thread_body', 'news_post', 'commercial',
                'match_thread_header', 'too_long_article', 'schedule_post') THEN 'skip'
  WHEN note IN ('match_thread_comment', 'score_update', 'result_line', 'historic_moment_factoid',
                'fan_moment', 'personal_reaction', 'short_exclamation', 'short_default')
    THEN 'reaction'
  WHEN note IN ('long_analytical', 'statistical_table', 'long_form_post',
                'multi_season_comparison', 'long_default') THEN 'analysis'
  ELSE 'hot_take' END"""


def features_sql(source: str) -> str:
    """CTE ``feats``: stripped and lower text, length and head segment of a relation."""
    return f"""feats AS (
  SELECT *, lower(t) AS tl, length(t) AS n, trim(split_part(t, '--', 1), '<TRIM>') AS head
  FROM (SELECT *, trim(text, '<TRIM>') AS t FROM {source}))"""


def cascade_sql(source: str, *keep: str) -> str:
    """CTE ``labelled``: ex_id, ordinal, text, source, label, note of a relation."""
    return f"""{features_sql(source)},
noted AS (SELECT *, {NOTE_SQL} AS note FROM feats),
labelled AS (
  SELECT ex_id, ordinal, text, source, n, note, {LABEL_SQL} AS label FROM noted)"""


# Gold documents with the cascade's label and the parsed answer.
PREDICTED_SQL = f"""{GOLD_SQL},
{ANSWERED_SQL},
unlabelled AS (SELECT ex_id, ordinal, text, source FROM gold),
{cascade_sql("unlabelled")},
predicted AS (
  SELECT g.ex_id, g.ordinal, g.text, g.label, NULLIF(l.label, 'skip') AS predicted,
         p.label AS answered, l.note, l.n
  FROM gold g JOIN labelled l USING (ex_id) LEFT JOIN answered p USING (ex_id))"""
