"""Union, dedupe, caps, shuffle, reviews, splits and their reports."""

from pyspark.sql import functions as F

from postlabel.operators import corpus, ranking, report, rules
from postlabel.session import cut_lineage

from .base import (
    EXAMPLES_SQL,
    GOLD_SQL,
    TURNS_SQL,
    cascade_sql,
    documents,
    examples,
    gold,
    query,
    table,
    turns,
)

LABELLED = f"WITH {EXAMPLES_SQL},\n{cascade_sql('examples')}"


def _labelled(spark, sf):
    return rules.labelable(rules.label_posts(examples(spark, sf)))


@query(
    """SELECT doc_id, text FROM (
  SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy
  FROM documents) WHERE copy = 1"""
)
def dedupe_text(spark, sf):
    return corpus.dedupe_text(documents(spark, sf).select("doc_id", "text"), ["doc_id"])


@query(
    f"""WITH {EXAMPLES_SQL},
{TURNS_SQL}
SELECT 0 AS input_no, ex_id, source FROM examples
UNION ALL SELECT 1, ex_id, source FROM turns"""
)
def union_all(spark, sf):
    both = corpus.union_all(examples(spark, sf), turns(spark, sf))
    return both.select("input_no", "ex_id", "source")


@query(
    LABELLED
    + """
SELECT ex_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label
  ORDER BY md5('42:' || ex_id), ex_id) AS rn FROM labelled WHERE label <> 'skip') WHERE rn <= 80"""
)
def cap_random(spark, sf):
    return corpus.cap_random(_labelled(spark, sf)).select("ex_id", "label")


@query(
    LABELLED
    + """
SELECT ex_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY
  CASE WHEN label = 'analysis' THEN -length(text) ELSE 0 END, ordinal) AS rn
  FROM labelled WHERE label <> 'skip') WHERE rn <= 80"""
)
def cap_preferring(spark, sf):
    return corpus.cap_preferring(_labelled(spark, sf)).select("ex_id", "label")


# A cap above the pruned k: ranked without gathering a group.
@query(
    """SELECT event_id, event_type, rank FROM (
  SELECT event_id, event_type,
    row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
  FROM events) WHERE rank <= 1500"""
)
def top_per_group_large(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    order = [F.col("value").desc(), F.col("event_id")]
    top = ranking.top_per_group(events, ["event_type"], order, 1500)
    return top.select("event_id", "event_type", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT doc_id AS ex_id, md5('42:' || doc_id) AS shuffle_key FROM documents")
def shuffle(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("ex_id"))
    return corpus.shuffle(ids)


REVIEWS_SQL = """reviews AS (
  SELECT doc_id AS ex_id,
    CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'confirm' ELSE 'change' END AS decision,
    CASE WHEN toxic = 0 AND quality = 0 THEN 'hot_take' END AS label
  FROM labels)"""


def _reviews(spark, sf):
    toxic, quality = F.col("toxic") == 1, F.col("quality") == 1
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("ex_id"),
        F.when(toxic, "drop").when(quality, "confirm").otherwise("change").alias("decision"),
        F.when(~toxic & ~quality, "hot_take").alias("label"),
    )


@query(
    LABELLED
    + f""",
{REVIEWS_SQL}
SELECT l.ex_id, CASE WHEN r.decision = 'change' THEN coalesce(r.label, l.label) ELSE l.label END AS label,
  l.note, CASE WHEN r.decision IS NULL THEN 'pre-labeled' ELSE 'reviewed' END AS status
FROM labelled l LEFT JOIN reviews r USING (ex_id)
WHERE l.label <> 'skip' AND (r.decision IS NULL OR r.decision <> 'drop')"""
)
def apply_reviews(spark, sf):
    reviewed = corpus.apply_reviews(_labelled(spark, sf), _reviews(spark, sf))
    return reviewed.select("ex_id", "label", "note", "status")


# Every labelled document is reviewed by one, two or three people, who do not always agree.
MANY_REVIEWS_SQL = """reviews AS (
  SELECT doc_id AS ex_id, 'r' || k AS reviewer, TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 7 + k * 3) % 5) AS reviewed_at,
    CASE WHEN k = 1 AND doc_id % 4 = 0 THEN 'change' WHEN k = 2 AND doc_id % 6 = 0 THEN 'drop'
      WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'confirm' ELSE 'change' END AS decision,
    CASE WHEN k = 1 AND doc_id % 8 = 0 THEN 'reaction' WHEN quality = 0 THEN 'hot_take' END AS label
  FROM labels, (VALUES (0), (1), (2)) AS v(k) WHERE k <= doc_id % 3)"""


def _many_reviews(spark, sf):
    doc, k = F.col("doc_id"), F.col("k")
    people = F.explode(F.sequence(F.lit(0), (doc % 3).cast("int"))).alias("k")
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    return (
        table(spark, sf, "labels")
        .select("*", people)
        .select(
            doc.alias("ex_id"),
            F.concat(F.lit("r"), k.cast("string")).alias("reviewer"),
            F.timestamp_seconds(start + (doc * 7 + k * 3) % 5).alias("reviewed_at"),
            F.when((k == 1) & (doc % 4 == 0), "change")
            .when((k == 2) & (doc % 6 == 0), "drop")
            .when(F.col("toxic") == 1, "drop")
            .when(F.col("quality") == 1, "confirm")
            .otherwise("change")
            .alias("decision"),
            F.when((k == 1) & (doc % 8 == 0), "reaction").when(F.col("quality") == 0, "hot_take").alias("label"),
        )
    )


@query(
    LABELLED
    + f""",
{MANY_REVIEWS_SQL},
last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ex_id ORDER BY reviewed_at DESC, reviewer DESC) AS place
    FROM reviews) WHERE place = 1)
SELECT l.ex_id, CASE WHEN r.decision = 'change' THEN coalesce(r.label, l.label) ELSE l.label END AS label,
  l.note, CASE WHEN r.decision IS NULL THEN 'pre-labeled' ELSE 'reviewed' END AS status
FROM labelled l LEFT JOIN last r USING (ex_id)
WHERE l.label <> 'skip' AND (r.decision IS NULL OR r.decision <> 'drop')"""
)
def apply_many_reviews(spark, sf):
    reviewed = corpus.apply_reviews(_labelled(spark, sf), _many_reviews(spark, sf))
    return reviewed.select("ex_id", "label", "note", "status")


@query(
    f"""WITH {MANY_REVIEWS_SQL}
SELECT ex_id, CAST(count(*) AS BIGINT) AS reviews, array_to_string(list_sort(list(DISTINCT decision)), ',') AS decisions,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels
FROM reviews GROUP BY ex_id HAVING count(DISTINCT decision) > 1 OR count(DISTINCT label) > 1"""
)
def review_conflicts(spark, sf):
    conflicts = corpus.review_conflicts(_many_reviews(spark, sf))
    return conflicts.select(
        "ex_id", "reviews", F.array_join("decisions", ",").alias("decisions"), F.array_join("labels", ",").alias("labels")
    )


SPLIT_SQL = f"""{GOLD_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || ex_id), ex_id) AS rn,
    count(*) OVER (PARTITION BY label) AS group_rows FROM gold),
sized AS (SELECT *, floor(0.7 * group_rows + 0.5) AS n_train FROM ranked),
split AS (
  SELECT *, CASE WHEN rn <= n_train THEN 'train'
    WHEN rn <= n_train + floor((group_rows - n_train) / 2) THEN 'val' ELSE 'test' END AS split
  FROM sized)"""


def split_gold(spark, sf):
    """Gold rows with their split, which is ranked once, on ids and labels, and kept."""
    rows = gold(spark, sf)
    split = corpus.stratified_split(rows.select("ex_id", "label")).select("ex_id", "split")
    return rows.join(cut_lineage(split), "ex_id")


@query(f"WITH {SPLIT_SQL}\nSELECT ex_id, label, split FROM split")
def stratified_split(spark, sf):
    # Ids and labels alone are ranked; the texts need not be shuffled.
    return corpus.stratified_split(gold(spark, sf).select("ex_id", "label"))


@query(
    """SELECT doc_id AS ex_id, CASE WHEN f < 0.7 THEN 'train' WHEN f < 0.7 + 0.15 THEN 'val'
  ELSE 'test' END AS split
FROM (SELECT doc_id,
  CAST(('0x' || substr(md5('42:' || doc_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS f
  FROM documents)"""
)
def split_by_hash(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("ex_id"))
    return corpus.split_by_hash(ids)


@query(
    f"""WITH {SPLIT_SQL}
SELECT 'id' AS kind, CAST(count(*) AS BIGINT) AS keys, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS shared
FROM (SELECT ex_id, count(DISTINCT split) AS n FROM split GROUP BY ex_id)
UNION ALL
SELECT 'text', count(*), count(*) FILTER (WHERE n > 1)
FROM (SELECT text, count(DISTINCT split) AS n FROM split GROUP BY text)"""
)
def split_overlap(spark, sf):
    # Texts stand for themselves by their digest, so none is shuffled.
    rows = gold(spark, sf).select("ex_id", "label", F.sha2("text", 256).alias("text"))
    return corpus.split_overlap(corpus.stratified_split(rows))


@query(
    f"""WITH {SPLIT_SQL}
SELECT coalesce(split, 'ALL') AS split, coalesce(label, 'ALL') AS label,
  CAST(count(*) AS BIGINT) AS rows FROM split GROUP BY CUBE (split, label)"""
)
def split_sizes(spark, sf):
    return report.split_sizes(corpus.stratified_split(gold(spark, sf).select("ex_id", "label")))


@query(
    LABELLED
    + """
SELECT label, CAST(count(*) AS BIGINT) AS rows,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent
FROM labelled GROUP BY label"""
)
def distribution(spark, sf):
    return report.distribution(rules.label_posts(examples(spark, sf)), "label")


@query(
    LABELLED
    + """,
counted AS (
  SELECT d.label, CAST(count(l.label) AS BIGINT) AS rows
  FROM (VALUES ('analysis'), ('hot_take'), ('reaction')) AS d(label) LEFT JOIN labelled l USING (label)
  GROUP BY d.label)
SELECT label, rows, round(rows / sum(rows) OVER (), 4) AS share,
  rows / sum(rows) OVER () > 0.7 AS too_large, rows < 50 AS too_rare FROM counted"""
)
def balance_check(spark, sf):
    return report.balance_check(_labelled(spark, sf))


@query(
    """SELECT event_type AS label, CAST(count(*) AS BIGINT) AS rows FROM events
WHERE event_type NOT IN ('click', 'view', 'purchase', 'error') GROUP BY event_type"""
)
def unknown_labels(spark, sf):
    domain = ("click", "view", "purchase", "error")
    return corpus.unknown_labels(table(spark, sf, "events"), domain, "event_type")


@query(
    LABELLED
    + f""",
{REVIEWS_SQL}
SELECT label FROM labelled EXCEPT SELECT label FROM reviews WHERE label IS NOT NULL"""
)
def label_difference(spark, sf):
    reviewed = _reviews(spark, sf).where("label IS NOT NULL")
    return corpus.label_difference(rules.label_posts(examples(spark, sf)), reviewed)
