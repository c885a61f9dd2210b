"""Sources and sinks: tables are written to the shared folder and read back."""

from pyspark.sql import functions as F

from postlabel import sources
from postlabel.operators import rules
from postlabel.plans import jobs
from postlabel.session import scratch_path

from .base import (
    COMMENTS_SQL,
    EXAMPLES_SQL,
    POSTS_SQL,
    PREDICTED_SQL,
    RESPONSES_SQL,
    answer_predictions,
    cascade_sql,
    comments,
    examples,
    gold,
    posts,
    query,
    responses,
    rule_predictions,
    table,
)
from .evaluation import _COMPARED_SQL

LABELLED = f"WITH {EXAMPLES_SQL},\n{cascade_sql('examples')}\n"


@query(
    f"""WITH {POSTS_SQL}
SELECT id, strftime(created_utc, '%Y-%m-%d %H:%M:%S') AS created, title, selftext,
  CAST(coalesce(num_comments, -1) AS INTEGER) AS num_comments FROM posts"""
)
def read_posts(spark, sf):
    path = scratch_path(spark, "posts")
    posts(spark, sf).write.json(path)
    return sources.read_posts(spark, path).select(
        "id",
        F.date_format("created_utc", "yyyy-MM-dd HH:mm:ss").alias("created"),
        "title",
        "selftext",
        F.coalesce("num_comments", F.lit(-1)).alias("num_comments"),
    )


@query(f"WITH {COMMENTS_SQL} SELECT id, post_id, body FROM comments")
def read_comments(spark, sf):
    path = scratch_path(spark, "comments")
    archive = comments(spark, sf).select(
        "id", F.concat(F.lit("t3_"), "post_id").alias("link_id"), "created_utc", "body"
    )
    archive.write.json(path)
    return sources.read_comments(spark, path).select("id", "post_id", "body")


# --- archives with broken lines -----------------------------------------------


def _accounted(spark, taken):
    """Rows by reason as counted on the way, beside those that were written."""
    names = {"read": "read", **{k: k for k in taken.counts if k != "read"}}
    counted = spark.createDataFrame([(k, taken.counts[k]) for k in names], "reason STRING, rows BIGINT")
    written = taken.dead.groupBy("reason").agg(F.count(F.lit(1)).alias("written"))
    kept = taken.kept.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("written"))
    both = counted.join(written.unionByName(kept), "reason", "left")
    return both.select("reason", "rows", F.coalesce("written", F.lit(0).cast("bigint")).alias("written"))


def _broken(json, number):
    """Every tenth line is cut in half."""
    return F.when(number % 10 == 1, F.substring(json, F.lit(1), F.floor(F.length(json) / 2).cast("int"))).otherwise(json)


def accounted_sql(rows: str, *reasons: str) -> str:
    """Counts of a relation's column ``reason``, of all reasons there can be."""
    names = ", ".join(f"('{r}')" for r in ("kept", "broken record", *reasons))
    return f"""SELECT 'read' AS reason, CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS written FROM ({rows})
UNION ALL SELECT n.reason, CAST(count(r.reason) AS BIGINT), CAST(count(r.reason) AS BIGINT)
FROM (VALUES {names}) AS n(reason) LEFT JOIN ({rows}) AS r ON r.reason = n.reason GROUP BY n.reason"""


@query(
    accounted_sql(
        """SELECT CASE doc_id % 10 WHEN 1 THEN 'broken record' WHEN 2 THEN 'no id' WHEN 3 THEN 'no time'
          WHEN 4 THEN 'no title' ELSE 'kept' END AS reason FROM documents""",
        "no id", "no time", "no title",
    )
)
def intake_posts(spark, sf):
    """Posts as lines of JSON, some of them broken or without what is needed, in both forms of time."""
    path, out = scratch_path(spark, "raw-posts"), scratch_path(spark, "posts-taken")
    number = F.substring("id", 2, 20).cast("bigint")
    iso = F.date_format("created_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    created = F.when(number % 10 == 3, "yesterday").when(number % 2 == 0, F.unix_timestamp("created_utc").cast("string")).otherwise(iso)
    line = F.to_json(
        F.struct(
            F.when(number % 10 != 2, F.col("id")).alias("id"),
            created.alias("created_utc"),
            F.when(number % 10 != 4, F.concat("title", F.lit("."))).alias("title"),
            "selftext",
            "num_comments",
        )
    )
    posts(spark, sf).select(_broken(line, number).alias("value")).write.text(path)
    return _accounted(spark, sources.take_in_posts(spark, path, out))


@query(
    f"""WITH {POSTS_SQL}
SELECT id, strftime(created_utc, '%Y-%m-%d %H:%M:%S') AS created, title FROM posts WHERE CAST(substr(id, 2) AS BIGINT) % 10 NOT IN (1, 2)"""
)
def intake_posts_kept(spark, sf):
    """What is kept of the same archive, when only broken lines and missing ids are faults in it."""
    path, out = scratch_path(spark, "raw-posts"), scratch_path(spark, "posts-taken")
    number = F.substring("id", 2, 20).cast("bigint")
    rows = posts(spark, sf).select(number.alias("number"), F.struct("*").alias("row"))
    line = F.to_json(
        F.struct(
            F.when(F.col("number") % 10 != 2, F.col("row.id")).alias("id"),
            F.when(F.col("number") % 2 == 0, F.unix_timestamp("row.created_utc").cast("string"))
            .otherwise(F.date_format("row.created_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .alias("created_utc"),
            F.concat("row.title", F.lit(".")).alias("title"),
        )
    )
    rows.select(_broken(line, F.col("number")).alias("value")).write.text(path)
    kept = sources.take_in_posts(spark, path, out).kept
    return kept.select(
        "id", F.date_format("created_utc", "yyyy-MM-dd HH:mm:ss").alias("created"), F.expr("left(title, length(title) - 1)").alias("title")
    )


@query(
    accounted_sql(
        """SELECT CASE (conv_id * 31 + turn) % 10 WHEN 1 THEN 'broken record' WHEN 2 THEN 'no id' WHEN 3 THEN 'no thread'
          WHEN 4 THEN 'no body' ELSE 'kept' END AS reason FROM conversations""",
        "no id", "no thread", "no body",
    )
)
def intake_comments(spark, sf):
    path, out = scratch_path(spark, "raw-comments"), scratch_path(spark, "comments-taken")
    number = F.col("conv_id") * 31 + F.col("turn")
    line = F.to_json(
        F.struct(
            F.when(number % 10 != 2, F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("id"),
            F.when(number % 10 != 3, F.concat(F.lit("t3_p"), F.col("conv_id").cast("string"))).alias("link_id"),
            F.lit(1700000000.5).alias("created_utc"),
            F.when(number % 10 != 4, F.col("text")).alias("body"),
        )
    )
    table(spark, sf, "conversations").select(_broken(line, number).alias("value")).write.text(path)
    return _accounted(spark, sources.take_in_comments(spark, path, out))


@query(
    f"WITH {RESPONSES_SQL}\n"
    + accounted_sql(
        """SELECT CASE WHEN ex_id % 10 = 1 THEN 'broken record' WHEN ex_id % 10 = 2 THEN 'no example'
          WHEN raw IS NULL OR ex_id % 10 = 3 THEN 'no answer' ELSE 'kept' END AS reason FROM responses""",
        "no example", "no answer",
    )
)
def intake_responses(spark, sf):
    path, out = scratch_path(spark, "raw-responses"), scratch_path(spark, "responses-taken")
    number = F.col("ex_id")
    line = F.to_json(F.struct(F.when(number % 10 != 2, number).alias("ex_id"), F.when(number % 10 != 3, F.col("raw")).alias("raw")))
    responses(spark, sf).select(_broken(line, number).alias("value")).write.text(path)
    return _accounted(spark, sources.take_in_responses(spark, path, out))


@query(f"WITH {RESPONSES_SQL} SELECT ex_id, raw FROM responses")
def read_responses(spark, sf):
    path = scratch_path(spark, "responses")
    responses(spark, sf).write.json(path)
    return sources.read_responses(spark, path)


@query(LABELLED + "SELECT text, label, source, note AS notes FROM labelled")
def examples_csv(spark, sf):
    path = scratch_path(spark, "examples")
    labelled = rules.label_posts(examples(spark, sf))
    sources.write_examples_csv(
        labelled.select("text", "label", "source", F.col("note").alias("notes")), path
    )
    return sources.read_examples_csv(spark, path).select("text", "label", "source", "notes")


@query(LABELLED + "SELECT text, label FROM labelled WHERE label <> 'skip'")
def export_clean(spark, sf):
    path = scratch_path(spark, "clean")
    labelled = rules.labelable(rules.label_posts(examples(spark, sf)))
    sources.write_examples_csv(sources.export_clean(labelled), path)
    columns = "text STRING, label STRING"
    return sources.read_examples_csv(spark, path, columns).select("text", "label")


@query(f"WITH {PREDICTED_SQL}" + _COMPARED_SQL)
def results_json(spark, sf):
    path = scratch_path(spark, "results")
    result = jobs.evaluate(
        answer_predictions(spark, sf), rule_predictions(spark, sf), gold(spark, sf), "rules"
    )
    sources.write_results_json(result.comparison, path)
    schema = (
        "baseline_accuracy DOUBLE, finetuned_accuracy DOUBLE, improvement DOUBLE, direction STRING, "
        "baseline_macro_f1 DOUBLE, finetuned_macro_f1 DOUBLE, macro_f1_improvement DOUBLE, both_right BIGINT, "
        "only_baseline_right BIGINT, only_finetuned_right BIGINT, neither_right BIGINT, "
        "test_set_size BIGINT, baseline_evaluated BIGINT, "
        "finetuned_evaluated BIGINT, label_map STRING, model STRING"
    )
    return spark.read.schema(schema).json(path)
