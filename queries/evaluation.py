"""Predictions against truth: matrix, report, comparison, errors, gates, agreement."""

from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.labels import parse_response
from postlabel.functions.scores import argmax, softmax
from postlabel.operators import metrics, report
from postlabel.operators.model import fit_naive_bayes, score_naive_bayes
from postlabel.operators.model import rule_baseline as rules_as_model

from .base import (
    LOGITS_SQL,
    PREDICTED_SQL,
    answer,
    answer_predictions,
    documents,
    gold,
    query,
    rule_predictions,
    scored,
)
from .corpora import SPLIT_SQL, split_gold
from .learning import NAIVE_BAYES_SQL

PREDICTED = f"WITH {PREDICTED_SQL}"
_LABELS = "(VALUES ('analysis'), ('hot_take'), ('reaction'))"

# Per-class counts, then scores, for any relation ``pairs(label, predicted)``.
SCORES_SQL = f"""counted AS (
  SELECT d.label,
    count(*) FILTER (WHERE p.label = d.label AND p.predicted = d.label) AS hit,
    count(*) FILTER (WHERE p.label = d.label AND p.predicted IS NOT NULL) AS support,
    count(*) FILTER (WHERE p.predicted = d.label) AS predicted
  FROM {_LABELS} AS d(label), pairs p GROUP BY d.label),
classes AS (
  SELECT label, support, predicted, hit,
    CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE hit / predicted END AS precision,
    CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hit / support END AS recall,
    CASE WHEN predicted + support = 0 THEN 0.0::DOUBLE ELSE 2 * hit / (predicted + support) END AS f1
  FROM counted),
overall AS (SELECT sum(hit) AS hits, sum(support) AS rows, sum(hit) / sum(support) AS accuracy FROM classes)"""


def _pairs(spark, sf):
    """Predictions beside the truth and the text, made on the gold rows in place."""
    predicted = rules_as_model(gold(spark, sf).withColumnRenamed("label", "truth"))
    return predicted.select("ex_id", F.col("truth").alias("label"), F.col("label").alias("predicted"), "text")


def _both(spark, sf):
    """Both models' predictions, made on the gold rows in place."""
    answered = parse_response(answer(F.col("text")))
    return _pairs(spark, sf).select(
        "ex_id", "label", answered.alias("predicted_a"), F.col("predicted").alias("predicted_b")
    )


@query(PREDICTED + "\nSELECT ex_id, label, predicted FROM predicted")
def align(spark, sf):
    return metrics.align(rule_predictions(spark, sf), gold(spark, sf))


@query(PREDICTED + "\nSELECT ex_id, predicted AS label, note FROM predicted")
def rule_baseline(spark, sf):
    return rules_as_model(gold(spark, sf).drop("label")).select("ex_id", "label", "note")


@query(PREDICTED + "\nSELECT ex_id, label, predicted, text FROM predicted WHERE predicted <> label")
def attach_text(spark, sf):
    errors = metrics.wrong_predictions(_pairs(spark, sf).drop("text"))
    texts = documents(spark, sf).select(F.col("doc_id").alias("ex_id"), "text")
    return metrics.attach_text(errors, texts)


@query(
    PREDICTED
    + "\nSELECT ex_id, label, answered AS predicted_a, predicted AS predicted_b FROM predicted"
)
def compare_models(spark, sf):
    return metrics.compare_models(
        answer_predictions(spark, sf), rule_predictions(spark, sf), gold(spark, sf)
    )


@query(
    PREDICTED
    + f"""
SELECT t.label, p.label AS predicted, CAST(count(x.ex_id) AS BIGINT) AS rows
FROM {_LABELS} AS t(label) CROSS JOIN {_LABELS} AS p(label)
LEFT JOIN predicted x ON x.label = t.label AND x.predicted = p.label GROUP BY t.label, p.label"""
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_pairs(spark, sf))


@query(
    PREDICTED
    + f"""
SELECT d.label, CAST(count(*) FILTER (WHERE x.predicted = 'analysis') AS BIGINT) AS analysis,
  CAST(count(*) FILTER (WHERE x.predicted = 'hot_take') AS BIGINT) AS hot_take,
  CAST(count(*) FILTER (WHERE x.predicted = 'reaction') AS BIGINT) AS reaction
FROM {_LABELS} AS d(label) LEFT JOIN predicted x USING (label) GROUP BY d.label"""
)
def confusion_matrix_wide(spark, sf):
    return metrics.confusion_matrix_wide(_pairs(spark, sf))


@query(
    PREDICTED
    + """
SELECT CAST(count(*) FILTER (WHERE predicted = label) AS BIGINT) AS hits,
  CAST(count(predicted) AS BIGINT) AS rows,
  round(count(*) FILTER (WHERE predicted = label) / count(predicted), 4) AS accuracy FROM predicted"""
)
def accuracy(spark, sf):
    return metrics.accuracy(_pairs(spark, sf))


@query(
    PREDICTED
    + f""",
pairs AS (SELECT label, predicted FROM predicted),
{SCORES_SQL}
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
  CAST(support AS BIGINT) AS support FROM classes
UNION ALL SELECT 'accuracy', round(accuracy, 4), round(accuracy, 4), round(accuracy, 4), CAST(rows AS BIGINT) FROM overall
UNION ALL SELECT 'macro avg', round(sum(precision) / 3, 4), round(sum(recall) / 3, 4), round(sum(f1) / 3, 4),
  CAST(sum(support) AS BIGINT) FROM classes
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
  round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
  CAST(sum(support) AS BIGINT) FROM classes"""
)
def class_report(spark, sf):
    return metrics.class_report(_pairs(spark, sf))


@query(
    PREDICTED
    + """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(answered) AS BIGINT) AS evaluated,
  CAST(count(*) - count(answered) AS BIGINT) AS unparsed,
  round(count(answered) / count(*), 4) AS coverage FROM predicted"""
)
def parse_coverage(spark, sf):
    pairs = metrics.align(answer_predictions(spark, sf), gold(spark, sf))
    return metrics.parse_coverage(pairs)


def f1_sql(name: str, column: str) -> str:
    """CTE ``name``: scores per class of a column of ``predicted``."""
    return f"""{name} AS (
  SELECT label, support, CASE WHEN made = 0 THEN 0.0::DOUBLE ELSE hit / made END AS precision,
    CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hit / support END AS recall,
    CASE WHEN made + support = 0 THEN 0.0::DOUBLE ELSE 2 * hit / (made + support) END AS f1
  FROM (SELECT d.label, count(*) FILTER (WHERE p.label = d.label AND p.{column} = d.label) AS hit,
          count(*) FILTER (WHERE p.label = d.label AND p.{column} IS NOT NULL) AS support,
          count(*) FILTER (WHERE p.{column} = d.label) AS made
        FROM {_LABELS} AS d(label), predicted p GROUP BY d.label))"""


_BOTH_F1_SQL = f"""{f1_sql("f1_a", "answered")},
{f1_sql("f1_b", "predicted")}"""
_COMPARED_SQL = f""",
{_BOTH_F1_SQL}
SELECT round(a, 4) AS baseline_accuracy, round(b, 4) AS finetuned_accuracy,
  round(b - a, 4) AS improvement,
  CASE WHEN b - a >= 0 THEN 'improvement' ELSE 'regression' END AS direction,
  round(ma, 4) AS baseline_macro_f1, round(mb, 4) AS finetuned_macro_f1, round(mb - ma, 4) AS macro_f1_improvement,
  both_right, only_baseline_right, only_finetuned_right, neither_right,
  n AS test_set_size, na AS baseline_evaluated, nb AS finetuned_evaluated,
  '{{"analysis":0,"hot_take":1,"reaction":2}}' AS label_map, 'rules' AS model
FROM (SELECT count(*) FILTER (WHERE answered = label) / count(answered) AS a,
  count(*) FILTER (WHERE predicted = label) / count(predicted) AS b,
  CAST(count(*) FILTER (WHERE answered = label AND predicted = label) AS BIGINT) AS both_right,
  CAST(count(*) FILTER (WHERE answered = label AND predicted IS DISTINCT FROM label) AS BIGINT) AS only_baseline_right,
  CAST(count(*) FILTER (WHERE answered IS DISTINCT FROM label AND predicted = label) AS BIGINT) AS only_finetuned_right,
  CAST(count(*) FILTER (WHERE answered IS DISTINCT FROM label AND predicted IS DISTINCT FROM label) AS BIGINT) AS neither_right,
  CAST(count(*) AS BIGINT) AS n, CAST(count(answered) AS BIGINT) AS na,
  CAST(count(predicted) AS BIGINT) AS nb FROM predicted),
  (SELECT sum(f1) / 3 AS ma FROM f1_a), (SELECT sum(f1) / 3 AS mb FROM f1_b)"""


@query(PREDICTED + _COMPARED_SQL)
def model_comparison(spark, sf):
    record = metrics.model_comparison(_both(spark, sf), "rules")
    return record.withColumn("label_map", F.to_json("label_map"))


@query(
    PREDICTED
    + f""",
{_BOTH_F1_SQL}
SELECT label, round(a.precision, 4) AS precision_a, round(a.recall, 4) AS recall_a, round(a.f1, 4) AS f1_a,
  round(b.precision, 4) AS precision_b, round(b.recall, 4) AS recall_b, round(b.f1, 4) AS f1_b,
  round(b.f1 - a.f1, 4) AS f1_gain, CAST(a.support AS BIGINT) AS support_a, CAST(b.support AS BIGINT) AS support_b
FROM f1_a a JOIN f1_b b USING (label)"""
)
def paired_report(spark, sf):
    return metrics.paired_report(_both(spark, sf))


@query(
    PREDICTED
    + """
SELECT ex_id, label, answered AS predicted_a, predicted AS predicted_b, CASE WHEN answered = label THEN 'a' ELSE 'b' END AS right
FROM predicted WHERE (answered IS NOT DISTINCT FROM label) <> (predicted IS NOT DISTINCT FROM label)"""
)
def disagreements(spark, sf):
    return metrics.disagreements(_both(spark, sf))


@query(
    PREDICTED
    + """
SELECT label, predicted, CAST(count(*) AS BIGINT) AS errors,
  round(count(*) / sum(count(*)) OVER (), 4) AS share
FROM predicted WHERE predicted <> label GROUP BY label, predicted"""
)
def error_pairs(spark, sf):
    return metrics.error_pairs(_pairs(spark, sf))


_SLICES_SQL = r"""
SELECT slice, CAST(count(*) FILTER (WHERE predicted <> label) AS BIGINT) AS errors,
  CAST(count(*) AS BIGINT) AS rows,
  round(count(*) FILTER (WHERE predicted <> label) / count(*), 4) AS error_rate
FROM (
  SELECT *, unnest([
    CASE WHEN length(text) < 50 THEN 'under 50 characters' END,
    CASE WHEN length(text) > 1000 THEN 'over 1000 characters' END,
    CASE WHEN regexp_matches(text, '\p{Nd}') THEN 'has digits' END,
    CASE WHEN contains(text, '?') THEN 'has question mark' END]) AS slice
  FROM predicted WHERE predicted IS NOT NULL)
WHERE slice IS NOT NULL GROUP BY slice
HAVING count(*) FILTER (WHERE predicted <> label) >= 3"""


def _slices():
    text = F.col("text")
    return {
        "under 50 characters": F.length(text) < 50,
        "over 1000 characters": F.length(text) > 1000,
        "has digits": text.rlike(r"\p{Nd}"),
        "has question mark": text.contains("?"),
    }


@query(PREDICTED + _SLICES_SQL)
def error_slices(spark, sf):
    return metrics.error_slices(_pairs(spark, sf), _slices())


@query(
    PREDICTED
    + r"""
SELECT label, predicted, CAST(count(*) AS BIGINT) AS errors,
  CAST(count(*) FILTER (WHERE length(text) < 50) AS BIGINT) AS "under 50 characters",
  CAST(count(*) FILTER (WHERE length(text) > 1000) AS BIGINT) AS "over 1000 characters",
  CAST(count(*) FILTER (WHERE regexp_matches(text, '\p{Nd}')) AS BIGINT) AS "has digits",
  CAST(count(*) FILTER (WHERE contains(text, '?')) AS BIGINT) AS "has question mark"
FROM predicted WHERE predicted <> label GROUP BY label, predicted HAVING count(*) >= 3"""
)
def error_patterns(spark, sf):
    return metrics.error_patterns(metrics.wrong_predictions(_pairs(spark, sf)), _slices())


# Traits of a row, by name and in this order: a Column and its SQL.
def _traits():
    text = F.col("text")
    return {
        **_slices(),
        "has pipe": text.contains("|"),
        "has two exclamation marks": text.contains("!!"),
        "over 5 lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) > 5,
        **{f"truth {name}": F.col("label") == name for name in fixed.LABELS},
        **{f"answer {name}": F.col("predicted") == name for name in fixed.LABELS},
    }


_TRAITS_SQL = r"""[CASE WHEN length(text) < 50 THEN 1 END, CASE WHEN length(text) > 1000 THEN 2 END,
  CASE WHEN regexp_matches(text, '\p{Nd}') THEN 3 END, CASE WHEN contains(text, '?') THEN 4 END,
  CASE WHEN contains(text, '|') THEN 5 END, CASE WHEN contains(text, '!!') THEN 6 END,
  CASE WHEN length(text) - length(replace(text, chr(10), '')) > 5 THEN 7 END,
  CASE label WHEN 'analysis' THEN 8 WHEN 'hot_take' THEN 9 ELSE 10 END,
  CASE predicted WHEN 'analysis' THEN 11 WHEN 'hot_take' THEN 12 ELSE 13 END]"""
_TRAIT_NAMES_SQL = """['under 50 characters', 'over 1000 characters', 'has digits', 'has question mark', 'has pipe',
  'has two exclamation marks', 'over 5 lines', 'truth analysis', 'truth hot_take', 'truth reaction',
  'answer analysis', 'answer hot_take', 'answer reaction']"""


@query(
    PREDICTED
    + f""",
rows AS (SELECT predicted <> label AS wrong, list_filter({_TRAITS_SQL}, lambda x: x IS NOT NULL) AS t FROM predicted WHERE predicted IS NOT NULL),
ones AS (SELECT wrong, t, unnest(t) AS i FROM rows),
twos AS (SELECT wrong, t, i, unnest(list_filter(t, lambda x: x > i)) AS j FROM ones),
threes AS (SELECT wrong, i, j, unnest(list_filter(t, lambda x: x > j)) AS k FROM twos),
sets AS (
  SELECT wrong, [i] AS s FROM ones UNION ALL SELECT wrong, [i, j] FROM twos UNION ALL SELECT wrong, [i, j, k] FROM threes),
counted AS (
  SELECT s, count(*) FILTER (WHERE wrong) AS errors, count(*) AS rows FROM sets GROUP BY s
  HAVING count(*) FILTER (WHERE wrong) >= 3)
SELECT array_to_string([{_TRAIT_NAMES_SQL}[x] FOR x IN s], ' & ') AS pattern, CAST(len(s) AS INTEGER) AS traits,
  CAST(errors AS BIGINT) AS errors, CAST(rows - errors AS BIGINT) AS right_rows, round(errors / rows, 4) AS error_rate,
  round((errors / rows) / (SELECT count(*) FILTER (WHERE wrong) / count(*) FROM rows), 4) AS lift
FROM counted"""
)
def find_error_patterns(spark, sf):
    return metrics.find_error_patterns(_pairs(spark, sf), _traits())


@query(
    PREDICTED
    + f""",
pairs AS (SELECT label, predicted FROM predicted),
{SCORES_SQL},
{f1_sql("f1_a", "answered")},
base AS (SELECT count(*) FILTER (WHERE answered = label) / count(answered) AS accuracy FROM predicted),
flat AS (SELECT (SELECT accuracy FROM overall) AS acc, sum(f1) / 3 AS macro, min(f1) AS lowest,
  sum(f1) / 3 - (SELECT sum(f1) / 3 FROM f1_a) AS macro_gain,
  (SELECT accuracy FROM overall) - (SELECT accuracy FROM base) AS gain FROM classes),
tiers(tier, a, c, m, g) AS (VALUES ('minimum', 0.7::DOUBLE, 0.6::DOUBLE, 0.65::DOUBLE, 0.05::DOUBLE),
  ('target', 0.8::DOUBLE, 0.7::DOUBLE, 0.75::DOUBLE, 0.1::DOUBLE))
SELECT 'accuracy' AS gate, t.tier, t.a AS threshold, round(acc, 4) AS achieved, acc > t.a AS met FROM flat, tiers t
UNION ALL SELECT 'f1 ' || label, t.tier, t.c, round(f1, 4), f1 > t.c FROM classes, tiers t
UNION ALL SELECT 'macro f1', t.tier, t.m, round(macro, 4), macro > t.m FROM flat, tiers t
UNION ALL SELECT 'gain', t.tier, t.g, round(gain, 4), gain > t.g FROM flat, tiers t
UNION ALL SELECT 'macro f1 gain', 'minimum', 0.0::DOUBLE, round(macro_gain, 4), macro_gain > 0 FROM flat
UNION ALL SELECT 'deployable', 'verdict', 0.7::DOUBLE, round(macro, 4), macro >= 0.7::DOUBLE AND lowest >= 0.6::DOUBLE FROM flat
UNION ALL SELECT 'suspicious', 'verdict', 0.95::DOUBLE, round(acc, 4), acc > 0.95::DOUBLE FROM flat"""
)
def success_gates(spark, sf):
    both = _both(spark, sf).withColumnRenamed("predicted_b", "predicted")
    return metrics.success_gates(both, baseline="predicted_a")


@query(
    f"""WITH {SPLIT_SQL},
top AS (SELECT label FROM split WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT (SELECT label FROM top) AS majority_label,
  CAST(count(*) FILTER (WHERE label = (SELECT label FROM top)) AS BIGINT) AS hits,
  CAST(count(*) AS BIGINT) AS rows,
  round(count(*) FILTER (WHERE label = (SELECT label FROM top)) / count(*), 4) AS accuracy,
  0.3333::DOUBLE AS chance
FROM split WHERE split = 'test'"""
)
def majority_baseline(spark, sf):
    split = split_gold(spark, sf).select("label", "split")
    return metrics.majority_baseline(
        split.where("split = 'train'"), split.where("split = 'test'")
    )


@query(
    PREDICTED
    + f""",
pairs AS (SELECT label, predicted FROM predicted),
{SCORES_SQL},
chance AS (SELECT sum(support * predicted)::DOUBLE / (sum(support) * sum(support))::DOUBLE AS e FROM classes)
SELECT CAST(rows AS BIGINT) AS rows, round(accuracy, 4) AS observed, round(e, 4) AS expected,
  round((accuracy - e) / (1 - e), 4) AS kappa FROM overall, chance"""
)
def cohen_kappa(spark, sf):
    return metrics.cohen_kappa(_pairs(spark, sf))


def _confident(spark, sf):
    names = F.array(*[F.lit(n) for n in fixed.LABELS])
    return scored(spark, sf).select(
        "ex_id",
        "label",
        F.get(names, argmax(F.col("p"))).alias("predicted"),
        F.array_max("p").alias("confidence"),
    )


@query(
    f"""WITH {LOGITS_SQL}
SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS rows,
  round(count(*) FILTER (WHERE predicted = label) / count(*), 4) AS accuracy,
  round(avg(confidence), 4) AS mean_confidence
FROM scored GROUP BY 1"""
)
def calibration(spark, sf):
    return metrics.calibration(_confident(spark, sf))


# Naive Bayes on the test rows, with the softmax of its scores as confidence.
_JUDGED_SQL = f"""{NAIVE_BAYES_SQL},
best AS (SELECT ex_id, arg_min(label, (-score, label)) AS predicted, max(score) AS m FROM scores GROUP BY ex_id),
judged AS (
  SELECT t.ex_id, t.text, t.label, b.predicted,
    1 / (SELECT sum(exp(s.score - b.m)) FROM scores s WHERE s.ex_id = t.ex_id) AS confidence
  FROM split t JOIN best b USING (ex_id) WHERE t.split = 'test')"""


def _judged(spark, sf):
    split = split_gold(spark, sf)
    model = fit_naive_bayes(split.where("split = 'train'"))
    test = split.where("split = 'test'")
    scored_rows = score_naive_bayes(test, model).select(
        "ex_id", F.col("label").alias("predicted"), F.array_max(softmax(F.col("scores"))).alias("confidence")
    )
    return test.select("ex_id", "text", "label").join(scored_rows, "ex_id")


@query(
    f"""WITH {_JUDGED_SQL}
SELECT ex_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text,
  label, predicted, round(confidence, 2) AS confidence
FROM judged WHERE predicted <> label ORDER BY ex_id LIMIT 15"""
)
def first_errors(spark, sf):
    return report.first_errors(metrics.wrong_predictions(_judged(spark, sf)), order=["ex_id"])


@query(
    f"""WITH {_JUDGED_SQL}
SELECT ex_id, substr(text, 1, 80) AS text, label, predicted, round(confidence, 4) AS confidence, predicted = label AS correct
FROM judged"""
)
def sample_report(spark, sf):
    return report.sample_report(_judged(spark, sf), "ex_id")
