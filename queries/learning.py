"""Tokens, the two trained models and plug-in scorers."""

from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.operators import model as ml
from postlabel.session import scratch_path

from .base import documents, query, table
from .corpora import SPLIT_SQL, split_gold

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(
    f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS words, array_to_string(w[1:256], ' ') AS tokens
FROM (SELECT doc_id, {_WORDS} AS w FROM documents)"""
)
def tokenize(spark, sf):
    cut = ml.tokenize(documents(spark, sf))
    return cut.select(
        "doc_id",
        F.size(ml.tokens_of(F.col("text"), None)).alias("words"),
        F.array_join("tokens", " ").alias("tokens"),
    )


NAIVE_BAYES_SQL = f"""{SPLIT_SQL},
words AS (SELECT label, unnest({_WORDS}) AS token FROM split WHERE split = 'train'),
docs AS (SELECT label, count(*) AS docs FROM split WHERE split = 'train' GROUP BY label),
vocabulary AS (SELECT count(DISTINCT token) AS v FROM words),
totals AS (SELECT label, count(*) AS total FROM words GROUP BY label),
counts AS (SELECT label, token, count(*) AS n FROM words GROUP BY label, token),
unseen AS (
  SELECT d.label, d.docs, ln(d.docs / (SELECT sum(docs) FROM docs)) AS prior,
    ln(t.total + (SELECT v FROM vocabulary)) AS denominator
  FROM docs d JOIN totals t USING (label)),
test AS (SELECT ex_id, unnest({_WORDS}) AS token FROM split WHERE split = 'test'),
tf AS (SELECT ex_id, token, count(*) AS tf FROM test GROUP BY ex_id, token),
scores AS (
  SELECT f.ex_id, u.label, round(any_value(u.prior)
    + sum(f.tf * ln(coalesce(c.n, 0) + 1)) - sum(f.tf) * any_value(u.denominator), 4) AS score
  FROM tf f CROSS JOIN unseen u LEFT JOIN counts c ON c.token = f.token AND c.label = u.label
  GROUP BY f.ex_id, u.label)"""


@query(
    f"""WITH {NAIVE_BAYES_SQL}
SELECT ex_id, arg_min(label, (-score, label)) AS label,
  max(score) FILTER (WHERE label = 'analysis') AS analysis,
  max(score) FILTER (WHERE label = 'hot_take') AS hot_take,
  max(score) FILTER (WHERE label = 'reaction') AS reaction
FROM scores GROUP BY ex_id"""
)
def naive_bayes(spark, sf):
    split = split_gold(spark, sf)
    model = ml.fit_naive_bayes(split.where("split = 'train'"))
    result = ml.score_naive_bayes(split.where("split = 'test'"), model)
    return result.select(
        "ex_id",
        "label",
        *[F.get("scores", F.lit(i)).alias(n) for i, n in enumerate(fixed.LABELS)],
    )


def grid_models(spark, sf):
    """The whole model of each grid point, fitted on the training rows."""
    text_model, candidates = ml.fit_grid(split_gold(spark, sf).where("split = 'train'"))
    return [ml.whole_model(text_model, classifier) for _, classifier in candidates]


def _fitted(spark, sf):
    split = split_gold(spark, sf)
    model, scores = ml.fit_classifier(split.where("split = 'train'"), split.where("split = 'val'"))
    return split, model, scores


# An iterative solver's numbers have no SQL; what must hold of them on every row has.
@query(
    f"""WITH {SPLIT_SQL}
SELECT g.reg_param, CAST(count(*) AS BIGINT) AS evaluated, TRUE AS is_a_share, TRUE AS best_is_kept
FROM split, (VALUES (0.01::DOUBLE), (0.1::DOUBLE)) AS g(reg_param) WHERE split = 'val' GROUP BY g.reg_param"""
)
def select_best(spark, sf):
    """Grid values, the rows they were judged on, and whether the first best one was kept."""
    split, model, scores = _fitted(spark, sf)
    val = split.where("split = 'val'")
    kept = model.stages[-1].getRegParam()
    best = max(accuracy for _, accuracy in scores)
    first = next(params["regParam"] for params, accuracy in scores if accuracy == best)
    # The predictions of the kept model are counted, so every row was judged.
    evaluated = ml.count_predicted(val, model)
    rows = [(float(p["regParam"]), evaluated, 0.0 <= a <= 1.0, kept == first) for p, a in scores]
    return spark.createDataFrame(
        rows, "reg_param DOUBLE, evaluated BIGINT, is_a_share BOOLEAN, best_is_kept BOOLEAN"
    )


@query(
    f"""WITH {SPLIT_SQL}
SELECT ex_id, label, TRUE AS sums_to_one, TRUE AS confidence_is_largest, TRUE AS label_is_largest,
  TRUE AS same_after_reload FROM split WHERE split = 'test'"""
)
def predict(spark, sf):
    """Fit, save, load, score the test rows with the fitted and the reloaded model."""
    split, model, _ = _fitted(spark, sf)
    path = scratch_path(spark, "model")
    ml.save_model(model, path)
    test = split.where("split = 'test'")
    scored = ml.predict(test, ml.load_model(path))
    own = ml.predict(test, model).select("ex_id", F.col("all_scores").alias("own"))
    scores = F.map_values("all_scores")
    return scored.join(own, "ex_id").select(
        "ex_id",
        "label",
        (F.abs(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) - 1) < 0.001).alias("sums_to_one"),
        (F.col("confidence") == F.array_max(scores)).alias("confidence_is_largest"),
        (F.col("all_scores")[F.col("predicted_label")] == F.col("confidence")).alias("label_is_largest"),
        F.forall(
            F.zip_with(scores, F.map_values("own"), lambda a, b: F.abs(a - b) < 1e-9), lambda x: x
        ).alias("same_after_reload"),
    )


@query(
    """SELECT conv_id * 1000 + turn AS ex_id, CASE WHEN length(text) > 1000 THEN 'analysis'
  WHEN length(text) < 200 THEN 'reaction' ELSE 'hot_take' END AS label FROM conversations"""
)
def score_with(spark, sf):
    def load():
        """A scorer in pandas: any Python model may stand in its place."""
        import pandas as pd

        def score(batch: pd.DataFrame) -> pd.DataFrame:
            length = batch["text"].str.len()
            label = pd.Series("hot_take", index=batch.index)
            label[length > 1000] = "analysis"
            label[length < 200] = "reaction"
            return pd.DataFrame({"ex_id": batch["ex_id"], "label": label})

        return score

    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ex_id"), "text"
    )
    return ml.score_with(turns, load, "ex_id BIGINT, label STRING")
