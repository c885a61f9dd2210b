"""Learning and scoring: naive Bayes as joins, a linear model with Spark ML, plug-in scorers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer, VarianceThresholdSelector
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.labels import encode_label
from postlabel.functions.scores import argmax, score_struct
from postlabel.operators.metrics import ratio
from postlabel.operators.rules import label_posts
from postlabel.session import cut_lineage, exists

TOKEN = r"[\p{L}\p{N}_]+"
# A token is frequent from this share of all tokens on, so there are at most 1 / share of them.
FREQUENT_SHARE = 0.001
# Buckets that words are hashed into for the linear model.
FEATURES = 1 << 18
# Regularisations tried, and iterations after which a fit that has not converged is given up.
GRID = ({"regParam": 0.01}, {"regParam": 0.1})
MAX_ITER = 200
# Rows that make a partition worth the gradient it sends: some 6 MB in every iteration.
ROWS_PER_PART = 20_000
# Megabytes of rows a fit multiplies at once. Each such block adds up a gradient of all buckets of its
# own, which costs more than the rows of a block of 1 MB, Spark's choice.
BLOCK_MB = 32.0


def tokens_of(text: Column, limit: int | None = fixed.MAX_TOKENS) -> Column:
    """Lower-case words of a text, at most ``limit`` of them (all when None)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return words if limit is None else F.slice(words, 1, limit)


def tokenize(df: DataFrame, limit: int | None = fixed.MAX_TOKENS) -> DataFrame:
    return df.withColumn("tokens", tokens_of(F.col("text"), limit))


# --- naive Bayes --------------------------------------------------------------


@dataclass(frozen=True)
class NaiveBayesModel:
    """Token counts by label as a table; the few totals as numbers."""

    tokens: DataFrame  # token, counts ARRAY<BIGINT>
    vocabulary: int
    token_totals: tuple[int, ...]
    doc_totals: tuple[int, ...]
    labels: tuple[str, ...]
    limit: int | None


def fit_naive_bayes(
    train: DataFrame, labels: Sequence[str] = fixed.LABELS, limit: int | None = None
) -> NaiveBayesModel:
    """Multinomial model with add-one smoothing.

    Counts are combined in each task before the shuffle on the token, so frequent words
    cost one row per task. Documents by label are counted in the same scan under an
    impossible empty token. The table is checkpointed: it is read again for every scoring.
    """
    label_id = encode_label(F.col("label"), {name: i for i, name in enumerate(labels)})
    words = train.select(
        label_id.alias("label_id"),
        F.explode(F.concat(F.array(F.lit("")), tokens_of(F.col("text"), limit))).alias("token"),
    ).where("label_id IS NOT NULL")
    counted = words.groupBy("token").agg(
        *[F.count_if(F.col("label_id") == i).alias(f"n{i}") for i in range(len(labels))]
    )
    counts = [f"n{i}" for i in range(len(labels))]
    table = cut_lineage(counted)
    is_token = F.col("token") != ""
    totals = table.agg(
        F.count_if(is_token).alias("vocabulary"),
        *[F.sum(F.when(is_token, F.col(c))).alias(f"t{c}") for c in counts],
        *[F.sum(F.when(~is_token, F.col(c))).alias(f"d{c}") for c in counts],
    ).first()
    return NaiveBayesModel(
        table.where(is_token).select("token", F.array(*counts).alias("counts")),
        totals["vocabulary"],
        tuple(totals[f"t{c}"] or 0 for c in counts),
        tuple(totals[f"d{c}"] or 0 for c in counts),
        tuple(labels),
        limit,
    )


def _is_frequent(model: NaiveBayesModel) -> Column:
    """Tokens that make up ``FREQUENT_SHARE`` of all in training: 1,000 at most."""
    seen = F.aggregate("counts", F.lit(0).cast("bigint"), lambda total, n: total + n)
    return seen >= FREQUENT_SHARE * sum(model.token_totals)


def _log_counts(counts: str, size: int) -> list[Column]:
    return [F.log(F.coalesce(F.get(counts, F.lit(i)), F.lit(0)) + 1) for i in range(size)]


def words_to_look_up(df: DataFrame, model: NaiveBayesModel, id_col: str = "ex_id") -> DataFrame:
    """(id, _size, _key, _tf, _f0, ...): each document's words, from one scan.

    Frequent tokens are looked up in a broadcast table where they are; those of a document
    become one row of sums, under a key of the document's own. Every other token is a row
    with its count, under the token. So a word that is everywhere is not sent anywhere.
    """
    size = len(model.labels)
    frequent = model.tokens.where(_is_frequent(model)).withColumnRenamed("counts", "_often")
    tokens = df.select(id_col, tokens_of(F.col("text"), model.limit).alias("_tokens"))
    words = tokens.select(id_col, F.size("_tokens").alias("_size"), F.explode_outer("_tokens").alias("token"))
    rare = F.when(F.col("_often").isNull(), F.col("token"))
    found = words.join(F.broadcast(frequent), "token", "left").select(
        id_col, "_size", rare.alias("_rare"), *[x.alias(f"_l{i}") for i, x in enumerate(_log_counts("_often", size))]
    )
    # No token holds the character zero.
    own = F.concat(F.lit("\0"), F.col(id_col).cast("string"))
    summed = found.groupBy(id_col, "_size", "_rare").agg(
        F.count(F.lit(1)).alias("_tf"), *[F.sum(f"_l{i}").alias(f"_f{i}") for i in range(size)]
    )
    return summed.withColumn("_key", F.coalesce("_rare", own)).drop("_rare")


def score_naive_bayes(df: DataFrame, model: NaiveBayesModel, id_col: str = "ex_id") -> DataFrame:
    """(id, label, scores): log-likelihoods to four decimals and the label of the highest.

    A word the model has not seen counts 0 times in every label. Equal scores go to the
    label that comes first.
    """
    size, all_docs = len(model.labels), sum(model.doc_totals)
    rare = model.tokens.where(~_is_frequent(model)).withColumnRenamed("token", "_key")
    seen = words_to_look_up(df, model, id_col).join(rare, "_key", "left")
    # A word is either frequent, with its sum at hand, or looked up here; the other term is 0.
    parts = [F.col(f"_f{i}") + F.col("_tf") * x for i, x in enumerate(_log_counts("counts", size))]
    sums = seen.groupBy(id_col, "_size").agg(*[F.sum(x).alias(f"_s{i}") for i, x in enumerate(parts)])
    scores = F.array(
        *[
            F.round(
                F.lit(_log_ratio(model.doc_totals[i], all_docs))
                + F.when(F.col("_size") > 0, F.col(f"_s{i}")).otherwise(0.0)
                - F.col("_size") * F.lit(_log(model.token_totals[i] + model.vocabulary)),
                4,
            )
            for i in range(size)
        ]
    )
    names = F.array(*[F.lit(name) for name in model.labels])
    return sums.select(id_col, scores.alias("scores")).select(
        id_col, F.get(names, argmax(F.col("scores"))).alias("label"), "scores"
    )


def _log(n: int) -> float:
    return math.log(n) if n > 0 else 0.0


def _log_ratio(a: int, b: int) -> float:
    return math.log(a / b) if a else -math.inf


# --- linear model -------------------------------------------------------------


def text_pipeline(features: int = FEATURES, limit: int | None = None) -> Pipeline:
    """Tokens (of whole texts unless limited), hashed counts and inverse document frequency."""
    words = f"regexp_extract_all(lower(text), '{TOKEN}', 0)".replace("\\", "\\\\")
    cut = words if limit is None else f"slice({words}, 1, {limit})"
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, {cut} AS tokens FROM __THIS__"),
            HashingTF(inputCol="tokens", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="features"),
        ]
    )


def fit_grid(
    train: DataFrame,
    grid: Iterable[Mapping[str, float]] = GRID,
    features: int = FEATURES,
    max_iter: int = MAX_ITER,
    labels: Sequence[str] = fixed.LABELS,
    limit: int | None = None,
) -> tuple[PipelineModel, list[tuple[Mapping[str, float], LogisticRegressionModel]]]:
    """The text stages and a multinomial logistic regression for each grid point.

    The text stages are fitted once, on words that are cut and hashed once. The fits see only
    buckets that vary in training, under a compact index: all others would get weight 0, which is
    what they have in the models returned, that read all buckets. What the fits read is kept in few
    partitions and large blocks, as each partition sends, and each block adds up, a gradient of the
    size of the model in every iteration, and the grid points are fitted side by side. A fit ends
    when it has converged; ``max_iter`` is only the last resort.
    """
    ready = _encoded(train, labels)
    words, hashed, idf = text_pipeline(features, limit).getStages()
    counted = hashed.transform(words.transform(ready)).select("label_id", "_tf").persist()
    compact = None
    try:
        parts = max(1, min(ready.sparkSession.sparkContext.defaultParallelism, -(-counted.count() // ROWS_PER_PART)))
        weights = idf.fit(counted)
        text_model = PipelineModel(stages=[words, hashed, weights])
        vectors = weights.transform(counted).select("label_id", "features")
        varying = VarianceThresholdSelector(featuresCol="features", outputCol="_few").fit(vectors)
        compact = varying.transform(vectors).select("label_id", "_few").coalesce(parts).persist()
        compact.count()
        counted.unpersist()

        def fit(params: Mapping[str, float]):
            fitted = LogisticRegression(
                featuresCol="_few",
                labelCol="label_id",
                family="multinomial",
                maxIter=max_iter,
                maxBlockSizeInMB=BLOCK_MB,
                **params,
            ).fit(compact)
            return params, _over_all(fitted, varying.selectedFeatures, features)

        points = list(grid)
        with ThreadPoolExecutor(len(points)) as pool:
            return text_model, list(pool.map(inheritable_thread_target(train.sparkSession)(fit), points))
    finally:
        counted.unpersist()
        if compact is not None:
            compact.unpersist()


def _over_all(fitted: LogisticRegressionModel, buckets: Sequence[int], features: int) -> LogisticRegressionModel:
    """A model of some buckets as one of all of them; the others have weight 0."""
    narrow = fitted.coefficientMatrix.toArray()
    wide = np.zeros((narrow.shape[0], features))
    wide[:, list(buckets)] = narrow
    spark = SparkSession.active()
    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        fitted.uid,
        _py2java(spark.sparkContext, Matrices.dense(*wide.shape, wide.ravel(order="F"))),
        _py2java(spark.sparkContext, fitted.interceptVector),
        fitted.numClasses,
        True,
    )
    model = LogisticRegressionModel(java)
    fitted._copyValues(model)
    return model.setFeaturesCol("features")


def _encoded(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    ids = {name: i for i, name in enumerate(labels)}
    label_id = encode_label(F.col("label"), ids).cast("double")
    return df.withColumn("label_id", label_id).where("label_id IS NOT NULL")


def fit_classifier(
    train: DataFrame,
    val: DataFrame,
    grid: Iterable[Mapping[str, float]] = GRID,
    features: int = FEATURES,
    max_iter: int = MAX_ITER,
    labels: Sequence[str] = fixed.LABELS,
    limit: int | None = None,
) -> tuple[PipelineModel, list[tuple[Mapping[str, float], float]]]:
    """Multinomial logistic regression; the grid point best on validation is kept.

    Returns the whole pipeline model and each grid point's validation accuracy.
    """
    text_model, candidates = fit_grid(train, grid, features, max_iter, labels, limit)
    val_ready = text_model.transform(_encoded(val, labels)).select("label_id", "features").persist()
    try:
        best, scores = select_best(candidates, val_ready)
    finally:
        val_ready.unpersist()
    return whole_model(text_model, best), scores


def whole_model(text_model: PipelineModel, classifier: LogisticRegressionModel) -> PipelineModel:
    return PipelineModel(stages=[*text_model.stages, classifier])


def select_best(candidates, val: DataFrame):
    """The candidate most accurate on validation, the first of equals, and all accuracies."""
    scores = []
    for params, model in candidates:
        right = F.count_if(F.col("prediction") == F.col("label_id"))
        row = model.transform(val).agg(ratio(right, F.count(F.lit(1))).alias("accuracy")).first()
        scores.append((params, row["accuracy"]))
    best = max(range(len(scores)), key=lambda i: (scores[i][1], -i))
    return candidates[best][1], scores


def predict(
    df: DataFrame, model: PipelineModel, labels: Sequence[str] = fixed.LABELS
) -> DataFrame:
    """Adds predicted label, confidence and all scores to every row."""
    scored = model.transform(df)
    record = score_struct(vector_to_array(F.col("probability")), labels)
    return scored.withColumn("_record", record).select(*df.columns, "_record.*")


def count_predicted(df: DataFrame, model: PipelineModel) -> int:
    """Rows that get a label.

    Counted as values: a filter on the label would be pushed below the joins that ``df`` is made
    of, and the model with it, to rows that are not in ``df``.
    """
    return predict(df, model).agg(F.count("predicted_label")).first()[0]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A saved model; a missing one is named clearly."""
    try:
        return PipelineModel.load(path)
    except Exception as error:
        if "not exist" not in str(error).lower():
            raise
        raise FileNotFoundError(f"no model at {path}; fit one and save it there") from error


VERSIONS = "version BIGINT, path STRING"


def publish_model(model: PipelineModel, folder: str) -> int:
    """Saves a model under the next version of a folder and returns the version.

    The list of versions gets its row after the model is saved whole, so a reader never finds
    a model that is still being written. One writer at a time.
    """
    spark = SparkSession.active()
    version = max([r["version"] for r in _versions(spark, folder)], default=0) + 1
    path = f"{folder}/model-{version}"
    save_model(model, path)
    spark.createDataFrame([(version, path)], VERSIONS).coalesce(1).write.mode("append").json(f"{folder}/versions")
    return version


def _versions(spark: SparkSession, folder: str) -> list:
    """A row for each version; there is one each time a model is trained."""
    listed = f"{folder}/versions"
    return spark.read.schema(VERSIONS).json(listed).collect() if exists(spark, listed) else []


def current_model(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, PipelineModel]:
    """The newest model of a folder, or the one of a version, with its version."""
    paths = {r["version"]: r["path"] for r in _versions(spark, folder)}
    if not paths or (version is not None and version not in paths):
        raise FileNotFoundError(f"no model version {version or ''} in {folder}; publish one there")
    version = version or max(paths)
    return version, load_model(paths[version])


# --- other scorers ------------------------------------------------------------


def rule_baseline(df: DataFrame) -> DataFrame:
    """The cascade as a classifier: its label, or null where it skips."""
    label = F.when(F.col("label") != fixed.SKIP, F.col("label"))
    return label_posts(df).withColumn("label", label)


def score_with(df: DataFrame, load: Callable[[], Callable], schema: str) -> DataFrame:
    """Any Python scorer over Arrow batches.

    ``load`` runs once per task and returns a function from a pandas frame to a pandas
    frame of ``schema``.
    """

    def run(batches):
        score = load()
        for batch in batches:
            yield score(batch)

    return df.mapInPandas(run, schema)
