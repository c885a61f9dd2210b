import math
import re

import pytest
from pyspark.sql import functions as F

from postlabel.operators import model as ml
from postlabel.session import scratch_path

TRAIN = [
    (1, "analysis", "xG trend and pass completion trend"),
    (2, "analysis", "formation data per 90"),
    (3, "hot_take", "he is overrated overrated bum"),
    (4, "hot_take", "worst keeper ever"),
    (5, "reaction", "what a goal goal goal"),
    (6, "other", "must not count"),
]
TEST = [(10, "trend data"), (11, "overrated goal bum"), (12, "!!!"), (13, "unseen words only"), (14, "Goal GOAL trend")]


@pytest.fixture(scope="module")
def frames(spark):
    train = spark.createDataFrame(TRAIN, "ex_id BIGINT, label STRING, text STRING")
    test = spark.createDataFrame(TEST, "ex_id BIGINT, text STRING")
    return train, test


def _brute_force():
    names = ["analysis", "hot_take", "reaction"]
    train = [(n, re.findall(r"\w+", t.lower())) for _, n, t in TRAIN if n in names]
    vocabulary = {w for _, ws in train for w in ws}
    out = {}
    for i, text in TEST:
        words = re.findall(r"\w+", text.lower())
        scores = []
        for name in names:
            mine = [w for n, ws in train if n == name for w in ws]
            prior = math.log(sum(n == name for n, _ in train) / len(train))
            total = sum(math.log((mine.count(w) + 1) / (len(mine) + len(vocabulary))) for w in words)
            scores.append(round(prior + total, 4))
        out[i] = (names[scores.index(max(scores))], scores)
    return out


@pytest.mark.parametrize("share", [ml.FREQUENT_SHARE, 0.1, 2.0])
def test_naive_bayes_equals_brute_force(frames, share, monkeypatch):
    """All tokens frequent, some, or none."""
    monkeypatch.setattr(ml, "FREQUENT_SHARE", share)
    train, test = frames
    model = ml.fit_naive_bayes(train)
    assert model.doc_totals == (2, 2, 1)
    got = {r["ex_id"]: (r["label"], r["scores"]) for r in ml.score_naive_bayes(test, model).collect()}
    want = _brute_force()
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0]
        assert got[i][1] == pytest.approx(want[i][1], abs=2e-4)


def test_a_word_in_every_document_is_not_sent_anywhere(spark, capsys):
    rows = [(i, "analysis" if i % 2 else "reaction", f"everywhere only{i} own{i} everywhere") for i in range(400)]
    df = spark.createDataFrame([*rows, (400, "analysis", "")], "ex_id BIGINT, label STRING, text STRING")
    model = ml.fit_naive_bayes(df)
    assert model.tokens.where(ml._is_frequent(model)).count() == 1
    words = ml.words_to_look_up(df, model)
    keys = words.groupBy("_key").count().where("count > 1").collect()
    assert words.count() == 1201 and keys == []
    assert ml.score_naive_bayes(df, model).where("label IN ('analysis', 'reaction')").count() == 401
    capsys.readouterr()
    ml.score_naive_bayes(df, model).explain()
    assert capsys.readouterr().out.count("Generate explode") == 1


def test_the_classifier_sees_whole_texts(spark):
    rows = [(i, "analysis" if i % 2 else "reaction", "same " * 400 + ("data" if i % 2 else "goal")) for i in range(40)]
    df = spark.createDataFrame(rows, "ex_id BIGINT, label STRING, text STRING")
    model, scores = ml.fit_classifier(df, df, grid=({"regParam": 0.01},), features=1 << 10, max_iter=10)
    assert scores[0][1] == 1.0 and ml.text_pipeline().getStages()[1].getNumFeatures() == 1 << 18


def test_tokens_are_cut_at_the_limit(spark):
    df = spark.createDataFrame([("One two_3 ünï, FOUR",), ("",)], "text STRING")
    assert [r["tokens"] for r in ml.tokenize(df, 3).collect()] == [["one", "two_3", "ünï"], []]
    assert len(ml.tokenize(df, None).first()["tokens"]) == 4


def test_linear_model_is_chosen_on_validation_and_survives_saving(spark):
    words = {"analysis": "data trend formation", "hot_take": "overrated bum worst", "reaction": "goal wow what"}
    rows = [(i, name, f"{words[name]} {i % 5}") for i, name in enumerate(list(words) * 12)]
    df = spark.createDataFrame(rows, "ex_id BIGINT, label STRING, text STRING")
    train, val = df.where("ex_id < 27"), df.where("ex_id >= 27")
    model, scores = ml.fit_classifier(train, val, grid=({"regParam": 100.0}, {"regParam": 0.01}), features=256, max_iter=10)
    assert len(scores) == 2 and scores[1][1] == 1.0
    path = scratch_path(spark, "model")
    ml.save_model(model, path)
    got = ml.predict(val, ml.load_model(path)).collect()
    assert all(r["predicted_label"] == r["label"] for r in got)
    assert all(abs(sum(r["all_scores"].values()) - 1) < 1e-3 for r in got)
    assert all(r["confidence"] == max(r["all_scores"].values()) for r in got)


def _counting(spark):
    """A text that counts how often it is made."""
    made = spark.sparkContext.accumulator(0)

    def text(x):
        made.add(1)
        return x

    return made, F.udf(text)


def test_a_fit_cuts_each_text_once_and_multiplies_large_blocks(spark):
    made, text = _counting(spark)
    rows = [(name, f"{name} data{i % 5}") for i, name in enumerate(["analysis", "hot_take", "reaction"] * 10)]
    train = spark.createDataFrame(rows, "label STRING, text STRING").withColumn("text", text("text"))
    _, candidates = ml.fit_grid(train, features=64, max_iter=2)
    assert made.value == len(rows)
    assert all(model.getMaxBlockSizeInMB() == ml.BLOCK_MB for _, model in candidates)


def test_rows_that_are_joined_away_are_not_scored(spark):
    made, text = _counting(spark)
    rows = [(i, name, f"{name} data") for i, name in enumerate(["analysis", "hot_take", "reaction"] * 10)]
    df = spark.createDataFrame(rows, "ex_id BIGINT, label STRING, text STRING")
    text_model, candidates = ml.fit_grid(df, grid=({"regParam": 0.1},), features=64, max_iter=2)
    some = df.join(spark.range(4).withColumnRenamed("id", "ex_id").hint("merge"), "ex_id")
    model = ml.whole_model(text_model, candidates[0][1])
    assert ml.count_predicted(some.withColumn("text", text("text")), model) == 4
    assert made.value == 4


def test_missing_model_is_named(spark):
    with pytest.raises(FileNotFoundError, match="no model at"):
        ml.load_model(scratch_path(spark, "nothing"))


def test_select_best_prefers_the_first_of_equals(spark):
    class Constant:
        def transform(self, df):
            return df.withColumn("prediction", F.lit(0.0))

    val = spark.createDataFrame([(0.0,), (1.0,)], "label_id DOUBLE")
    first, second = Constant(), Constant()
    best, scores = ml.select_best([("a", first), ("b", second)], val)
    assert best is first and [s for _, s in scores] == [0.5, 0.5]


def test_rule_baseline_gives_null_for_skip(spark):
    df = spark.createDataFrame([(1, "Two tickets available"), (2, "Midfield depth")], "ex_id INT, text STRING")
    got = {r["ex_id"]: r["label"] for r in ml.rule_baseline(df).collect()}
    assert got == {1: None, 2: "hot_take"}


def test_plug_in_scorer_loads_once_per_task(spark):
    def load():
        state = {"calls": 0}

        def score(batch):
            state["calls"] += 1
            return batch.assign(label="x", calls=state["calls"])[["ex_id", "label"]]

        return score

    df = spark.range(100).withColumnRenamed("id", "ex_id").repartition(3)
    assert ml.score_with(df, load, "ex_id BIGINT, label STRING").count() == 100
