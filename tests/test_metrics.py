"""Published results as golden values, and brute force on small fixtures."""

import pytest

from postlabel import fixed
from postlabel.operators import metrics
from postlabel.plans import evaluate

MATRIX = [[12, 0, 0], [3, 8, 1], [2, 5, 5]]
NAMES = list(fixed.LABELS)


@pytest.fixture(scope="module")
def published(spark):
    rows = []
    for t, line in enumerate(MATRIX):
        for p, n in enumerate(line):
            rows += [(len(rows) + i, NAMES[t], NAMES[p]) for i in range(n)]
    return spark.createDataFrame(rows, "ex_id BIGINT, label STRING, predicted STRING")


def test_matrix(published):
    cells = {(r["label"], r["predicted"]): r["rows"] for r in metrics.confusion_matrix(published).collect()}
    assert cells == {(NAMES[t], NAMES[p]): MATRIX[t][p] for t in range(3) for p in range(3)}
    wide = {r["label"]: [r[n] for n in NAMES] for r in metrics.confusion_matrix_wide(published).collect()}
    assert wide == dict(zip(NAMES, MATRIX))


def test_class_report(published):
    got = {r["label"]: tuple(r)[1:] for r in metrics.class_report(published).collect()}
    assert got["analysis"] == (0.7059, 1.0, 0.8276, 12)
    assert got["hot_take"] == (0.6154, 0.6667, 0.64, 12)
    assert got["reaction"] == (0.8333, 0.4167, 0.5556, 12)
    assert got["macro avg"] == (0.7182, 0.6944, 0.6744, 36)
    assert got["weighted avg"] == (0.7182, 0.6944, 0.6744, 36)
    assert got["accuracy"] == (0.6944, 0.6944, 0.6944, 36)


def test_accuracy_and_kappa(published):
    assert tuple(metrics.accuracy(published).first()) == (25, 36, 0.6944)
    assert metrics.cohen_kappa(published).first()["kappa"] == 0.5417


def test_error_pairs(published):
    got = {(r["label"], r["predicted"]): (r["errors"], r["share"]) for r in metrics.error_pairs(published).collect()}
    assert got == {
        ("reaction", "hot_take"): (5, 0.4545), ("hot_take", "analysis"): (3, 0.2727),
        ("reaction", "analysis"): (2, 0.1818), ("hot_take", "reaction"): (1, 0.0909),
    }


def test_published_comparison_and_gates(spark, published):
    # A baseline that is right on 14 of the 36 rows.
    other = {"analysis": "hot_take", "hot_take": "reaction", "reaction": "analysis"}
    rows = [(r["ex_id"], r["label"] if i < 14 else other[r["label"]]) for i, r in enumerate(published.orderBy("ex_id").collect())]
    base = spark.createDataFrame(rows, "ex_id BIGINT, label STRING")
    model = published.select("ex_id", published["predicted"].alias("label"))
    truth = published.select("ex_id", "label")
    record = evaluate(base, model, truth, "linear").comparison.first()
    assert (record["baseline_accuracy"], record["finetuned_accuracy"], record["improvement"]) == (0.3889, 0.6944, 0.3056)
    assert record["test_set_size"] == 36 and record["direction"] == "improvement"
    assert record["label_map"] == fixed.LABEL_MAP

    both = metrics.compare_models(base, model, truth).withColumnRenamed("predicted_b", "predicted")
    rows = metrics.success_gates(both, "predicted_a").collect()
    gates = {r["gate"]: (r["achieved"], r["met"]) for r in rows if r["tier"] != "target"}
    assert {r["gate"]: r["met"] for r in rows if r["tier"] == "target"} == {
        "accuracy": False, "f1 analysis": True, "f1 hot_take": False, "f1 reaction": False, "macro f1": False, "gain": True,
    }
    report = {r["label"]: r for r in evaluate(base, model, truth, "linear").baseline_report.collect()}
    assert report["accuracy"]["f1"] == 0.3889 and len(report) == 6
    assert gates == {
        "accuracy": (0.6944, False), "f1 analysis": (0.8276, True), "f1 hot_take": (0.64, True),
        "f1 reaction": (0.5556, False), "macro f1": (0.6744, True), "gain": (0.3056, True),
        "macro f1 gain": (round(0.6744 - record["baseline_macro_f1"], 4), True),
        "deployable": (0.6744, False), "suspicious": (0.6944, False),
    }
    # Macro F1 in the record is that of the two reports.
    assert (record["baseline_macro_f1"], record["finetuned_macro_f1"]) == (report["macro avg"]["f1"], 0.6744)
    base_of = {r["ex_id"]: r["label"] for r in base.collect()}
    right = [(base_of[r["ex_id"]] == r["label"], r["predicted"] == r["label"]) for r in published.collect()]
    fields = ("both_right", "only_baseline_right", "only_finetuned_right", "neither_right")
    assert [record[f] for f in fields] == [right.count(x) for x in ((True, True), (True, False), (False, True), (False, False))]
    only = metrics.disagreements(metrics.compare_models(base, model, truth)).collect()
    assert sorted(r["right"] for r in only) == ["a"] * right.count((True, False)) + ["b"] * right.count((False, True))
    sides = {r["label"]: r for r in metrics.paired_report(metrics.compare_models(base, model, truth)).collect()}
    assert (sides["analysis"]["f1_b"], sides["hot_take"]["f1_b"], sides["reaction"]["f1_b"]) == (0.8276, 0.64, 0.5556)
    assert {n: sides[n]["f1_a"] for n in NAMES} == {n: report[n]["f1"] for n in NAMES}


def test_answers_of_no_and_of_unknown_label(spark):
    rows = [(1, "analysis", None, "analysis"), (2, "reaction", "what", "reaction"), (3, "hot_take", "hot_take", None), (4, "other", "analysis", "analysis")]
    df = spark.createDataFrame(rows, "ex_id BIGINT, label STRING, predicted_a STRING, predicted_b STRING")
    r = metrics.model_comparison(df, "m").first()
    assert (r["test_set_size"], r["baseline_evaluated"], r["finetuned_evaluated"]) == (4, 2, 2)
    assert (r["baseline_accuracy"], r["finetuned_accuracy"]) == (0.5, 1.0)
    assert (r["both_right"], r["only_baseline_right"], r["only_finetuned_right"], r["neither_right"]) == (0, 1, 2, 0)
    empty = metrics.model_comparison(df.limit(0), "m").first()
    assert (empty["test_set_size"], empty["baseline_macro_f1"]) == (0, 0.0)


def test_two_predictions_of_a_row_do_not_multiply_it(spark):
    truth = spark.createDataFrame([(1, "analysis"), (2, "reaction")], "ex_id BIGINT, label STRING")
    pred = spark.createDataFrame([(1, 9, "reaction"), (1, 3, "hot_take"), (1, 5, None), (2, 1, None), (2, 2, "analysis")], "ex_id BIGINT, at INT, label STRING")
    for n in (1, 4):
        rows = pred.repartition(n)
        assert sorted(tuple(r) for r in metrics.align(rows, truth).collect()) == [(1, "analysis", "hot_take"), (2, "reaction", "analysis")]
        assert sorted(map(str, metrics.align(rows, truth, order=["at"]).collect())) == sorted(map(str, spark.createDataFrame([(1, "analysis", "hot_take"), (2, "reaction", None)], "ex_id BIGINT, label STRING, predicted STRING").collect()))
        assert metrics.compare_models(rows, rows, truth).count() == 2


def test_found_patterns_equal_all_sets_of_traits(spark):
    import itertools
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice(["a", "b", "b", None]), rng.randrange(64)) for i in range(300)]
    df = spark.createDataFrame(rows, "ex_id BIGINT, label STRING, predicted STRING, bits INT")
    traits = {f"t{i}": F.getbit("bits", F.lit(i)) == 1 for i in range(6)}
    made = [(p != t, [f"t{i}" for i in range(6) if b >> i & 1]) for _, t, p, b in rows if p is not None]
    overall = sum(w for w, _ in made) / len(made)
    expected = {}
    for size in (1, 2, 3):
        for names in itertools.combinations([f"t{i}" for i in range(6)], size):
            held = [w for w, own in made if set(names) <= set(own)]
            if sum(held) >= 3:
                rate = sum(held) / len(held)
                expected[" & ".join(names)] = (size, sum(held), len(held) - sum(held), round(rate, 4), round(rate / overall, 4))
    got = {r["pattern"]: (r["traits"], r["errors"], r["right_rows"], r["error_rate"], r["lift"]) for r in metrics.find_error_patterns(df, traits).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=2e-4) for k in expected)
    assert metrics.find_error_patterns(df.where("label = predicted"), traits).count() == 0
    assert metrics.find_error_patterns(df.limit(0), traits).count() == 0


def test_missing_classes_and_missing_predictions(spark):
    rows = [(1, "analysis", "analysis"), (2, "hot_take", "analysis"), (3, "hot_take", None)]
    df = spark.createDataFrame(rows, "ex_id BIGINT, label STRING, predicted STRING")
    got = {r["label"]: tuple(r)[1:] for r in metrics.class_report(df).collect()}
    assert got["hot_take"] == (0.0, 0.0, 0.0, 1)  # never predicted
    assert got["reaction"] == (0.0, 0.0, 0.0, 0)  # absent from both
    assert got["accuracy"][0] == 0.5
    assert tuple(metrics.accuracy(df).first()) == (1, 2, 0.5)
    assert tuple(metrics.parse_coverage(df).first()) == (3, 2, 1, 0.6667)


def test_no_rows_at_all(spark):
    df = spark.createDataFrame([], "ex_id BIGINT, label STRING, predicted STRING")
    assert sum(r["rows"] for r in metrics.confusion_matrix(df).collect()) == 0
    assert len(metrics.class_report(df).collect()) == 6
    assert metrics.accuracy(df).first()["accuracy"] == 0.0


def test_align_keeps_all_truth(spark):
    truth = spark.createDataFrame([(1, "analysis"), (2, "reaction")], "ex_id BIGINT, label STRING")
    pred = spark.createDataFrame([(2, "hot_take"), (9, "analysis")], "ex_id BIGINT, label STRING")
    got = {tuple(r) for r in metrics.align(pred, truth).collect()}
    assert got == {(1, "analysis", None), (2, "reaction", "hot_take")}


def test_majority_baseline(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",)], "label STRING")
    test = spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "label STRING")
    row = metrics.majority_baseline(train, test).first()
    assert tuple(row) == ("a", 1, 4, 0.25, 0.3333)


def test_slices_below_the_minimum_are_left_out(spark):
    rows = [("short", "a", "b")] * 3 + [("a longer text", "a", "b")] * 2 + [("x" * 60, "a", "a")] * 4
    df = spark.createDataFrame(rows, "text STRING, label STRING, predicted STRING")
    from pyspark.sql import functions as F

    n = F.length("text")
    got = metrics.error_slices(df, {"tiny": n < 8, "medium": (n >= 8) & (n < 50), "all": n > 0}).collect()
    assert {tuple(r) for r in got} == {("tiny", 3, 3, 1.0), ("all", 5, 9, 0.5556)}


def test_calibration(spark):
    rows = [("a", "a", 0.95), ("a", "b", 1.0), ("a", "a", 0.31)]
    df = spark.createDataFrame(rows, "label STRING, predicted STRING, confidence DOUBLE")
    got = {r["bin"]: tuple(r)[1:] for r in metrics.calibration(df).collect()}
    assert got == {9: (2, 0.5, 0.975), 3: (1, 1.0, 0.31)}


def test_listings(spark):
    from postlabel.operators import report

    rows = [(i, "x" * (190 + i), "analysis", "hot_take" if i % 2 else "analysis", 0.12345) for i in range(40)]
    df = spark.createDataFrame(
        rows, "ordinal BIGINT, text STRING, label STRING, predicted STRING, confidence DOUBLE"
    )
    errors = report.first_errors(metrics.wrong_predictions(df.repartition(5))).collect()
    assert [r["ordinal"] for r in errors] == list(range(1, 31, 2))
    assert errors[-1]["text"] == "x" * 200 + "..." and errors[0]["text"] == "x" * 191
    sample = report.sample_report(df, "ordinal").collect()
    assert sum(r["correct"] for r in sample) == 20
    assert {len(r["text"]) for r in sample} == {80} and sample[0]["confidence"] == 0.1235


def test_error_patterns(published):
    from pyspark.sql import functions as F

    errors = metrics.wrong_predictions(published)
    got = {(r["label"], r["predicted"]): r["late"] for r in metrics.error_patterns(errors, {"late": F.col("ex_id") >= 26}).collect()}
    assert got == {("reaction", "hot_take"): 5, ("hot_take", "analysis"): 0}
