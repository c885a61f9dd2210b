import math

from pyspark.sql import functions as F

from postlabel.functions import argmax, decode_label, encode_label, parse_response, score_struct, softmax


def test_parse_response(spark):
    rows = [
        ("analysis", "analysis"), (" HOT_TAKE. ", "hot_take"), ("I would say reaction", "reaction"),
        ("reaction, not analysis", "analysis"), ("hot take", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame(rows, "raw STRING, want STRING")
    for raw, want, got in df.select("raw", "want", parse_response(F.col("raw"))).collect():
        assert got == want, raw


def test_longer_label_wins(spark):
    df = spark.createDataFrame([("a strong_yes indeed",), ("yes",)], "raw STRING")
    got = [r[0] for r in df.select(parse_response(F.col("raw"), ["yes", "strong_yes"])).collect()]
    assert got == ["strong_yes", "yes"]


def test_encode_and_decode(spark):
    df = spark.createDataFrame([("hot_take", 2), ("other", 9), (None, None)], "l STRING, i INT")
    got = [tuple(r) for r in df.select(encode_label(F.col("l")), decode_label(F.col("i"))).collect()]
    assert got == [(1, "reaction"), (None, None), (None, None)]


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0, -1000.0],)], "s ARRAY<DOUBLE>")
    p = softmax(F.col("s"))
    first, second = df.select(p.alias("p"), argmax(F.col("s")).alias("i"), score_struct(p).alias("r")).collect()
    total = math.exp(1) + 2 * math.exp(3)
    assert all(abs(a - math.exp(b) / total) < 1e-12 for a, b in zip(first["p"], [1, 3, 3]))
    assert first["i"] == 1  # the first of equal maxima
    assert first["r"]["predicted_label"] == "hot_take"
    assert first["r"]["confidence"] == round(math.exp(3) / total, 4)
    assert second["p"] == [1.0, 0.0, 0.0]
    assert second["r"]["all_scores"] == {"analysis": 1.0, "hot_take": 0.0, "reaction": 0.0}
