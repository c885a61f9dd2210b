import oracle
import pytest
from pyspark.sql import functions as F
from queries import ORACLES, QUERIES

from postlabel.operators import rules
from postlabel.operators import model as ml
from postlabel.session import scratch_path
from postlabel.streaming import (
    dedupe_stream,
    label_counts_stream,
    label_stream,
    late_counts,
    predict_stream,
    read_stage,
    read_stream,
    run_available,
    run_once,
    split_late,
    thin_stream,
)

SCHEMA = "ex_id BIGINT, ts TIMESTAMP, text STRING, source STRING"


def _write(spark, folder, rows):
    df = spark.createDataFrame(rows, "ex_id BIGINT, ts STRING, text STRING, source STRING")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(folder))


ROWS = [
    (1, "2024-01-01 00:00:00", "Match Thread: A v B", "post"),
    (2, "2024-01-01 00:10:00", "Midfield depth wins titles", "post"),
    (3, "2024-01-01 01:10:00", "Midfield depth wins titles", "post"),
    (4, "2024-01-01 01:20:00", "WHAT A goal from the halfway mark", "post"),
]


def test_stream_labels_equal_batch_labels(spark, tmp_path):
    _write(spark, tmp_path / "in", ROWS)
    stream = read_stream(spark, str(tmp_path / "in"), SCHEMA, "*.parquet")
    got = run_once(label_stream(stream).select("ex_id", "label", "note"), "label")
    want = rules.label_posts(spark.read.parquet(str(tmp_path / "in"))).select("ex_id", "label", "note")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["label_stream", "dedupe_stream", "label_counts_stream"])
def test_stream_queries_read_a_table_of_many_files(spark, sf, tmp_path, name):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = oracle.spark_rows(QUERIES[name](spark, str(tmp_path)))
    assert oracle.difference(got, oracle.sql_rows(oracle.connect(sf), ORACLES[name])) is None


def test_stream_dedupe_keeps_one_of_a_flood(spark, tmp_path):
    rows = [(i, "2024-01-01 00:00:00", "hot" if i % 3 else f"t{i}", "post") for i in range(300)]
    _write(spark, tmp_path / "in", rows)
    stream = read_stream(spark, str(tmp_path / "in"), SCHEMA, "*.parquet")
    got = run_once(dedupe_stream(stream).select("text"), "dedupe").collect()
    texts = [r["text"] for r in got]
    assert texts.count("hot") == 1
    assert sorted(set(texts)) == sorted(texts) and len(texts) == 101


def test_stream_counts(spark, tmp_path):
    _write(spark, tmp_path / "in", ROWS)
    stream = label_stream(read_stream(spark, str(tmp_path / "in"), SCHEMA, "*.parquet"))
    got = run_once(label_counts_stream(stream), "counts", "update")
    counts = {(r["start"].hour, r["label"]): r["rows"] for r in got.collect()}
    assert counts == {(0, "skip"): 1, (0, "hot_take"): 1, (1, "hot_take"): 1, (1, "reaction"): 1}


def _batches(spark, folder, *batches):
    """One file per batch, with rising modification times."""
    import os

    for i, rows in enumerate(batches):
        before = set(folder.glob("*.parquet")) if folder.exists() else set()
        _write(spark, folder, rows)
        for new in set(folder.glob("*.parquet")) - before:
            os.utime(new, (1_700_000_000 + i * 60,) * 2)
    return read_stream(spark, str(folder), SCHEMA, "*.parquet", files_per_batch=1)


def test_late_rows_are_dropped_past_the_watermark(spark, tmp_path):
    stream = _batches(
        spark,
        tmp_path / "in",
        [(1, "2024-01-01 00:10:00", "Midfield depth wins titles", "post")],
        [(2, "2024-01-01 05:00:00", "Midfield depth wins titles", "post")],
        # Spark drops late rows by the watermark of the batch before.
        [(5, "2024-01-01 05:00:30", "Midfield depth wins titles", "post")],
        [
            (3, "2024-01-01 00:20:00", "Midfield depth wins titles", "post"),  # too late
            (4, "2024-01-01 04:30:00", "Midfield depth wins titles", "post"),  # late, in time
        ],
    )
    got = run_once(label_counts_stream(label_stream(stream)), "late", "update").collect()
    latest = {}
    for r in sorted(got, key=lambda r: r["batch"]):
        latest[r["start"].hour] = r["rows"]
    assert latest == {0: 1, 5: 2, 4: 1}


def test_copies_in_later_batches_are_dropped_within_the_delay(spark, tmp_path):
    stream = _batches(
        spark,
        tmp_path / "in",
        [(1, "2024-01-01 00:00:00", "same", "post"), (2, "2024-01-01 00:01:00", "other", "post")],
        [(3, "2024-01-01 00:30:00", "same", "post")],
        [(4, "2024-01-01 00:40:00", "new", "post"), (5, "2024-01-01 00:41:00", "other", "post")],
    )
    got = run_once(dedupe_stream(stream).select("ex_id"), "copies").collect()
    assert sorted(r["ex_id"] for r in got) == [1, 2, 4]


def test_a_dropped_copy_does_not_renew_the_memory_of_a_text(spark, tmp_path):
    """Whatever the ids: a text comes again once its first row is older than the delay."""
    for name, ids in (("a", (1, 2, 3)), ("b", (1, 2, 17)), ("c", (40, 9, 5))):
        stream = _batches(
            spark,
            tmp_path / name,
            [(ids[0], "2024-01-01 00:00:00", "same", "post")],
            [(ids[1], "2024-01-01 00:50:00", "same", "post")],
            [(90, "2024-01-01 02:10:00", "later", "post")],
            [(91, "2024-01-01 02:11:00", "latest", "post")],
            [(ids[2], "2024-01-01 02:12:00", "same", "post")],
        )
        got = run_once(dedupe_stream(stream).select("ex_id"), f"renew-{name}").collect()
        assert sorted(r["ex_id"] for r in got) == sorted([ids[0], 90, 91, ids[2]])


def _models(spark):
    words = {"analysis": "data trend formation", "hot_take": "overrated bum worst", "reaction": "goal wow what"}
    rows = [(i, name, f"{words[name]} {i % 5}") for i, name in enumerate(list(words) * 8)]
    train = spark.createDataFrame(rows, "ex_id BIGINT, label STRING, text STRING")
    text_model, candidates = ml.fit_grid(train, ({"regParam": 0.01}, {"regParam": 10.0}), features=256)
    return [ml.whole_model(text_model, m) for _, m in candidates]


def _stream_rows(n, first=0):
    texts = ["data trend", "a bum", "wow what a goal", "", "none of these"]
    return [(i, "2024-01-01 00:00:00", texts[i % 5], "post") for i in range(first, first + n)]


def test_predict_stream_equals_batch_over_a_restart_with_another_model(spark, tmp_path):
    models, out, progress = (str(tmp_path / x) for x in ("models", "out", "progress"))
    expected = {}
    for version, (model, rows) in enumerate(zip(_models(spark), (_stream_rows(20), _stream_rows(15, 20)), strict=True), start=1):
        assert ml.publish_model(model, models) == version
        _write(spark, tmp_path / "in", rows)
        stream = read_stream(spark, str(tmp_path / "in"), SCHEMA, "*.parquet")
        got = run_available(predict_stream(stream, models), out, progress)
        batch = ml.predict(spark.createDataFrame(rows, "ex_id BIGINT, ts STRING, text STRING, source STRING"), model)
        expected |= {r["ex_id"]: (version, r["predicted_label"], r["confidence"], r["all_scores"]) for r in batch.collect()}
    found = got.collect()
    assert len(found) == 35
    assert {r["ex_id"]: (r["model_version"], r["predicted_label"], r["confidence"], r["all_scores"]) for r in found} == expected
    # Started again with nothing new, it writes nothing.
    again = run_available(predict_stream(read_stream(spark, str(tmp_path / "in"), SCHEMA, "*.parquet"), models), out, progress)
    assert again.count() == 35


def test_a_query_that_fails_in_a_batch_scores_each_text_once(spark, tmp_path):
    """The first start dies while it scores; the second one goes on from the noted progress."""
    import pytest

    models, out, progress = (str(tmp_path / x) for x in ("models", "out", "progress"))
    for model in _models(spark)[:1]:
        ml.publish_model(model, models)
    _write(spark, tmp_path / "in", _stream_rows(10))
    run_available(predict_stream(read_stream(spark, str(tmp_path / "in"), SCHEMA, "*.parquet"), models), out, progress)
    _write(spark, tmp_path / "in", _stream_rows(10, 10))
    stream = predict_stream(read_stream(spark, str(tmp_path / "in"), SCHEMA, "*.parquet"), models)
    with pytest.raises(Exception, match="lost"):
        run_available(stream.withColumn("confidence", F.when(F.col("ex_id") == 15, F.raise_error(F.lit("lost"))).otherwise(F.col("confidence"))), out, progress)
    got = run_available(stream, out, progress)
    assert sorted(r["ex_id"] for r in got.collect()) == list(range(20))


def test_missing_models_are_named(spark, tmp_path):
    import pytest

    with pytest.raises(FileNotFoundError, match="no model"):
        ml.current_model(spark, str(tmp_path / "none"))


HASHED = f"{SCHEMA}, text_hash STRING"


def _thin(spark, folder, thin, progress):
    stream = read_stream(spark, str(folder), SCHEMA, "*.parquet").withColumn("text_hash", F.sha2("text", 256))
    thin_stream(stream, str(thin), str(progress), order=("ts", "ex_id"))


def test_a_flood_is_one_row_a_batch_for_the_state(spark, tmp_path):
    """Three batches of a flooding text and an hour's delay: thinned, forgotten, emitted again."""
    folder, thin, first, second, out = (tmp_path / x for x in ("in", "thin", "first", "second", "out"))
    lots = [("00:00:00", 0), ("00:30:00", 1000), ("05:00:00", 2000)]
    for time, base in lots:
        _write(spark, folder, [(base + i, f"2024-01-01 {time}", "hot" if i % 3 else f"t{base + i}", "post") for i in range(300)])
        _thin(spark, folder, thin, first)
        kept = run_available(dedupe_stream(read_stage(spark, str(thin), HASHED)), str(out), str(second))
    staged = spark.read.option("basePath", str(thin)).parquet(f"{thin}/batch=*")
    assert {r["batch"]: r["count"] for r in staged.where("text = 'hot'").groupBy("batch").count().collect()} == {0: 1, 1: 1, 2: 1}
    assert staged.count() == 3 * 101
    # Known in the second lot; the state goes when the third has moved the watermark past it.
    assert [r["ex_id"] for r in kept.where("text = 'hot'").collect()] == [1]
    _write(spark, folder, [(3000 + i, "2024-01-01 05:10:00", "hot", "post") for i in range(50)])
    _thin(spark, folder, thin, first)
    kept = run_available(dedupe_stream(read_stage(spark, str(thin), HASHED)), str(out), str(second))
    assert sorted(r["ex_id"] for r in kept.where("text = 'hot'").collect()) == [1, 3000]


def test_a_batch_written_before_its_progress_is_not_written_again(spark, tmp_path):
    """Lost progress: the same rows come as batch 0 again, which is there already."""
    _write(spark, tmp_path / "in", [(1, "2024-01-01 00:00:00", "a", "post"), (2, "2024-01-01 00:00:00", "a", "post")])
    _thin(spark, tmp_path / "in", tmp_path / "thin", tmp_path / "one")
    before = sorted(p.name for p in (tmp_path / "thin" / "batch=0").iterdir())
    _thin(spark, tmp_path / "in", tmp_path / "thin", tmp_path / "another")
    assert sorted(p.name for p in (tmp_path / "thin" / "batch=0").iterdir()) == before
    assert [r["ex_id"] for r in spark.read.parquet(str(tmp_path / "thin" / "batch=0")).collect()] == [1]


def test_late_rows_are_counted_and_the_others_all_arrive(spark, tmp_path):
    staged, first, second, out = (str(tmp_path / x) for x in ("staged", "first", "second", "out"))
    schema = "ex_id BIGINT, ts TIMESTAMP, label STRING"
    lots = [
        [(1, "2024-01-01 00:10:00"), (2, "2024-01-01 05:00:00")],
        [(3, "2024-01-01 00:20:00"), (4, "2024-01-01 03:59:59"), (5, "2024-01-01 02:59:59"), (6, None)],
        [(7, "2024-01-01 04:00:00"), (8, "2024-01-01 03:00:00")],
    ]
    for rows in lots:
        _write(spark, tmp_path / "in", [(i, t, "Midfield depth wins titles", "post") for i, t in rows])
        stream = label_stream(read_stream(spark, str(tmp_path / "in"), SCHEMA, "*.parquet")).select("ex_id", "ts", "label")
        split_late(stream, staged, first)
        counts = run_available(label_counts_stream(read_stage(spark, staged, schema, late=False)), out, second, "update")
    latest = {}
    for r in sorted(counts.collect(), key=lambda r: r["batch"]):
        latest[r["start"].hour] = r["rows"]
    # The window from 3 to 4 ends at the watermark of the second and third lot, 4 o'clock.
    assert latest == {0: 1, 5: 1, 4: 1}
    late = {r["start"].hour: r["late"] for r in late_counts(spark, staged, schema, ["label"]).collect()}
    assert late == {0: 1, 3: 2, 2: 1}
