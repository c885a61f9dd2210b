import json
import pathlib

import pytest

from postlabel import session, sources
from postlabel.session import scratch_path

TRICKY = [
    'plain', 'comma, "quoted" text', "line one\nline two\n\nline four", "  spaces kept  ", 'ends with quote"',
    "back\\slash", "tab\tinside", "carriage\r\nreturn", "é ü 漢字 🙂", '""',
]


def test_csv_round_trip(spark):
    rows = [(t, "analysis", "post", "rule") for t in TRICKY]
    df = spark.createDataFrame(rows, "text STRING, label STRING, source STRING, notes STRING")
    path = scratch_path(spark, "csv")
    sources.write_examples_csv(df.coalesce(1), path)
    back = sources.read_examples_csv(spark, path).orderBy("file", "ordinal").collect()
    assert [r["text"] for r in back] == TRICKY
    first = next(pathlib.Path(path).glob("*.csv")).read_text().splitlines()[0]
    assert first == '"text","label","source","notes"'


def test_blank_label_is_null_and_source_defaults_to_post(spark):
    df = spark.createDataFrame([("a", "", None), ("b", None, "discussion_comment")], "text STRING, label STRING, source STRING")
    path = scratch_path(spark, "csv")
    sources.write_examples_csv(df.coalesce(1), path)
    back = sources.read_examples_csv(spark, path, "text STRING, label STRING, source STRING")
    got = [(r["text"], r["label"], r["source"]) for r in back.orderBy("ordinal").collect()]
    assert got == [("a", None, "post"), ("b", None, "discussion_comment")]
    two = sources.read_examples_csv(spark, path, "text STRING, label STRING, source STRING")
    assert "source" in two.columns


def test_csv_without_source(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("a", "analysis")], "text STRING, label STRING")
    sources.write_examples_csv(sources.export_clean(df), path)
    row = sources.read_examples_csv(spark, path, "text STRING, label STRING").first()
    assert (row["text"], row["label"], row["source"]) == ("a", "analysis", "post")


def test_json_archives(spark, tmp_path):
    posts = tmp_path / "posts"
    posts.mkdir()
    record = {"id": "p1", "created_utc": "2024-01-02T03:04:05Z", "title": "T", "selftext": None, "num_comments": 3, "score": 9}
    (posts / "a.json").write_text(json.dumps(record) + "\n" + json.dumps({"id": "p2"}) + "\n")
    rows = {r["id"]: r for r in sources.read_posts(spark, str(posts)).collect()}
    assert rows["p1"]["num_comments"] == 3 and rows["p1"]["selftext"] is None
    assert str(rows["p1"]["created_utc"]).startswith("2024-01-02 03:04:05")
    assert rows["p2"]["title"] is None

    comments = tmp_path / "comments"
    comments.mkdir()
    (comments / "a.json").write_text(json.dumps({"id": "c", "link_id": "t3_p1", "body": "hi"}))
    row = sources.read_comments(spark, str(comments)).first()
    assert (row["post_id"], row["body"]) == ("p1", "hi")


def test_intake_accounts_for_every_line(spark, tmp_path):
    good = {"id": "p1", "created_utc": 1700000000, "title": "T", "selftext": "s", "num_comments": 3}
    lines = [
        json.dumps(good), json.dumps(good | {"id": "p2", "created_utc": "1700000000.25"}), json.dumps(good | {"id": "p3", "created_utc": "2023-11-14T22:13:20Z"}),
        json.dumps(good)[:30], "not json", json.dumps(good | {"num_comments": "many"}), json.dumps(good | {"id": " "}),
        json.dumps({k: v for k, v in good.items() if k != "id"}), json.dumps(good | {"created_utc": "yesterday"}), json.dumps(good | {"title": None}), "",
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines) + "\n")
    taken = sources.take_in_posts(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert taken.counts == {"read": 10, "kept": 3, "broken record": 3, "no id": 2, "no time": 1, "no title": 1}
    rows = {r["id"]: r for r in taken.kept.collect()}
    assert {str(r["created_utc"])[:19] for r in rows.values()} == {"2023-11-14 22:13:20"} and set(rows) == {"p1", "p2", "p3"}
    dead = taken.dead.groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in dead} == {"broken record": 3, "no id": 2, "no time": 1, "no title": 1}
    assert {r["_corrupt"] for r in taken.dead.where("reason = 'broken record'").collect()} >= {"not json", json.dumps(good)[:30]}


def test_intake_of_nothing_and_of_answers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("")
    taken = sources.take_in_responses(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert taken.counts["read"] == 0 and taken.kept.count() == taken.dead.count() == 0
    (tmp_path / "in" / "b.json").write_text('{"ex_id": 1, "raw": ""}\n{"ex_id": 2}\n{"raw": "x"}\n{"ex_id": "x", "raw": "y"}\n')
    taken = sources.take_in_responses(spark, str(tmp_path / "in"), str(tmp_path / "two"))
    assert taken.counts == {"read": 4, "kept": 1, "broken record": 1, "no example": 1, "no answer": 1}
    assert [tuple(r) for r in taken.kept.collect()] == [(1, "")]


def test_results_are_one_file(spark):
    path = scratch_path(spark, "results")
    sources.write_results_json(spark.createDataFrame([(0.5, "m")], "accuracy DOUBLE, model STRING"), path)
    files = list(pathlib.Path(path).glob("*.json"))
    assert len(files) == 1
    assert json.loads(files[0].read_text()) == {"accuracy": 0.5, "model": "m"}


def test_a_session_decides_on_spreading(spark, sf, capsys):
    sources.read_table(spark, f"{sf}/documents.parquet", "doc_id").explain()
    assert "Exchange" in capsys.readouterr().out
    before = spark.conf.get(session.SPREAD_CONF)
    spark.conf.unset(session.SPREAD_CONF)
    try:
        many = spark.range(0, 1000, 1, 64)
        assert session.spread(many, "id") is many
    finally:
        spark.conf.set(session.SPREAD_CONF, before)


def test_shared_folder_is_read_from_the_session(spark, monkeypatch):
    named = session.shared_dir(spark)
    assert session.shared_dir(spark) == named
    assert scratch_path(spark, "x").startswith(named)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    # The real setting cannot be changed in a running session, so another name stands for it.
    monkeypatch.setattr(session, "CHECKPOINT_CONF", "spark.postlabel.testDir")
    spark.conf.set("spark.postlabel.testDir", "/shared/by/cluster")
    assert scratch_path(spark, "x").startswith("/shared/by/cluster/postlabel/x-")


@pytest.mark.parametrize("column", ["n_chars"])
def test_only_needed_columns_are_read(spark, sf, capsys, column):
    sources.read_table(spark, f"{sf}/documents.parquet").select(column).where(f"{column} > 5").explain()
    plan = capsys.readouterr().out
    assert f"ReadSchema: struct<{column}:bigint>" in plan and f"GreaterThan({column},5)" in plan
