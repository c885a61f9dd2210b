"""The stages' decisions on planted rows and on a whole table; the entry without this folder."""

import subprocess
import sys

import corpus_pipeline
import pyarrow as pa
from corpus_pipeline import COLUMNS, STAGES, run

from postlabel.llm.store import materialise


def test_stages_on_planted_rows(spark, tmp_path):
    english = [f"word{chr(97 + i)} other{chr(97 + j)} thing" for i in range(8) for j in range(8)]
    text = {i: " ".join(english[i:] + english[:i]) + f" unique{chr(97 + i)} tail" for i in range(12)}
    item = "a passage of the benchmark that must never be seen in training data at all by anyone"
    rows = [(i, t, "en", "s", len(t)) for i, t in text.items()]
    rows += [(100, text[3], "en", "s", 1), (101, None, None, "s", 0), (102, "12 34", "en", "s", 5), (103, f"before {item} after", "en", "s", 1)]
    rows += [(None, "some words without an id but with letters", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = {i for i in text} | {100, 103, None}
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == COLUMNS
        expected -= {"near_dedup": {100}, "decontaminate": {103}}.get(name, set())
        got = {r.doc_id for r in docs.collect()}
        # Shingles of the rotated texts overlap, so near duplicates among them may go.
        assert got <= expected and {0, None} <= got and (name == "near_dedup" or name == "decontaminate" or got == expected), name
    assert {r.doc_id for r in STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == got


def test_whole_pipeline(spark, sf):
    pieces = run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.5 * docs < len({r.doc_id for r in pieces}) <= docs
    assert [n for n, _ in STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]


def test_entry_without_this_folder():
    code = f"""
import sys
sys.path.insert(0, {corpus_pipeline.__file__.rsplit("/", 1)[0]!r})
sys.modules["corpus_pipeline"] = None
import importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("postlabel.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in e.queries()) and len(e.queries()) > 90
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_steps_get_few_rows_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = materialise(spark.range(0, 30_000, 1, 2).mapInArrow(sizes, "n long"), "sizes").collect()
    assert sum(r.n for r in rows) == 30_000 and max(r.n for r in rows) <= 2000
    assert spark.conf.get(name) == before
