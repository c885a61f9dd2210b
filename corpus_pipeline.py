"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. ``run``
writes each stage's rows as Parquet to the shared folder and reads them again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlabel.llm.decontaminate import match_benchmark
from postlabel.llm.language_id import UNKNOWN, identify
from postlabel.llm.line_templates import drop_recurring_lines
from postlabel.llm.minhash_dedup import near_duplicates
from postlabel.llm.packing import pack_documents
from postlabel.llm.store import materialise, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# A document goes if no language has this share of its words.
MIN_LANGUAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) or without a main language."""
    found = identify(docs.select(*COLUMNS))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates, and documents of which no word is left."""
    done = drop_recurring_lines(docs.select(*COLUMNS))
    kept = done.where((F.col("n_lines") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return kept.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Rows that share an id are one document and stay together; rows without id stay.
    """
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    docs = docs.select(*COLUMNS)
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat a benchmark item."""
    found = match_benchmark(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return found.where(F.size("item_ids") == 0).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, one row per piece."""
    return pack_documents(docs, added=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

# Language ID, templates and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
