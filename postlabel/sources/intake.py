"""Readers that account for their input: what was kept, what was not and why, from one scan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postlabel.functions.text import strip_ws

CORRUPT = "_corrupt"
KEPT, BROKEN = "kept", "broken record"
POSTS = "id STRING, created_utc STRING, title STRING, selftext STRING, num_comments INT"
COMMENTS = "id STRING, link_id STRING, created_utc STRING, body STRING"
RESPONSES = "ex_id BIGINT, raw STRING"


@dataclass(frozen=True)
class Intake:
    """``kept`` and ``dead`` rows as written tables, and rows ``read`` and by reason."""

    kept: DataFrame
    dead: DataFrame
    counts: Mapping[str, int]


def take_in(
    spark: SparkSession,
    path: str,
    out: str,
    schema: str,
    checks: Mapping[str, Column],
    shape: Callable[[DataFrame], DataFrame] = lambda df: df,
    fmt: str = "json",
    **options: str,
) -> Intake:
    """Reads raw records, writes the good ones and the dead letters apart, and counts both.

    A record that does not parse, or not into the schema, is a ``broken record`` and keeps its
    raw line in ``_corrupt``. Each check names a fault and the condition under which a shaped
    row has it; the first counts, a null condition does not. All rows go to ``out`` in one pass, in a
    folder by reason; the counts are taken on the way (so of what was written, once). Dead
    letters keep every column, with ``reason``.
    """
    reader = spark.read.schema(f"{schema}, {CORRUPT} STRING").option("mode", "PERMISSIVE")
    raw = reader.option("columnNameOfCorruptRecord", CORRUPT).options(**options).format(fmt).load(path)
    reason = F.when(F.col(CORRUPT).isNotNull(), BROKEN)
    for name, fault in checks.items():
        reason = reason.when(fault, name)
    judged = shape(raw).withColumn("reason", reason.otherwise(KEPT))
    seen = Observation()
    names = [KEPT, BROKEN, *checks]
    counts = [F.count_if(F.col("reason") == name).alias(name) for name in names]
    judged.observe(seen, F.count(F.lit(1)).alias("read"), *counts).write.partitionBy("reason").parquet(out)
    written = spark.read.schema(judged.schema).parquet(out)
    return Intake(
        written.where(F.col("reason") == KEPT).drop("reason", CORRUPT),
        written.where(F.col("reason") != KEPT),
        dict(seen.get),
    )


def moment(col: Column) -> Column:
    """A time given as Unix seconds, with or without fraction, or in ISO form; else null."""
    seconds = F.when(col.rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), col).try_cast("double")
    return F.coalesce(F.timestamp_seconds(seconds), F.when(seconds.isNull(), F.try_to_timestamp(col)))


def _blank(column: str) -> Column:
    return F.length(strip_ws(F.coalesce(column, F.lit("")))) == 0


def take_in_posts(spark: SparkSession, path: str, out: str, fmt: str = "json") -> Intake:
    """Archived posts; those without id, time or title are dead letters."""
    return take_in(
        spark,
        path,
        out,
        POSTS,
        {"no id": _blank("id"), "no time": F.col("created_utc").isNull(), "no title": _blank("title")},
        lambda df: df.withColumn("created_utc", moment(F.col("created_utc"))),
        fmt,
    )


def take_in_comments(spark: SparkSession, path: str, out: str, fmt: str = "json") -> Intake:
    """Archived comments with the id of their thread; those without id, thread or body are dead letters."""

    def shape(df: DataFrame) -> DataFrame:
        thread = F.regexp_replace("link_id", "^t3_", "").alias("post_id")
        return df.select("id", thread, moment(F.col("created_utc")).alias("created_utc"), "body", CORRUPT)

    checks = {"no id": _blank("id"), "no thread": _blank("post_id"), "no body": F.col("body").isNull()}
    return take_in(spark, path, out, COMMENTS, checks, shape, fmt)


def take_in_responses(spark: SparkSession, path: str, out: str, fmt: str = "json") -> Intake:
    """Raw answers; those without example or without any answer are dead letters, an empty one is not."""
    checks = {"no example": F.col("ex_id").isNull(), "no answer": F.col("raw").isNull()}
    return take_in(spark, path, out, RESPONSES, checks, fmt=fmt)
