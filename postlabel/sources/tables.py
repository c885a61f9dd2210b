"""Readers and writers. Every reader has an explicit schema, so nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.session import spread

POSTS = "id STRING, created_utc TIMESTAMP, title STRING, selftext STRING, num_comments INT"
COMMENTS = "id STRING, link_id STRING, created_utc TIMESTAMP, body STRING"
EXAMPLES = "text STRING, label STRING, source STRING, notes STRING"
RESPONSES = "ex_id BIGINT, raw STRING"


def read_table(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """A Parquet table; given its unique key, dealt to the tasks the session asks for (``spread``)."""
    df = spark.read.parquet(path)
    return spread(df, *keys) if keys else df


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_posts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Archived posts; only the fields the jobs use are read."""
    return _read(spark, path, POSTS, fmt)


def read_comments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Archived comments with the id of their thread as ``post_id``."""
    return _read(spark, path, COMMENTS, fmt).select(
        "id",
        F.regexp_replace("link_id", "^t3_", "").alias("post_id"),
        "created_utc",
        "body",
    )


def read_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw model answers by example."""
    return _read(spark, path, RESPONSES, fmt)


def read_examples_csv(spark: SparkSession, path: str, columns: str = EXAMPLES) -> DataFrame:
    """Quoted CSV with embedded newlines, in row order.

    ``columns`` is the schema of the file. ``(file, ordinal)`` gives the order: a file
    with embedded newlines cannot be split, so its row ids rise. Keep files small and
    many, or use Parquet, where one large file would otherwise be one task.
    Blank labels come back as null; a missing or null source is a post.
    """
    df = (
        spark.read.schema(columns)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("lineSep", "\n")
        .csv(path)
    )
    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    return df.select(
        *[c for c in df.columns if c != "source"],
        F.coalesce(source, F.lit(fixed.POST)).alias("source"),
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("ordinal"),
    )


def write_examples_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_results_json(df: DataFrame, path: str) -> None:
    """The one-row results record as a single JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def export_clean(df: DataFrame) -> DataFrame:
    """The two columns a trainer needs."""
    return df.select("text", "label")
