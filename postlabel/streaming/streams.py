"""The same Column code over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.operators.model import current_model, predict
from postlabel.operators.ranking import top_per_group
from postlabel.operators.rules import DEFAULT_RULES, Rule, label_posts
from postlabel.session import exists, scratch_path


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: str,
    pattern: str,
    spread_by: str | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """A stream of the Parquet files of a folder whose names fit the pattern.

    A folder in it whose name fits stands for the files it holds, as a table may be one file
    or a folder of many. ``spread_by`` shuffles each batch over all cores by a unique key, for batches of few
    files and costly rows.
    """
    # The braces make any name a pattern: Spark takes a plain path for a folder, never a file.
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{{{pattern}}}")
    )
    if spread_by is None:
        return stream
    return stream.repartition(spark.sparkContext.defaultParallelism, spread_by)


def label_stream(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """The cascade on a stream; it has no state."""
    return label_posts(df, rules)


def dedupe_stream(
    df: DataFrame, ts: str = "ts", delay: str = "1 hour"
) -> DataFrame:
    """Drops texts seen within the watermark.

    The first to arrive stays, not the one of lowest ordinal as in ``dedupe_text``. There is
    one state per text, a SHA-256 and not the text; a dropped copy does not renew it.
    """
    return (
        df.withColumn("text_hash", F.sha2("text", 256))
        .withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark(["text_hash"])
    )


def label_counts_stream(
    labelled: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Rows per time window and label; rows later than the watermark are dropped."""
    return (
        labelled.withWatermark(ts, delay)
        .groupBy(F.window(ts, width), "label")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("window.start", "window.end", "label", "rows")
    )


def predict_stream(df: DataFrame, folder: str, labels: Sequence[str] = fixed.LABELS) -> DataFrame:
    """Predicted label, confidence and scores of every row, by the newest model in ``folder``.

    The model is the one that ``publish_model`` put there last when the query is started, and
    ``model_version`` says which. It has no state, so a query that is stopped goes on where its
    progress ends, with a newer model if there is one by then; rows already written stay.
    """
    version, model = current_model(df.sparkSession, folder)
    return predict(df, model, labels).withColumn("model_version", F.lit(version))


# --- first stages -------------------------------------------------------------


def _written(spark: SparkSession, path: str) -> bool:
    """True if a batch was written there to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def thin_stream(
    stream: DataFrame,
    out: str,
    progress: str,
    keys: Sequence[str] = ("text_hash",),
    order: Sequence[str] = ("ts",),
) -> None:
    """First stage of a dedupe: cuts each batch to one row a key, the first by a total ``order``.

    Every task cuts its own rows first, so a text that floods a batch is one row a task in the
    shuffle, and one row a batch for the task that keeps its state in the next stage. Runs
    over all there is; batch n is written to ``out/batch=n``, once: a batch that was written
    before its progress was noted is not written again. Read it with ``read_stage``.
    """

    def write(batch: DataFrame, number: int) -> None:
        path = f"{out}/batch={number}"
        if not _written(batch.sparkSession, path):
            first = top_per_group(batch, list(keys), [F.col(c) for c in order], 1, rank="_place")
            first.drop("_place").write.mode("overwrite").parquet(path)

    _each_batch(stream, write, progress)


def split_late(
    stream: DataFrame,
    out: str,
    progress: str,
    ts: str = "ts",
    width: str = "1 hour",
    delay: str = "1 hour",
) -> None:
    """First stage of counts by window: tells rows that come too late from those in time.

    A row is late if its window had ended ``delay`` before the latest time seen in earlier
    batches, which is the rule by which the counts would drop it without a trace. Batch n is
    written once, to ``out/batch=n``, late rows apart (``late=true``); the latest time so far
    stands beside it. Read it with ``read_stage``, and count what was late with ``late_counts``.
    """
    spark = stream.sparkSession

    def bounds(number: int) -> str:
        return f"{out}-latest/batch={number}"

    def write(batch: DataFrame, number: int) -> None:
        path = f"{out}/batch={number}"
        before = spark.read.parquet(bounds(number - 1)).first()["latest"] if number else None
        if not _written(spark, path):
            latest = F.lit(before).cast("timestamp")
            closed = F.window(ts, width).getField("end") <= latest - F.expr(f"INTERVAL {delay}")
            marked = batch.withColumn("late", F.coalesce(closed, F.lit(False)))
            marked.write.mode("overwrite").partitionBy("late").parquet(path)
        if not _written(spark, bounds(number)):
            seen = spark.read.schema(batch.schema).parquet(path).agg(F.max(ts).alias("latest"))
            seen = seen.select(F.greatest("latest", F.lit(before).cast("timestamp")).alias("latest"))
            seen.coalesce(1).write.mode("overwrite").parquet(bounds(number))

    _each_batch(stream, write, progress)


def read_stage(spark: SparkSession, out: str, schema: str, late: bool | None = None) -> DataFrame:
    """A stream of what a first stage wrote; given ``late``, of those rows of ``split_late`` alone."""
    folder = f"{out}/batch=*" if late is None else f"{out}/batch=*/late={str(late).lower()}"
    return spark.readStream.schema(schema).parquet(folder)


def late_counts(
    spark: SparkSession, out: str, schema: str, by: Sequence[str], ts: str = "ts", width: str = "1 hour"
) -> DataFrame:
    """Rows that ``split_late`` found late, by window and other columns; ``schema`` is that of the rows."""
    rows = spark.read.schema(f"{schema}, late STRING").option("basePath", out).parquet(f"{out}/batch=*")
    return (
        rows.where("late = 'true'")
        .groupBy(F.window(ts, width).alias("window"), *by)
        .agg(F.count(F.lit(1)).alias("late"))
        .select("window.start", "window.end", *by, "late")
    )


# --- running ------------------------------------------------------------------


def _each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], progress: str) -> None:
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_available(stream: DataFrame, out: str, progress: str, mode: str = "append") -> DataFrame:
    """Processes all that is there since ``progress``, and returns all that was ever written to ``out``.

    In update mode a window is written again whenever it changed; ``batch`` tells which row is
    the latest.
    """
    spark = stream.sparkSession
    if mode == "append":
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress)
        query = writer.trigger(availableNow=True).format("parquet").option("path", out).start()
        query.awaitTermination()
        return spark.read.parquet(out)

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces what it wrote before.
        numbered = batch.withColumn("batch", F.lit(number))
        numbered.write.mode("overwrite").parquet(f"{out}/{number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress)
    writer.trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Processes all that is there, with output and progress in new folders of the shared one."""
    spark = stream.sparkSession
    return run_available(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-progress"), mode)
