"""Intermediate tables in the shared folder, and null-safe input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlabel.session import scratch_path

# Shuffle files go once a step is written, and Python tasks get a few megabytes of rows at a time:
# a batch stands in the task's JVM and in its worker, some times over.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}
# Stands for a null id inside an operator: larger than every other.
NO_ID = (1 << 63) - 1


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a step to the folder all executors share and reads it back.

    Later steps then start from files, not from shuffle output that a lost executor takes
    with it, and the shuffle files of this step are dropped as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    try:
        for name, value in _SETTINGS.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_id(column: str = "doc_id") -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def own_id(column: str) -> Column:
    """Turns ``order_id`` back into the id."""
    return F.when(F.col(column) != NO_ID, F.col(column))
