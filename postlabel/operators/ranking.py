"""Ranks and top-k inside groups, none of which puts a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.text import shuffle_key
from postlabel.session import cut_lineage

# Up to the k of this setting, Spark prunes a row_number() <= k window before its shuffle.
PRUNING = "spark.sql.optimizer.windowGroupLimitThreshold"
# Reducers that the tasks' rows of one group are dealt to where there are only a few groups.
SALTS = 64
HASH_DIGITS = 4


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """The first k rows of each group, with their rank; ``order`` must be total.

    Every task keeps only k rows per group before the shuffle, as far as the session lets
    Spark prune so. With few groups and many tasks that is still tasks x k rows for one
    reducer: given ``spread_by`` (the columns of a unique key), the rows of each task go to
    one of ``SALTS`` reducers, which cut them to k rows each, and the last round sees
    SALTS x k rows. A task has one salt, so it still sends k rows per group and no more; the
    order is total, so the rows do not depend on the salt. A k beyond the pruning is ranked
    exactly.
    """
    if k > _pruned(df):
        return exact_rank(df, keys, order, rank, k)
    if spread_by:
        cut = df.withColumn("_salt", _task_salt())
        df = _first_k(cut, [*keys, "_salt"], order, k, "_place").drop("_salt", "_place")
    return _first_k(df, keys, order, k, rank)


def first_rows(
    df: DataFrame, order: Sequence[Column], k: int, spread_by: Sequence[str]
) -> DataFrame:
    """The first k rows of the whole table, in order.

    A plain ordered limit sends k rows of every task to one reducer or to the driver; here
    ``SALTS`` tasks cut them first, and the last one sees SALTS x k rows. A k beyond Spark's
    pruning is ranked exactly, and only the rows it keeps are sorted.
    """
    if k > _pruned(df):
        one = df.withColumn("_all", F.lit(0))
        top = exact_rank(one, ["_all"], order, "_place", k)
        return top.orderBy("_place").drop("_all", "_place")
    salted = df.withColumn("_salt", _task_salt())
    cut = _first_k(salted, ["_salt"], order, k, "_place").drop("_salt", "_place")
    return cut.orderBy(*order).limit(k)


def _pruned(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(PRUNING))


def _task_salt() -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(SALTS))


def _first_k(df, keys, order, k, rank):
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def exact_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rank: str = "rank",
    first: int | None = None,
) -> DataFrame:
    """row_number() over (keys, order) for groups of any size; the ``first`` ranks if given.

    Rows are range partitioned by (keys, order), so a large group is spread over many
    partitions; each row's rank is its place in its partition plus the group's rows in
    the partitions before. ``order`` must be total. The ranged rows are checkpointed,
    because a recomputed range could cut elsewhere.
    """
    part = "_part"
    sort_keys = [F.col(k) for k in keys]
    ranged = cut_lineage(
        df.repartitionByRange(*sort_keys, *order).withColumn(part, F.spark_partition_id())
    )
    return _rank_by_bucket(ranged, keys, [part], order, rank, first).drop(part, "group_rows")


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seed: int = fixed.SEED,
    rank: str = "rank",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Rank inside each group in seeded random order, plus ``group_rows``.

    The order is that of an md5, so its leading digits cut every group into buckets of
    equal expected size: 65,536 per group for four digits. Rows of nothing but id and keys
    are written before they are counted and ranked, so what makes them runs once.
    """
    keyed = df.withColumn("_key", shuffle_key(F.col(id_col), seed)).withColumn(
        "_bucket", F.substring("_key", 1, digits)
    )
    if set(df.columns) <= {id_col, *keys}:
        keyed = cut_lineage(keyed)
    order = [F.col("_key"), F.col(id_col)]
    return _rank_by_bucket(keyed, keys, ["_bucket"], order, rank).drop("_key", "_bucket")


def _rank_by_bucket(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[str],
    order: Sequence[Column],
    rank: str,
    first: int | None = None,
) -> DataFrame:
    """Rank from buckets whose order agrees with ``order``.

    One pass counts rows per (group, bucket), a second ranks inside the buckets; both
    shuffle on (group, bucket). The counts hold one row per bucket, and AQE broadcasts
    them only when they turn out small. Upstream work is done in both passes, so
    expensive inputs should be a written table.
    """
    cell = F.struct(*keys, *buckets)
    before = (
        Window.partitionBy(*keys)
        .orderBy(*buckets)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = df.groupBy(*keys, *buckets).agg(F.count(F.lit(1)).alias("_rows"))
    # As a struct, a null key equals a null key, so null groups are ranked as well.
    offsets = counts.select(
        cell.alias("_cell"),
        (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("group_rows"),
    )
    if first is not None:
        # Buckets that lie behind the last wanted row are not ranked.
        offsets = offsets.where(F.col("_before") < first)
    inside = Window.partitionBy("_cell").orderBy(*order)
    ranked = (
        df.withColumn("_cell", cell)
        .join(offsets, "_cell")
        .withColumn(rank, F.col("_before") + F.row_number().over(inside))
        .drop("_cell", "_before")
    )
    return ranked if first is None else ranked.where(F.col(rank) <= first)
