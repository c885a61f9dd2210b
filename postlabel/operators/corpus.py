"""Building the corpus: union, dedupe, caps, shuffle, review, split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.labels import encode_label
from postlabel.functions.text import shuffle_key, strip_ws, with_context_prefix
from postlabel.operators.ranking import hash_rank, top_per_group

INPUT_ORDER = ("input_no", "ordinal")
SPLITS = ("train", "val", "test")


def union_all(*dfs: DataFrame) -> DataFrame:
    """All rows of all inputs; ``input_no`` keeps which input comes first."""
    numbered = [df.withColumn("input_no", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def dedupe_text(df: DataFrame, order: Sequence[str] = ("ordinal",), text: str = "text") -> DataFrame:
    """Exact duplicates of a text: the first in ``order`` stays.

    Every task keeps one row per text before the shuffle, so a text that makes up a third
    of all rows still sends one row per task. The 64-bit hash goes first, so that texts
    are compared with each other only where hashes are equal.
    """
    return top_per_group(
        df.withColumn("_hash", F.xxhash64(text)),
        ["_hash", text],
        [F.col(c) for c in order],
        1,
        rank="_copy",
    ).drop("_hash", "_copy")


def cap_random(
    df: DataFrame, cap: int = fixed.CAP_PER_LABEL, seed: int = fixed.SEED, id_col: str = "ex_id"
) -> DataFrame:
    """At most ``cap`` rows per label, chosen at random by seed."""
    order = [shuffle_key(F.col(id_col), seed), F.col(id_col)]
    top = top_per_group(df, ["label"], order, cap, rank="_rank", spread_by=[id_col])
    return top.drop("_rank")


def cap_preferring(
    df: DataFrame,
    cap: int = fixed.CAP_PER_LABEL,
    order: Sequence[str] = ("ordinal",),
    longest_first: Sequence[str] = ("analysis",),
) -> DataFrame:
    """At most ``cap`` rows per label: the longest of some labels, the first of the others."""
    length = F.when(F.col("label").isin(*longest_first), -F.length("text")).otherwise(F.lit(0))
    keys = [length, *[F.col(c) for c in order]]
    return top_per_group(df, ["label"], keys, cap, rank="_rank", spread_by=order).drop("_rank")


def shuffle(df: DataFrame, seed: int = fixed.SEED, id_col: str = "ex_id") -> DataFrame:
    """Random row order; ``shuffle_key`` keeps it once the rows are written."""
    return df.withColumn("shuffle_key", shuffle_key(F.col(id_col), seed)).orderBy(
        "shuffle_key", id_col
    )


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.length(strip_ws(F.col(text))) > 0)


def add_context_prefix(df: DataFrame, title: str | None = None) -> DataFrame:
    """Puts the source before each text, and a comment's thread title from the column ``title``."""
    thread = None if title is None else F.col(title)
    return df.withColumn("text", with_context_prefix(F.col("text"), F.col("source"), thread))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """A user's column names to the ones used here."""
    return df.withColumnsRenamed(dict(names))


# --- labels -------------------------------------------------------------------


def encode_labels(df: DataFrame, label_map: Mapping[str, int] = fixed.LABEL_MAP) -> DataFrame:
    return df.withColumn("label_id", encode_label(F.col("label"), label_map))


def valid_label(df: DataFrame, label_map: Mapping[str, int] = fixed.LABEL_MAP) -> DataFrame:
    """Rows whose label is in the map, with its id; see ``unknown_labels`` for the others."""
    return encode_labels(df, label_map).where(F.col("label_id").isNotNull())


def unknown_labels(
    df: DataFrame, domain: Sequence[str] = fixed.LABELS, label: str = "label"
) -> DataFrame:
    """Labels that occur in the data but not in the domain, with their rows.

    The domain is a literal, so this is a filter before the count and not an anti join.
    """
    known = F.coalesce(F.col(label).isin(*domain), F.lit(False))
    return (
        df.where(~known).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    )


def label_difference(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    """Labels of ``a`` that do not occur in ``b``."""
    return a.select(label).subtract(b.select(label))


DECISIONS = ("drop", "change", "confirm")


def resolve_reviews(
    reviews: DataFrame,
    id_col: str = "ex_id",
    order: Sequence[str] = ("reviewed_at", "reviewer"),
) -> DataFrame:
    """One decision an id from several reviewers' reviews: the last by ``order``.

    Columns of ``order`` that ``reviews`` lacks are left out. Of reviews equal in it, drop goes
    before change before confirm, then the first label; a change without a label is a
    confirmation. A null in ``order`` comes before everything else. Tasks cut the reviews to
    one per id before the shuffle.
    """
    decision = F.when((F.col("decision") == "change") & F.col("label").isNull(), "confirm").otherwise(F.col("decision"))
    rank = F.coalesce(*[F.when(F.col("_decision") == name, F.lit(i)) for i, name in enumerate(DECISIONS)])
    keys = [F.col(c).desc_nulls_last() for c in order if c in reviews.columns]
    valid = reviews.withColumn("_decision", decision).where(rank.isNotNull() & F.col(id_col).isNotNull())
    kept = top_per_group(valid, [id_col], [*keys, rank, F.col("label")], 1, rank="_place")
    return kept.withColumn("decision", F.col("_decision")).drop("_decision", "_place")


def review_conflicts(reviews: DataFrame, id_col: str = "ex_id") -> DataFrame:
    """Ids on which reviews differ in decision or label: (id, reviews, decisions, labels).

    Sets are sorted. They are bounded by the number of decisions and labels there are.
    """
    grouped = reviews.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("reviews"),
        F.sort_array(F.collect_set("decision")).alias("decisions"),
        F.sort_array(F.collect_set("label")).alias("labels"),
    )
    return grouped.where((F.size("decisions") > 1) | (F.size("labels") > 1))


def apply_reviews(labelled: DataFrame, reviews: DataFrame, id_col: str = "ex_id") -> DataFrame:
    """A reviewer's decision over the rule's label.

    Decision ``drop`` removes the example, ``change`` replaces the label, ``confirm`` keeps it;
    of several reviews of an example one counts (``resolve_reviews``), so no example is
    multiplied. ``status`` is ``pre-labeled`` without a review.
    """
    found = resolve_reviews(reviews, id_col).select(
        id_col, F.col("label").alias("_label"), F.col("decision").alias("_decision")
    )
    decided = F.col("_decision")
    return (
        labelled.join(found, id_col, "left")
        .where(decided.isNull() | (decided != "drop"))
        .withColumn("status", F.when(decided.isNull(), "pre-labeled").otherwise("reviewed"))
        .withColumn(
            "label",
            F.when(decided == "change", F.coalesce("_label", "label")).otherwise(F.col("label")),
        )
        .drop("_label", "_decision")
    )


# --- splits -------------------------------------------------------------------


def stratified_split(
    df: DataFrame,
    train: float = 0.70,
    seed: int = fixed.SEED,
    id_col: str = "ex_id",
    label: str = "label",
) -> DataFrame:
    """Adds ``split`` with exact sizes per label: ``train``, then half and half.

    Rows are ranked by hash inside their label without gathering a label in one task.
    """
    n = F.col("group_rows")
    n_train = F.floor(n * F.lit(train) + F.lit(0.5))
    n_val = F.floor((n - n_train) / 2)
    rank = F.col("_rank")
    split = (
        F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")
    )
    return (
        hash_rank(df, [label], id_col, seed, rank="_rank")
        .withColumn("split", split)
        .drop("_rank", "group_rows")
    )


def split_by_hash(
    df: DataFrame,
    train: float = 0.70,
    val: float = 0.15,
    seed: int = fixed.SEED,
    id_col: str = "ex_id",
) -> DataFrame:
    """Adds ``split`` from the hash alone: no shuffle, sizes right on average."""
    drawn = hash_fraction(F.col(id_col), seed)
    return df.withColumn(
        "split",
        F.when(drawn < train, "train").when(drawn < train + val, "val").otherwise("test"),
    )


def hash_fraction(id_col: Column, seed: int = fixed.SEED) -> Column:
    """A number in [0, 1) from the first eight hex digits of the shuffle key."""
    digits = F.substring(shuffle_key(id_col, seed), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**8))


def split_overlap(df: DataFrame, id_col: str = "ex_id", text: str = "text") -> DataFrame:
    """How many ids and how many texts occur in more than one split.

    Texts are grouped by their SHA-256, so 32 bytes are shuffled for each and not the text.
    """
    keys = F.array(
        F.struct(F.lit("id").alias("kind"), F.col(id_col).cast("string").alias("key")),
        F.struct(F.lit("text").alias("kind"), F.sha2(text, 256).alias("key")),
    )
    bits = F.lit(0)
    for i, name in enumerate(SPLITS):
        bits = F.when(F.col("split") == name, F.lit(1 << i)).otherwise(bits)
    per_key = (
        df.select(bits.alias("bit"), F.inline(keys))
        .groupBy("kind", "key")
        .agg(F.bit_or("bit").alias("splits"))
    )
    return per_key.groupBy("kind").agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.bit_count("splits") > 1).alias("shared"),
    )
