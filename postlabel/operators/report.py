"""Counts and listings about a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.text import preview
from postlabel.operators.ranking import first_rows
from postlabel.operators.rules import DEFAULT_RULES, Rule


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent per value, most frequent first.

    The total is a scalar subquery over the same counts, so a column of many values is
    not gathered in one task.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.select(
        column, "rows", F.round(F.col("rows") * 100 / total, 1).alias("percent")
    ).orderBy(F.col("rows").desc(), column)


def source_breakdown(df: DataFrame) -> DataFrame:
    """Rows per source, most frequent first."""
    return (
        df.groupBy("source")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.col("rows").desc(), "source")
    )


def rule_firing(labelled: DataFrame) -> DataFrame:
    """Rows per (label, note), per label and in all; ``ALL`` stands for a subtotal."""
    return (
        labelled.rollup("label", "note")
        .agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("_level"))
        .select(
            F.when(F.col("_level") == 3, "ALL").otherwise(F.col("label")).alias("label"),
            F.when(F.col("_level") > 0, "ALL").otherwise(F.col("note")).alias("note"),
            "rows",
        )
    )


def _masks(matched: DataFrame) -> DataFrame:
    """Rows by set of matching rules, from ``match_bits``; far fewer than texts."""
    return matched.groupBy("bits").agg(F.count(F.lit(1)).alias("rows"))


def shadowing(matched: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Which rule hides which: rows by deciding and hidden rule, from ``match_bits``.

    Texts are counted by their set of rules in one pass; only the sets are taken apart. Rules
    are numbered from 1 in their order, as notes repeat. ``other_label`` tells that the hidden
    rule would have given another label.
    """
    fired = F.filter(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda i: F.getbit("bits", i) == 1)
    notes = F.array(*[F.lit(r.note) for r in rules])
    labels = F.array(*[F.lit(r.label) for r in rules])
    pairs = (
        _masks(matched)
        .select("rows", fired.alias("fired"))
        .select("rows", F.get("fired", F.lit(0)).alias("d"), F.explode(F.slice("fired", 2, len(rules))).alias("h"))
        .groupBy("d", "h")
        .agg(F.sum("rows").alias("rows"))
    )
    return pairs.select(
        (F.col("d") + 1).alias("rule_no"),
        F.get(notes, F.col("d")).alias("rule"),
        (F.col("h") + 1).alias("hidden_no"),
        F.get(notes, F.col("h")).alias("hidden"),
        "rows",
        (F.get(labels, F.col("d")) != F.get(labels, F.col("h"))).alias("other_label"),
    )


def rule_use(matched: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """How often each rule matches, decides and is hidden by a rule of another label.

    From ``match_bits``. Rules that match nothing are listed too; ``never_decides`` names those
    that could go without any label changing.
    """
    lowest = F.col("bits").bitwiseAND(-F.col("bits"))
    counters, entries = [], []
    for i, rule in enumerate(rules):
        # Sets in which the lowest rule is one that gives another label.
        other = sum(1 << j for j, r in enumerate(rules[:i]) if r.label != rule.label)
        matches = F.getbit("bits", F.lit(i)) == 1
        decides = lowest == F.lit(1 << i).cast("bigint")
        relabels = matches & (lowest.bitwiseAND(F.lit(other).cast("bigint")) != 0)
        for name, condition in (("m", matches), ("d", decides), ("o", relabels)):
            counters.append(F.sum(F.when(condition, F.col("rows")).otherwise(0)).alias(f"{name}{i}"))
        m, d, o = (F.coalesce(F.col(f"{name}{i}"), F.lit(0).cast("bigint")) for name in "mdo")
        entries.append(
            F.struct(
                F.lit(i + 1).alias("rule_no"),
                F.lit(rule.note).alias("rule"),
                F.lit(rule.label).alias("label"),
                m.alias("matches"),
                d.alias("decides"),
                (m - d).alias("hidden"),
                o.alias("relabelled"),
                (d == 0).alias("never_decides"),
            )
        )
    return _masks(matched).agg(*counters).select(F.inline(F.array(*entries)))


def skip_report(reasons: DataFrame) -> DataFrame:
    """Rows per skip reason, with all skipped and all kept; from ``skip_reason``."""
    reason = F.col("skip_reason")
    counts = reasons.groupBy(reason).agg(F.count(F.lit(1)).alias("_n"))
    lines = F.array_compact(
        F.array(
            F.when(reason.isNotNull(), F.struct(reason.alias("line"), F.col("_n").alias("n"))),
            F.struct(
                F.when(reason.isNull(), "Total kept").otherwise("Total skipped").alias("line"),
                F.col("_n").alias("n"),
            ),
        )
    )
    return counts.select(F.inline(lines)).groupBy("line").agg(F.sum("n").alias("rows"))


def overlong_listing(reasons: DataFrame, *keep: str, n: int = 100) -> DataFrame:
    """The over-long articles with their full length and first n characters."""
    return reasons.where(F.col("skip_reason") == "too_long_article").select(
        *keep, F.length("text").alias("length"), preview(F.col("text"), n).alias("preview")
    )


def window_yield(df: DataFrame, keys: Sequence[str], kept: Column) -> DataFrame:
    """Rows fetched and rows kept per time window or thread."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(kept).alias("kept")
    )


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows per split, per label, per both and in all; ``ALL`` stands for a subtotal."""
    return (
        df.cube("split", "label")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.grouping("split").alias("_s"),
            F.grouping("label").alias("_l"),
        )
        .select(
            F.when(F.col("_s") == 1, "ALL").otherwise(F.col("split")).alias("split"),
            F.when(F.col("_l") == 1, "ALL").otherwise(F.col("label")).alias("label"),
            "rows",
        )
    )


def balance_check(
    df: DataFrame,
    max_share: float = fixed.MAX_LABEL_SHARE,
    min_rows: int = fixed.MIN_LABEL_ROWS,
    labels: Sequence[str] = fixed.LABELS,
) -> DataFrame:
    """Share of each label and whether it is too large or too rare; absent labels count 0."""
    counters = [F.count_if(F.col("label") == name).alias(f"n_{i}") for i, name in enumerate(labels)]
    total = sum((F.col(f"n_{i}") for i in range(1, len(labels))), F.col("n_0"))
    share = [F.coalesce(F.try_divide(F.col(f"n_{i}"), total), F.lit(0.0)) for i in range(len(labels))]
    rows = [
        F.struct(
            F.lit(name).alias("label"),
            F.col(f"n_{i}").alias("rows"),
            F.round(share[i], 4).alias("share"),
            (share[i] > max_share).alias("too_large"),
            (F.col(f"n_{i}") < min_rows).alias("too_rare"),
        )
        for i, name in enumerate(labels)
    ]
    return df.agg(*counters).select(F.inline(F.array(*rows)))


def first_errors(
    errors: DataFrame, n: int = fixed.FIRST_ERRORS, order: Sequence[str] = ("ordinal",)
) -> DataFrame:
    """The first n wrong rows with text, truth, prediction and confidence.

    The texts are cut to what is shown before any row moves.
    """
    shown = errors.select(
        *order,
        preview(F.col("text"), 200, ellipsis=True).alias("text"),
        "label",
        "predicted",
        F.round("confidence", 2).alias("confidence"),
    )
    return first_rows(shown, [F.col(c) for c in order], n, order)


def sample_report(scored: DataFrame, *keep: str, n: int = 80) -> DataFrame:
    """Listed posts with truth, prediction, confidence and whether they agree."""
    return scored.select(
        *keep,
        preview(F.col("text"), n).alias("text"),
        "label",
        "predicted",
        F.round("confidence", 4).alias("confidence"),
        (F.col("predicted") == F.col("label")).alias("correct"),
    )
