"""Evaluation: every metric comes from one small matrix of counts.

``matrix_row`` scans the predictions once, with partial counts, and yields one row
holding the L x L counts (rows = truth). Reports, gates and agreement are arithmetic on
that row, so they add no scan, join or shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.labels import encode_label
from postlabel.session import cut_lineage


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _sum(values: Column, zero) -> Column:
    return F.aggregate(values, zero, lambda acc, x: acc + x)


def _total(values: Column) -> Column:
    return _sum(values, F.lit(0).cast("bigint"))


def _column(matrix: Column, i: int) -> Column:
    return F.transform(matrix, lambda row: F.get(row, F.lit(i)))


def _names(labels: Sequence[str]) -> Column:
    return F.array(*[F.lit(name) for name in labels])


# --- joins --------------------------------------------------------------------


def one_prediction(pred: DataFrame, id_col: str = "ex_id", order: Sequence[str] = ()) -> DataFrame:
    """(id, label): of several predictions of an id the first by ``order``, then by label.

    Tasks cut them to one per id before the shuffle on the id, which the join after it uses too.
    """
    first = F.min(F.struct(*order, F.col("label").isNull().alias("_none"), "label"))
    return pred.groupBy(id_col).agg(first.alias("_first")).select(id_col, "_first.label")


def align(pred: DataFrame, truth: DataFrame, id_col: str = "ex_id", order: Sequence[str] = ()) -> DataFrame:
    """(id, label, predicted) for every true row; predicted is null where none was made.

    True ids are unique; of several predictions one counts (``one_prediction``), so no row is
    multiplied.
    """
    made = one_prediction(pred, id_col, order).withColumnRenamed("label", "predicted")
    return truth.select(id_col, "label").join(made, id_col, "left")


def wrong_predictions(df: DataFrame) -> DataFrame:
    return df.where(F.col("predicted") != F.col("label"))


def parseable(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull())


def attach_text(errors: DataFrame, texts: DataFrame, id_col: str = "ex_id") -> DataFrame:
    return errors.join(texts.select(id_col, "text"), id_col)


def compare_models(
    pred_a: DataFrame,
    pred_b: DataFrame,
    truth: DataFrame,
    id_col: str = "ex_id",
    order: Sequence[str] = (),
) -> DataFrame:
    """(id, label, predicted_a, predicted_b) on the same rows, all of the truth kept once."""
    a = one_prediction(pred_a, id_col, order).withColumnRenamed("label", "predicted_a")
    b = one_prediction(pred_b, id_col, order).withColumnRenamed("label", "predicted_b")
    return truth.select(id_col, "label").join(a, id_col, "left").join(b, id_col, "left")


def disagreements(compared: DataFrame) -> DataFrame:
    """Rows that only one of two models gets right, from ``compare_models``, and which (a or b)."""
    right_a, right_b = (
        F.coalesce(F.col(c) == F.col("label"), F.lit(False)) for c in ("predicted_a", "predicted_b")
    )
    return compared.where(right_a != right_b).withColumn("right", F.when(right_a, "a").otherwise("b"))


# --- the matrix ---------------------------------------------------------------


def matrix_row(
    df: DataFrame,
    labels: Sequence[str] = fixed.LABELS,
    truth: str = "label",
    predicted: str = "predicted",
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row: ``m``, the dense counts by truth and prediction, zeros included.

    Rows with a null or unknown label on either side are not counted in ``m``. ``totals``
    are sums over all rows, taken in the same pass.
    """
    totals = dict(totals or {})
    size = len(labels)
    ids = {name: i for i, name in enumerate(labels)}
    cell = encode_label(F.col(truth), ids) * size + encode_label(F.col(predicted), ids)
    counts = (
        df.select(cell.alias("cell"), *[c.alias(name) for name, c in totals.items()])
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.sum(name).alias(name) for name in totals])
    )
    # At most L x L entries; collect_list leaves the null out.
    entry = F.when(F.col("cell").isNotNull(), F.struct("cell", "rows"))
    by_cell = F.map_from_entries(F.collect_list(entry))
    dense = F.array(
        *[
            F.array(
                *[
                    F.coalesce(
                        F.try_element_at(F.col("by_cell"), F.lit(t * size + p)),
                        F.lit(0).cast("bigint"),
                    )
                    for p in range(size)
                ]
            )
            for t in range(size)
        ]
    )
    return counts.agg(
        by_cell.alias("by_cell"), *[F.sum(name).alias(name) for name in totals]
    ).select(dense.alias("m"), *totals)


def confusion_matrix(df: DataFrame, labels: Sequence[str] = fixed.LABELS, **names) -> DataFrame:
    """Long form: (label, predicted, rows), one row per cell."""
    row = matrix_row(df, labels, **names).select(F.posexplode("m").alias("_t", "_row"))
    cell = row.select("_t", F.posexplode("_row").alias("_p", "rows"))
    return cell.select(
        F.get(_names(labels), F.col("_t")).alias("label"),
        F.get(_names(labels), F.col("_p")).alias("predicted"),
        "rows",
    )


def confusion_matrix_wide(
    df: DataFrame, labels: Sequence[str] = fixed.LABELS, **names
) -> DataFrame:
    """One row per true label, one column per predicted label."""
    row = matrix_row(df, labels, **names).select(F.posexplode("m").alias("_t", "_row"))
    return row.select(
        F.get(_names(labels), F.col("_t")).alias("label"),
        *[F.get("_row", F.lit(i)).alias(name) for i, name in enumerate(labels)],
    )


def _class_scores(m: Column, labels: Sequence[str]) -> Column:
    """Unrounded scores per class, as an array of structs, from an L x L matrix."""
    classes = []
    for i, name in enumerate(labels):
        hit = F.get(F.get(m, F.lit(i)), F.lit(i))
        support = _total(F.get(m, F.lit(i)))
        predicted = _total(_column(m, i))
        classes.append(
            F.struct(
                F.lit(name).alias("label"),
                ratio(hit, predicted).alias("precision"),
                ratio(hit, support).alias("recall"),
                # 2PR / (P + R), written so that it is one division of counts.
                ratio(2 * hit, predicted + support).alias("f1"),
                support.alias("support"),
                predicted.alias("predicted"),
            )
        )
    return F.array(*classes)


def _diagonal(m: Column, size: int) -> Column:
    return sum(
        (F.get(F.get(m, F.lit(i)), F.lit(i)) for i in range(1, size)),
        F.get(F.get(m, F.lit(0)), F.lit(0)),
    )


def _scores_row(df: DataFrame, labels: Sequence[str], **names) -> DataFrame:
    """One row: total, accuracy and per-class scores, unrounded."""
    m = F.col("m")
    return (
        matrix_row(df, labels, **names)
        .select(
            _class_scores(m, labels).alias("classes"),
            _diagonal(m, len(labels)).alias("hits"),
            _total(F.transform(m, _total)).alias("rows"),
        )
        .withColumn("accuracy", ratio(F.col("hits"), F.col("rows")))
    )


def paired_row(
    compared: DataFrame,
    labels: Sequence[str] = fixed.LABELS,
    truth: str = "label",
    a: str = "predicted_a",
    b: str = "predicted_b",
) -> DataFrame:
    """One row about two models on the same rows, from one scan with partial counts.

    Rows are counted by truth, answer of a and answer of b, where an answer may also be none
    (null) or a label that is not in ``labels``. From that come, for each model, ``classes_x``
    (scores per class over the rows it gave a known label), ``hits_x``, ``known_x`` (rows with a
    known label), ``made_x`` (rows with any answer) and ``macro_x``; then how many rows both,
    only one or neither gets right. ``rows`` counts all, those of unknown truth too, which
    count nowhere else.
    """
    size, wide = len(labels), len(labels) + 2
    ids = {name: i for i, name in enumerate(labels)}

    def place(column: str) -> Column:
        known = F.coalesce(encode_label(F.col(column), ids), F.lit(size + 1))
        return F.when(F.col(column).isNull(), F.lit(size)).otherwise(known)

    cell = (encode_label(F.col(truth), ids) * wide + place(a)) * wide + place(b)
    counts = compared.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    # At most L x (L + 2) x (L + 2) entries; collect_list leaves the null out.
    entry = F.when(F.col("cell").isNotNull(), F.struct("cell", "rows"))
    everything = counts.agg(
        F.map_from_entries(F.collect_list(entry)).alias("cells"), F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("rows")
    )

    def count(t: int, x: int, y: int) -> Column:
        found = F.try_element_at(F.col("cells"), F.lit((t * wide + x) * wide + y))
        return F.coalesce(found, F.lit(0).cast("bigint"))

    def added(parts) -> Column:
        first, *rest = parts
        return sum(rest, first)

    every = range(wide)
    by_a = [[added(count(t, x, y) for y in every) for x in every] for t in range(size)]
    by_b = [[added(count(t, x, y) for x in every) for y in every] for t in range(size)]
    both = added(count(t, t, t) for t in range(size))
    columns = []
    for name, table in (("a", by_a), ("b", by_b)):
        m = F.array(*[F.array(*row[:size]) for row in table])
        made = added(row[x] for row in table for x in every if x != size)
        columns += [m.alias(f"m_{name}"), made.alias(f"made_{name}")]
    known = added(row[x] for row in by_a for x in every)
    counted = everything.select("rows", both.alias("both_right"), known.alias("_known"), *columns)
    for name in "ab":
        m = F.col(f"m_{name}")
        counted = (
            counted.withColumn(f"classes_{name}", _class_scores(m, labels))
            .withColumn(f"hits_{name}", _diagonal(m, size))
            .withColumn(f"known_{name}", _total(F.transform(m, _total)))
            .withColumn(f"macro_{name}", _mean(F.col(f"classes_{name}"), "f1", size))
        )
    only_a, only_b = F.col("hits_a") - F.col("both_right"), F.col("hits_b") - F.col("both_right")
    neither = F.col("_known") - F.col("hits_a") - F.col("hits_b") + F.col("both_right")
    return counted.select(
        "*", only_a.alias("only_a_right"), only_b.alias("only_b_right"), neither.alias("neither_right")
    ).drop("_known")


def _mean(classes: Column, field: str, size: int) -> Column:
    return _sum(F.transform(classes, lambda c: c[field]), F.lit(0.0)) / F.lit(float(size))


def _weighted(classes: Column, field: str, rows: Column) -> Column:
    return ratio(
        _sum(F.transform(classes, lambda c: c[field] * c["support"]), F.lit(0.0)), rows
    )


def _report_entry(name: str, precision: Column, recall: Column, f1: Column, support: Column):
    return F.struct(
        F.lit(name).alias("label"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        support.alias("support"),
    )


def class_report(df: DataFrame, labels: Sequence[str] = fixed.LABELS, **names) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    Means are taken of unrounded values; a division by zero gives 0. In the accuracy row
    all three scores are the accuracy.
    """
    classes, rows, size = F.col("classes"), F.col("rows"), len(labels)
    per_class = F.transform(
        classes,
        lambda c: F.struct(
            c["label"].alias("label"),
            F.round(c["precision"], 4).alias("precision"),
            F.round(c["recall"], 4).alias("recall"),
            F.round(c["f1"], 4).alias("f1"),
            c["support"].alias("support"),
        ),
    )
    accuracy = F.col("accuracy")
    fields = ("precision", "recall", "f1")
    means = F.array(
        _report_entry("accuracy", accuracy, accuracy, accuracy, rows),
        _report_entry("macro avg", *[_mean(classes, f, size) for f in fields], rows),
        _report_entry("weighted avg", *[_weighted(classes, f, rows) for f in fields], rows),
    )
    return _scores_row(df, labels, **names).select(F.inline(F.concat(per_class, means)))


def accuracy(df: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """Right rows, evaluated rows and their ratio; rows without a prediction are left out."""
    made = df.where(F.col(predicted).isNotNull())
    hits = F.count_if(F.col(predicted) == F.col(truth))
    rows = F.count(F.lit(1))
    return made.agg(
        hits.alias("hits"), rows.alias("rows"), F.round(ratio(hits, rows), 4).alias("accuracy")
    )


def parse_coverage(df: DataFrame, predicted: str = "predicted") -> DataFrame:
    """How many answers named no label, and the share that did."""
    rows, made = F.count(F.lit(1)), F.count(predicted)
    return df.agg(
        rows.alias("rows"),
        made.alias("evaluated"),
        (rows - made).alias("unparsed"),
        F.round(ratio(made, rows), 4).alias("coverage"),
    )


def model_comparison(
    compared: DataFrame,
    model: str,
    label_map: Mapping[str, int] = fixed.LABEL_MAP,
) -> DataFrame:
    """The results record of two models on one test set, from ``compare_models``.

    Each accuracy is over the rows its model answered; both counts are given, because
    they can differ. Macro F1 is that of ``class_report``. All of it comes from one scan.
    """
    gain = F.col("_b") - F.col("_a")
    pairs = F.create_map(*[F.lit(x) for pair in label_map.items() for x in pair])
    return (
        paired_row(compared, tuple(label_map))
        .withColumn("_a", ratio(F.col("hits_a"), F.col("made_a")))
        .withColumn("_b", ratio(F.col("hits_b"), F.col("made_b")))
        .select(
            F.round("_a", 4).alias("baseline_accuracy"),
            F.round("_b", 4).alias("finetuned_accuracy"),
            F.round(gain, 4).alias("improvement"),
            F.when(gain >= 0, "improvement").otherwise("regression").alias("direction"),
            F.round("macro_a", 4).alias("baseline_macro_f1"),
            F.round("macro_b", 4).alias("finetuned_macro_f1"),
            F.round(F.col("macro_b") - F.col("macro_a"), 4).alias("macro_f1_improvement"),
            "both_right",
            F.col("only_a_right").alias("only_baseline_right"),
            F.col("only_b_right").alias("only_finetuned_right"),
            "neither_right",
            F.col("rows").alias("test_set_size"),
            F.col("made_a").alias("baseline_evaluated"),
            F.col("made_b").alias("finetuned_evaluated"),
            pairs.alias("label_map"),
            F.lit(model).alias("model"),
        )
    )


def paired_report(compared: DataFrame, labels: Sequence[str] = fixed.LABELS) -> DataFrame:
    """Scores per class of two models side by side, and which is ahead, from one scan."""
    a, b = F.col("_x.classes_a"), F.col("_x.classes_b")
    fields = ("precision", "recall", "f1")
    row = paired_row(compared, labels).select(F.explode(F.arrays_zip("classes_a", "classes_b")).alias("_x"))
    return row.select(
        a["label"].alias("label"),
        *[F.round(side[f], 4).alias(f"{f}_{name}") for name, side in (("a", a), ("b", b)) for f in fields],
        F.round(b["f1"] - a["f1"], 4).alias("f1_gain"),
        a["support"].alias("support_a"),
        b["support"].alias("support_b"),
    )


# --- errors -------------------------------------------------------------------


def error_pairs(df: DataFrame) -> DataFrame:
    """Wrong rows by (truth, prediction) with their share of all errors.

    The window runs over the pairs, of which there are fewer than L x L.
    """
    pairs = wrong_predictions(df).groupBy("label", "predicted")
    everything = Window.partitionBy()
    return pairs.agg(F.count(F.lit(1)).alias("errors")).select(
        "label",
        "predicted",
        "errors",
        F.round(F.col("errors") / F.sum("errors").over(everything), 4).alias("share"),
    )


def error_slices(
    df: DataFrame,
    slices: Mapping[str, Column],
    minimum: int = fixed.MIN_PATTERN_ERRORS,
) -> DataFrame:
    """Named patterns with at least ``minimum`` wrong rows.

    All patterns are counted in one pass, and only their counts are shuffled.
    """
    wrong = F.col("predicted") != F.col("label")
    counts = []
    for i, condition in enumerate(slices.values()):
        counts.append(F.count_if(wrong & condition).alias(f"wrong_{i}"))
        counts.append(F.count_if(condition).alias(f"rows_{i}"))
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("slice"),
                F.col(f"wrong_{i}").alias("errors"),
                F.col(f"rows_{i}").alias("rows"),
            )
            for i, name in enumerate(slices)
        ]
    )
    evaluated = df.where(F.col("predicted").isNotNull())
    return (
        evaluated.agg(*counts)
        .select(F.inline(entries))
        .where(F.col("errors") >= minimum)
        .withColumn("error_rate", F.round(ratio(F.col("errors"), F.col("rows")), 4))
    )


def error_patterns(
    errors: DataFrame,
    slices: Mapping[str, Column],
    minimum: int = fixed.MIN_PATTERN_ERRORS,
) -> DataFrame:
    """Each confused pair with at least ``minimum`` errors, and how many are in each slice."""
    return (
        errors.groupBy("label", "predicted")
        .agg(
            F.count(F.lit(1)).alias("errors"),
            *[F.count_if(condition).alias(name) for name, condition in slices.items()],
        )
        .where(F.col("errors") >= minimum)
    )


def find_error_patterns(
    df: DataFrame,
    traits: Mapping[str, Column],
    minimum: int = fixed.MIN_PATTERN_ERRORS,
    most: int = 3,
) -> DataFrame:
    """Which traits wrong rows have in common: every set of up to three with ``minimum`` errors.

    (pattern, traits, errors, right_rows, error_rate, lift): the sets are found by frequent
    pattern growth over the traits of wrong rows; ``lift`` is the set's error rate over that of
    all rows that have a prediction. For the right rows, rows are first counted by their whole
    set of traits, as a bit set, and only these few are taken apart. At most 63 traits.
    """
    if not 1 <= most <= 3 or len(traits) > 63:
        raise ValueError("sets of one to three out of 63 traits")
    names = list(traits)
    zero = F.lit(0).cast("bigint")
    mask = zero
    for i, condition in enumerate(traits.values()):
        mask = mask.bitwiseOR(F.when(condition, F.lit(1 << i).cast("bigint")).otherwise(zero))
    wrong = F.col("predicted") != F.col("label")
    made = df.where(F.col("predicted").isNotNull() & F.col("label").isNotNull())
    masks = cut_lineage(
        made.select(mask.alias("mask"), wrong.alias("wrong")).groupBy("mask", "wrong").agg(F.count(F.lit(1)).alias("rows"))
    )
    total = masks.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("wrong"), F.col("rows"))), F.lit(0)).alias("errors"),
    ).first()
    bits = F.array(*[F.lit(1 << i).cast("bigint") for i in range(len(names))])
    own = F.filter(bits, lambda b: F.col("mask").bitwiseAND(b) != 0)
    sets = _frequent_sets(masks.where("wrong").select("rows", own.alias("items")), minimum, total["errors"], most)
    named = F.array(*[F.lit(name) for name in names])
    right = masks.where("NOT wrong").select("rows", F.explode(_subsets(own, most)).alias("set"))
    right = right.groupBy("set").agg(F.sum("rows").alias("right_rows"))
    held = F.zip_with(bits, named, lambda b, name: F.when(F.col("set").bitwiseAND(b) != 0, name))
    rows = F.col("errors") + F.col("right_rows")
    rate = F.col("errors") / rows
    return (
        sets.join(right, "set", "left")
        .withColumn("right_rows", F.coalesce("right_rows", F.lit(0).cast("bigint")))
        .select(
            F.array_join(F.array_compact(held), " & ").alias("pattern"),
            F.bit_count("set").alias("traits"),
            "errors",
            "right_rows",
            F.round(rate, 4).alias("error_rate"),
            F.round(rate / F.lit(total["errors"] / max(total["rows"], 1)), 4).alias("lift"),
        )
    )


def _frequent_sets(masks: DataFrame, minimum: int, errors: int, most: int) -> DataFrame:
    """(set, errors) of sets of items that ``minimum`` of the rows hold, by frequent pattern growth.

    Equal rows count by their number: a row with its whole set stands for each of them.
    """
    each = masks.select("items", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy"))
    # A hair below the share, so that a share of exactly ``minimum`` rows is not lost to rounding.
    share = min(1.0, (minimum - 0.5) / max(errors, 1))
    grown = FPGrowth(itemsCol="items", minSupport=share).fit(each.select("items")).freqItemsets
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return grown.where(F.size("items") <= most).select(total.alias("set"), F.col("freq").alias("errors"))


def _subsets(bits: Column, most: int) -> Column:
    """Sums of up to ``most`` different elements of a rising array of powers of two."""
    above = lambda low: F.filter(bits, lambda b: b > low)
    out = [bits]
    if most > 1:
        out.append(F.flatten(F.transform(bits, lambda a: F.transform(above(a), lambda b: a + b))))
    if most > 2:
        triples = F.transform(
            bits, lambda a: F.flatten(F.transform(above(a), lambda b: F.transform(above(b), lambda c: a + b + c)))
        )
        out.append(F.flatten(triples))
    return F.concat(*out)


# --- gates and baselines ------------------------------------------------------


def success_gates(
    df: DataFrame,
    baseline: str | None = None,
    labels: Sequence[str] = fixed.LABELS,
    truth: str = "label",
    predicted: str = "predicted",
) -> DataFrame:
    """(gate, tier, threshold, achieved, met) for the stated success thresholds.

    Accuracy, F1 and gain have a minimum and a target. Comparisons are strict and of unrounded
    values. The gains are over the column ``baseline``: in accuracy, on the rows it answered,
    and in macro F1, where the model need only be better. ``suspicious`` is met when raised.
    """
    size, classes = len(labels), F.col("classes")
    macro = _mean(classes, "f1", size)
    lowest = F.array_min(F.transform(classes, lambda c: c["f1"]))

    def gate(name, threshold, achieved, met=None, tier="minimum"):
        return F.struct(
            F.lit(name).alias("gate"),
            F.lit(tier).alias("tier"),
            F.lit(threshold).alias("threshold"),
            F.round(achieved, 4).alias("achieved"),
            (achieved > F.lit(threshold) if met is None else met).alias("met"),
        )

    def tiers(name, minimum, target, achieved):
        return [gate(name, minimum, achieved), gate(name, target, achieved, tier="target")]

    gates = tiers("accuracy", fixed.GATE_ACCURACY, fixed.TARGET_ACCURACY, F.col("accuracy"))
    for i, name in enumerate(labels):
        f1 = F.get(classes, F.lit(i))["f1"]
        gates += tiers(f"f1 {name}", fixed.GATE_CLASS_F1, fixed.TARGET_CLASS_F1, f1)
    gates += tiers("macro f1", fixed.GATE_MACRO_F1, fixed.TARGET_MACRO_F1, macro)
    if baseline is None:
        row = _scores_row(df, labels, truth=truth, predicted=predicted)
    else:
        row = (
            paired_row(df, labels, truth, baseline, predicted)
            .withColumn("classes", F.col("classes_b"))
            .withColumn("accuracy", ratio(F.col("hits_b"), F.col("known_b")))
        )
        gain = F.col("accuracy") - ratio(F.col("hits_a"), F.col("made_a"))
        gates += tiers("gain", fixed.GATE_GAIN, fixed.TARGET_GAIN, gain)
        gates.append(gate("macro f1 gain", fixed.GATE_MACRO_GAIN, macro - F.col("macro_a")))
    deployable = (macro >= fixed.DEPLOY_MACRO_F1) & (lowest >= fixed.DEPLOY_CLASS_F1)
    gates.append(gate("deployable", fixed.DEPLOY_MACRO_F1, macro, deployable, "verdict"))
    gates.append(gate("suspicious", fixed.SUSPICIOUS_ACCURACY, F.col("accuracy"), tier="verdict"))
    return row.select(F.inline(F.array(*gates)))


def majority_baseline(
    train: DataFrame, test: DataFrame, labels: Sequence[str] = fixed.LABELS
) -> DataFrame:
    """Accuracy on test of always answering train's most frequent label, and chance.

    Only counts per label meet; equal counts go to the first label in the alphabet.
    """
    both = train.select("label", F.lit(True).alias("_train")).unionByName(
        test.select("label", F.lit(False).alias("_train"))
    )
    per_label = both.groupBy("label").agg(
        F.count_if(F.col("_train")).alias("train_rows"),
        F.count_if(~F.col("_train")).alias("test_rows"),
    )
    first = F.min(F.struct((-F.col("train_rows")).alias("order"), "label", "test_rows"))
    best = per_label.agg(first.alias("best"), F.sum("test_rows").alias("rows"))
    return best.select(
        F.col("best.label").alias("majority_label"),
        F.col("best.test_rows").alias("hits"),
        "rows",
        F.round(ratio(F.col("best.test_rows"), F.col("rows")), 4).alias("accuracy"),
        F.round(F.lit(1.0 / len(labels)), 4).alias("chance"),
    )


# --- agreement and calibration ------------------------------------------------


def cohen_kappa(
    df: DataFrame, labels: Sequence[str] = fixed.LABELS, a: str = "label", b: str = "predicted"
) -> DataFrame:
    """Agreement of two label columns beyond chance; 0 where chance agreement is total."""
    classes = F.col("classes")
    expected = ratio(
        _sum(
            F.transform(
                classes, lambda c: c["support"].cast("double") * c["predicted"].cast("double")
            ),
            F.lit(0.0),
        ),
        F.col("rows").cast("double") * F.col("rows").cast("double"),
    )
    return (
        _scores_row(df, labels, truth=a, predicted=b)
        .select("rows", F.col("accuracy").alias("_observed"), expected.alias("_expected"))
        .select(
            "rows",
            F.round("_observed", 4).alias("observed"),
            F.round("_expected", 4).alias("expected"),
            F.round(
                ratio(F.col("_observed") - F.col("_expected"), 1 - F.col("_expected")), 4
            ).alias("kappa"),
        )
    )


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Rows, accuracy and mean confidence per confidence bin; 1.0 belongs to the last bin."""
    number = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    hits, rows = F.count_if(F.col("predicted") == F.col("label")), F.count(F.lit(1))
    return (
        df.withColumn("bin", number)
        .groupBy("bin")
        .agg(
            rows.alias("rows"),
            F.round(ratio(hits, rows), 4).alias("accuracy"),
            F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        )
    )
