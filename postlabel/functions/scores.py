"""Score vectors: softmax, argmax and the prediction record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlabel import fixed


def softmax(scores: Column) -> Column:
    """exp(x - max) / sum, so that large scores do not overflow."""
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda p: p / total)


def argmax(scores: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def score_struct(probabilities: Column, labels: Sequence[str] = fixed.LABELS) -> Column:
    """(predicted_label, confidence, all_scores), rounded to four decimals."""
    names = F.array(*[F.lit(name) for name in labels])
    rounded = F.transform(probabilities, lambda p: F.round(p, 4))
    return F.struct(
        F.get(names, argmax(probabilities)).alias("predicted_label"),
        F.array_max(rounded).alias("confidence"),
        F.map_from_arrays(names, rounded).alias("all_scores"),
    )
