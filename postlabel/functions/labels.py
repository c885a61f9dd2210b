"""Label encoding and the parsing of free-form model answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.text import strip_ws


def _literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs)])


def encode_label(col: Column, label_map: Mapping[str, int] = fixed.LABEL_MAP) -> Column:
    """Label name to id; an unknown label gives null."""
    return F.try_element_at(_literal_map(label_map.items()), col)


def decode_label(col: Column, label_map: Mapping[str, int] = fixed.LABEL_MAP) -> Column:
    return F.try_element_at(_literal_map((i, name) for name, i in label_map.items()), col)


def parse_response(col: Column, labels: Sequence[str] = fixed.LABELS) -> Column:
    """The label an answer names, or null.

    Longer labels are tried first, so that a label that is part of another cannot win;
    equal lengths keep the order of ``labels``.
    """
    answer = F.lower(strip_ws(col))
    by_length = sorted(labels, key=lambda name: -len(name))
    return F.coalesce(*[F.when(answer.contains(name), F.lit(name)) for name in by_length])
