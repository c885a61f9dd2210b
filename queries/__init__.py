"""Registered queries: each Spark function stands next to the SQL it must agree with."""

from . import collecting, corpora, evaluation, files, learning, rules, streams, texts
from .base import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "collecting", "corpora", "evaluation", "files", "learning", "rules",
    "streams", "texts",
]
