"""Line dedup by a log-template tree over all documents.

A line is a list of tokens. Tokens with a digit are variable from the start. The tree has
fixed depth: the number of tokens, then the first ``depth`` tokens; its leaves hold
templates. In a leaf, lines are taken from the most frequent to the least; a line joins the
template with which it shares most tokens, if these are at least ``percent`` of all, and the
fields in which it differs become variable. Otherwise it starts a template.

A template found in ``min_docs`` documents or more is recurring. One with ``LONG_TOKENS``
fixed tokens or more does not repeat by chance and is recurring from ``LONG_DOCS`` documents
on, if their texts differ (whole copies are left to dedup of documents). Lines of recurring
templates are dropped from all documents but the one with the smallest id, so that one copy
of each wording stays.

A leaf seen in fewer documents cannot hold a recurring template, so only lines of common
leaves are gathered, each distinct wording once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise, order_id, own_id, read
from .vector import U, lookup, mix, prefix_hash, span_hash, text_chunks, word_bounds

DEPTH = 3
PERCENT = 80
MIN_DOCS = 10
LONG_TOKENS = 20
LONG_DOCS = 2

_DIGIT = lookup(range(48, 58))
_VARIABLE = U(0x2A)
_BASE = U(0x9FB21C651E98DF25)


def parsed_lines(data: np.ndarray, offs: np.ndarray, depth: int):
    """Document, line number, leaf, first token and end token of every line with tokens; token hashes."""
    starts, ends, first = word_bounds(data, offs)
    sums, inverse = prefix_hash(data)
    tokens = span_hash(sums, inverse, starts, ends)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_DIGIT[data], out=digits[1:])
    tokens[digits[ends] > digits[starts]] = _VARIABLE
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    line = breaks[starts] - breaks[offs[doc]] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts))
    leaf = (tail - head).astype(U)
    for i in range(depth):
        at = np.minimum(head + i, len(starts) - 1)
        leaf = mix(leaf * _BASE + np.where(head + i < tail, tokens[at], U(1)))
    return doc[head], line[head], leaf, head, tail, tokens


def _leaves(depth: int):
    """Maps texts to leaves, each with its number of documents in the batch and whether its lines are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [np.empty(0, U)], [np.empty(0, int)]
            for _, _, data, offs in text_chunks(batch.column("text")):
                doc, _, leaf, head, tail, _ = parsed_lines(data, offs, depth)
                order = np.lexsort((doc, leaf))
                doc, leaf, size = doc[order], leaf[order], (tail - head)[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (leaf[1:] != leaf[:-1])
                found.append(leaf[new])
                sizes.append(size[new])
            leaf, at, count = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            long = np.concatenate(sizes)[at] >= LONG_TOKENS
            yield pa.RecordBatch.from_arrays([pa.array(leaf.view(np.int64)), pa.array(count, pa.int64()), pa.array(long)], names=["leaf", "n", "long"])

    return run


def _lines(depth: int):
    """Maps (doc, fp, text) to its lines, tokens packed in four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            for row, _, data, offs in text_chunks(batch.column("text")):
                doc, line, leaf, head, tail, tokens = parsed_lines(data, offs, depth)
                if not len(doc):
                    continue
                places = np.append(head, tail[-1:]) * 4
                packed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(doc), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer((tokens >> U(32)).astype("<u4"))]
                ).cast(pa.binary())
                arrays = [pa.array(leaf.view(np.int64)), packed, pa.array(docs[row + doc]), pa.array(prints[row + doc]), pa.array(line, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["leaf", "tokens", "doc", "fp", "line"])

    return run


class Leaf:
    """The templates of one leaf, in the order in which they began."""

    def __init__(self, length: int, percent: int):
        self.need = -(-length * percent // 100)
        self.templates = np.empty((4, length), np.uint32)
        self.fixed = np.empty((4, length), bool)
        self.n = 0

    def place(self, tokens: np.ndarray) -> int:
        same = (self.templates[: self.n] == tokens) & self.fixed[: self.n]
        shared = same.sum(axis=1)
        best = int(shared.argmax()) if self.n else 0
        if self.n and shared[best] >= self.need:
            self.fixed[best] &= same[best]
            return best
        if self.n == len(self.templates):
            self.templates = np.concatenate([self.templates, np.empty_like(self.templates)])
            self.fixed = np.concatenate([self.fixed, np.empty_like(self.fixed)])
        self.templates[self.n], self.fixed[self.n] = tokens, True
        self.n += 1
        return self.n - 1


def _templates(percent: int):
    """Maps (leaf, tokens), sorted by leaf, to template numbers; holds one leaf's templates at a time.

    ``fixed`` is the number of the template's fixed tokens with this line in it; its last line's is the least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaf = None, None
        for batch in batches:
            numbers, fixed = [], []
            for key, packed in zip(batch.column("leaf").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = np.frombuffer(packed, "<u4")
                if key != now or leaf.templates.shape[1] != len(tokens):
                    now, leaf = key, Leaf(len(tokens), percent)
                numbers.append(leaf.place(tokens))
                fixed.append(int((leaf.fixed[numbers[-1]] & (tokens != 0)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("leaf"), batch.column("tokens"), pa.array(numbers, pa.int64()), pa.array(fixed, pa.int64())],
                names=["leaf", "tokens", "template", "fixed"],
            )

    return run


def recurring_lines(texts: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, percent: int = PERCENT) -> DataFrame:
    """(doc, fp, line) of all lines to drop, from texts (doc, fp, text)."""
    leaves = texts.mapInArrow(_leaves(depth), "leaf long, n long, long boolean").groupBy("leaf").agg(F.sum("n").alias("n"), F.max("long").alias("long"))
    common = leaves.where((F.col("n") >= min_docs) | (F.col("long") & (F.col("n") >= LONG_DOCS)))
    lines = texts.mapInArrow(_lines(depth), "leaf long, tokens binary, doc long, fp long, line long")
    lines = materialise(lines.join(common.select("leaf"), "leaf"), "lines")
    wordings = lines.groupBy("leaf", "tokens").agg(F.count("*").alias("n"))
    sorted_ = wordings.repartition("leaf").sortWithinPartitions("leaf", F.length("tokens"), F.desc("n"), "tokens").select("leaf", "tokens")
    placed = materialise(sorted_.mapInArrow(_templates(percent), "leaf long, tokens binary, template long, fixed long"), "templates")
    held = lines.join(placed, ["leaf", "tokens"]).select("leaf", F.length("tokens").alias("size"), "template", "fixed", "doc", "fp", "line")
    key = ["leaf", "size", "template"]
    each = held.groupBy(*key, "doc", "fp").agg(F.min("fixed").alias("fixed"))
    found = each.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("doc").alias("first"), F.min("fixed").alias("fixed"), (F.min("fp") < F.max("fp")).alias("differ")
    )
    long = (F.col("fixed") >= LONG_TOKENS) & (F.col("n") >= LONG_DOCS) & F.col("differ")
    recurring = found.where((F.col("n") >= min_docs) | long).select(*key, "first")
    return held.join(recurring, key).where(F.col("doc") > F.col("first")).select("doc", "fp", "line")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            counts.append(sum(1 for x in lines if x.strip(" \t\n\x0b\x0c\r")))
            if drop:
                gone = set(drop)
                text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            texts.append(text)
        drops = batch.column("drop").value_lengths().fill_null(0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), drops], names=["row", "kept_text", "n_lines", "n_dropped"]
        )


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, percent: int = PERCENT) -> DataFrame:
    """Drops the lines of recurring templates from documents.

    Returns row (a struct of all columns of the document, whatever their names), kept_text,
    n_lines (with tokens) and n_dropped. Lines are parted by newlines; those without tokens
    belong to no template and stay. Null and empty texts come back as they are. Rows that share
    an id are different documents if their texts differ, but never lose lines to each other. A
    null id counts as the largest. No rows give none.
    """
    keyed = docs.select(order_id().alias("doc"), F.struct("*").alias("row"), "text").withColumn("fp", F.crc32(F.coalesce("text", F.lit(""))))
    texts = keyed.select("doc", "fp", "text")
    drops = recurring_lines(texts, min_docs, depth, percent).groupBy("doc", "fp").agg(F.collect_set("line").alias("drop"))
    joined = keyed.join(drops, ["doc", "fp"], "left").select("row", "text", "drop")
    row = docs.select(F.struct("*").alias("row")).schema["row"]
    schema = joined.select("row", F.col("text").alias("kept_text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    schema["row"].dataType = row.dataType
    for field in schema:
        field.nullable = True
    return joined.mapInArrow(_rewrite, schema)


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: lines, lines dropped, what remains, and whether any word remains."""
    done = drop_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
        ((F.col("n_lines") == 0) | (F.col("n_dropped") < F.col("n_lines"))).alias("kept"),
    )
