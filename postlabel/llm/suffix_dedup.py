"""Substring dedup over the whole corpus by prefix-free parsing.

A rolling hash of ``width`` bytes is taken at every byte. In each window of ``span`` bytes
the place of the smallest hash is its trigger, so every window holds one and equal windows
hold the same one at the same place. Windows in a row that share a trigger form a phrase:
the bytes from the first of them to the end of the last. The texts become a parse of such
overlapping phrases, and the distinct phrases are the dictionary.

Corpus order is needed only as far as ``span`` bytes, the length at which two suffixes count
as equal, and a phrase reaches that far beyond each of its suffixes; so the order of the
dictionary decides alone, and the parse is only walked back to places. It is found in three
rounds, each on what the one before left open:

1. Phrases are sorted by trigger, content and document. A phrase that a smaller document
   holds too is removed whole. One that meets no other phrase under its trigger cannot share
   a window, and all of it stays.
2. The rest, a few per cent, is parsed again with a wider trigger.
3. The suffixes of what is still open are sorted by their first ``span`` bytes, as in a
   suffix array of the dictionary, and those of the smallest document in each class stay.

Long repeats are settled in round 1, a phrase at a time, which is what makes this cheap on
repetitive text. Copies inside one Arrow batch are settled before the shuffle, so that a
phrase held by a third of all documents leaves one row a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialise, order_id, own_id, read
from .vector import U, byte_table, mix, prefix_hash, span_hash, string_buffers, text_chunks

SPAN = 50
WIDTHS = (16, 32)

_ROLL = byte_table(4099)
_ROLL_BASE = U(0xD6E8FEB86659FD93)
_LOW = U(0xFFFFFFFF)
_ROWS = "t long, b long, doc long, fp long, at long, done boolean"


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` bytes in a row, by doubling the length hashed."""
    total, done, part, size = None, 0, _ROLL[data], 1
    while True:
        if width & size:
            if total is None:
                total = part
            else:
                n = max(0, len(data) - done - size + 1)
                total = total[:n] * (_ROLL_BASE + U(2 * done)) + part[done : done + n]
            done += size
        if done == width:
            return mix(total)
        n = max(0, len(part) - size)
        part = part[:n] * (_ROLL_BASE + U(2 * size)) + part[size : size + n]
        size *= 2


def _least(key: np.ndarray, count: int) -> np.ndarray:
    """The minimum of each ``count`` values in a row."""
    size = 1
    while size * 2 <= count:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < count:
        key = np.minimum(key[: len(key) - (count - size)], key[count - size :])
    return key


def window_mask(offs: np.ndarray, span: int) -> np.ndarray:
    """True where a window of ``span`` bytes starts that ends inside its text."""
    mask = np.zeros(int(offs[-1]) + 1, np.int32)
    fits = np.diff(offs) >= span
    np.add.at(mask, offs[:-1][fits], 1)
    np.add.at(mask, offs[1:][fits] - span + 1, -1)
    return np.cumsum(mask)[:-1] > 0


def parse(data: np.ndarray, windows: np.ndarray, width: int, span: int):
    """Trigger hash, first window and last window of each phrase of the marked windows."""
    starts = np.flatnonzero(windows)
    if not len(starts):
        return np.empty(0, U), starts, starts
    rolled = rolling_hash(data, width)
    key = (rolled & ~_LOW) | np.arange(len(rolled), dtype=U)
    at = (_least(key, span - width + 1)[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return rolled[at[first]], starts[first], starts[np.append(first[1:], len(starts)) - 1]


def _pack(place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run of window starts as one long: place, then up to 255 windows."""
    return (place << 8) | count


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 8, at & 255


def _marked(runs: pa.Array, offs: np.ndarray, n: int) -> np.ndarray:
    """True at the window starts that the lists of packed runs, one for each text, name."""
    mask = np.zeros(n + 1, np.int32)
    flat = runs.flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        base = np.repeat(offs[:-1], runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        place, count = _unpack(flat)
        np.add.at(mask, base + place, 1)
        np.add.at(mask, base + place + count, -1)
    return np.cumsum(mask)[:-1] > 0


def _settle_copies(rows: list[np.ndarray]) -> pa.RecordBatch:
    """Marks as done each phrase of the batch that a smaller document in it holds too.

    Equal contents have equal triggers, so the content's hash alone tells phrases apart.
    """
    t, b, doc, fp, at = rows
    codes, distinct = pd.factorize(b)
    falling = np.argsort(doc, kind="stable")[::-1]
    least = np.empty(len(distinct), np.int64)
    # Of several values for one phrase the last stays, which is the smallest id.
    least[codes[falling]] = doc[falling]
    columns = [t.view(np.int64), b.view(np.int64), doc, fp, at, doc > least[codes]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["t", "b", "doc", "fp", "at", "done"])


def _phrases(width: int, span: int, marked: bool):
    """Maps batches of (doc, fp, text[, open]) to phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            out: list[list[np.ndarray]] = [[np.empty(0, k)] for k in (U, U, np.int64, np.int64, np.int64)]
            for row, end, data, offs in text_chunks(batch.column("text")):
                windows = window_mask(offs, span)
                if marked:
                    windows &= _marked(batch.column("open")[row:end], offs, len(data))
                t, first, last = parse(data, windows, width, span)
                # A phrase fits a packed run: at most span - width + 1 windows share a trigger.
                sums, inverse = prefix_hash(data)
                own = np.searchsorted(offs, first, "right") - 1
                found = (t, span_hash(sums, inverse, first, last + span), docs[row:end][own], prints[row:end][own],
                         _pack(first - offs[own], last - first + 1))
                for column, part in zip(out, found, strict=True):
                    column.append(part)
            yield _settle_copies([np.concatenate(x) for x in out])

    return run


def _suffixes(span: int):
    """Maps batches of (doc, fp, text, open) to every open suffix, cut after ``span`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            for row, end, data, offs in text_chunks(batch.column("text")):
                starts = np.flatnonzero(window_mask(offs, span) & _marked(batch.column("open")[row:end], offs, len(data)))
                for part in np.array_split(starts, len(starts) // 200_000 + 1):
                    own = np.searchsorted(offs, part, "right") - 1
                    cut = np.lib.stride_tricks.sliding_window_view(data, span)[part] if len(part) else np.empty(0, np.uint8)
                    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(span), len(part), [None, pa.py_buffer(cut.tobytes())])
                    arrays = [fixed.cast(pa.binary())]
                    arrays += [pa.array(x) for x in (docs[row:end][own], prints[row:end][own], _pack(part - offs[own], np.ones(len(part), np.int64)))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["suffix", "doc", "fp", "at"])

    return run


def _judged(phrases: DataFrame) -> DataFrame:
    """Per document, the runs of windows to remove and those still open."""
    trigger = Window.partitionBy("t")
    same = Window.partitionBy("t", "b").orderBy("doc")
    judged = (
        phrases.where(~F.col("done"))
        .repartition("t")
        .sortWithinPartitions("t", "b", "doc")
        .withColumn("lo", F.min("b").over(trigger))
        .withColumn("hi", F.max("b").over(trigger))
        .withColumn("least", F.min("doc").over(trigger))
        .withColumn("most", F.max("doc").over(trigger))
        .withColumn("place", F.rank().over(same))
        .where((F.col("place") > 1) | ((F.col("lo") != F.col("hi")) & (F.col("least") != F.col("most"))))
        .select("doc", "fp", "at", (F.col("place") > 1).alias("drop"))
    )
    settled = phrases.where("done").select("doc", "fp", "at", F.lit(True).alias("drop"))
    return _runs(judged.unionByName(settled))


def _runs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "fp").agg(
        F.collect_list(F.when(F.col("drop"), F.col("at"))).alias("drop"),
        F.collect_list(F.when(~F.col("drop"), F.col("at"))).alias("open"),
    )


def repeated_runs(texts: DataFrame, span: int = SPAN, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(doc, fp, drop): packed runs of window starts that a smaller document holds too.

    ``texts`` has doc, fp (tells apart rows with one id) and text, none of them null.
    """
    parts, still = [], texts
    for step, width in enumerate(widths):
        phrases = still.mapInArrow(_phrases(width, span, step > 0), _ROWS)
        found = materialise(_judged(phrases), f"phrases-{width}")
        parts.append(found.select("doc", "fp", "drop"))
        still = texts.join(found.where(F.size("open") > 0).select("doc", "fp", "open"), ["doc", "fp"]).select("doc", "fp", "text", "open")
    suffixes = still.mapInArrow(_suffixes(span), "suffix binary, doc long, fp long, at long")
    order = Window.partitionBy("suffix").orderBy("doc")
    later = suffixes.withColumn("place", F.rank().over(order)).where("place > 1").select("doc", "fp", "at", F.lit(True).alias("drop"))
    parts.append(materialise(_runs(later), "suffixes").select("doc", "fp", "drop"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("doc", "fp").agg(F.flatten(F.collect_list("drop")).alias("drop"))


def _without(span: int):
    """Maps (doc, text, drop) to the digest and the remaining text of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = string_buffers(batch.column("text"))
            runs, rows = batch.column("drop"), []
            for i in range(len(batch)):
                text, removed, spans = data[offs[i] : offs[i + 1]], 0, 0
                if runs[i].is_valid and len(runs[i]):
                    place, count = _unpack(runs[i].values.to_numpy(zero_copy_only=False))
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + count + span - 1, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed = int(gone.sum())
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    text = text[~gone]
                kept = text.tobytes()
                rows.append((int(offs[i + 1] - offs[i]), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [batch.column("doc"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, span: int = SPAN, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Removes every byte covered by ``span`` bytes that also start in a document with a smaller id.

    Takes doc_id and text; other columns are ignored. Returns doc_id, n_bytes, n_removed,
    n_spans, kept_sha256 and kept (the remaining bytes; a cut may fall inside a character).
    A null text is empty. Repeats inside one document, and between rows that share an id, stay.
    A null id counts as the largest. Texts shorter than ``span`` bytes stay whole. No rows give none.
    """
    texts = docs.select(order_id().alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", F.crc32("text"))
    texts = texts.select("doc", "fp", "text")
    found = repeated_runs(texts, span, widths)
    joined = texts.join(found, ["doc", "fp"], "left").select("doc", "text", "drop")
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cleaned = joined.mapInArrow(_without(span), schema)
    return cleaned.select(own_id("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("kept")
