"""Packing of tokenised documents into sequences by length patterns and least squares.

Only the histogram of piece lengths, of at most ``size`` entries, comes to the driver. There
every pattern of up to three lengths that fill a sequence exactly is enumerated, and repeat
counts are fitted to the histogram by non-negative least squares: multiplicative updates,
which keep counts non-negative and never raise the error. Rounded counts, held to what the
histogram has, take their pieces; what is left is packed best-fit, longest first, again on
counts. The plan's size depends on ``size``, not on the number of documents.

Pieces then take their places in parallel: each gets its rank among those of its length
(counts by length and hash bucket, summed, then a rank inside the bucket), and the plan maps
ranks to sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pretokens import WordIds
from .store import materialise, order_id, own_id, read
from .vector import text_chunks

SIZE = 2048
END = 0
TOKENIZER = "byte_bpe_50k.json"
# Bytes of text encoded together.
CHUNK = 1 << 18
UPDATES = 200


_encoders: dict[tuple, WordIds] = {}


def encoder(path: str | None, pattern: str | None, added: bool) -> WordIds:
    """The worker's encoder, which keeps its words from task to task; one at a time."""
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path(TOKENIZER)
        pattern = None if pattern in (None, public_tokenizers.PATTERN) else pattern
    how = (path, pattern, added)
    if how not in _encoders:
        _encoders.clear()
        _encoders[how] = WordIds(path, pattern, added, END)
    return _encoders[how]


def _pieces(size: int, path: str | None, pattern: str | None, added: bool):
    """Maps (doc, text) to its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern, added)
        for batch in batches:
            docs = np.asarray(batch.column("doc"))
            for a, b, data, offs in text_chunks(batch.column("text"), CHUNK):
                ids, bounds = encode(data, offs)
                total = np.diff(bounds)
                count = -(-total // size)
                number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                short = np.repeat((total - 1) % size + 1, count)
                start = np.where(number == 0, 0, short + (number - 1) * size)
                length = np.where(number == 0, short, size)
                at = (np.repeat(bounds[:-1], count) + start).tolist()
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(at, length.tolist(), strict=True)]
                arrays = [pa.array(np.repeat(docs[a:b], count)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(size: int, present: np.ndarray) -> np.ndarray:
    """All ascending patterns of up to three lengths that fill a sequence; 0 for no length."""
    one = np.array([[0, 0, size]])
    a = np.arange(1, size // 2 + 1)
    two = np.stack([np.zeros_like(a), a, size - a], axis=1)
    small = np.arange(1, size // 3 + 1)
    three = [np.stack([np.full((size - x) // 2 - x + 1, x), np.arange(x, (size - x) // 2 + 1), size - x - np.arange(x, (size - x) // 2 + 1)], axis=1) for x in small]
    found = np.concatenate([one, two, *three])
    known = present.copy()
    known[0] = True
    return found[known[found].all(axis=1)]


def fit_counts(found: np.ndarray, histogram: np.ndarray, updates: int = UPDATES) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that least-squares fit the histogram."""
    size = len(histogram)
    target = histogram.astype(float)

    def spread(x):
        total = sum(np.bincount(found[:, i], x, size) for i in range(3))
        total[0] = 0
        return total

    def gather(lengths):
        lengths[0] = 0
        return lengths[found].sum(axis=1)

    aim = gather(target.copy())
    x = np.full(len(found), target.sum() / max(1, 3 * len(found)))
    for _ in range(updates):
        x *= aim / np.maximum(gather(spread(x)), 1e-12)
    return x


def best_fit(left: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts: each length goes where it leaves least space."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    for length in range(size, 0, -1):
        count = int(left[length])
        placed: list[tuple[int, list[int], int]] = []
        while count:
            space = min((s for s in open_ if s >= length), default=None)
            if space is None:
                # As many of this length to a new sequence as fit.
                each = size // length
                full, rest = divmod(count, each)
                if full:
                    placed.append((size - each * length, [length] * each, full))
                if rest:
                    placed.append((size - rest * length, [length] * rest, 1))
                break
            members, n = open_[space].pop()
            if not open_[space]:
                del open_[space]
            used = min(n, count)
            if n > used:
                open_.setdefault(space, []).append((members, n - used))
            # One more of this length in the same sequence is the next best fit.
            open_.setdefault(space - length, []).append(([*members, length], used))
            count -= used
        for space, members, n in placed:
            open_.setdefault(space, []).append((members, n))
    return [x for own in open_.values() for x in own]


def pack_plan(histogram: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """(lengths, repeats) of all sequences; lengths of each use up the histogram exactly."""
    found = patterns(size, histogram > 0)
    fitted = fit_counts(found, histogram)
    # Never more sequences than best-fit alone needs.
    plans = [best_fit(histogram.copy(), size)]
    for counts in (np.floor(fitted), np.rint(fitted)):
        left, plan = histogram.copy(), []
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] < 1:
                break
            lengths = [int(x) for x in found[i] if x]
            repeats = min(int(counts[i]), *(int(left[x]) // lengths.count(x) for x in lengths))
            if repeats:
                for x in lengths:
                    left[x] -= repeats
                plan.append((lengths, repeats))
        plans.append(plan + best_fit(left, size))
    return min(plans, key=lambda p: sum(n for _, n in p))


class Slots:
    """Where the pieces of each length go, by their rank."""

    def __init__(self, plan: list[tuple[list[int], int]], size: int):
        rows: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
        used, sequence = [0] * (size + 1), 0
        for lengths, repeats in plan:
            offset = 0
            for x in lengths:
                rows[x].append((used[x], sequence, offset))
                used[x] += repeats
                offset += x
            sequence += repeats
        self.first = np.cumsum([0, *map(len, rows)])
        flat = np.array([x for own in rows for x in own], np.int64).reshape(-1, 3)
        # One sorted key over all lengths: each length's ranks start at its own multiple.
        self.stride = max(used) + 1
        lengths = np.repeat(np.arange(size + 1), [len(x) for x in rows])
        self.keys = lengths * self.stride + flat[:, 0]
        self.start, self.sequence, self.offset = flat.T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length * self.stride + rank, "right") - 1
        return self.sequence[at] + rank - self.start[at], self.offset[at]


def _placed(slots: Slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
                sequence, offset = slots.find(length, rank)
                names = ["doc", "piece", "start", "length", "ids_crc32"]
                arrays = [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, size: int = SIZE, path: str | None = None, pattern: str | None = None, added: bool = False) -> DataFrame:
    """Packs the tokens of each text and an end token into sequences of at most ``size`` tokens.

    Takes doc_id and text; other columns are ignored. Returns one row per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset. A document longer than a sequence is cut; its
    first piece is the short one. Null and empty texts are one end token. A null id stays null;
    rows that share an id are packed each by itself. No rows give none. ``path`` and ``pattern``
    name the tokenizer's file and its splitting pattern; the public 50k vocabulary by default.
    ``added`` gives the tokenizer's added tokens in a text their own ids, as the tokenizer's file
    does and the query and the pipeline do; else they are plain text.
    """
    schema = "doc long, piece int, start long, length long, ids_crc32 long"
    pieces = materialise(docs.select(order_id().alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(size, path, pattern, added), schema), "pieces")
    histogram = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    total = int(histogram.sum())
    # Buckets of some thousand pieces split the lengths that many share.
    buckets = 64 + total // 100_000
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc", "piece", "ids_crc32")
    ranked = bucketed.withColumn("inside", F.row_number().over(inside)).join(offsets, ["length", "bucket"])
    ranked = ranked.select("doc", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).alias("rank"))
    slots = Slots(pack_plan(histogram, size), size) if total else None
    placed = ranked.mapInArrow(_placed(slots), schema + ", sequence_id long, offset long")
    return placed.select(own_id("doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), added=True)
