"""Benchmark decontamination by SimHash windows the size of each benchmark item.

Words are lower-cased runs of letters, digits and non-ASCII characters; shingles are five
words (an item of fewer words is one shingle). A shingle weighs 1 + the bit length of
(items / items that hold it), so phrases that many items share count less; weights are whole
numbers, so results do not depend on the order of sums. Items are counted over the whole
benchmark; the shingles that this gives less than the largest weight lie in files of the
shared folder, which tasks memory-map.

A window of a document has as many words as an item; a document of fewer words is one window.
Its 64-bit SimHash over weighted shingles is looked up in a multi-index: of eight blocks of
eight bits, one must lie within ``radius // 8`` bits of the item's if the whole lies within
``radius``. For each word count and block there is a table from the block's value to the
items whose block lies so near, so no fingerprint within the radius is missed and only
items found in a table are compared whole. Those within the radius are confirmed by exact weighted
shingle similarity. A window without a shingle of an item of its size has similarity 0 with
all of them and is not hashed.

At similarity 0.75 a fingerprint is 11 bits away on average, with a standard deviation of 3;
the radius of 23 bits is four deviations beyond.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlabel.session import scratch_path

from .files import map_arrays, write_arrays
from .store import materialise, read
from .vector import U, lookup, mix, shingle_hashes, text_chunks, word_hashes

SHINGLE = 5
PERCENT = 75
RADIUS = 23
BLOCKS = 8
# Items are sent to the tasks in slices of so many bytes of text; each slice is a pass of its own.
SLICE_BYTES = 4 << 20
# Pairs of a window and an item looked up together.
PAIRS = 1 << 18
# Shared shingles a file of weights has on average.
SHARD_SHINGLES = 1_000_000

_ALNUM = ~lookup([i for i in range(128) if not chr(i).isalnum()])
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprint_bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle."""
    bits = np.unpackbits(mix(shingles ^ U(0x5157)).view(np.uint8)).reshape(-1, 64)
    return bits.astype(np.int64) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


_opened: dict[str, dict] = {}


class Weights:
    """Weights of shingles by their number of items in the whole benchmark."""

    def __init__(self, items: int, bits: int, paths: dict[int, str]):
        self.bits, self.paths = bits, paths
        self.rare = 1 + items.bit_length()

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), self.rare)
        own = (shingles >> U(64 - self.bits) if self.bits else shingles * U(0)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(own) else ():
            path = self.paths.get(int(own[mine[0]]))
            if path is not None:
                if path not in _opened:
                    _opened[path] = map_arrays(path)
                held, weights = _opened[path]["shingle"], _opened[path]["weight"]
                at = np.minimum(np.searchsorted(held, shingles[mine]), len(held) - 1)
                out[mine] = np.where(held[at] == shingles[mine], weights[at], self.rare)
        return out


class BlockIndex:
    """For each block, a table from each of its 256 values to the items whose block lies within ``reach`` bits."""

    def __init__(self, prints: np.ndarray, reach: int):
        self.items = len(prints)
        near = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None]] <= reach
        self.tables = []
        for b in range(BLOCKS):
            value, item = np.nonzero(near[:, prints[:, b]])
            self.tables.append((np.searchsorted(value, np.arange(257)), item))

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first window, windows counted from it, items) that meet in a table, each pair once, for a part of the windows."""
        step = max(1, PAIRS // max(1, self.items))
        for first in range(0, len(prints), step):
            part, found = prints[first : first + step], []
            for b, (starts, items) in enumerate(self.tables):
                lo = starts[part[:, b]]
                count = starts[part[:, b].astype(np.int64) + 1] - lo
                at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                found.append(np.repeat(np.arange(len(part)), count) * self.items + items[at])
            pairs = np.unique(np.concatenate(found))
            yield first, pairs // self.items, pairs % self.items


class Items:
    """A slice of the benchmark: shingles, fingerprints and their block index."""

    def __init__(self, ids: list[int], texts: list[str | None], weights: Weights, size: int, percent: int, radius: int):
        self.size, self.percent, self.radius, self.weigh = size, percent, radius, weights.of
        self.shingles: list[np.ndarray] = []
        self.ids, self.words = [], []
        for item, text in zip(ids, texts, strict=True):
            hashes, _ = _words(pa.array([text], pa.string()))
            if len(hashes):
                self.ids.append(item)
                self.words.append(len(hashes))
                self.shingles.append(shingle_hashes(hashes, min(size, len(hashes))))
        self.by_words: dict[int, list[int]] = {}
        for i, n in enumerate(self.words):
            self.by_words.setdefault(n, []).append(i)
        # A window of n words is worth hashing if it holds a shingle of an item of n words.
        self.seeds = {n: np.unique(np.concatenate([self.shingles[i] for i in own])) for n, own in self.by_words.items()}
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.prints = np.concatenate([np.empty((0, 8), np.uint8), *(_packed(self.sums(s)[None]) for s in self.shingles)])
        self.index = {n: BlockIndex(self.prints[own], radius // BLOCKS) for n, own in self.by_words.items()}

    def sums(self, shingles: np.ndarray) -> np.ndarray:
        return (fingerprint_bits(shingles) * self.weigh(shingles)[:, None]).sum(axis=0)

    def near(self, prints: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
        """(window, item) within the radius, found by blocks."""
        own = np.array(self.by_words[words])
        for first, window, item in self.index[words].candidates(prints):
            distance = _POPCOUNT[prints[first + window] ^ self.prints[own[item]]].sum(axis=1, dtype=np.int64)
            keep = distance <= self.radius
            yield from zip((first + window[keep]).tolist(), own[item[keep]].tolist(), strict=True)

    def similarity(self, window: np.ndarray, item: int) -> tuple[int, int]:
        """Weights in common and in either, counting repeats."""
        one, two = Counter(window.tolist()), self.counts[item]
        keys = np.array(sorted({*one, *two}), U)
        common = either = 0
        for key, weight in zip(keys.tolist(), self.weigh(keys).tolist(), strict=True):
            common += weight * min(one[key], two[key])
            either += weight * max(one[key], two[key])
        return common, either


def _words(column: pa.Array):
    for _, _, data, offs in text_chunks(column):
        return word_hashes(data, offs, word=_ALNUM)
    return np.empty(0, U), np.zeros(1, int)


def _item_shingles(size: int):
    """Maps items to their distinct shingles with numbers of items; null counts the items with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column("text")):
                words, first = word_hashes(data, offs, word=_ALNUM)
                own = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
                found = [np.unique(shingle_hashes(x, min(size, len(x)))) for x in own]
                shingles, n = np.unique(np.concatenate([np.empty(0, U), *found]), return_counts=True)
                arrays = [pa.array([None, *shingles.view(np.int64).tolist()], pa.int64()), pa.array([len(own), *n.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["shingle", "n"])

    return run


def _write_weights(items: int, folder: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(shingle=rows["shingle"].to_numpy().view(U)).sort_values("shingle")
        weights = [1 + (items // n).bit_length() for n in rows["n"].tolist()]
        path = f"{folder}/weights-{key[0]}-{np.random.bytes(8).hex()}"
        write_arrays(path, {"shingle": rows["shingle"].to_numpy(), "weight": np.array(weights, np.uint8)})
        return pd.DataFrame({"shard": [key[0]], "path": [path]})

    return run


def shingle_weights(items: DataFrame, size: int) -> Weights:
    """Counts all items (distinct, columns item_id and text) and writes the weights of shared shingles."""
    counts = items.mapInArrow(_item_shingles(size), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "item-shingles")
    total = counts.where("shingle is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # One item's own shingles have the largest weight, as unknown ones do.
    shared = counts.where("shingle is not null and n > 1")
    bits = (shared.count() // SHARD_SHINGLES).bit_length()
    shard = F.shiftrightunsigned("shingle", 64 - bits) if bits else F.lit(0).cast("long")
    folder = scratch_path(items.sparkSession, "weights")
    written = shared.groupBy(shard.alias("shard")).applyInPandas(_write_weights(total, folder), "shard long, path string")
    return Weights(total, bits, {r.shard: r.path for r in materialise(written, "weight-shards").collect()})


class _Table:
    """Membership of 64-bit hashes: a bitmap by low bits, then a sorted search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.mask = U((1 << max(16, 6 + len(self.values).bit_length())) - 1)
        self.bitmap = np.zeros(int(self.mask) + 1, bool)
        self.bitmap[self.values & self.mask] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bitmap[hashes & self.mask])
        if not len(self.values):
            return at[:0]
        near = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        return at[self.values[near] == hashes[at]]


def _matches(items: Items, words: np.ndarray, places: dict[int, np.ndarray]) -> dict[int, tuple[int, int]]:
    """Items that a document holds, with weights in common and in either at the best window.

    ``places`` has the document's positions with a known shingle, by shingle size.
    """
    best: dict[int, tuple[int, int]] = {}
    for n in items.by_words:
        unit = min(items.size, n)
        at = places.get(unit, ())
        if not len(at):
            continue
        shingles = shingle_hashes(words, unit)
        at = at[np.isin(shingles[at], items.seeds[n])]
        if not len(at):
            continue
        # A document of fewer words than the item is its own one window.
        width = min(n, len(words))
        per = width - unit + 1
        edge = np.zeros(len(words) + 2, np.int64)
        np.add.at(edge, np.maximum(at - per + 1, 0), 1)
        np.add.at(edge, at + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge)[: len(words) - width + 1] > 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > per) + 1):
            for run in np.array_split(part, len(part) // 4096 + 1):
                if not len(run):
                    continue
                region = shingles[run[0] : run[-1] + per]
                rolled = np.zeros((len(region) + 1, 64), np.int64)
                np.cumsum(fingerprint_bits(region) * items.weigh(region)[:, None], axis=0, out=rolled[1:])
                local = run - run[0]
                for window, item in items.near(_packed(rolled[local + per] - rolled[local]), n):
                    common, either = items.similarity(region[local[window] : local[window] + per], item)
                    if 100 * common >= items.percent * either:
                        old = best.get(item, (0, 1))
                        if common * old[1] > old[0] * either:
                            best[item] = (common, either)
    return best


def _flag(items: Items):
    """Maps (row, item_ids, similarity) to the same with this slice's matches added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = sorted({min(items.size, n) for n in items.by_words})
        tables = {u: _Table(np.concatenate([items.seeds[n] for n in items.by_words if min(items.size, n) == u])) for u in units}
        for batch in batches:
            ids, scores = batch.column("item_ids").to_pylist(), batch.column("similarity").to_pylist()
            for row, _, data, offs in text_chunks(batch.column("row").field("text").cast(pa.string())):
                words, first = word_hashes(data, offs, word=_ALNUM)
                found: dict[int, dict[int, np.ndarray]] = {}
                for unit in units:
                    places = tables[unit].places(shingle_hashes(words, unit))
                    own = np.searchsorted(first, places, "right") - 1
                    inside = places + unit <= first[np.minimum(own + 1, len(first) - 1)]
                    places, own = places[inside], own[inside]
                    for doc, at in zip(np.unique(own).tolist(), np.split(places, np.flatnonzero(np.diff(own)) + 1), strict=False):
                        found.setdefault(doc, {})[unit] = at - first[doc]
                for doc, places in found.items():
                    best = _matches(items, words[first[doc] : first[doc + 1]], places)
                    if best:
                        ids[row + doc] = sorted({*ids[row + doc], *(items.ids[i] for i in best)})
                        scores[row + doc] = max(scores[row + doc], *(c / e for c, e in best.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.float64())],
                names=["row", "item_ids", "similarity"],
            )

    return run


def match_benchmark(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Finds the benchmark items (item_id, text) whose wording a document repeats.

    Returns row (a struct of all columns of the document, whatever their names), item_ids (sorted,
    empty if clean) and similarity (of the best match, else 0). Null, empty and wordless texts
    are clean; items without words or id match nothing; items with one id are reported once. The
    documents are read once for each ``SLICE_BYTES`` of the benchmark and never shuffled.
    """
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = total // SLICE_BYTES + 1
    weights = shingle_weights(known.distinct(), size)
    found = docs.select(F.struct("*").alias("row"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("similarity"))
    for part in range(slices):
        own = known.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == part) if slices > 1 else known
        rows = sorted(own.distinct().collect())
        if rows:
            items = Items([r.item_id for r in rows], [r.text for r in rows], weights, size, percent, radius)
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in found.schema])
            found = found.mapInArrow(_flag(items), schema)
    return found


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, the benchmark items it repeats, and whether it stays."""
    found = match_benchmark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "similarity",
        (F.size("item_ids") == 0).alias("kept"),
    )
