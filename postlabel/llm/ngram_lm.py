"""An n-gram language model in memory-mapped Elias-Fano tries, trained and queried by Spark tasks.

Tokens are hashes of lower-cased words and one end token per text. Word counts are exact.
N-grams of order 2 and up are kept from ``min_count`` occurrences on (all are counted, and
only those whose shorter n-grams are kept can reach it); the query keeps all of them, up to
order 3. Probabilities are interpolated with absolute discounting,

    p(w | h) = max(c(hw) - D, 0) / c(h) + g(h) p(w | h'),

over the kept n-grams, g(h) being what they leave, down to the add-0.1 word probability; so
they sum to one over the vocabulary and one unknown word. Values are kept as 8-bit codes into
a codebook of equal steps of the logarithm, per shard and level.

The trie is cut into shards by the hash of the first word, each written by one task; their
number follows the tokens, which bound the n-grams of every order. Tasks send a shard its
n-grams sorted and packed, a block for each shard, and the shard's task adds them up. In a
level, the successors of a context stand together: Elias-Fano pointers give their range, and
their ids one monotone Elias-Fano sequence, each range starting where the one before ended.
From order 3 on, an id is the place of a word among the successors of the context without
its first word, which makes ids small. A lookup searches the sequence for the successor of
(base of the range + id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlabel.session import scratch_path

from .elias_fano import EliasFano, encode
from .files import map_arrays, write_arrays
from .store import materialise, read
from .vector import U, text_chunks, word_hashes

# What the query trains: every n-gram up to this order. ``score`` can prune (``PRUNED``).
ORDER = 3
MIN_COUNT = 1
PRUNED = 2
DISCOUNT = 0.75
ADD = 0.1
# Tokens a shard of the trie has on average, and so n-grams of one order at most.
SHARD_NGRAMS = 2_000_000
HELD_OUT_OF = 10
# Distinct n-grams a task gathers before it hands them on.
GATHERED = 1_500_000

_END = U(0x0E7D0E7D0E7D0E7D)
_opened: dict[str, dict] = {}


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, end tokens included, and the index of each text's first."""
    words, first = word_hashes(data, offs)
    return np.insert(words, first[1:], _END), first + np.arange(len(first))


def sorted_distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and for each value which of them it is (hashed, then sorted)."""
    codes, distinct = pd.factorize(hashes)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[codes]


def in_order(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows sorted by all columns, equal ones as they stand, and which of these begin a new value."""
    n, size = len(columns[0]), 1
    if not n:
        return np.empty(0, np.int64), np.empty(0, bool)
    bounds = [(int(x.min()), int(x.max())) for x in columns]
    for low, high in bounds:
        size *= high - low + 1
    if size * n >= 1 << 64:
        order = np.lexsort(columns[::-1])
        return order, np.append(True, np.any([x[order[1:]] != x[order[:-1]] for x in columns], axis=0))
    # One number holds a row and its place: sorting numbers is much faster than sorting places.
    key = np.zeros(n, U)
    for x, (low, high) in zip(columns, bounds, strict=True):
        key = key * U(high - low + 1) + (x - low).astype(U)
    key = np.sort(key * U(n) + np.arange(n, dtype=U))
    value = key // U(n)
    return (key - value * U(n)).view(np.int64), np.append(True, value[1:] != value[:-1])


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places it stands at, in order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        yield int(shard[own[0]]), own


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their codebook: 256 equal steps from the least value to the largest."""
    low, high = (values.min(), values.max()) if len(values) else (0.0, 0.0)
    step = (high - low) / 255 or 1.0
    return np.rint((values - low) / step).astype(np.uint8), (low + step * np.arange(256)).astype("<f4")


@dataclass
class Model:
    """Where the shards are, and what the whole corpus adds up to. ``bits``: shards are 2**bits."""

    order: int
    bits: int
    total: int = 0
    vocabulary: int = 0
    words: dict[int, str] = field(default_factory=dict)
    levels: dict[int, dict[int, str]] = field(default_factory=dict)
    bases: np.ndarray | None = None

    def shard(self, path: str) -> dict:
        if path not in _opened:
            arrays = dict(map_arrays(path))
            if "ptr_low" in arrays:
                arrays |= {"ptr": EliasFano(arrays, "ptr_"), "succ": EliasFano(arrays, "succ_")}
            _opened[path] = arrays
        return _opened[path]

    def word_logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.total + ADD * (self.vocabulary + 1)))

    def find_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(hashes >> U(64 - self.bits) if self.bits else hashes * U(0), np.arange((1 << self.bits) + 1, dtype=U))
        for shard, path in self.words.items():
            a, b = cuts[shard], cuts[shard + 1]
            held = self.shard(path)
            if a < b:
                at = np.minimum(np.searchsorted(held["hash"], hashes[a:b]), len(held["hash"]) - 1)
                same = held["hash"][at] == hashes[a:b]
                ids[a:b][same] = self.bases[shard] + at[same]
                counts[a:b][same] = held["count"][at[same]]
        return ids, counts

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        return self._by_shard(ids, lambda held, local: held["count"][local], self.words, np.int64)

    def _by_shard(self, ids: np.ndarray, take, paths: dict[int, str], kind) -> np.ndarray:
        out, own = np.zeros(len(ids), kind), np.searchsorted(self.bases, ids, "right") - 1
        for shard, mine in _groups(own):
            if shard in paths:
                out[mine] = take(self.shard(paths[shard]), ids[mine] - self.bases[shard])
        return out

    def find(self, level: int, shard: np.ndarray, context: np.ndarray, word: np.ndarray):
        """Places of sorted n-grams (-1: none), where their contexts' ranges start, their logs and the weights g of their contexts."""
        place, begin, logs, rest = np.full(len(shard), -1), np.zeros(len(shard), np.int64), np.zeros(len(shard)), np.zeros(len(shard))
        cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if int(shard[a]) not in self.levels[level]:
                continue
            held = self.shard(self.levels[level][int(shard[a])])
            # Each context once.
            first = np.flatnonzero(np.diff(context[a:b], prepend=-1))
            one, times = context[a:b][first], np.diff(np.append(first, b - a))
            lo, hi = (x.astype(np.int64) for x in held["ptr"].get_two(one))
            some = hi > lo
            rest[a:b] = np.repeat(np.where(some, held["rest_book"][held["rest"][one]], 0), times)
            begin[a:b] = np.repeat(lo, times)
            # What the range before ends with, and the first of the range: mostly it is the only one.
            base, lead = np.zeros((2, len(one)), U)
            behind, front = np.flatnonzero(some & (lo > 0)), np.flatnonzero(some & (lo == 0))
            base[behind], lead[behind] = held["succ"].get_two(lo[behind] - 1)
            lead[front] = held["succ"].get(lo[front])
            ask = np.flatnonzero(np.repeat(some, times) & (word[a:b] >= 0))
            of = np.repeat(np.arange(len(one)), times)[ask]
            sought, end = base[of] + (word[a:b][ask] + 1).astype(U), hi[of]
            at = np.where(lead[of] == sought, lo[of], -1)
            open_ = np.flatnonzero((at < 0) & (end - lo[of] > 1))
            at[open_] = held["succ"].place(sought[open_])
            ok = (at >= 0) & (at < end)
            place[a:b][ask[ok]] = at[ok]
            logs[a:b][ask[ok]] = held["log_book"][held["log"][at[ok]]]
        return place, begin, logs, rest

    def walk(self, data: np.ndarray, offs: np.ndarray, order: int):
        """Yields the texts' n-grams, order by order.

        Order 1 gives the index of each text's first token, counts and logs of all tokens. Each
        further order gives the tokens with a kept context, its shard and place, the id of the
        token in it (-1: unknown there), the logs, which then hold all orders so far, and numbers
        of the contexts and of the tokens among those of these texts, by which n-grams sort as
        they do in the trie, however large it is. The walk ends with the first order that has no
        trie yet.
        """
        hashes, first = tokens(data, offs)
        distinct, inverse = sorted_distinct(hashes)
        found, seen = self.find_words(distinct)
        ids, counts, logs = found[inverse], seen[inverse], self.word_logs(seen)[inverse]
        yield first, counts, logs
        shards = (np.searchsorted(self.bases, found, "right") - 1)[inverse]
        ahead = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
        place, word, number = ids, ids, inverse
        for level in range(2, order + 1):
            # ``place`` is where the token's n-gram of the order before stands, ``word`` its id there, ``number`` its own.
            previous = np.full(len(ids), -1)
            previous[1:] = place[:-1]
            at = np.flatnonzero((ahead >= level - 1) & (previous >= 0))
            shard = shards[at - level + 1]
            context = previous[at] - self.bases[shard] if level == 2 else previous[at]
            numbers = number[at - 1], inverse[at]
            yield at, shard, context, word[at], logs, numbers
            if level not in self.levels:
                return
            one, back = self._distinct(*numbers)
            spot, begin, log, rest = self.find(level, shard[one], context[one], word[at][one])
            logs[at] = np.where(spot >= 0, log, rest)[back] + np.where(spot >= 0, 0.0, 1.0)[back] * logs[at]
            place = np.full(len(ids), -1)
            place[at] = spot[back]
            if level < order:
                word = np.full(len(ids), -1)
                word[at] = np.where(spot >= 0, spot - begin, -1)[back]
                number = np.zeros(len(ids), np.int64)
                number[at] = back

    def _distinct(self, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of distinct n-grams in order, so that lookups go one way, and for each n-gram which of them it is."""
        order, new = in_order(*columns)
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        return order[new], back


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for _, _, data, offs in text_chunks(batch.column("text")):
            codes, distinct = pd.factorize(tokens(data, offs)[0])
            parts.append((distinct, np.bincount(codes)))
        if parts:
            inverse, distinct = pd.factorize(np.concatenate([p[0] for p in parts]))
            n = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n)], names=["hash", "n"])


def _packed(columns: list[np.ndarray]) -> bytes:
    """Sorted contexts, words, counts and logs of shorter n-grams as one compressed block, whole numbers in as few bytes as hold them."""
    context, word, n, *below = columns
    columns = [x.astype(np.min_scalar_type(x.max())) for x in (np.diff(context, prepend=0), word, n)] + [x.astype("<f4") for x in below]
    raw = b"".join(x.tobytes() for x in columns)
    kinds = "".join(x.dtype.str for x in columns).encode()
    return np.array([len(n), len(raw), len(kinds)], "<i8").tobytes() + kinds + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(block: bytes) -> list[np.ndarray]:
    n, size, head = np.frombuffer(block, "<i8", 3).tolist()
    raw, at, columns = pa.decompress(block[24 + head :], size, "zstd", asbytes=True), 0, []
    for i in range(24, 24 + head, 3):
        kind = np.dtype(block[i : i + 3].decode())
        columns.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    context, word, counts, *below = columns
    return [np.cumsum(context, dtype=np.int64), word.astype(np.int64), counts.astype(np.int64), *below]


def _added(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Contexts and words sorted, each pair once, with its counts added up."""
    order, new = in_order(*columns[:2])
    first = np.flatnonzero(new)
    context, word, n, *below = columns
    counts = np.add.reduceat(n[order], first) if len(n) else n
    return [context[order[first]], word[order[first]], counts, *(x[order[first]] for x in below)]


def _level_counts(model: Model, level: int, min_count: int):
    """Maps texts to the n-grams of one order with their numbers in what a task gathered, a block for each shard.

    An n-gram occurs at most as often as each of its words, so those with a rarer word are left out.
    """

    def merged(parts: list) -> pa.RecordBatch:
        shard, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = [(number, _packed(_added([x[at] for x in columns]))) for number, at in _groups(shard)]
        arrays = [pa.array([k for k, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column("text")):
                (_, counts, _), *_, (at, shard, context, word, logs, numbers) = model.walk(data, offs, level)
                keep = (word >= 0) & (counts[at] >= min_count) & (counts[at - 1] >= min_count)
                order, new = in_order(*(x[keep] for x in numbers))
                first = np.flatnonzero(new)
                one = np.flatnonzero(keep)[order[first]]
                n = np.diff(np.append(first, len(order)))
                parts.append((shard[one], context[one], word[one], n, *([logs[at[one]]] if level > 2 else [])))
                held += len(one)
                if held >= GATHERED:
                    yield merged(parts)
                    parts, held = [], 0
        if parts:
            yield merged(parts)

    return run


def _write_words(folder: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = rows["hash"].to_numpy().view(U), rows["n"].to_numpy()
        order = np.argsort(hashes)
        counts = counts[order]
        path = f"{folder}/words-{key[0]}-{np.random.bytes(8).hex()}"
        write_arrays(path, {"hash": hashes[order], "count": counts.astype(np.min_scalar_type(counts.max()))})
        return pd.DataFrame({"shard": [key[0]], "path": [path], "n": [len(hashes)], "total": [counts.sum()]})

    return run


def _write_level(model: Model, level: int, min_count: int, folder: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        found = _added([np.concatenate(x) for x in zip(*map(_unpacked, rows["block"]), strict=True)])
        enough = found[2] >= min_count
        context, word, n, *kept = (x[enough] for x in found)
        if not len(n):
            return pd.DataFrame({"shard": [], "path": [], "n": []})
        lower = model.shard(model.words[shard] if level == 2 else model.levels[level - 1][shard])
        of_context = lower["count"][:].astype(float)
        size = len(of_context)
        discounted = (n - DISCOUNT) / of_context[context]
        rest = 1 - np.bincount(context, discounted, size)
        # The same n-gram without its first word, for the mass that is left.
        below = 10 ** (model.word_logs(model.word_counts(word)) if level == 2 else kept[0].astype(float))
        log = np.log10(discounted + rest[context] * below)
        ends = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(context, minlength=size), out=ends[1:])
        # Each range starts at the value the one before ended with.
        last = np.flatnonzero(np.append(context[1:] != context[:-1], True))
        base = np.concatenate([[0], np.cumsum(word[last] + 1)])[:-1]
        values = np.repeat(base, np.diff(np.append(-1, last))) + word + 1
        codes, book = _quantised(log)
        rest_codes, rest_book = _quantised(np.log10(np.maximum(rest, 1e-9)))
        arrays = {f"ptr_{k}": v for k, v in encode(ends).items()} | {f"succ_{k}": v for k, v in encode(values).items()}
        arrays |= {"log": codes, "log_book": book, "rest": rest_codes, "rest_book": rest_book, "count": n.astype(np.min_scalar_type(n.max()))}
        path = f"{folder}/level{level}-{shard}-{np.random.bytes(8).hex()}"
        write_arrays(path, arrays)
        return pd.DataFrame({"shard": [shard], "path": [path], "n": [len(n)]})

    return run


def train(texts: DataFrame, order: int = ORDER, min_count: int = PRUNED) -> Model:
    """Counts all texts (column text, not null) and writes the trie to the shared folder."""
    spark = texts.sparkSession
    folder = scratch_path(spark, "ngrams")
    texts = texts.select("text")
    words = texts.mapInArrow(_word_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    words = materialise(words, "words")
    distinct, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    model = Model(order, (total // SHARD_NGRAMS).bit_length())
    shard = F.shiftrightunsigned("hash", 64 - model.bits) if model.bits else F.lit(0).cast("long")
    written = words.groupBy(shard.alias("shard")).applyInPandas(_write_words(folder), "shard long, path string, n long, total long")
    rows = materialise(written, "word-shards").collect()
    sizes = np.zeros((1 << model.bits) + 1, np.int64)
    for row in rows:
        model.words[row.shard] = row.path
        sizes[row.shard + 1] = row.n
    model.bases = np.cumsum(sizes)
    model.total, model.vocabulary = sum(r.total for r in rows), distinct
    for level in range(2, order + 1):
        blocks = texts.mapInArrow(_level_counts(model, level, min_count), "shard long, block binary")
        written = blocks.groupBy("shard").applyInPandas(_write_level(model, level, min_count, folder), "shard long, path string, n long")
        model.levels[level] = {r.shard: r.path for r in materialise(written, f"level{level}-shards").collect()}
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, held = batch.column("doc_id"), batch.column("held_out")
            for row, end, data, offs in text_chunks(batch.column("text")):
                steps = model.walk(data, offs, model.order)
                first, counts, logs = next(steps)
                base = logs.copy()
                for _ in steps:  # adds each order to ``logs``
                    pass
                starts, n = first[:-1], np.diff(first)
                arrays = [
                    docs[row:end], held[row:end], pa.array(n), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(n), model.total)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, order: int = ORDER, min_count: int = PRUNED, held_out_of: int = HELD_OUT_OF) -> DataFrame:
    """Scores every document by a model of those not held out.

    Takes doc_id and text; other columns are ignored. Returns doc_id, held_out (crc32 of the id
    as text, modulo ``held_out_of``, is 0), n_tokens, n_known (seen in training), train_tokens,
    base_score (add-0.1 words) and score, both log10. Null and empty texts are one end token. A
    document without id is held out. Rows that share an id are scored each by itself. If all are
    held out, every token is unknown. No rows give none.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_of == 0, F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model = train(texts.where("not held_out"), order, min_count)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.mapInArrow(_scored(model), schema)


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), ORDER, MIN_COUNT)
