"""Language of documents by a linear-chain conditional random field over their words.

Every run of letters is a word of the chain, its language the label. A word's features are
hashed: its first and last one to three letters, all its letter trigrams with the word's
ends, and the word itself (the lexicon). Weights of features and transitions between
languages are learned together, by the likelihood of training chains in which pieces of
different documents follow one another, so that the cost of a switch is learned as well.
Forward-backward gives each word's probabilities; a document's are their mean.

Documents of a batch go through forward-backward in step, longest first. Long ones are cut into
blocks of ``BLOCK`` words: the product of a block's transition matrices tells how what comes in at
one end goes out at the other, so the messages between blocks are known before any block is run, and
all blocks of all documents are run in step.

The model is fitted on a bounded sample: at most ``DOCS_PER_LANG`` labelled documents of a
language, ``PIECES`` pieces of ``PIECE_WORDS`` words from anywhere in each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import read
from .vector import U, mix, prefix_sums, span_hash, text_chunks, word_bounds

FEATURE_BITS = 16
AFFIXES = (1, 2, 3)
DOCS_PER_LANG = 200
PIECES = 8
PIECE_WORDS = 30
PIECES_IN_CHAIN = 4
STEPS = 60
RATE = 0.3
PENALTY = 1e-5
UNKNOWN = "und"
CHUNK = 1 << 19
# Words of a block that forward-backward runs through one after another.
BLOCK = 512

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter; made once by each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_words(texts: list[str]):
    """Code points of the lower-cased texts, starts and ends of words, each text's first word."""
    texts = [x.lower() for x in texts]
    offs = np.cumsum([0, *map(len, texts)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, *word_bounds(codes, offs, letter_table())


def features(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the given words in a row, and where each word's begin."""
    size = ends - starts
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(starts - begin, size)
    wide = np.concatenate([[0], codes, [0]]).astype(U)
    left, own, right = wide[at], wide[at + 1], wide[at + 2]
    left[begin] = 0
    right[begin + size - 1] = 0
    mask = U((1 << FEATURE_BITS) - 1)
    grams = mix((left << U(42)) ^ (own << U(21)) ^ right) & mask
    sums, inverse = prefix_sums(mix(codes.astype(U) + U(1)))
    rest = [span_hash(sums, inverse, starts, ends)]
    for n in AFFIXES:
        rest.append(mix(span_hash(sums, inverse, starts, np.minimum(starts + n, ends)) + U(n)))
        rest.append(mix(span_hash(sums, inverse, np.maximum(ends - n, starts), ends) + U(16 + n)))
    fixed = np.stack(rest, axis=1) & mask
    width = fixed.shape[1]
    first = begin + width * np.arange(len(starts))
    flat = np.empty(len(at) + fixed.size, np.int64)
    slots = first[:, None] + np.arange(width)
    flat[slots] = fixed
    taken = np.zeros(len(flat), bool)
    taken[slots] = True
    flat[~taken] = grams
    return flat, first


def distinct_words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct words, and for each word which of them it is."""
    sums, inverse = prefix_sums(mix(codes.astype(U) + U(1)))
    _, one, back = np.unique(span_hash(sums, inverse, starts, ends), return_index=True, return_inverse=True)
    return one, back


def _in_step(first: np.ndarray) -> Iterator[np.ndarray]:
    """The words at each place of all stretches that reach it, in order; ``first`` is where each starts, and the end."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    head = first[:-1][order]
    for t, n in enumerate(np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")):
        yield order[:n], head[:n] + t


def _scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def marginals(scores: np.ndarray, first: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, and expected numbers of transitions, by forward-backward.

    ``scores`` are log weights of words and labels, ``first`` the index of each chain's first
    word, ``switch`` the weights (not logs) of transitions.
    """
    size = scores.shape[1]
    if not len(scores):
        return np.empty((0, size)), np.zeros_like(switch)
    weight = np.exp(scores - scores.max(axis=1, keepdims=True))
    chain = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # Blocks: where they start, and whether a chain does there.
    starts = np.flatnonzero((np.arange(len(scores)) - first[chain]) % BLOCK == 0)
    cuts = np.append(starts, len(scores))
    opens = starts == first[chain[starts]]
    incoming, outgoing = np.ones((len(starts), size)), np.ones((len(starts), size))
    if not opens.all():
        incoming, outgoing = _between(weight, cuts, opens, switch)
    forward, backward = np.empty_like(weight), np.empty_like(weight)
    state = np.empty((len(starts), size))
    for t, (own, at) in enumerate(_in_step(cuts)):
        came = np.where(opens[own, None], 1.0, incoming[own] @ switch) if t == 0 else state[own] @ switch
        state[own] = came * weight[at]
        state[own] /= state[own].sum(axis=1, keepdims=True)
        forward[at] = state[own]
    state = outgoing.copy()
    for own, at in reversed(list(_in_step(cuts))):
        last = at == cuts[own + 1] - 1
        ahead = np.minimum(at + 1, len(scores) - 1)
        message = np.where(last[:, None], outgoing[own], (weight[ahead] * state[own]) @ switch.T)
        state[own] = message / message.sum(axis=1, keepdims=True)
        backward[at] = state[own]
    found = forward * backward
    # Pairs of words in a row of one chain.
    left = np.flatnonzero(chain[:-1] == chain[1:])
    after = weight[left + 1] * backward[left + 1]
    through = np.einsum("ni,ni->n", forward[left] @ switch, after)
    pairs = (forward[left].T @ (after / np.maximum(through, 1e-300)[:, None])) * switch
    return found / np.maximum(found.sum(axis=1, keepdims=True), 1e-30), pairs


def _between(weight: np.ndarray, cuts: np.ndarray, opens: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes into each block from before, and into its last word from behind.

    The product of a block's matrices takes the last word of the block before to the block's last; an opening block has
    no transition into its first word.
    """
    size = weight.shape[1]
    product = np.broadcast_to(np.eye(size), (len(opens), size, size)).copy()
    for t, (own, at) in enumerate(_in_step(cuts)):
        step = product[own] if t == 0 else product[own] @ switch
        if t == 0:
            step = np.where(opens[own, None, None], step, step @ switch)
        product[own] = _scaled(step * weight[at][:, None, :], (1, 2))
    incoming, outgoing = np.ones((len(opens), size)), np.ones((len(opens), size))
    # Blocks of all chains in step: the first of each, then the second, and so on.
    chains = np.append(np.flatnonzero(opens), len(opens))
    rounds = list(_in_step(chains))
    state = np.ones((len(chains) - 1, size))
    for own, at in rounds:
        incoming[at] = state[own]
        state[own] = _scaled(np.einsum("ni,nij->nj", state[own], product[at]), (1,))
    state = np.ones((len(chains) - 1, size))
    for own, at in reversed(rounds):
        outgoing[at] = state[own]
        state[own] = _scaled(np.einsum("nij,nj->ni", product[at], state[own]), (1,))
    return incoming, outgoing


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    switch: np.ndarray

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of every word, and the index of each text's first word."""
        codes, starts, ends, first = letter_words(texts)
        if not len(starts):
            return np.empty((0, len(self.labels))), first
        one, back = distinct_words(codes, starts, ends)
        flat, begin = features(codes, starts[one], ends[one])
        scores = np.add.reduceat(self.weights[flat], begin)[back]
        return marginals(scores, first, self.switch)[0], first


def fit(pieces: list[tuple[str, str]]) -> Model | None:
    """Learns weights from (language, text) pieces by full-batch adaptive gradient steps."""
    labels = sorted({lang for lang, _ in pieces})
    pieces = sorted(pieces)
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(pieces))
    texts = [pieces[i][1] for i in order]
    codes, starts, ends, first = letter_words(texts)
    if not len(starts):
        return None
    truth = np.repeat([labels.index(pieces[i][0]) for i in order], np.diff(first))
    chains = np.append(first[:-1:PIECES_IN_CHAIN], first[-1])
    one, back = distinct_words(codes, starts, ends)
    flat, begin = features(codes, starts[one], ends[one])
    counts = np.diff(np.append(begin, len(flat)))
    size, n = len(labels), len(starts)
    weights, switch = np.zeros((1 << FEATURE_BITS, size)), np.zeros((size, size))
    seen_w, seen_s = np.full(weights.shape, 1e-8), np.full(switch.shape, 1e-8)
    inner = np.ones(n, bool)
    inner[chains[:-1][np.diff(chains) > 0]] = False
    there = np.zeros((size, size))
    np.add.at(there, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    for _ in range(STEPS):
        scores = np.add.reduceat(weights[flat], begin)[back]
        found, pairs = marginals(scores, chains, np.exp(switch))
        found[np.arange(n), truth] -= 1
        for label in range(size):
            own = np.repeat(np.bincount(back, found[:, label], len(one)), counts)
            slope = np.bincount(flat, own, 1 << FEATURE_BITS) / n + PENALTY * weights[:, label]
            seen_w[:, label] += slope**2
            weights[:, label] -= RATE * slope / np.sqrt(seen_w[:, label])
        slope = (pairs - there) / n + PENALTY * switch
        seen_s += slope**2
        switch -= RATE * slope / np.sqrt(seen_s)
    return Model(labels, weights.astype(np.float32), np.exp(switch).astype(np.float32))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps (lang, text) to pieces from places drawn by the text's own checksum."""
    for batch in batches:
        langs, pieces = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            codes, starts, ends, _ = letter_words([text])
            blocks = -(-len(starts) // PIECE_WORDS)
            drawn = np.random.Generator(np.random.PCG64(len(codes) + int(codes.sum()))).permutation(blocks)[:PIECES] if blocks else []
            lower = text.lower()
            for block in sorted(drawn):
                a, b = block * PIECE_WORDS, min(len(starts), (block + 1) * PIECE_WORDS) - 1
                langs.append(lang)
                pieces.append(lower[starts[a] : ends[b]])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.string())], names=["lang", "text"])


def train(docs: DataFrame) -> Model | None:
    """Fits a model on a bounded sample of labelled documents (doc_id, text, lang)."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= DOCS_PER_LANG)
    ids = [r.doc_id for r in drawn.select("doc_id").collect()]
    if not ids:
        return None
    sample = docs.where(F.col("doc_id").isin(ids) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return fit([(r.lang, r.text) for r in sample.mapInArrow(_cut, "lang string, text string").collect()])


def _predicted(model: Model | None, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, words = [], [], []
            texts = batch.column("row").field(column).cast(pa.string())
            for row, end, *_ in text_chunks(texts, CHUNK):
                part = [x or "" for x in texts.slice(row, end - row).to_pylist()]
                if model is None:
                    found, first = np.empty((0, 1)), np.zeros(len(part) + 1, int)
                else:
                    found, first = model.words(part)
                n = np.diff(first)
                mean = np.zeros((len(part), found.shape[1]))
                if len(found):
                    mean[n > 0] = np.add.reduceat(found.astype(float), first[:-1][n > 0]) / n[n > 0, None]
                best = mean.argmax(axis=1)
                langs += [model.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)]
                scores.append(np.clip(mean.max(axis=1), 0, 1))
                words.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(langs, pa.string()), *(pa.array(np.concatenate(x or [np.empty(0)]), k) for x, k in ((scores, pa.float64()), (words, pa.int64())))],
                names=["row", "lang_pred", "score", "n_words"],
            )

    return run


def held_out(column: str = "doc_id") -> Column:
    """True for documents that a model must not learn from; those without id are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """The language of every document, learned from those not held out (doc_id, text, lang).

    Returns row (a struct of all columns of the document, whatever their names), lang_pred,
    score (the mean probability of that language over words) and n_words. A text that is null
    or has no letter is ``und`` with score 0, and so is all if nothing is labelled. Ties go to
    the first language in order. No rows give none.
    """
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    rows = docs.select(F.struct("*").alias("row"))
    kinds = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("n_words", T.LongType()))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(*x) for x in kinds)])
    return rows.mapInArrow(_predicted(model, "text"), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "n_words")
