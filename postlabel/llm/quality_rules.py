"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of target to corpus.

Words and pairs of words of a text are hashed into ``BUCKETS`` buckets. Two multinomials are
counted over them, a document counting once for each of its n-grams: one over all documents,
one over the trusted ones. A document's score is the mean, over its n-grams, of
log(target / corpus); it is kept if it passes the base rules and its score reaches a threshold
that is the same on every run.

Most n-grams tell nothing: their ratio is what chance makes of a few documents, and the mean of
hundreds of such would drown the two or three that tell. So an n-gram's ratio counts as far as
there is evidence for it, and else as 0: its share of trusted among the labelled documents that
hold it must be ``EVIDENCE`` standard deviations off the share among all, on the side of the ratio.

Half of the labelled documents, by hash of the id, are counted; the other half sets the
threshold. With untrusted labels it parts the two kinds best: the share of untrusted dropped less
``TRUST`` times the share of trusted dropped. Without, it is what all but ``MISSES`` in a thousand
trusted documents reach. So a document is held against labels that the counts have not seen.

Everything is DataFrame expressions over arrays. Only texts of the counted half meet labels,
always by the same shuffle; the corpus is counted and scored where it is read. The ratios reach the
tasks as constant arrays, a bit set of buckets with the numbers of bits before each word.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise, read

# For words, and as many again for pairs; a power of two.
BUCKETS = 1 << 20
EVIDENCE = 3.0
TRUST = 5
WINDOW = 5
MISSES = 2
STEP = 0.0001
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACES))


def _bucket(x: Column, first: int = 0) -> Column:
    # Bits and not a remainder and a sum: this is evaluated for each n-gram.
    low = x.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))
    return (low.bitwiseOR(F.lit(first).cast("long")) if first else low).cast("int")


def _apart(left: Column, right: Column, n: int, then) -> Column:
    """``then`` of each value of ``left`` and the one of ``right`` that is ``n`` places on."""
    size = F.greatest(F.size(right) - n, F.lit(0))
    return F.zip_with(F.slice(left, 1, size), F.slice(right, n + 1, size), then)


def hashed(docs: DataFrame) -> DataFrame:
    """Adds ``_words`` and their ``_hashes``."""
    return docs.withColumn("_words", words(F.col("text"))).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def ngram_buckets() -> Column:
    """Buckets of all words and pairs of words."""
    pairs = _apart(F.col("_hashes"), F.col("_hashes"), 1, lambda a, b: _bucket(F.xxhash64(a, b), BUCKETS))
    return F.concat(F.transform("_hashes", lambda x: _bucket(x)), pairs)


class Ratios:
    """Whole hundredths of log ratios by bucket, as constants that expressions index in place."""

    def __init__(self, found: Mapping[int, int]):
        bits, before, seen = [0] * (2 * BUCKETS // 64), [], 0
        for b in found:
            bits[b >> 6] |= 1 << (b & 63)
        for word in bits:
            before.append(seen)
            seen += word.bit_count()
        self.bits = self._constant([w - (1 << 64) if w >> 63 else w for w in bits], "bigint")
        self.before = self._constant(before, "int")
        self.values = self._constant([found[b] for b in sorted(found)] or [0], "int")
        self.below = self._constant([(1 << i) - 1 for i in range(64)], "bigint")

    @staticmethod
    def _constant(values: list[int], kind: str) -> Column:
        # Text, so that it is one constant and not thousands.
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")

    def holds(self, bucket: Column) -> Column:
        return F.getbit(F.get(self.bits, F.shiftright(bucket, 6)), bucket.bitwiseAND(63)) == F.lit(1).cast("tinyint")

    def of(self, bucket: Column) -> Column:
        """The ratio of a bucket that is held."""
        word, place = F.shiftright(bucket, 6), bucket.bitwiseAND(63)
        ahead = F.get(self.bits, word).bitwiseAND(F.get(self.below, place))
        return F.get(self.values, F.get(self.before, word) + F.bit_count(ahead))


def _half() -> Column:
    """0 for ids whose labels are counted, 1 for those that set the threshold; null without id."""
    return F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(2)))


def _labels(targets: DataFrame, untrusted: DataFrame | None) -> DataFrame:
    """(doc_id, _good): 1 for trusted, 0 for untrusted; an id that is both is untrusted."""
    labels = targets.select("doc_id", F.lit(1).alias("_good"))
    if untrusted is not None:
        labels = labels.unionByName(untrusted.select("doc_id", F.lit(0).alias("_good")))
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("_good").alias("_good"))


def telling_buckets(docs: DataFrame, targets: DataFrame, untrusted: DataFrame | None) -> tuple[dict[int, tuple[int, float]], int]:
    """Trusted documents and deviation by bucket for which there is evidence, and all n-grams of trusted ones.

    Without untrusted ids all other documents of the counted half stand for them.
    """
    counted = docs.select("doc_id", "text").where(_half() == 0)
    labels = _labels(targets, untrusted).where(_half() == 0)
    marked = counted.join(labels.hint("merge"), "doc_id", "inner" if untrusted is not None else "left")
    grams = hashed(marked.withColumn("_good", F.coalesce("_good", F.lit(0))))
    # One more entry for each document (-1) gives the numbers of documents.
    buckets = F.concat(F.array(F.lit(-1)), F.array_distinct(ngram_buckets()))
    seen = grams.select("_good", F.explode(buckets).alias("bucket"))
    counts = materialise(seen.groupBy("bucket").agg(F.sum("_good").alias("good"), F.count("*").alias("n")), "telling-buckets")
    every = counts.where("bucket = -1").first()
    share = every.good / every.n if every else 0
    if not 0 < share < 1:
        return {}, 0
    expected = F.col("n") * share
    deviation = (F.col("good") - expected) / F.sqrt(expected * (1 - share))
    # At most as many rows as there are buckets.
    told = counts.where("bucket >= 0").withColumn("z", deviation).where(F.abs("z") >= EVIDENCE).collect()
    total = counts.where("bucket >= 0").agg(F.sum("good")).first()[0]
    return {r.bucket: (r.good, r.z) for r in told}, total


def log_ratios(docs: DataFrame, targets: DataFrame, untrusted: DataFrame | None) -> Ratios:
    """The ratios of all buckets for which there is evidence, from documents and labelled doc_ids."""
    told, target_total = telling_buckets(docs, targets, untrusted)
    if not told:
        return Ratios({})
    held = Ratios(dict.fromkeys(told, 0))
    every = hashed(docs.select("text")).select(F.array_distinct(ngram_buckets()).alias("_grams"))
    own = F.transform(F.filter("_grams", held.holds), lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("n")))
    total = F.struct(F.lit(-1).alias("bucket"), F.size("_grams").alias("n"))
    counts = every.select(F.inline(F.concat(F.array(total), own))).groupBy("bucket").agg(F.sum("n").alias("n"))
    corpus = {r.bucket: r.n for r in counts.collect()}
    base = math.log((corpus[-1] + 2 * BUCKETS) / (target_total + 2 * BUCKETS))
    found = {}
    for bucket, (good, z) in told.items():
        ratio = round(100 * (math.log((good + 1) / (corpus.get(bucket, 0) + 1)) + base))
        if ratio * z > 0:
            found[bucket] = ratio
    return Ratios(found)


def _labelled_steps(scores: DataFrame, labels: DataFrame) -> list:
    """(step, good, n) in order: labelled documents by score in steps, which are bounded by the range of ratios."""
    step = F.floor(F.col("score") / STEP).alias("step")
    rows = scores.where("not base_failed").join(labels.where(_half() == 1).hint("merge"), "doc_id")
    return rows.groupBy(step).agg(F.sum("_good").alias("good"), F.count("*").alias("n")).orderBy("step").collect()


def parting(steps: list) -> int | None:
    """The least step to keep, which parts trusted from untrusted documents best; None without both."""
    good, bad = sum(r.good for r in steps), sum(r.n - r.good for r in steps)
    if not good or not bad:
        return None
    best, limit, lost, gone = 0.0, None, 0, 0
    for r, after in zip(steps, steps[1:], strict=False):
        lost, gone = lost + r.good, gone + r.n - r.good
        gain = gone / bad - TRUST * lost / good
        if gain > best:
            best, limit = gain, after.step
    return limit


def reached(steps: list, misses: int) -> int | None:
    """The step that all but ``misses`` in a thousand trusted documents reach; None without any."""
    allowed, gone = sum(r.good for r in steps) * misses // 1000, 0
    for r in steps:
        gone += r.good
        if gone > allowed:
            return r.step
    return None


def _repeated_words() -> tuple[Column, Column]:
    """Windows by hash, and in text order the places of those that occur twice or more."""
    pairs = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = F.transform(
        "_sorted",
        lambda e, i: F.when((e["x"] == F.get("_sorted", i - 1)["x"]) | (e["x"] == F.get("_sorted", i + 1)["x"]), e["i"]),
    )
    return pairs, F.sort_array(F.filter(same, lambda x: x.isNotNull()))


def _windows() -> Column:
    """Hashes of all windows in text order."""
    words = F.col("_hashes")
    # Of two words, of one more, and so on, as arrays side by side: nothing is looked up by place.
    found = words
    for n in range(1, WINDOW):
        found = _apart(found, words, n, lambda a, b: F.xxhash64(a, b))
    return found


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the five counts and base_failed to ``hashed`` documents."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    pairs, places = _repeated_words()
    docs = docs.withColumn("_windows", _windows()).withColumn("_lines", lines)
    none = F.size(F.array_distinct("_windows")) == F.size("_windows")
    docs = docs.withColumn("_sorted", F.when(~none, pairs)).withColumn("_places", places)
    covered = F.transform("_places", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - x, F.lit(WINDOW))))
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


def quality_scores(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """doc_id, the base counts, base_failed and score of every document."""
    rows = base_counts(hashed(docs.select("doc_id", "text")))
    n = 2 * F.size("_hashes") - 1
    told = F.filter(ngram_buckets(), ratios.holds)
    total = F.aggregate(told, F.lit(0).cast("long"), lambda s, b: s + ratios.of(b))
    score = F.when(n > 0, total / (100 * n)).otherwise(F.lit(0.0))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(*names, score.alias("score"))


def judge(docs: DataFrame, targets: DataFrame, misses: int = MISSES, untrusted: DataFrame | None = None) -> DataFrame:
    """Base counts, score and verdict of every document, from trusted doc_ids (``targets``) and untrusted ones.

    Takes doc_id and text; other columns are ignored. Returns doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept. A null or empty text has
    no words, fails the base and scores 0. Rows that share an id are judged each by itself, and
    all are trusted if the id is; a row without id is judged but never trusted. A score that
    equals the threshold is kept. Without trusted documents, or where no threshold parts the
    labels, all that pass the base are kept. No rows give none.
    """
    scores = materialise(quality_scores(docs, log_ratios(docs, targets, untrusted)), "quality-scores")
    steps = _labelled_steps(scores, _labels(targets, untrusted))
    limit = reached(steps, misses) if untrusted is None else parting(steps)
    kept = ~F.col("base_failed")
    if limit is not None:
        kept &= F.floor(F.col("score") / STEP) >= limit
    return scores.withColumn("kept", kept)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    trusted, untrusted = labels.where("quality = 1 and toxic = 0"), labels.where("quality = 0 or toxic = 1")
    return judge(read(spark, sf_dir, "documents"), trusted, untrusted=untrusted)
