"""Spelling variants: words one letter apart, grouped under their most frequent forms.

Two words that differ by one inserted, deleted or replaced code point have a half in common:
an error in one half of a word leaves the other as it is, as a beginning or an end of both
words. So words meet by their halves. A word is looked for in the shard of its first half and
in that of its second, and stands in the shards of all the beginnings and ends that words
with it in reach may have as halves (those of words one shorter, as long, or one longer). Each
shard is a bidirectional FM-index; one half is matched exactly, the search goes on across the
other with one error.

The vocabulary is counted with partial sums in every task and written. Shards are as many as
keep them small on average. A shard that a common half makes larger is a grid: its words are
dealt to parts, its queries too, and each cell of the grid searches one part of the queries in
one part of the words, so no task gets more than ``SHARD_WORDS`` of each on average.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fm_index import Bidirectional
from .periodic_runs import CRC_TABLE_SQL, crc_sql
from .store import materialise, read

MIN_LENGTH = 6
MIN_COUNT = 5
# A form occurs at least so many times as often as its variant.
FACTOR = 5
SHARD_WORDS = 1 << 14
# Queries searched in step.
TOGETHER = 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]+"
WORD, FIRST_HALF, SECOND_HALF = range(3)


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of a table of words, one row for each time a word occurs."""
    long = words.where(F.length("word") >= min_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _halves(side: int, length: Column) -> Column:
    """The half of a word of this length, as a key."""
    half = F.substring("word", 1, length) if side == FIRST_HALF else F.substring("word", F.length("word") - length + 1, length)
    return F.xxhash64(F.lit(side), half)


def _cells(words: DataFrame, shards: int) -> DataFrame:
    """Each word as a query and as an index entry, in the cells of the grid where they meet."""
    n = F.length("word").cast("int")
    # A word of m letters has halves of m // 2 and m - m // 2.
    firsts = [(n - 1 + i) / 2 for i in range(3)]
    seconds = [n - 1 + i - F.floor((n - 1 + i) / 2) for i in range(3)]
    keys = [_halves(FIRST_HALF, F.floor(x).cast("int")) for x in firsts] + [_halves(SECOND_HALF, x.cast("int")) for x in seconds]
    entries = F.transform(F.array_distinct(F.transform(F.array(*keys), lambda k: F.pmod(k, F.lit(shards)))), lambda s: F.struct(s.alias("shard"), F.lit(WORD).alias("role")))
    asked = [F.struct(F.pmod(keys[1], F.lit(shards)).alias("shard"), F.lit(FIRST_HALF).alias("role")), F.struct(F.pmod(keys[4], F.lit(shards)).alias("shard"), F.lit(SECOND_HALF).alias("role"))]
    rows = words.select("word", "n", F.inline(F.concat(entries, F.array(*asked))))
    # A row for each shard, of which there is one in SHARD_WORDS / 4 words.
    is_word = F.col("role") == WORD
    parts = rows.groupBy("shard").agg(
        F.ceil(F.count_if(is_word) / SHARD_WORDS).alias("word_parts"), F.ceil(F.count_if(~is_word) / SHARD_WORDS).alias("query_parts")
    )
    dealt = F.xxhash64("word", F.lit(1))
    sized = rows.join(F.broadcast(parts), "shard").where("word_parts > 0 AND query_parts > 0")
    own = F.when(is_word, F.pmod(dealt, "word_parts")).otherwise(F.pmod(dealt, "query_parts"))
    across = F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_word, F.col("query_parts")).otherwise(F.col("word_parts")) - 1))
    spread = sized.select("shard", "role", "word", "n", own.alias("own"), across.alias("across"))
    return spread.select(
        "shard", "role", "word", "n", F.when(is_word, F.col("own")).otherwise(F.col("across")).alias("word_part"), F.when(is_word, F.col("across")).otherwise(F.col("own")).alias("query_part")
    )


def _searched(cell: pa.Table) -> pa.Table:
    role, n = cell.column("role").to_numpy(), cell.column("n").to_pylist()
    text = cell.column("word").to_pylist()
    indexed = sorted((text[i], n[i]) for i in (role == WORD).nonzero()[0])
    found: list[list] = [[], [], [], []]
    if indexed:
        index = Bidirectional([w for w, _ in indexed])
        for half in (FIRST_HALF, SECOND_HALF):
            asked = (role == half).nonzero()[0].tolist()
            for a in range(0, len(asked), TOGETHER):
                part = asked[a : a + TOGETHER]
                for q, w in sorted(set(zip(*(x.tolist() for x in index.one_error([text[i] for i in part], half == SECOND_HALF)), strict=True))):
                    for column, value in zip(found, (text[part[q]], n[part[q]], *indexed[w]), strict=True):
                        column.append(value)
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one code point apart, once.

    ``words`` (word, n) are distinct and not empty.
    """
    shards = 4 * words.count() // SHARD_WORDS + 1
    cells = _cells(words, shards).groupBy("shard", "word_part", "query_part")
    found = cells.applyInArrow(_searched, "word string, n long, near string, near_n long")
    # Dealt by word once, for this step and for sums by word after it.
    return found.repartition("word").distinct()


def group_variants(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """Each word's form and the root of its chain of forms, from a table with a column word.

    Words are the distinct values of at least ``min_length`` code points that occur
    ``min_count`` times; null and shorter ones are left out. A word's form is its near word that
    occurs most often, the first in code-point order of equals, if it occurs ``factor`` times as
    often as the word; else null. The root is found by following forms to the last; it is the
    word itself if it has no form. Returns word, form, root, n, n_near, form_n. No rows give none.
    """
    counted = materialise(vocabulary(words.select(F.col("word").cast("string").alias("word")), min_length, min_count), "vocabulary")
    by_word = near_words(counted).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    )
    enough = -F.col("best.order") >= factor * F.col("n")
    best = materialise(by_word.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n")), "near-words")
    roots = best.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # Every step multiplies the count, so a chain is at most so long; each round doubles the steps.
    most = counted.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(most, factor)) + 1
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = materialise(roots.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return (
        counted.join(best.hint("merge"), "word", "left")
        .join(roots.hint("merge"), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )


# --- query --------------------------------------------------------------------


def with_planted_slips(docs: DataFrame) -> DataFrame:
    """The words of documents (doc_id, text), one code point gone where the contract says so."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    lowered = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return lowered.select(F.when(h % 199 == 0, slip).otherwise(F.col("run")).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(with_planted_slips(read(spark, sf_dir, "documents")))


_BYTES = "flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END FOR x IN string_split(doc_id || ':' || run, '')])"

# Words are near if taking a code point out of the one gives the other, or taking it out of the same
# place of both gives the same.
OP13_SQL = rf"""WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, c, coalesce({crc_sql(_BYTES)}, 1)::BIGINT AS h FROM counted, crc_table),
slipped AS (
  SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
vocabulary AS (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
deleted AS (SELECT DISTINCT l.word, l.n, v.word AS near, v.n AS near_n FROM less l JOIN vocabulary v ON v.word = l.rest),
near AS (
  SELECT word, n, near, near_n FROM deleted
  UNION SELECT near, near_n, word, n FROM deleted
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, n, count(*) AS n_near, arg_min(struct_pack(w := near, c := near_n), (-near_n, near)) AS b FROM near GROUP BY word, n),
forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.b.c >= 5 * v.n THEN b.b.w END AS form,
    CASE WHEN b.b.c >= 5 * v.n THEN b.b.c END AS form_n
  FROM vocabulary v LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS root, form AS following FROM forms
  UNION ALL SELECT c.word, c.following, f.form FROM chain c JOIN forms f ON f.word = c.following)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.following IS NULL"""
