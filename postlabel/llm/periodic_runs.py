"""Periodic runs of words, found in tiles by period octave and stitched by document and period.

A run is a stretch of words with smallest period q (words q apart are identical) of at least
``MIN_WORDS`` and ``EXPONENT`` * q words that no neighbouring word extends. In terms of
matches, places i at which words i and i + q are identical, it is an unbroken interval of at
least (``EXPONENT`` - 1) * q places.

An octave holds the periods from P up to 2 P. A document is cut at every multiple of 2 P
words, and the tile of a cut reaches 2 P words back and 4 P ahead, so tiles overlap. An
interval of an octave is at least 3 P long, so it has a cut in it. In each tile two Z-functions
from the cut, one ahead and one back, give for every period how far matches go on both sides,
up to the next cuts. Periods below ``LEAST`` are one octave in which every word is a cut: words
are compared with those q places on.

    scan    whole texts, cut into tiles where they are read; only tiles that can hold a part of a
            run are sent on (one of two eight-word stretches must occur again at the same
            distance), and none whose words around the cut have a smaller period anyway
    solve   tiles dealt over all tasks, each solved by itself
    stitch  intervals that touch are joined by document and period
    drop    only documents that may have a run are joined with their runs

Words are compared by 64-bit hashes within a document, tiles hold numbers of words.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialise, read
from .vector import U, mix, shingle_hashes, text_chunks, word_bounds, word_hashes

MIN_WORDS = 6
EXPONENT = 4
# Periods below this are compared word by word; the octaves begin here.
LEAST = 16
GRAM = 8
# Pairs of a cut and a period looked at together.
BLOCK = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"
SETTLED, OPEN, TILE, INTERVAL = range(4)


def primes_of(n: int) -> list[int]:
    """The distinct prime factors of n."""
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return found + [n] if n > 1 else found


def z_function(words: array) -> array:
    """For each place, how many words from there on are the same as from the first on."""
    n = len(words)
    z = array("i", bytes(4 * n))
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def has_period(codes: np.ndarray, start: int, stop: int, period: int) -> bool:
    return np.array_equal(codes[start : stop - period], codes[start + period : stop])


# --- scan ---------------------------------------------------------------------


def short_intervals(codes: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, first match, end of matches) of all runs of periods below ``LEAST``.

    ``left`` is the number of words from each word to the end of its document.
    """
    found = []
    for q in range(1, LEAST):
        if len(codes) <= q:
            break
        same = np.zeros(len(codes) - q + 2, np.int8)
        same[1:-1] = (codes[:-q] == codes[q:]) & (left[:-q] > q)
        edges = np.flatnonzero(np.diff(same))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= max(MIN_WORDS - q, (EXPONENT - 1) * q)
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            if not any(has_period(codes, a, a + q, q // r) for r in primes_of(q)):
                found.append((q, a, b))
    return found


def likely_cuts(grams: np.ndarray, codes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """The cuts of an octave whose tiles may hold a part of a run, in rising order.

    ``grams`` are hashes of ``GRAM`` words in a row, with numbers of their own where a document
    ends sooner and one more at the end. A tile that holds matches 1.5 ``size`` places ahead of
    the cut has them at the cut and ``size`` words on; the same holds backwards.
    """
    n = np.diff(first)
    whole = np.flatnonzero(n >= EXPONENT * size)
    count = (n[whole] - size) // (2 * size)
    cuts = np.repeat(first[whole] - 2 * size * (np.cumsum(count) - count), count) + 2 * size * (np.arange(count.sum()) + 1)
    ends = np.repeat(first[whole + 1], count)
    last, kept = len(grams) - 1, []
    step = max(1, BLOCK // size)
    for i in range(0, len(cuts), step):
        at, end = cuts[i : i + step], ends[i : i + step]
        found: dict[int, set[int]] = {}
        for here, there in ((at, at + size), (at - GRAM, at - GRAM - size)):
            near = np.minimum(here[:, None] + np.arange(size, 2 * size), last)
            row, period = np.nonzero(grams[near] == grams[np.minimum(here, last)][:, None])
            far = there[row]
            same = grams[np.minimum(far, last)] == grams[np.minimum(far + period + size, last)]
            for r, q in zip(row[same].tolist(), (period[same] + size).tolist(), strict=True):
                found.setdefault(r, set()).add(q)
        kept += [int(at[r]) for r, periods in sorted(found.items()) if not repeats(codes, int(at[r]), int(end[r]), periods)]
    return np.array(kept, np.int64)


def repeats(codes: np.ndarray, cut: int, end: int, periods: set[int]) -> bool:
    """True if the words from the cut on show that each of the periods has a smaller one in it.

    A run through the cut with period q holds the q words from there on.
    """
    longest = max(periods)
    if cut + longest > end:
        return False
    if len(periods) > 1:
        # Two of them differ by less than the smaller, and so does their greatest common divisor.
        return has_period(codes, cut, cut + longest, int(np.gcd.reduce(list(periods))))
    return any(has_period(codes, cut, cut + longest, longest // r) for r in primes_of(longest))


def squeezed(data: np.ndarray, offs: np.ndarray, starts, ends, first, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[keep]] += 1
    inside[ends[keep]] -= 1
    taken = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[keep]
    gaps = ends[keep][:-1][text[:-1] == text[1:]]
    out = data.copy()
    out[gaps] = 0x20
    taken[gaps] = True
    sizes = np.concatenate([[0], np.cumsum(taken)])[offs].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(sizes), pa.py_buffer(out[taken])).cast(pa.string())


def _scanned(schema: T.StructType):
    names = schema.fieldNames()

    def rows(count: int, like: pa.DataType, **columns) -> pa.RecordBatch:
        kinds = {"row": like, "text": pa.string(), "words": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(columns[k], pa.int64()) if k in columns and k not in kinds else columns[k] if k in columns else pa.nulls(count, kinds.get(k, pa.int64())) for k in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts = batch.column("row"), batch.column("text")
            keys = np.asarray(batch.column("key"))
            for a, b, data, offs in text_chunks(texts):
                starts, ends, first = word_bounds(data, offs)
                hashes, _ = word_hashes(data, offs, lower=False)
                codes = np.unique(hashes, return_inverse=True)[1].astype(np.int32)
                left = np.repeat(first[1:], np.diff(first)) - np.arange(len(codes))
                owner = np.repeat(np.arange(b - a), np.diff(first))
                short = short_intervals(codes, left)
                doc = owner[[x[1] for x in short]] if short else np.empty(0, np.int64)
                is_open = np.zeros(b - a, bool)
                is_open[doc] = True
                if short:
                    q, lo, hi = np.array(short, np.int64).T
                    yield rows(len(short), row.type, kind=[INTERVAL] * len(short), key=keys[a:b][doc], period=q, lo=lo - first[doc], hi=hi - first[doc])
                grams = mix(np.arange(len(codes) + 1, dtype=U) + U(len(codes)))
                full = np.flatnonzero(left >= GRAM)
                grams[full] = shingle_hashes(hashes, GRAM)[full]
                size, most = LEAST, int(np.diff(first).max(initial=0))
                while EXPONENT * size <= most:
                    for cut in likely_cuts(grams, codes, first, size).tolist():
                        d = owner[cut]
                        is_open[d] = True
                        piece = codes[cut - 2 * size : min(cut + 4 * size, first[d + 1])]
                        yield rows(1, row.type, kind=[TILE], key=[keys[a + d]], period=[size], lo=[cut - first[d]], words=pa.array([piece.tobytes()], pa.binary()))
                    size *= 2
                kept = squeezed(data, offs, starts, ends, first, np.ones(len(codes), bool))
                for kind, which in ((SETTLED, ~is_open), (OPEN, is_open)):
                    at = np.flatnonzero(which)
                    if len(at):
                        yield rows(len(at), row.type, kind=[kind] * len(at), key=keys[a:b][at], row=row.slice(a, b - a).take(pa.array(at)), n_words=np.diff(first)[at], text=kept.take(pa.array(at)))

    return run


# --- solve --------------------------------------------------------------------


def solve(words: array, size: int) -> list[tuple[int, int, int]]:
    """(period, matches before the cut, matches from it on) of the parts of runs in a tile.

    The cut stands 2 * ``size`` words into the tile. A part ends within the tile or goes on to
    the next cut, where the next tile's begins.
    """
    lead, n = 2 * size, len(words)
    ahead = z_function(words[lead:])
    reach = min(n, 2 * lead)
    back = z_function(words[lead - 1 :: -1] + array("i", [-1]) + words[reach - 1 :: -1])
    q = np.arange(size, min(2 * size - 1, n - lead) + 1)
    right = np.append(np.frombuffer(ahead, np.int32), 0)[q].clip(max=lead)
    left = np.frombuffer(back, np.int32)[lead + 1 + reach - lead - q]
    whole = (left + right >= (EXPONENT - 1) * q) | (left == lead) | (right == lead)
    found = []
    for period, a, b in zip(q[whole].tolist(), left[whole].tolist(), right[whole].tolist(), strict=True):
        smaller = (period // r for r in primes_of(period))
        if not any(ahead[p] >= period - p for p in smaller):
            found.append((period, a, b))
    return found


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for key, size, cut, words in zip(*(batch.column(k) for k in ("key", "period", "lo", "words")), strict=True):
            at = cut.as_py()
            out += [(key.as_py(), q, at - a, at + b) for q, a, b in solve(array("i", words.as_py()), size.as_py())]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "period", "lo", "hi"])


# --- stitch and drop ----------------------------------------------------------


def stitch(intervals: DataFrame) -> DataFrame:
    """Runs by document from intervals of matches (key, period, lo, hi) that may touch or overlap.

    A group is one period of one document, with two intervals a tile at most.
    """
    order = Window.partitionBy("key", "period").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("lo") <= before, 0).otherwise(1)
    island = intervals.withColumn("begins", begins).withColumn("island", F.sum("begins").over(order))
    matches = island.groupBy("key", "period", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("lo")
    long = (length >= (EXPONENT - 1) * F.col("period")) & (length + F.col("period") >= MIN_WORDS)
    run = F.struct(F.col("lo").alias("start"), "period", (length + F.col("period")).alias("length"))
    return matches.where(long).groupBy("key").agg(F.sort_array(F.collect_list(run)).alias("runs"))


def _dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, n_words, texts, runs = (batch.column(k) for k in ("row", "n_words", "text", "runs"))
        for a, b, data, offs in text_chunks(texts):
            starts, ends, first = word_bounds(data, offs)
            part = runs.slice(a, b - a)
            flat, counts = part.flatten(), np.diff(np.asarray(part.offsets))
            begin, length, period = (np.asarray(flat.field(k)) for k in ("start", "length", "period"))
            base = np.repeat(first[:-1], counts)
            depth = np.zeros(len(starts) + 1, np.int64)
            np.add.at(depth, base + begin + period, 1)
            np.add.at(depth, base + begin + length, -1)
            keep = np.cumsum(depth)[:-1] == 0
            kept = squeezed(data, offs, starts, ends, first, keep)
            yield pa.RecordBatch.from_arrays([row.slice(a, b - a), n_words.slice(a, b - a), part, kept], names=["row", "n_words", "runs", "kept_text"])


def drop_periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The runs of every document and its text without their repetitions.

    Returns row (a struct of all other columns, whatever their names), n_words, runs (start,
    period and length in words, in this order; empty if there are none) and kept_text:
    the words that no run holds after its first period, joined by one space. Null and empty
    texts have no words and an empty kept_text. Equal rows are documents of their own, ids are not looked at. No rows
    give none.
    """
    runs_type = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "period", "length")]))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    source = docs.select(F.struct(*others).alias("row"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("key"))
    row = T.StructField("row", source.schema["row"].dataType)
    longs = [T.StructField(k, T.LongType()) for k in ("kind", "key", "n_words", "period", "lo", "hi")]
    schema = T.StructType([*longs, row, T.StructField("text", T.StringType()), T.StructField("words", T.BinaryType())])
    found = materialise(source.mapInArrow(_scanned(schema), schema), "periods")
    # One tile after another goes to the next task, whatever document it is from.
    tiles = found.where(F.col("kind") == TILE).select("key", "period", "lo", "words").repartition("key", "period", "lo")
    parts = tiles.mapInArrow(_solved, "key long, period long, lo long, hi long")
    short = found.where(F.col("kind") == INTERVAL).select("key", "period", "lo", "hi")
    runs = stitch(parts.unionByName(short))
    none = F.from_json(F.lit("[]"), runs_type)
    kept = F.coalesce("runs", none).alias("runs")
    opened = found.where(F.col("kind") == OPEN).select("key", "row", "n_words", "text")
    joined = opened.join(runs.hint("merge"), "key", "left").select("row", "n_words", "text", kept)
    done = T.StructType([row, T.StructField("n_words", T.LongType()), T.StructField("runs", runs_type), T.StructField("kept_text", T.StringType())])
    settled = found.where(F.col("kind") == SETTLED).select("row", "n_words", none.alias("runs"), F.col("text").alias("kept_text"))
    return joined.mapInArrow(_dropped, done).unionByName(settled)


# --- query --------------------------------------------------------------------


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) whose words repeat as the contract says, by the id's checksum."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(words, i)), " ")).otherwise("")

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    planted = F.element_at(F.transform(F.array(words), repeated), 1)
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_periodic_runs(with_planted_periods(read(spark, sf_dir, "documents")))
    runs = F.col("runs")
    by_length = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.when(F.size(runs) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    longest = done.withColumn("most", F.array_max(by_length))
    return longest.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(runs).cast("long").alias("n_runs"),
        (-F.col("most.start")).alias("start"),
        F.col("most.length").alias("length"),
        (-F.col("most.period")).alias("period"),
        F.floor(1000 * F.col("most.length") / -F.col("most.period")).alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


CRC_TABLE_SQL = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i)))"""


def crc_sql(codes: str) -> str:
    """crc32 of a list of bytes, beside a row of ``crc_table``."""
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}::UBIGINT[]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"


# A run of period q has three multiples of q in a row among its matches, so only such (document,
# period) pairs are looked at word by word.
OP12_SQL = rf"""WITH {CRC_TABLE_SQL},
hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce({crc_sql("[ascii(x) FOR x IN string_split(doc_id::VARCHAR, '')]")}, 1)::BIGINT AS h
  FROM documents, crc_table),
placed AS (
  SELECT doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed),
planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN [w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END) + 1] FOR i IN range(n)]
    ELSE w END AS w FROM placed),
periods AS (SELECT doc_id, n, w, unnest(range(1, n // 4 + 1)) AS q FROM planted),
multiples AS (SELECT doc_id, n, q, w, unnest(range(0, n - 3 * q, q)) AS i FROM periods),
likely AS (
  SELECT DISTINCT doc_id, q FROM multiples
  WHERE w[i + 1] = w[i + q + 1] AND w[i + q + 1] = w[i + 2 * q + 1] AND w[i + 2 * q + 1] = w[i + 3 * q + 1]),
pairs AS (SELECT doc_id, q, n, w, unnest(range(0, n - q)) AS i FROM likely JOIN planted USING (doc_id)),
matches AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island
  FROM pairs WHERE w[i + 1] = w[i + q + 1]),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM matches GROUP BY doc_id, q, island
  HAVING count(*) >= 3 * q AND count(*) + q >= 6),
runs AS (
  SELECT doc_id, s, length, q FROM stretches JOIN planted USING (doc_id)
  WHERE len([p FOR p IN range(1, q) IF q % p = 0 AND w[s + 1 : s + q - p] = w[s + p + 1 : s + q]]) = 0),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    arg_min(struct_pack(s := s, length := length, q := q), (-length, s, q)) AS best,
    flatten(list(range(s + q, s + length))) AS gone
  FROM runs GROUP BY doc_id),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM planted) AS p
  LEFT JOIN (SELECT DISTINCT doc_id, unnest(gone) AS i FROM listed) AS g ON g.doc_id = p.doc_id AND g.i = p.i
  WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, l.best.s::BIGINT AS start, l.best.length::BIGINT AS length,
  l.best.q::BIGINT AS period, (1000 * l.best.length // l.best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM planted AS d LEFT JOIN listed AS l USING (doc_id) LEFT JOIN kept AS k USING (doc_id)"""
