"""Near-duplicate documents: MinHash bands, exact confirmation, star-contracted components.

1. Each text becomes its set of distinct word shingles, a digest of the set, the minima of
   ``bands * rows`` universal hash functions and the band keys made of them.
2. Texts with equal sets are one class, whose smallest document stands for all. Copies,
   however many, are never paired.
3. Documents that share a band key are a bucket. Its leader is the one that meets most
   others over all its buckets; every other document is paired with the leader only.
4. A pair whose signatures agree too little is dropped (five standard deviations below the
   threshold). Each document's ``TRIED`` best leaders are confirmed on whole sets.
5. Components come from alternating large-star and small-star rounds.
6. Buckets that still hold several components give the pairs between those, so that no linked
   pair of a bucket is left untested. Before they are made, a document leaves a bucket if it
   cannot have a link there: of its shingles only those that another component has as well can
   be in common, and with the sizes of the bucket's documents this bounds its similarity. What
   is left of a bucket is compared on whole sets in tiles of bounded size, and only links
   leave a tile, so the many strongly edited copies of one text make no rows of pairs.

With 50 bands of 5 rows a pair at similarity 0.75 shares no band once in 760,000 times, at
0.8 once in 420 million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import NO_ID, materialise, order_id, own_id, read
from .vector import U, mix, shingle_hashes, text_chunks, word_hashes

SHINGLE = 5
PERCENT = 75
BANDS = 50
ROWS = 5
TRIED = 3
# Documents of a bucket that one side of a tile has on average.
TILE = 512


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, the whole text as one if it is shorter."""
    for _, _, data, offs in text_chunks(column):
        words, first = word_hashes(data, offs)
        shingles = shingle_hashes(words, size)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                yield np.unique(shingles[a : b - size + 1])
            elif b > a:
                yield shingle_hashes(words[a:b], int(b - a))
            else:
                yield np.empty(0, U)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of the universal hash functions, the same in every task."""
    rng = np.random.Generator(np.random.PCG64(750))
    draw = rng.integers(0, 1 << 64, (2, count), dtype=U)
    return draw[0] | U(1), draw[1]


def minima(shingles: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    least = np.full(len(times), U((1 << 64) - 1))
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * times + plus).min(axis=0), out=least)
    return least >> U(20)


def _signed(bands: int, rows: int, size: int):
    """Maps (doc, text) to set size, set digest, band keys and one byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _functions(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=U))
        for batch in batches:
            counts, keys, bytes_, digests = [], [], [], []
            for found in shingle_sets(batch.column("text"), size):
                counts.append(len(found))
                if not len(found):
                    keys.append(None)
                    bytes_.append(None)
                    digests.append(None)
                    continue
                least = minima(found, times, plus)
                key = salt
                for row in least.reshape(bands, rows).T:
                    key = mix(key ^ row) + salt
                keys.append(key.view(np.int64))
                bytes_.append((least & U(255)).astype(np.uint8).tobytes())
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            arrays = [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                      pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n_shingles", "digest", "bands", "signature"])

    return run


def _agreeing(hashes: int, percent: int):
    """Keeps pairs whose signatures agree as often as a linked pair's do, with their agreement."""
    share = percent / 100
    least = hashes * share - 5 * (hashes * share * (1 - share)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), hashes) for c in ("sa", "sb")
            )
            agree = (left == right).sum(axis=1)
            keep = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(agree, pa.int64()).filter(keep)],
                names=["a", "b", "agree"],
            )

    return run


def _whole_sets(size: int):
    """Maps (doc, text) to the document's shingles as packed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.tobytes() for x in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(packed, pa.binary())], names=["doc", "shingles"])

    return run


def _confirmed(percent: int):
    """Keeps pairs whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                left, right = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(left) + len(right)
                common = both - len(np.unique(np.concatenate([left, right])))
                keep.append(100 * common >= percent * (both - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link (a, b): the smallest node it can reach.

    Large-star links each neighbour above a node to the least of its neighbours, small-star
    those below. A table is written after each, until the links are stars: every node has one
    parent, and no parent has one itself.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child")))).alias("e"))
        roles = ends.select("e.*").groupBy("node").agg(F.sum("child").alias("parents"), F.min("child").alias("is_child_only"))
        if roles.where("parents > 1 or (parents = 1 and is_child_only = 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps (doc, root, shingles) to one row per shingle."""
    for batch in batches:
        for doc, root, packed in zip(*(batch.column(c).to_pylist() for c in ("doc", "root", "shingles")), strict=True):
            found = np.frombuffer(packed, np.int64)
            columns = (found, np.full(len(found), doc), np.full(len(found), root), np.full(len(found), len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shingle", "doc", "root", "size"])


def agreeing(pairs: DataFrame, signed: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Signature verification of pairs (a, b)."""
    one = signed.select(F.col("doc").alias("a"), F.col("signature").alias("sa"))
    two = signed.select(F.col("doc").alias("b"), F.col("signature").alias("sb"))
    found = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    return materialise(found.mapInArrow(_agreeing(hashes, percent), "a long, b long, agree long"), "agreeing")


def whole_sets(texts: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(doc, shingles) of the listed documents, whose number grows with the data: never a broadcast."""
    return materialise(texts.join(docs.hint("merge"), "doc", "left_semi").select("doc", "text").mapInArrow(_whole_sets(size), "doc long, shingles binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return materialise(joined.mapInArrow(_confirmed(percent), "a long, b long"), "links")


def rooted(rows: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    """Adds the root of a node; a node without links is its own."""
    known = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return rows.join(known, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """The rows (band, root, ...) of buckets that hold more than one component."""
    mixed = rows.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    return rows.join(mixed, "band", "left_semi")


def able(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (band, doc, root) of documents that can have a link to another component of the bucket."""
    owners = rows.select("doc", "root").distinct()
    shingles = materialise(sets.join(owners, "doc").select("doc", "root", "shingles").mapInArrow(_set_rows, "shingle long, doc long, root long, size long"), "shingles")
    across = shingles.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    common = shingles.select("shingle", "doc", "size").join(across, "shingle").groupBy("doc", "size").agg(F.count("*").alias("common"))
    sized = materialise(rows.join(materialise(common, "common"), "doc"), "sized")
    bounds = sized.groupBy("band").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    # The partner size that suits a document best is the number of shingles it can share.
    partner = F.least(F.greatest("common", "least"), F.col("most"))
    shared = F.least("common", partner)
    can = 100 * shared >= percent * (F.col("size") + partner - shared)
    return mixed_buckets(materialise(sized.join(bounds, "band").where(can).select("band", "doc", "root"), "able"))


def _linked(percent: int):
    """Maps rows (band, i, j, own, doc, root, shingles), sorted by tile, to links between components."""

    def compare(tile: list[tuple]) -> pa.RecordBatch:
        own, docs, roots, packed = zip(*tile, strict=True)
        sets = [np.frombuffer(x, U) for x in packed]
        size, root, side, n = np.array([len(x) for x in sets]), np.array(roots), np.array(own), len(sets)
        _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = held > 1
        keep = shared[column]
        row, column = np.repeat(np.arange(n), size)[keep], (np.cumsum(shared) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((n, n), np.float32)
        for at in range(0, int(shared.sum()), 4096):
            x, y = np.searchsorted(column, [at, at + 4096])
            block = np.zeros((n, 4096), np.float32)
            block[row[x:y], column[x:y] - at] = 1
            common += block @ block.T
        link = (100 * common >= percent * (size[:, None] + size - common)) & (root[:, None] < root)
        if side.min() != side.max():
            link &= side[:, None] != side
        a, b = np.nonzero(link)
        ids = np.array(docs, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, []
        for batch in batches:
            for *now, own, doc, root, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key and tile:
                    yield compare(tile)
                    tile = []
                key = now
                tile.append((own, doc, root, packed))
        if tile:
            yield compare(tile)

    return run


def linked_across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components inside buckets, from (band, doc, root) and whole sets.

    A bucket's documents are dealt to chunks of ``TILE`` by hash; each two chunks are a tile.
    """
    chunks = rows.groupBy("band").agg(F.ceil(F.count("*") / TILE).alias("chunks"))
    own = F.pmod(F.xxhash64("doc"), F.col("chunks"))
    dealt = rows.join(chunks, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    tiles = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "root")
    # In a tile of two chunks, only pairs of one document of each are compared.
    keys = ["band", "i", "j"]
    full = tiles.join(sets, "doc").select(*keys, "own", "doc", "root", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return materialise(full.mapInArrow(_linked(percent), "a long, b long").distinct(), "links-across")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Links documents whose shingle sets have ``percent`` of their union in common.

    Takes doc_id and text; other columns are ignored. Returns doc_id, n_shingles, component_id
    (the smallest doc_id reachable over links, itself included) and kept (doc_id is that one).
    A text without words, or null, has no set and is linked with nothing. Rows that share an id
    are one document. A row without an id is linked with nothing: its component is null, and it
    is kept. No rows give none.
    """
    texts = docs.select(order_id().alias("doc"), "text")
    signed = materialise(
        texts.mapInArrow(_signed(bands, rows, size), "doc long, n_shingles long, digest binary, bands array<long>, signature binary"), "signed"
    )
    known = signed.where((F.col("doc") != NO_ID) & F.col("digest").isNotNull())
    classes = known.groupBy("digest").agg(F.min("doc").alias("node"))
    members = materialise(signed.select("doc", "n_shingles", "digest").join(classes, "digest", "left").drop("digest"), "members")
    nodes = known.join(classes.select(F.col("digest"), F.col("node").alias("doc")), ["digest", "doc"], "left_semi")

    # Buckets of at least two documents; a leader is in most of them together with others.
    banded = nodes.select("doc", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(banded.join(sizes, "band").select("band", "doc", "n"), "buckets")
    meets = shared.groupBy("doc").agg(F.sum("n").alias("meets"))
    ranked = shared.select("band", "doc").join(meets, "doc")
    leaders = ranked.groupBy("band").agg(F.max(F.struct("meets", F.xxhash64("doc"), "doc")).getField("doc").alias("b"))
    led = shared.select("band", F.col("doc").alias("a")).join(leaders, "band").where("a <> b").select("a", "b").distinct()

    known_texts, signatures = texts.where(F.col("doc") != NO_ID), nodes.select("doc", "signature")
    best = Window.partitionBy("a").orderBy(F.desc("agree"), "b")
    tried = agreeing(led, signatures, percent, bands * rows).withColumn("place", F.row_number().over(best)).where(F.col("place") <= TRIED)
    tried = materialise(tried.select("a", "b"), "tried")
    # Every document compared below shares a bucket, so the sets are made once.
    sets = whole_sets(known_texts, meets.select("doc"), size)
    roots = components(confirmed(tried, sets, percent))

    # What is left: buckets that hold more than one component.
    left = materialise(mixed_buckets(rooted(shared.select("band", "doc"), "doc", roots, "root")), "mixed")
    if not left.isEmpty():
        found = linked_across(able(left, sets, percent), sets, percent)
        links = rooted(rooted(found, "a", roots, "root_a"), "b", roots, "root_b")
        merged = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        roots = rooted(roots, "root", merged, "_top").select("node", F.col("_top").alias("root")).unionByName(
            merged.join(roots, "node", "left_anti")
        )

    labelled = rooted(members.withColumn("node", F.when(F.col("doc") == NO_ID, NO_ID).otherwise(F.coalesce("node", "doc"))), "node", roots, "root")
    component = own_id("root")
    return labelled.select(
        own_id("doc").alias("doc_id"), "n_shingles", component.alias("component_id"),
        ((F.col("doc") == F.col("root")) | (F.col("doc") == NO_ID)).alias("kept"),
    )


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
