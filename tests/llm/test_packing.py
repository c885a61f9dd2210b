"""Against the tokenizer on whole texts, and by the rules of a packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from postlabel.llm.packing import op10_packing, pack_documents, pack_plan


def expected_pieces(tokenizer, doc, text, size):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    first = len(ids) % size or size
    cuts = [0, *range(first, len(ids) + 1, size)]
    parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [(doc, i, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, (a, p) in enumerate(zip(cuts, parts, strict=False))]


def check(rows, size):
    """Every sequence is filled without gaps from 0, in at most ``size`` tokens."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_whole_table_against_the_tokenizer(spark, sf):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = op10_packing(spark, sf).collect()
    expected = sorted(x for d in docs for x in expected_pieces(tokenizer, d.doc_id, d.text, 2048))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    tokens = sum(r.length for r in rows)
    assert check(rows, 2048) <= -(-tokens // 2048) * 1.03 + 1


def test_small_sizes_nulls_special_and_repeated(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = [None, "", "   a  b\n\n c's\t", "<|endoftext|> x", "é" * 50, "word " * 37, "word " * 37, "ab" * 200]
    data = [(i // 2 if i != 5 else None, t, 1) for i, t in enumerate(texts)]
    rows = pack_documents(spark.createDataFrame(data, "doc_id long, text string, piece int"), 16).collect()
    expected = [x for d, t, _ in data for x in expected_pieces(tokenizer, -1 if d is None else d, t, 16)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    check(rows, 16)
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_added_tokens_as_the_file_has_them(spark, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> x", "<|endoftext|>", "  <|endoftext|><|endoftext|>\n b's", "<|endoftext| > é", None, "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op10_packing(spark, str(tmp_path)).collect()
    expected = sorted(x for d, t in enumerate(texts) for x in expected_pieces(tokenizer, d, t, 2048))
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 2124]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected


def test_cuts_are_those_of_the_pattern():
    import regex

    from postlabel.llm.pretokens import classes, word_starts

    rng = random.Random(6)
    pieces = ["'", "'s", "'ll", "'re", "'r", "''s", "s", "ll", "ve", "D", "é", "ß", "漢", "ⅷ", "٣", "1", "²", " ", "  ", "\t", "\n", "\u00a0", "\u3000", "\x85", "\x1c", "-", "…", "🙂", "\u0301", "_", "."]
    split = regex.compile(public_tokenizers.PATTERN)
    for _ in range(3000):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(4)]
        offs = np.cumsum([0, *map(len, texts)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        expected = [int(a) + m.start() for a, x in zip(offs, texts) for m in split.finditer(x)]
        assert word_starts(codes, offs).tolist() == expected, texts
    for kind, pattern in enumerate((r"\s", r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")):
        for i in [*range(0x3000), *range(0x10000, 0x10200), *range(0x1F600, 0x1F640), 0x2FA1D, 0xFFFD, 0x10FFFF]:
            assert (classes()[i] == kind) == bool(regex.fullmatch(pattern, chr(i))), i


def test_random_unicode_against_the_tokenizer_and_forgetting(spark, monkeypatch):
    from postlabel.llm import pretokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(8)
    words = ["the", "it's", "naïve", "we'll", "I'VE", "漢字", "🙂🙂", "x" * 70, "12", "³", "\u200b", "<|endoftext|>", "don't", "e\u0301", "\ufffd", "ñandú"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", "\n", "  ", "\t ", ". "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    monkeypatch.setattr(pretokens, "REMEMBERED", 30)
    for pattern in (None, public_tokenizers.PATTERN):
        encode = pretokens.WordIds(path, pattern, True, 0)
        for a in range(0, 300, 50):
            raw = [x.encode() for x in texts[a : a + 50]]
            data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
            ids, bounds = encode(data, offs)
            assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])] == [tokenizer.encode(x, add_special_tokens=False).ids + [0] for x in texts[a : a + 50]]


def test_text_longer_than_a_chunk(spark):
    from postlabel.llm.packing import CHUNK

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "a long text, isn't it? 漢字 " * 60_000
    assert len(text.encode()) > CHUNK
    rows = pack_documents(spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string")).collect()
    expected = expected_pieces(tokenizer, 1, text, 2048) + expected_pieces(tokenizer, 2, "b", 2048)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    check(rows, 2048)


def test_plan_is_never_worse_than_best_fit():
    from postlabel.llm.packing import best_fit

    rng = random.Random(5)
    for size in (8, 31, 64):
        for _ in range(20):
            histogram = np.bincount([rng.randint(1, size) for _ in range(rng.randrange(1, 400))], minlength=size + 1)
            count = [sum(n for _, n in plan) for plan in (pack_plan(histogram.copy(), size), best_fit(histogram.copy(), size))]
            assert count[0] <= count[1]


def test_plan_uses_each_length_exactly():
    rng = random.Random(4)
    for size, n in ((16, 500), (64, 3000), (257, 40), (100, 1)):
        histogram = np.bincount([rng.randint(1, size) for _ in range(n)], minlength=size + 1)
        used = np.zeros(size + 1, np.int64)
        for lengths, repeats in pack_plan(histogram.copy(), size):
            assert sum(lengths) <= size
            for x in lengths:
                used[x] += repeats
        assert (used == histogram).all()
