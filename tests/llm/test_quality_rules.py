"""Base counts, scores, threshold and verdict against plain Python, the verdict against the labels."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from postlabel.llm import quality_rules
from postlabel.llm.quality_rules import Ratios, hashed, judge, ngram_buckets, op2_quality_rules, parting, reached

SCHEMA = "doc_id long, text string, score string, _words string"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_and_verdict_of_the_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), r.doc_id
    good = [r.kept for r in rows if not r.base_failed and r.doc_id in labels and labels[r.doc_id].quality == 1 and labels[r.doc_id].toxic == 0]
    bad = [r.kept for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.4 * len(bad)
    assert not any(r.kept and r.base_failed for r in rows)


def test_random_small_texts(spark):
    rng = random.Random(9)
    rows = [(1, None, "", ""), (2, "", "", ""), (3, " \t\n\x0b ", "", ""), (None, "a " * 12, "", ""), (4, "é\u00a0b x\x0cy", None, None)]
    rows += [(10 + i, "".join(rng.choice(["a", "b", "c ", " ", "\n", "a b c d e ", "#", "\t"]) for _ in range(rng.randint(0, 60))), "", "") for i in range(150)]
    rows.append((10, rows[-1][1], "", ""))
    got = judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(10,), (11,), (None,)], "doc_id long")).collect()
    mine = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert mine == sorted((-1 if d is None else d, *base(t)) for d, t, *_ in rows)


def test_windows_are_hashed_where_they_stand(spark):
    """As many as there are, equal where their words are; no list of words is made for each."""
    texts = ["", "a", "a b c d", "a b c d e", "a b c d e a b c d e a", "x x x x x x x"]
    docs = hashed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = docs.select("text", quality_rules._windows().alias("w")).collect()
    for text, got in found:
        words = text.split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        assert len(got) == len(windows)
        assert all((a == b) == (x == y) for a, x in zip(got, windows, strict=True) for b, y in zip(got, windows, strict=True))
    plan = quality_rules.base_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


def test_ngrams_take_few_steps_each(spark):
    """No window looks its words up by place, no bucket is divided for; buckets are the remainders they were."""
    docs = hashed(spark.createDataFrame([(" ".join(f"w{i * i % 97}" for i in range(n)),) for n in (0, 1, 2, 4, 5, 300)], "text string"))
    found = docs.select("_hashes", quality_rules._windows().alias("w"), ngram_buckets().alias("b"), F.transform("_hashes", lambda x: F.pmod(x, F.lit(quality_rules.BUCKETS))).alias("words"))
    plan = found.drop("words")._jdf.queryExecution().optimizedPlan().toString()
    assert "get(" not in plan and "pmod(" not in plan
    for r in found.collect():
        assert len(r.w) == max(0, len(r["_hashes"]) - 4) and len(r.b) == max(0, 2 * len(r["_hashes"]) - 1)
        assert r.b[: len(r.words)] == r.words and all(quality_rules.BUCKETS <= b < 2 * quality_rules.BUCKETS for b in r.b[len(r.words) :])


def test_no_rows_and_no_targets(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert judge(spark.createDataFrame([], SCHEMA), none).count() == 0
    row = judge(spark.createDataFrame([(1, " ".join(map(str, range(20))), "", "")], SCHEMA), none).first()
    assert row.kept


def test_few_toxic_words_in_good_prose(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(80, 200))]
        toxic = i % 6 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in op2_quality_rules(spark, str(tmp_path)).where("kept").collect()}
    assert len([i for i in kept if i % 6]) >= 0.95 * 500 and len([i for i in kept if i % 6 == 0]) <= 5


def test_ratios_of_any_set_of_buckets(spark):
    rng = random.Random(1)
    found = {b: rng.randrange(-900, 900) for b in {0, 63, 64, 127, 2 * quality_rules.BUCKETS - 1, *(rng.randrange(2 * quality_rules.BUCKETS) for _ in range(300))}}
    ratios = Ratios(found)
    asked = sorted({*found, *(b + 1 for b in found if b + 1 < 2 * quality_rules.BUCKETS), *(max(0, b - 1) for b in found)})
    rows = spark.createDataFrame([(b,) for b in asked], "b int").select("b", ratios.holds(F.col("b")).alias("held"), F.when(ratios.holds(F.col("b")), ratios.of(F.col("b"))).alias("r"))
    assert all((r.held, r.r) == (r.b in found, found.get(r.b)) for r in rows.collect())
    assert not any(r.held for r in spark.createDataFrame([(0,), (9,)], "b int").select(Ratios({}).holds(F.col("b")).alias("held")).collect())


def test_scores_threshold_and_verdict_against_plain_python(spark, sf):
    """Everything after the hashes, over the whole table, once with and once without untrusted labels."""
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    half = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("h")).collect()}
    grams = {r.doc_id: r.g for r in hashed(docs.select("doc_id", "text")).select("doc_id", ngram_buckets().alias("g")).collect()}
    good = {r.doc_id: int(r.quality == 1 and r.toxic == 0) for r in labels.collect()}
    for evidence, both in ((3.0, True), (1.0, True), (1.0, False)):
        before, quality_rules.EVIDENCE = quality_rules.EVIDENCE, evidence
        try:
            trusted, untrusted = labels.where("quality = 1 and toxic = 0"), labels.where("quality = 0 or toxic = 1")
            rows = judge(docs, trusted, untrusted=untrusted if both else None).collect()
        finally:
            quality_rules.EVIDENCE = before
        kind = good if both else {d: int(good.get(d) == 1) for d in grams}
        own = [d for d in grams if half[d] == 0 and d in kind]
        t, n, corpus = Counter(), Counter(), Counter()
        for d in grams:
            corpus.update(set(grams[d]))
        for d in own:
            n.update(set(grams[d]))
            t.update(set(grams[d]) if kind[d] else ())
        share = sum(kind[d] for d in own) / len(own)
        base_log = math.log((sum(corpus.values()) + 2 * quality_rules.BUCKETS) / (sum(t.values()) + 2 * quality_rules.BUCKETS))
        told = {}
        for b in n:
            z = (t[b] - n[b] * share) / math.sqrt(n[b] * share * (1 - share))
            ratio = round(100 * (math.log((t[b] + 1) / (corpus[b] + 1)) + base_log))
            if abs(z) >= evidence and z * ratio > 0:
                told[b] = ratio
        score = {d: sum(told.get(b, 0) for b in g) / (100 * len(g)) if g else 0.0 for d, g in grams.items()}
        assert all(abs(r.score - score[r.doc_id]) < 1e-9 for r in rows)
        step = {d: math.floor(x / quality_rules.STEP) for d, x in score.items()}
        failed = {r.doc_id: r.base_failed for r in rows}
        judged = [d for d in grams if half[d] == 1 and not failed[d] and (d in good if both else good.get(d) == 1)]
        limits = sorted({step[d] for d in judged})
        if both:
            total = [sum(good[d] == k for d in judged) for k in (0, 1)]
            gain = {x: sum(step[d] < x and good[d] == 0 for d in judged) / total[0] - 5 * sum(step[d] < x and good[d] == 1 for d in judged) / total[1] for x in limits}
            limit = max(limits, key=lambda x: (gain[x], -x))
            limit = limit if gain[limit] > 0 else -math.inf
        else:
            limit = next(x for x in limits if sum(step[d] <= x for d in judged) > len(judged) * 2 // 1000)
        assert {r.doc_id: r.kept for r in rows} == {d: not failed[d] and step[d] >= limit for d in grams}


def test_a_word_has_one_bucket_wherever_it_stands(spark):
    rows = spark.createDataFrame([("a b a b c", None)], "text string, score string")
    a, b, c, d, e, *pairs = hashed(rows).select(ngram_buckets()).first()[0]
    assert a == c and b == d and len({a, b, e}) == 3 and max(a, b, e) < quality_rules.BUCKETS <= min(pairs)
    assert len(pairs) == 4 and pairs[0] == pairs[2] and len(set(pairs)) == 3


def test_thresholds_and_ties():
    class Row:
        def __init__(self, step, good, n):
            self.step, self.good, self.n = step, good, n

    steps = [Row(-9, 0, 4), Row(-5, 1, 3), Row(0, 99, 100)]
    # Dropping all below -5 parts best; what stands on the threshold stays.
    assert parting(steps) == 0 and parting([Row(-9, 0, 4), Row(-5, 30, 31), Row(0, 70, 70)]) == -5
    assert parting([Row(0, 5, 5)]) is None and parting([Row(0, 0, 5)]) is None and parting([]) is None and parting([Row(-1, 5, 5), Row(0, 0, 5)]) is None
    assert reached(steps, 2) == -5 and reached(steps, 10) == 0 and reached([], 2) is None


def test_text_longer_than_any_batch(spark):
    text = "word " * 10 + " ".join(f"w{i}" for i in range(400_000))
    row = judge(spark.createDataFrame([(1, text, "", "")], SCHEMA), spark.createDataFrame([(1,)], "doc_id long")).first()
    assert (row.n_words, row.base_failed, row.n_repeat_words) == (400_010, False, 10)
