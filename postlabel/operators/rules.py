"""The ordered rule cascade, as data folded into one CASE expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlabel import fixed
from postlabel.functions.text import (
    contains_all,
    contains_any,
    count_char,
    count_matches,
    ends_with_question,
    head_segment,
    matches_any,
    prefix,
    starts_with_any,
    strip_ws,
)

NULL_TEXT = "null_text"


@dataclass(frozen=True)
class Post:
    """The columns a rule may look at."""

    text: Column
    lower: Column
    length: Column
    source: Column


@dataclass(frozen=True)
class Rule:
    """``note`` names the rule. It fires on posts with ``over < length < under`` that pass
    ``test``; the lengths are compared first, so long texts never reach a costly test."""

    note: str
    label: str
    test: Callable[[Post], Column] | None = None
    over: int | None = None
    under: int | None = None

    def condition(self, post: Post) -> Column:
        parts = []
        if self.over is not None:
            parts.append(post.length > self.over)
        if self.under is not None:
            parts.append(post.length < self.under)
        if self.test is not None:
            parts.append(self.test(post))
        if not parts:
            return F.lit(True)
        result = parts[0]
        for part in parts[1:]:
            result = result & part
        return result


def _has(words: Sequence[str]) -> Callable[[Post], Column]:
    return lambda p: contains_any(p.lower, words)


def _opens(words: Sequence[str]) -> Callable[[Post], Column]:
    return lambda p: starts_with_any(p.lower, words)


def _finds(pattern: str, guard: Callable[[Post], Column]) -> Callable[[Post], Column]:
    """Regex search behind a cheap test that every match passes.

    A pattern with word boundaries costs about a microsecond per character, a substring
    test a nanosecond; most texts contain none of the words a pattern needs.
    """
    return lambda p: guard(p) & matches_any(p.lower, [pattern])


def _finds_any(
    patterns: Sequence[str], guards: Sequence[Callable[[Post], Column]]
) -> Callable[[Post], Column]:
    tests = [_finds(pattern, guard) for pattern, guard in zip(patterns, guards, strict=True)]
    return lambda p: reduce(or_, [test(p) for test in tests])


def _sourced(p: Post) -> Column:
    return p.text.startswith("[") & matches_any(p.text, [fixed.NEWS_SOURCE])


def _score(p: Post) -> Column:
    return p.text.contains("[") & matches_any(p.text, [fixed.SCORE_UPDATE])


def _sourced_without_opinion(p: Post) -> Column:
    return _sourced(p) & ~contains_any(p.lower, fixed.NEWS_OPINION)


def _historic(p: Post) -> Column:
    tactical = contains_any(p.lower, fixed.TACTICAL_WORDS)
    return contains_any(p.lower, fixed.HISTORIC_MOMENT) & ~tactical


def _tabular(p: Post) -> Column:
    ruled = p.text.contains("---") & (count_char(p.text, "|") > 4)
    listed = count_char(p.text, "\n") > 6
    return (ruled | listed) & contains_any(p.lower, fixed.TABLE_TERMS)


def _not_news(p: Post) -> Column:
    return ~(contains_any(prefix(p.lower), fixed.NEWSISH_WORDS) | _sourced(p))


def _years(p: Post) -> Column:
    any_year = p.text.contains("19") | p.text.contains("20")
    return any_year & (count_matches(p.text, fixed.YEAR) >= 3)


def _opinionated_question(p: Post) -> Column:
    return ends_with_question(p.text) & matches_any(p.lower, [fixed.OPINIONATED_QUESTION])


def _bold_quote(p: Post) -> Column:
    named = p.text.contains('"') & matches_any(p.text, [fixed.QUOTE_OPENER])
    return (p.text.startswith('"') | named) & matches_any(p.lower, [fixed.BOLD_CLAIM])


# What a text must contain, or open with, for each opinion marker to be found in it.
OPINION_GUARDS = (
    _has(["overrated", "underrated", "the best", "the worst", "elite", "trash", "a bum"]),
    _has(["will never"]),
    _has(["should", "deserve"]),
    _opens(["honestly", "actually", "unpopular opinion", "hot take", "controversial take"]),
    _has(["change my mind", "fight me", "prove me wrong"]),
    _has(["can we please", "why ", "how "]),
    _has(["am i the only one", "does anyone else", "seriously though"]),
    _has(["the greatest"]),
    _has(["fire ", "sack "]),
)
# The same for each judgment.
JUDGMENT_GUARDS = (
    _has(
        "good bad poor great terrible awful brilliant embarrassing shameful pathetic incredible "
        "class clinical dominant".split()
    ),
    _has(["than"]),
    _has(["deserve", "should", "has to", "needs to", "must"]),
    _has(["letting", "allowing", "conceding"]),
    _has(["win", "beat", "score", "compete"]),
    _has(["as good as", "as bad as", "same as", "comparable to"]),
    _has(["prove"]),
    _opens(["i ", "we "]),
)
HEDGE_GUARD = _has(
    [
        "i think", "i believe", "honestly", "actually", "feel like", "seems like", "looks like",
        "clearly", "obviously", "definitely", "absolutely",
    ]
)


EXCLUSION_RULES = (
    Rule("match_thread_body", "skip", _has(fixed.MATCH_THREAD_BODY), over=1500),
    Rule(
        "post_match_thread_body",
        "skip",
        lambda p: contains_all(p.lower, fixed.POST_MATCH_BODY),
        over=1000,
    ),
    Rule("news_post", "skip", _sourced_without_opinion, under=300),
    Rule("commercial", "skip", _has(fixed.COMMERCIAL)),
    Rule("match_thread_header", "skip", _opens([fixed.MATCH_THREAD_HEADER]), under=300),
    Rule("too_long_article", "skip", over=5000),
    Rule("schedule_post", "skip", _has([fixed.SCHEDULE_PHRASE]), over=500),
)

REACTION_RULES = (
    Rule(
        "match_thread_comment",
        "reaction",
        lambda p: p.source == fixed.MATCH_THREAD_COMMENT,
    ),
    Rule("score_update", "reaction", _score, under=180),
    Rule(
        "result_line",
        "reaction",
        lambda p: matches_any(head_segment(p.text), [fixed.RESULT_LINE]),
        under=150,
    ),
    Rule("historic_moment_factoid", "reaction", _historic, under=350),
    Rule("fan_moment", "reaction", _has(fixed.FAN_MOMENT), under=600),
    Rule("personal_reaction", "reaction", _opens(fixed.PERSONAL_REACTION), under=300),
    Rule("short_exclamation", "reaction", _has(fixed.EXCLAMATIONS), under=80),
)

ANALYSIS_RULES = (
    # One term is enough, so the test may stop at the first.
    Rule("long_analytical", "analysis", _has(fixed.ANALYTICAL_TERMS), over=350),
    Rule("statistical_table", "analysis", _tabular, over=500),
    Rule("long_form_post", "analysis", _not_news, over=1000),
    Rule("multi_season_comparison", "analysis", _years, over=400),
)

OPINION_RULES = (
    Rule("opinion_marker", "hot_take", _finds_any(fixed.OPINION_MARKERS, OPINION_GUARDS)),
    Rule("opinion_keyword", "hot_take", _has(fixed.OPINION_KEYWORDS)),
    Rule("opinionated_question", "hot_take", _opinionated_question, under=250),
    Rule("pundit_quote_opinion", "hot_take", _bold_quote, under=500),
    Rule("judgment_assertion", "hot_take", _finds_any(fixed.JUDGMENTS, JUDGMENT_GUARDS)),
    Rule("first_person_opinion", "hot_take", _opens(fixed.FIRST_PERSON_OPENERS), under=400),
    Rule("discussion_question", "hot_take", lambda p: ends_with_question(p.text), under=300),
)

FALLBACK_RULES = (
    Rule("short_exclamation", "reaction", _opens(fixed.EMOTIVE_OPENERS), under=120),
    Rule("short_opinion", "hot_take", under=120),
    Rule("soft_opinion", "hot_take", _finds(fixed.HEDGES, HEDGE_GUARD), under=400),
    Rule("short_default", "reaction", under=200),
    Rule("long_default", "analysis"),
)

DEFAULT_RULES = (
    *EXCLUSION_RULES,
    *REACTION_RULES,
    *ANALYSIS_RULES,
    *OPINION_RULES,
    *FALLBACK_RULES,
)

# The rules of the exclusion audit, which knows fewer phrases and no opinion exception.
AUDIT_RULES = (
    Rule("match_thread_body", "skip", _has(fixed.AUDIT_MATCH_THREAD_BODY), over=1500),
    EXCLUSION_RULES[1],
    Rule("news_post", "skip", _sourced, under=300),
    Rule("commercial", "skip", _has(fixed.AUDIT_COMMERCIAL)),
    *EXCLUSION_RULES[4:],
)


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds stripped text ``t``, its lower case ``tl`` and its length ``n``.

    Each is computed once per row, however often it is used. ``tl`` and ``n`` come out of a
    generator: a filter on many keywords would otherwise be pushed below the projection
    with a copy of ``lower(trim(text))`` for every keyword.
    """
    stripped = df.withColumn("t", strip_ws(F.col(text)))
    derived = F.struct(F.lower("t").alias("tl"), F.length("t").alias("n"))
    return stripped.select("*", F.inline(F.array(derived)))


def _post() -> Post:
    source = F.coalesce(F.col("source"), F.lit(fixed.POST))
    return Post(F.col("t"), F.col("tl"), F.col("n"), source)


def _with_source(df: DataFrame) -> DataFrame:
    return df if "source" in df.columns else df.withColumn("source", F.lit(fixed.POST))


def _first_match(rules: Sequence[Rule], post: Post) -> Column:
    """Index of the first rule that fires, or null."""
    folded = None
    for i, rule in enumerate(rules):
        start = F.when if folded is None else folded.when
        folded = start(rule.condition(post), F.lit(i))
    return folded


def _fire(df: DataFrame, **rulesets: Sequence[Rule]) -> DataFrame:
    """Adds, per name, the index of the first rule of that set that fires.

    The indexes come out of a generator, because a filter on the label would otherwise be
    pushed below the projection with a copy of the whole cascade, which would then run
    twice.
    """
    application = df.sparkSession.sparkContext.applicationId
    fired = F.struct(
        *[_folded(tuple(rules), application).alias(name) for name, rules in rulesets.items()]
    )
    return df.select("*", F.inline(F.array(fired)))


@lru_cache(maxsize=32)
def _folded(rules: tuple[Rule, ...], application: str) -> Column:
    """The cascade over ``_post()``; made once per application, as it has many parts."""
    return _first_match(rules, _post())


def _pick(names: Sequence[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in names]), index)


def label_posts(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Adds ``label`` and ``note`` of the first rule that fires.

    A null text is skipped with the note ``null_text``. One pass, no shuffle, no UDF.
    """
    index = F.col("_rule")
    nothing = F.col("text").isNull()
    return (
        _fire(text_features(_with_source(df)), _rule=rules)
        .withColumn(
            "label",
            F.when(nothing, F.lit(fixed.SKIP)).otherwise(_pick([r.label for r in rules], index)),
        )
        .withColumn(
            "note",
            F.when(nothing, F.lit(NULL_TEXT)).otherwise(_pick([r.note for r in rules], index)),
        )
        .drop("t", "tl", "n", "_rule")
    )


def label_all_matches(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Adds ``matches``: every rule that fires, in order, to show what shadows what."""
    post = _post()
    fired = F.array_compact(
        F.array(*[F.when(r.condition(post), F.lit(r.note)) for r in rules])
    )
    return text_features(_with_source(df)).withColumn("matches", fired).drop("t", "tl", "n")


def match_bits(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Adds ``bits``: bit i is set where rule i fires, whichever rule decides; 0 for a null text.

    At most 63 rules. The lowest bit is the deciding rule, all others are hidden by it.
    """
    if len(rules) > 63:
        raise ValueError("a bit set holds 63 rules")
    post = _post()
    zero = F.lit(0).cast("bigint")
    bits = zero
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.condition(post), F.lit(1 << i).cast("bigint")).otherwise(zero))
    bits = F.when(F.col("text").isNull(), zero).otherwise(bits)
    return text_features(_with_source(df)).withColumn("bits", bits).drop("t", "tl", "n")


def skip_reason(df: DataFrame, rules: Sequence[Rule] = AUDIT_RULES) -> DataFrame:
    """Adds ``skip_reason``, null for posts that are kept."""
    reason = _pick([r.note for r in rules], F.col("_rule"))
    return (
        _fire(text_features(_with_source(df)), _rule=rules)
        .withColumn("skip_reason", reason)
        .drop("t", "tl", "n", "_rule")
    )


def ruleset_diff(df: DataFrame, a: Sequence[Rule], b: Sequence[Rule]) -> DataFrame:
    """Rows on which two rule sets disagree, counted per pair of notes."""
    notes = _fire(text_features(_with_source(df)), _a=a, _b=b)
    pair = notes.select(
        _pick([r.note for r in a], F.col("_a")).alias("note_a"),
        _pick([r.note for r in b], F.col("_b")).alias("note_b"),
    )
    return (
        pair.where(~F.col("note_a").eqNullSafe(F.col("note_b")))
        .groupBy("note_a", "note_b")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def labelable(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") != fixed.SKIP)
