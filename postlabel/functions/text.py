"""Text expressions. All are built-in Column expressions, so they stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlabel import fixed

# Members of Python's \w, \s and \d, to stand inside [...]. Java's own classes are
# ASCII, or differ on marks and control characters in Unicode mode.
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_DIGIT = r"\p{Nd}"
_CLASSES = {r"\w": _WORD, r"\s": _SPACE, r"\d": _DIGIT}


def java_regex(*patterns: str) -> str:
    """One Java pattern that finds what any of the Python patterns finds.

    ``(?d)`` lets ``.`` stop at a newline only. A ``\\b`` is spelled as a look-around
    over the word class; it must stand next to a word character of the pattern, before
    it when a letter, digit or group follows, else after it.
    """
    parts = [_spell(p) for p in patterns]
    body = parts[0] if len(parts) == 1 else "|".join(f"(?:{p})" for p in parts)
    return f"(?d){body}"


def _spell(pattern: str) -> str:
    inside = False
    out = []
    for m in re.finditer(r"\\.|.", pattern, re.DOTALL):
        token, following = m.group(), pattern[m.end() : m.end() + 1]
        if token in _CLASSES:
            out.append(_CLASSES[token] if inside else f"[{_CLASSES[token]}]")
        elif token == r"\b":
            ahead = following.isalnum() or following == "("
            out.append(f"(?<![{_WORD}])" if ahead else f"(?![{_WORD}])")
        else:
            inside = token == "[" or (inside and token != "]")
            out.append(token)
    return "".join(out)


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def strip_ws(col: Column) -> Column:
    """Text without white space at its ends; inner newlines stay."""
    return F.btrim(col, F.lit(fixed.TRIM_CHARS))


def collapse_ws(col: Column) -> Column:
    """Every run of white space becomes one space, ends are trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), f"[{_SPACE}]+", " "))


def not_tombstone(col: Column) -> Column:
    """True for a body that was neither deleted nor removed."""
    return ~col.isin(*fixed.TOMBSTONES)


def compose_text(title: Column, selftext: Column) -> Column:
    """``title -- selftext``, or the title alone when the body is empty or a tombstone."""
    return F.when(
        (selftext != "") & not_tombstone(selftext),
        F.concat(title, F.lit(fixed.TITLE_SEPARATOR), selftext),
    ).otherwise(title)


def head_segment(col: Column, separator: str = "--") -> Column:
    """The part before the first separator, stripped."""
    return strip_ws(F.substring_index(col, separator, 1))


def prefix(col: Column, n: int = fixed.NEWSISH_PREFIX) -> Column:
    return F.substring(col, 1, n)


def preview(col: Column, n: int, ellipsis: bool = False) -> Column:
    """First n characters, optionally with '...' where something was cut."""
    cut = F.substring(col, 1, n)
    if not ellipsis:
        return cut
    return F.when(F.length(col) > n, F.concat(cut, F.lit("..."))).otherwise(cut)


def count_char(col: Column, char: str) -> Column:
    return (F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))).cast("int")


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(java_regex(pattern)))


def keyword_hits(col: Column, words: Iterable[str]) -> Column:
    """How many of the listed substrings are present, each counted once."""
    return reduce(lambda a, b: a + b, [col.contains(w).cast("int") for w in words])


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """Plain substring test without word boundaries: "album" contains "bum"."""
    return _any(col.contains(w) for w in words)


def contains_all(col: Column, words: Iterable[str]) -> Column:
    return reduce(and_, [col.contains(w) for w in words])


def starts_with_any(col: Column, words: Iterable[str]) -> Column:
    return _any(col.startswith(w) for w in words)


def matches_any(col: Column, patterns: Iterable[str]) -> Column:
    """Regex search for any pattern, as one alternation: the text is decoded once."""
    return col.rlike(java_regex(*patterns))


def ends_with_question(col: Column) -> Column:
    return strip_ws(col).endswith("?")


def is_match_thread(title: Column, keywords: Iterable[str] = fixed.MATCH_THREAD_KEYWORDS) -> Column:
    return contains_any(F.lower(F.coalesce(title, F.lit(""))), keywords)


def is_discussion(
    title: Column,
    num_comments: Column,
    minimum: int = fixed.DISCUSSION_MIN_COMMENTS,
    keywords: Iterable[str] = fixed.MATCH_THREAD_KEYWORDS,
) -> Column:
    """A busy thread that is not a match thread; a missing count is 0."""
    return ~is_match_thread(title, keywords) & (F.coalesce(num_comments, F.lit(0)) > minimum)


def with_context_prefix(text: Column, source: Column, title: Column | None = None) -> Column:
    """Text preceded by where it was written, so that the model can see it.

    A null or unknown source is a post. Given ``title``, comments have that of their thread
    before them as well, unless it is null or blank.
    """
    match, post = fixed.CONTEXT_PREFIX[fixed.MATCH_THREAD_COMMENT], fixed.CONTEXT_PREFIX[fixed.POST]
    in_match = source == fixed.MATCH_THREAD_COMMENT
    in_discussion = source.isin(fixed.DISCUSSION_COMMENT, fixed.DISCUSSION_COMMENT_OLDER)
    lead = F.when(in_match, match).when(in_discussion, fixed.DISCUSSION_PREFIX).otherwise(post)
    if title is None:
        return F.concat(lead, F.lit(" "), text)
    named = (in_match | in_discussion) & (F.length(strip_ws(title)) > 0)
    thread = F.when(named, F.concat(title, F.lit(fixed.TITLE_SEPARATOR))).otherwise("")
    return F.concat(lead, F.lit(" "), thread, text)


def shuffle_key(id_col: Column, seed: int = fixed.SEED) -> Column:
    """A reproducible random order: the same on every engine and every partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))
