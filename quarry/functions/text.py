"""Text and tag functions over Columns.

Python's ``str.strip()`` / ``str.split()`` use Unicode whitespace; SQL ``trim``
strips only spaces. ``WHITESPACE`` is built from the rule "every code point that
``str.isspace()`` accepts" (all of them lie below U+3001) and is used as a
character set for ``trim`` and as a regex class for ``split``.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.rand import hash_int

WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _ranges(chars: str) -> str:
    """Regex class body for a set of characters, consecutive code points merged."""
    cps = sorted(ord(c) for c in chars)
    out, start, prev = [], cps[0], cps[0]
    for cp in cps[1:] + [None]:
        if cp is not None and cp == prev + 1:
            prev = cp
            continue
        out.append("\\x{%x}" % start if start == prev else "\\x{%x}-\\x{%x}" % (start, prev))
        if cp is not None:
            start = prev = cp
    return "".join(out)


WS_CLASS = "[" + _ranges(WHITESPACE) + "]"
NOT_WS = "[^" + _ranges(WHITESPACE) + "]"
TAG_PATTERN = "<([^>]+)>"
LINE_BREAK = "\\r\\n|\\r|\\n"


def lit_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ustrip(col: Column) -> Column:
    """Unicode strip, like Python ``str.strip()``."""
    return F.trim(col, F.lit(WHITESPACE))


# Java's Unicode \s (White_Space) plus U+001C..U+001F is exactly the set
# above; this form is much faster to match than an explicit class.
JAVA_WS = "(?U)[\\s\\x{1c}-\\x{1f}]"
JAVA_NOT_WS = "[^\\s\\x{1c}-\\x{1f}]"      # within a pattern that has (?U)


def split_ws(col: Column) -> Column:
    """Whitespace tokens of an already stripped string (``str.split()``)."""
    return F.filter(F.split(col, JAVA_WS + "+"), lambda t: t != F.lit(""))


def split_lines(col: Column) -> Column:
    """Physical lines, with the universal-newline rule of text files."""
    return F.split(col, LINE_BREAK)


def extract_tags(col: Column) -> Column:
    """All ``<...>`` contents in order; an unclosed opening tag glues with the next."""
    return F.regexp_extract_all(col, F.lit(TAG_PATTERN), 1)


def drop_closing_tags(tags: Column, dedup: bool = False) -> Column:
    kept = F.filter(tags, lambda t: ~t.startswith("/"))
    return F.array_distinct(kept) if dedup else kept


def extract_body(col: Column) -> Column:
    """Text after the last 'prompt ' (whole text when absent), stripped."""
    return ustrip(F.substring_index(col, "prompt ", -1))


def genres_of(tags: Column, whitelist: Iterable[str]) -> Column:
    """Whitelisted tags, in tag order, duplicates kept."""
    wl = lit_array(whitelist)
    return F.filter(tags, lambda t: F.array_contains(wl, t))


def themes_of(tags: Column, genres: Column) -> Column:
    """Tags that are not among this entry's genres and not 'prompt'."""
    return F.filter(tags, lambda t: ~F.array_contains(genres, t) & (t != F.lit("prompt")))


def opposite_genres(genres: Column, whitelist: Iterable[str]) -> Column:
    """Whitelist minus the entry's genres, in whitelist order."""
    return F.filter(lit_array(whitelist), lambda g: ~F.array_contains(genres, g))


def keyword_candidates(body: Column, min_len: int = 5) -> Column:
    """Whitespace tokens of at least ``min_len`` characters made only of
    letters, in text order (Python: ``len(w) >= min_len and w.isalpha()``)."""
    # one scan of the text: no array of all its words and no test a word
    return F.regexp_extract_all(body, F.lit("(?U)(?<!%s)\\p{L}{%d,}+(?!%s)" % (JAVA_NOT_WS, max(1, min_len), JAVA_NOT_WS)), 0)


def sample_keywords(cands: Column, key: Column, seed: int, tag: str,
                    max_keywords: int = 3) -> Column:
    """Pick n = min(#cands, uniform{1..max}) candidates by position, without
    replacement, in draw order (sequential draws, see ``ring_offsets``)."""
    from quarry.functions.rand import ring_offsets
    n = F.least(F.size(cands).cast("bigint"),
                F.lit(1) + F.pmod(hash_int(seed, tag + "#n", key), F.lit(max_keywords)))
    offs = ring_offsets(n, F.size(cands).cast("bigint"), seed, key, tag)
    return F.transform(offs, lambda o: F.element_at(cands, (o + F.lit(1)).cast("int")))


def strip_starters(q: Column, starters: Iterable[str]) -> Column:
    """Remove leading phrases one after the other, in list order,
    case-insensitively and without a word boundary; strip after each."""
    lowered = [s.lower() for s in starters]
    return F.aggregate(
        lit_array(lowered), q,
        lambda acc, s: F.when(F.startswith(F.lower(acc), s),
                              ustrip(F.substr(acc, F.length(s) + F.lit(1)))).otherwise(acc))


def lower_first(q: Column) -> Column:
    return F.concat(F.lower(F.substr(q, F.lit(1), F.lit(1))), F.substr(q, F.lit(2)))


def normalise_context(c: Column) -> Column:
    """String context with nulls as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))
