"""Text functions as Column expressions; none needs a UDF but the exact form of strip_diacritics."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MARKS = "[\\u0300-\\u036f]"
#: Runs of all but a-z, 0-9 and hyphens. Spelled out as ranges, which regular expressions meet several times as fast as the complement.
NO_WORD = r"[\x00-,./:-`\{-\x{10FFFF}]+"


#: White space of any kind, no-break spaces and the byte order mark included.
SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_blank(text: Column) -> Column:
    """Whether a text is nothing but white space of any kind; its first other character settles it."""
    return ~text.rlike("[^" + SPACE[1:])


def trimmed(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _without_marks(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")


@lru_cache(2)
def folding(ascii_only: bool) -> tuple[str, str]:
    """Characters that lose their marks without changing in number, and what they become."""
    pairs = []
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        plain = _without_marks(c := chr(code))
        if len(plain) == 1 and plain != c and (not ascii_only or plain < "\x80"):
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Fixed values of the syllables of Hangul: the first one, and the numbers of vowels and of ends.
HANGUL, VOWELS, ENDS = 0xAC00, 21, 28
#: The letters that they are made of, in their order: beginnings, vowels, ends.
LEADS, MIDDLES, TAILS = ("".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, VOWELS), (0x11A8, ENDS - 1)))


@lru_cache(1)
def expanding() -> dict[str, str]:
    """Characters that become none or several when decomposed, Hangul's syllables and the marks themselves aside, and what they become without marks."""
    codes = (c for c in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)) if not HANGUL <= c < HANGUL + len(LEADS) * VOWELS * ENDS and not 0x300 <= c <= 0x36F)
    plain = ((chr(c), _without_marks(chr(c))) for c in codes)
    return {c: to for c, to in plain if to != c and len(to) != 1}


def _expanded(c: Column) -> Column:
    """One character as it is decomposed: a syllable of Hangul by arithmetic, others by the table."""
    at = F.ascii(c) - HANGUL
    letter = lambda letters, i: F.substr(F.lit(letters), (i + 1).cast("int"), F.lit(1))
    tail = at % ENDS
    syllable = F.concat(letter(LEADS, F.floor(at / (VOWELS * ENDS))), letter(MIDDLES, F.floor(at % (VOWELS * ENDS) / ENDS)), F.when(tail > 0, letter(TAILS, tail - 1)).otherwise(""))
    table = F.create_map(*[F.lit(x) for pair in expanding().items() for x in pair])
    return F.when((at >= 0) & (at < len(LEADS) * VOWELS * ENDS), syllable).otherwise(F.coalesce(F.element_at(table, c), c))


def strip_diacritics(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Marks removed after canonical decomposition, of every character as the Unicode tables have it.

    Characters that become one are translated; only texts that hold one of the few that become several (Hangul's syllables among them) are taken apart
    character by character. Those and the marks lie beyond U+0300: texts without such characters aren't searched for them. Marks outside U+0300 to U+036F
    stay, in the order that they had.
    """
    source, target = folding(False)
    extra = extra or {}
    held = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _ranges()) + "]"
    plain = F.translate(text, "".join(extra) + source, "".join(extra.values()) + target)
    whole = F.when(plain.rlike(held), F.array_join(F.transform(F.split(plain, ""), _expanded), "")).otherwise(plain)
    whole = F.regexp_replace(whole, MARKS, "")
    near = not any(c >= "\u0300" for c in "".join(extra.values()))
    return _unless_ascii(text, F.when(text.rlike(r"[\x{300}-\x{10FFFF}]"), whole).otherwise(plain) if near else whole)


def _unless_ascii(text: Column, folded: Column) -> Column:
    """Text of ASCII alone folds to itself, which is quicker to see than to do. (All folds are of other characters.)"""
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


@lru_cache(1)
def _ranges(gap: int = 0x80) -> list[list[int]]:
    """Few ranges of code points that hold all characters which become several; those less than a gap apart are in one."""
    out: list[list[int]] = []
    for code in sorted([*map(ord, expanding()), *range(HANGUL, HANGUL + len(LEADS) * VOWELS * ENDS)]):
        if out and code - out[-1][1] < gap:
            out[-1][1] = code
        else:
            out.append([code, code])
    return out


@F.pandas_udf(StringType())
def strip_diacritics_exact(text: pd.Series) -> pd.Series:
    """The same in Python, and marks that stay in canonical order too."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not "\u0300" <= c <= "\u036f"))


def normalize(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Marks removed, lower case, runs of all but a-z, 0-9 and hyphens to one space, trimmed; null gives ''."""
    source, target = folding(True)
    extra = extra or {}
    text = F.coalesce(text, F.lit(""))
    plain = _unless_ascii(text, F.regexp_replace(F.translate(text, "".join(extra) + source, "".join(extra.values()) + target), MARKS, ""))
    return F.trim(F.regexp_replace(F.lower(plain), NO_WORD, " "))


def trigrams_of(normalized: Column) -> Column:
    """Distinct trigrams of normalised text in order: those of each word; a word under 3 characters is its own, empty text has none."""
    parts = F.transform(
        F.split(normalized, " "),
        lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substr(w, i, F.lit(3)))),
    )
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(parts)))


def padded_trigrams_of(text: Column) -> Column:
    """Distinct trigrams of each run of a-z and 0-9, with two blanks put before it and one behind, so that beginnings weigh more; null and text without such a run have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def padded_similarity(a: Column, b: Column) -> Column:
    """Shared by all distinct trigrams of two arrays; 0 where either is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram arrays: 1 for two empty ones, 0 for one."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less edits by the longer length, of normalised texts; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def is_postcode(text: Column) -> Column:
    return trimmed(text).rlike(r"^\d{2}-?\d{3}$")


#: Fixed value: characters that a text must have to be searched with tolerance for errors.
MIN_SEARCH_TOKEN_LENGTH = 3
#: Characters deleted from full-text terms.
TERM_SYNTAX = "'\"(){}*:^~-!&|<>"


def fts_terms(tokens: Column, most: int = 6) -> Column:
    """The first terms of a full-text query: syntax characters deleted, empty terms dropped. Hyphens are deleted, which joins the words beside them."""
    return F.slice(F.filter(F.transform(tokens, lambda t: F.translate(t, TERM_SYNTAX, "")), lambda t: t != ""), 1, most)


def fts_query(terms: Column) -> Column:
    """The terms as a prefix query for display: "term"* OR ..."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"*'))), " OR ")


def aliases_of(tokens: Column) -> Column:
    """Single tokens, then adjacent pairs."""
    pairs = F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.concat(t, F.lit(" "), F.get(tokens, i + 1)))
    return F.concat(tokens, pairs)


def min_overlap(n: Column) -> Column:
    """How many of a query's n trigrams an entity must share."""
    return F.when(n <= 3, F.greatest(F.lit(1), n - 1)).otherwise(F.greatest(F.lit(2), F.ceil(n * 0.45))).cast("int")


def tokens_of(normalized: Column) -> Column:
    """Index tokens: split at spaces and hyphens, no empty ones."""
    return F.filter(F.split(normalized, "[ -]"), lambda t: t != "")
