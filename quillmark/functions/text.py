"""Text functions (D1-D7, D10): all Catalyst expressions, row-local, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters Python's str.split() splits on, so token
# boundaries agree with the reference's tokeniser on any Unicode text.
PY_WHITESPACE = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)

# A sentence ends at terminators before white space or the end of the text (so "3.14",
# "www.a.com" and "e.g." inside a sentence stay whole), or at the end of the text.
SENTENCE_PATTERN = r"(?s).+?[.!?]+(?:[ \t\n\r\f\x0B]+|\z)|.+\z"
SENTENCE_TRIM = " \t\n\r\f\x0b"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Whitespace split keeping case (used by rule rewriters); codegen'd, no lambda."""
    return F.array_remove(F.split(_c(text), PY_WHITESPACE), "")


def token_count(text) -> Column:
    """Number of tokens.  The split costs a fifth of counting matches of a negated
    character class, which tests every letter against every kind of white space."""
    t = _c(text)
    return F.when(t.isNotNull(), F.size(words(t)))


def tokens(text) -> Column:
    """Whitespace split, lower-cased; empty strings dropped."""
    return words(F.lower(_c(text)))


def _ngram_pattern(n: int) -> str:
    # zero-width match at every token start, capturing the next n tokens
    return r"(?<![^ ])(?=([^ ]+" + r"(?: [^ ]+)" * (n - 1) + "))"


def ngrams(toks, n: int) -> Column:
    """Space-joined n-grams of a token array, [] when shorter than n.

    Tokens never contain a space, so the n-grams are the overlapping matches of n
    space-separated runs in the joined string: one compiled regex pass per order
    instead of an interpreted per-token lambda."""
    t = _c(toks)
    if n == 1:
        return t
    return F.regexp_extract_all(F.array_join(t, " "), F.lit(_ngram_pattern(n)), 1)


def ngram_set(toks, n: int) -> Column:
    return F.array_distinct(ngrams(toks, n))


def common_ngrams(a_toks, b_toks, n: int) -> Column:
    """C8 + D4 element: number of distinct n-grams shared by two token arrays."""
    return F.size(F.array_intersect(ngrams(a_toks, n), ngrams(b_toks, n))).cast("long")


def common_from_sets(a_ngrams, b_ngrams) -> Column:
    """Shared-n-gram count when both sides are already n-gram arrays."""
    return F.size(F.array_intersect(_c(a_ngrams), _c(b_ngrams))).cast("long")


def common4(a_toks, b_toks) -> Column:
    """Counts of common 1..4-grams as ARRAY<LONG>."""
    return F.array(*[common_ngrams(a_toks, b_toks, n) for n in range(1, 5)])


def common2(a_toks, b_toks, legacy_unigrams: bool = False) -> Column:
    """D3: (common unigrams, common bigrams).

    ``legacy_unigrams`` reproduces the reference quirk that compares 1-grams with
    2-grams (always 0 since a 2-gram contains a space)."""
    uni = (common_from_sets(ngrams(a_toks, 1), ngrams(b_toks, 2)) if legacy_unigrams
           else common_ngrams(a_toks, b_toks, 1))
    return F.array(uni, common_ngrams(a_toks, b_toks, 2))


def sum_lists(a, b) -> Column:
    """Element-wise sum."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def distinct_ratio(toks, n: int) -> Column:
    """G5 / block 3: distinct n-grams of the text over its token count."""
    t = _c(toks)
    return F.size(F.array_distinct(ngrams(t, n))) / F.size(t)


def sentences(text) -> Column:
    """Sentences with their punctuation kept; white space at both ends stripped,
    empties dropped.  Joined by spaces they give the text back, but for the white space
    between sentences."""
    parts = F.regexp_extract_all(_c(text), F.lit(SENTENCE_PATTERN), 0)
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(SENTENCE_TRIM))), lambda s: s != F.lit(""))


def combined_text(text, variants) -> Column:
    """Original followed by every rewrite, space separated."""
    return F.concat_ws(" ", _c(text), F.array_join(_c(variants), " "))


def join_sentences(arr) -> Column:
    """D10."""
    return F.array_join(_c(arr), " ")


def truncate_chars(text, n: int = 4000) -> Column:
    """The reference's defined fallback cut (first n characters)."""
    return F.substring(_c(text), 1, n)


def truncate_tokens(text, n: int = 1024) -> Column:
    """B4 on whitespace tokens: first n words joined by single spaces."""
    return F.array_join(F.slice(words(text), 1, n), " ")
