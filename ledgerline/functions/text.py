"""Text expressions: blank tests, description matching, header scoring."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as white space (no-break spaces do not).
WHITESPACE = (
    " \t\n\x0B\f\r\x1C\x1D\x1E\x1F\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009"
    "\u200A\u2028\u2029\u205F\u3000"
)

# Fuzzy matching needs at least this length, and this share of equal characters.
MINIMUM_FUZZY_LENGTH = 8
FUZZY_THRESHOLD = 0.90

# Score of a header equal to, or containing, a keyword; and the least accepted score.
HEADER_EQUAL_SCORE = 0.95
HEADER_CONTAINS_SCORE = 0.75
MINIMUM_HEADER_SCORE = 0.55


def is_blank(c: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(F.ltrim(c, F.lit(WHITESPACE)) == "", F.lit(True))


def trim_ascii(c: Column) -> Column:
    """Drop leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def strip(c: Column) -> Column:
    """Drop leading and trailing Unicode white space.

    Only the ends are looked at: a pattern for white space up to the end would be tried at every inner run.
    """
    return F.btrim(c, F.lit(WHITESPACE))


def strip_column(c: Column) -> Column:
    """``strip`` of a column that costs nothing to name more than once.

    A text whose ends are printable ASCII is taken as it is; others are compared with all white space.
    """
    first, last = F.ascii(c), F.ascii(F.substring(c, -1, 1))
    return F.when(first.between(33, 126) & last.between(33, 126), c).otherwise(strip(c))


@F.pandas_udf(StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKD")


def decompose(c: Column) -> Column:
    """Unicode compatibility decomposition (NFKD). Only text that is not ASCII goes to Python, in Arrow batches."""
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfkd(F.when(other, c))).otherwise(c)


def normalize_description(c: Column) -> Column:
    """Upper-case letters and digits of the decomposed text: ``Café #42`` -> ``CAFE42``.

    The result is not usable inside a join condition (the decomposition runs in Python); compute it
    in a projection first.
    """
    return F.regexp_replace(F.upper(decompose(c)), r"[^\p{L}\p{Nd}]+", "")


def numeric_tokens(c: Column) -> Column:
    """Maximal digit runs of the original text, in order."""
    return F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), 1)


def numeric_token_key(c: Column) -> Column:
    """The digit runs as one joinable string (runs hold no spaces, so nothing is lost)."""
    return F.array_join(numeric_tokens(c), " ")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: supplementary characters count twice."""
    extra = F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", ""))
    return F.length(c) + extra


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length over two normalized texts; two empty texts give 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest
    )


def within_edit_budget(a: Column, b: Column) -> Column:
    """similarity(a, b) >= 0.90 without floating point.

    The length gap is tested first, then the banded distance, which stops at the budget.
    """
    budget = F.floor(F.greatest(F.length(a), F.length(b)) / 10).cast("int")
    distance = F.call_function("levenshtein", a, b, budget)
    return (F.abs(F.length(a) - F.length(b)) <= budget) & (distance >= 0)


def prepared_match(
    norm_a: Column, tokens_a: Column, norm_b: Column, tokens_b: Column
) -> Column:
    """``descriptions_match`` over columns that already hold the normalized text and token key."""
    return (
        F.when(norm_a == norm_b, F.lit(True))
        .when(tokens_a != tokens_b, F.lit(False))
        .when(
            (utf16_length(norm_a) < MINIMUM_FUZZY_LENGTH)
            | (utf16_length(norm_b) < MINIMUM_FUZZY_LENGTH),
            F.lit(False),
        )
        .otherwise(within_edit_budget(norm_a, norm_b))
    )


def descriptions_match(a: Column, b: Column) -> Column:
    """Whether two raw descriptions name the same transaction (use in a projection)."""
    return prepared_match(
        normalize_description(a), numeric_token_key(a), normalize_description(b), numeric_token_key(b)
    )


def header_token(c: Column) -> Column:
    """Lower-case ``[a-z0-9]`` form of a header; NULL becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def keyword_score(token: Column, keywords: Sequence[str]) -> Column:
    """0.95 when the header token is a keyword, 0.75 when it contains one, else 0."""
    contains = F.lit(False)
    for word in keywords:
        contains = contains | token.contains(word)
    return (
        F.when(token.isin(list(keywords)), F.lit(HEADER_EQUAL_SCORE))
        .when(contains, F.lit(HEADER_CONTAINS_SCORE))
        .otherwise(F.lit(0.0))
    )


def filled_or_null(c: Column) -> Column:
    """The text, or NULL when it is blank."""
    return F.when(~is_blank(c), c)
