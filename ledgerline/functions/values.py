"""Amount, date and type expressions for statement text.

Statement text is dirty, and ANSI mode raises on bad casts, so every conversion here is a ``try``
conversion: a value that cannot be read becomes NULL and the caller turns that into an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import header_token, strip, strip_column

AMOUNT_TYPE = "decimal(38,18)"
MONEY_TYPE = "decimal(38,2)"

# English month names.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
SHORT_MONTHS = [name[:3] for name in MONTHS]

# Words of a type column.
CSV_CREDIT_WORDS = ["credit", "deposit"]
CSV_DEBIT_WORDS = ["debit", "withdrawal"]
TABLE_CREDIT_WORDS = ["credit", "cr", "deposit", "payment", "inflow"]
TABLE_DEBIT_WORDS = ["debit", "dr", "withdrawal", "withdraw", "purchase", "outflow"]


def canonical_amount(c: Column) -> Column:
    """Two decimals, half up."""
    return c.cast(MONEY_TYPE)


def plain_amount(c: Column) -> Column:
    """``1,862.72`` as a number; NULL when it is none."""
    return F.regexp_replace(c, ",", "").try_cast(AMOUNT_TYPE)


def csv_amount(c: Column) -> Column:
    """Digits and points only, so signs and currency marks vanish; NULL when unreadable."""
    return F.regexp_replace(c, "[^0-9.]+", "").try_cast(AMOUNT_TYPE)


def signed_amount(c: Column) -> Column:
    """``(1,234.50)`` and ``-$1,234.50`` are negative; a trailing minus is ignored."""
    text = strip_column(c)
    digits = strip(F.regexp_replace(text, r"[()$,+\-]+", ""))
    amount = digits.try_cast(AMOUNT_TYPE)
    return F.when(text.startswith("(") | text.startswith("-"), -amount).otherwise(amount)


def csv_type(c: Column) -> Column:
    """CREDIT or DEBIT from the cell of a CSV type column, else NULL."""
    word = F.lower(F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""))
    return (
        F.when(word.isin(CSV_CREDIT_WORDS), "CREDIT").when(word.isin(CSV_DEBIT_WORDS), "DEBIT")
    )


def table_type(c: Column) -> Column:
    """CREDIT or DEBIT from the cell of a text-table type column, else NULL."""
    word = header_token(c)
    return (
        F.when(word.isin(TABLE_CREDIT_WORDS), "CREDIT").when(word.isin(TABLE_DEBIT_WORDS), "DEBIT")
    )


def month_number(name: Column) -> Column:
    """1..12 from the first three letters of an English month name, else NULL."""
    names = F.create_map(*[F.lit(x) for n, m in enumerate(SHORT_MONTHS, 1) for x in (m, n)])
    return F.try_element_at(names, F.substring(name, 1, 3))


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL when there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), month, day), "yyyy-M-d")


# Pattern letters, longest first, a mark to stand for them, and the text that they read. Month and
# day take part only within 1..12 and 1..31; a month name is read as its first three letters.
_PATTERN_TOKENS = [
    (r"uuuu|yyyy", "\u0001", r"(?<y>\d{4})"),
    (r"uu|yy", "\u0002", r"(?<y>\d{2})"),
    (r"MMMM", "\u0003", "(?=(?:" + "|".join(MONTHS) + r")\b)(?<m>\w{3})\w*"),
    (r"MMM", "\u0004", "(?<m>" + "|".join(SHORT_MONTHS) + ")"),
    (r"MM", "\u0005", r"(?<m>0[1-9]|1[0-2])"),
    (r"M", "\u0006", r"(?<m>0?[1-9]|1[0-2])"),
    (r"dd", "\u0007", r"(?<d>0[1-9]|[12]\d|3[01])"),
    (r"d", "\u0008", r"(?<d>0?[1-9]|[12]\d|3[01])"),
    (r"HH", "\u000e", r"(?:[01]\d|2[0-3])"),
    (r"mm|ss", "\u000f", r"[0-5]\d"),
]


def date_pattern_regex(pattern: Column) -> Column:
    """The regular expression that reads a date pattern such as ``MM/dd/uu``.

    Derived from the pattern text by string functions, so one job serves every layout: each layout
    row carries its own expression, with groups y, m and d.
    """
    regex = F.regexp_replace(pattern, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    for letters, mark, _ in _PATTERN_TOKENS:
        regex = F.regexp_replace(regex, letters, mark)
    for _, mark, reads in _PATTERN_TOKENS:
        regex = F.replace(regex, F.lit(mark), F.lit(reads))
    absent = [
        F.when(pattern.rlike(letter), "").otherwise(f"(?<{group}>)")
        for group, letter in (("y", "[uy]"), ("m", "M"), ("d", "d"))
    ]
    return F.concat(F.lit(r"\A"), regex, *absent, F.lit(r"\z"))


def simplified_pattern(pattern: Column) -> Column:
    """The pattern without its time of day."""
    return F.trim(F.regexp_replace(pattern, r"\s*HH(:mm(:ss)?)?", ""))


_MONTH_NUMBERS = {
    **{name: n for n, name in enumerate(SHORT_MONTHS, 1)},
    **{str(n): n for n in range(1, 10)},
    **{f"{n:02d}": n for n in range(1, 13)},
}


def read_date(value: Column, regex: Column) -> Column:
    """Read ``value`` by an expression of ``date_pattern_regex``; NULL when it does not fit.

    Two-digit years are 20yy, and day 29..31 is moved back to the end of a shorter month.
    """
    found = F.regexp_replace(value, regex, F.lit("@20${y}-${m}-${d}"))
    year = F.regexp_extract(found, r"\A@(?:20)?(\d{4})-", 1).try_cast("int")
    month = F.regexp_extract(found, r"\A@\d+-(\w+)-", 1)
    day = F.regexp_extract(found, r"\A@\d+-\w+-(\d+)\z", 1).try_cast("int")
    numbers = F.create_map(*[F.lit(x) for pair in _MONTH_NUMBERS.items() for x in pair])
    first = F.make_date(year, F.try_element_at(numbers, month), F.lit(1))
    return F.least(F.date_add(first, day - 1), F.last_day(first))


def statement_date(value: Column, pattern: Column) -> Column:
    """Read a date by its pattern, then by the pattern without time of day."""
    return F.coalesce(
        read_date(value, date_pattern_regex(pattern)),
        read_date(value, date_pattern_regex(simplified_pattern(pattern))),
    )


def pattern_has_year(pattern: Column) -> Column:
    return pattern.contains("u") | pattern.contains("y")


def month_first_year(
    month: Column, start_month: Column, start_year: Column, end_year: Column
) -> Column:
    """Year of a month in a period that may span New Year."""
    return F.when(
        (start_year != end_year) & (month >= start_month), start_year
    ).otherwise(end_year)


def month_end_year(month: Column, end_month: Column, year: Column) -> Column:
    """Year of a month in a one-month statement: months well past its end belong to last year."""
    return F.when(month > end_month + 1, year - 1).otherwise(year)
