"""Criteria search: one boolean Column from a set of optional conditions.

``criteria_column`` serves a search known when the query is planned. ``view_predicate`` serves stored
criteria, where every row of a view table carries its own conditions and the predicate compares
columns with columns.

Range and equality conditions stay bare column comparisons so that they reach the Parquet reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, trim_ascii
from ..schemas import ID_SET_JSON, VIEW_CRITERIA_JSON

_ASCII_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
# Space-like characters that do not count as white space.
_NOT_SPACE = {"\u0085", "\u00a0", "\u2007", "\u202f"}


def _blank(text: str | None) -> bool:
    return text is None or all(ch.isspace() and ch not in _NOT_SPACE for ch in text)


def _kept(values: Iterable[str | None] | None) -> tuple[str, ...]:
    return tuple(v for v in (values or ()) if not _blank(v))


def _words(text: str) -> list[str]:
    trimmed = text.strip("".join(map(chr, range(0x21))))
    return [w.lower() for w in _ASCII_SPACE.split(trimmed) if not _blank(w)]


@dataclass(frozen=True)
class Criteria:
    """Optional conditions, all ANDed. None, blank text and empty sets mean "no condition"."""

    id: int | None = None
    owner_id: str | None = None
    account_ids: tuple[str, ...] = ()
    bank_names: tuple[str, ...] = ()
    currency_iso_codes: tuple[str, ...] = ()
    date_from: date | None = None
    date_to: date | None = None
    min_amount: Decimal | None = None
    max_amount: Decimal | None = None
    type: str | None = None
    description: str | None = None
    search_text: str | None = None
    created_after: datetime | None = None
    created_before: datetime | None = None
    updated_after: datetime | None = None
    updated_before: datetime | None = None

    def __post_init__(self):
        for name in ("account_ids", "bank_names", "currency_iso_codes"):
            object.__setattr__(self, name, _kept(getattr(self, name)))

    @classmethod
    def from_filter(
        cls,
        account_id: str | None = None,
        bank_name: str | None = None,
        currency_iso_code: str | None = None,
        **conditions,
    ) -> Criteria:
        """Criteria of a search form, where account, bank and currency are single values."""
        return cls(
            account_ids=(account_id,),
            bank_names=(bank_name,),
            currency_iso_codes=(currency_iso_code,),
            **conditions,
        )

    @classmethod
    def from_view(cls, owner_id: str, open_ended: bool, as_of: date, **conditions) -> Criteria:
        """Criteria of one stored view: scoped to its owner, ending today when open-ended."""
        if open_ended and conditions.get("date_to") is None:
            conditions["date_to"] = as_of
        return cls(owner_id=owner_id, **conditions)


def text_filter(field: Column, text: str | None) -> Column | None:
    """Any word of ``text`` occurs in ``field``, ignoring case; None for blank text."""
    if _blank(text):
        return None
    words = _words(text)
    if not words:
        return None
    low = F.lower(field)
    return reduce(lambda a, b: a | b, [low.contains(F.lit(w)) for w in words])


def any_text_filter(field: Column, texts: Iterable[str]) -> Column | None:
    parts = [p for p in (text_filter(field, t) for t in texts) if p is not None]
    return reduce(lambda a, b: a | b, parts) if parts else None


def criteria_column(c: Criteria | None) -> Column:
    """The condition of ``c`` as one Column; always true for empty criteria."""
    c = c or Criteria()
    col = F.col
    parts: list[Column | None] = [
        None if c.id is None else col("id") == c.id,
        None if _blank(c.owner_id) else col("owner_id") == c.owner_id,
        any_text_filter(col("account_id"), c.account_ids),
        any_text_filter(col("bank_name"), c.bank_names),
        F.lower(col("currency_iso_code")).isin([v.lower() for v in c.currency_iso_codes])
        if c.currency_iso_codes
        else None,
        text_filter(col("description"), c.description),
        text_filter(col("description"), c.search_text),
        None if c.type is None else col("type") == c.type,
    ]
    ranges = [
        ("date", c.date_from, c.date_to),
        ("amount", c.min_amount, c.max_amount),
        ("created_at", c.created_after, c.created_before),
        ("updated_at", c.updated_after, c.updated_before),
    ]
    for name, low, high in ranges:
        parts.append(None if low is None else col(name) >= F.lit(low))
        parts.append(None if high is None else col(name) <= F.lit(high))
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def active(tx: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return tx.where(~F.col("deleted"))


def criteria_filter(tx: DataFrame, c: Criteria | None) -> DataFrame:
    return tx.where(criteria_column(c))


def scope_to_actor(tx: DataFrame, actor: str, can_act_on_any: bool = False) -> DataFrame:
    """Rows the actor may see; the rest is as good as missing."""
    return tx if can_act_on_any else tx.where(F.col("owner_id") == actor)


# -- stored criteria ---------------------------------------------------------------------------


def _word_list(texts: Column) -> Column:
    """Lower-case words of all non-blank texts of an array column (never NULL)."""
    kept = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: ~is_blank(t))
    words = F.flatten(F.transform(kept, lambda t: F.split(trim_ascii(t), r"[ \t\n\x0B\f\r]+")))
    return F.transform(F.filter(words, lambda w: ~is_blank(w)), F.lower)


def id_set(text: Column) -> Column:
    """``[1,2]`` as an array; NULL, blank and ``[]`` give an empty array."""
    empty = F.array().cast(ID_SET_JSON)
    return F.when(is_blank(text), empty).otherwise(
        F.array_distinct(F.coalesce(F.from_json(text, ID_SET_JSON), empty))
    )


def id_set_text(ids: Column) -> Column:
    """An id array as stored text; an empty set is ``[]``."""
    return F.to_json(F.array_sort(F.coalesce(ids, F.array().cast(ID_SET_JSON))))


def id_set_add(ids: Column, more: Column) -> Column:
    return F.array_union(ids, more)


def id_set_remove(ids: Column, gone: Column) -> Column:
    return F.array_except(ids, gone)


def with_view_conditions(views: DataFrame, as_of: date) -> DataFrame:
    """Views with their JSON criteria resolved into plain condition columns.

    Everything that depends on the view alone (JSON, word splitting, lower-casing, the open end) is
    worked out here, once per view, not once per view and transaction.
    """
    crit = F.coalesce(F.col("criteria"), F.lit("{}"))
    parsed = views.withColumn("_c", F.from_json(crit, VIEW_CRITERIA_JSON))
    return parsed.select(
        F.col("id").alias("view_id"),
        F.col("user_id").alias("view_owner"),
        F.col("_c.dateFrom").alias("v_date_from"),
        F.coalesce(F.col("_c.dateTo"), F.when(F.col("open_ended"), F.lit(as_of))).alias("v_date_to"),
        F.col("_c.minAmount").alias("v_min"),
        F.col("_c.maxAmount").alias("v_max"),
        F.col("_c.type").alias("v_type"),
        _word_list(F.col("_c.accountIds")).alias("v_accounts"),
        _word_list(F.col("_c.bankNames")).alias("v_banks"),
        F.transform(
            F.filter(
                F.coalesce(F.col("_c.currencyIsoCodes"), F.array().cast("array<string>")),
                lambda t: ~is_blank(t),
            ),
            F.lower,
        ).alias("v_currencies"),
        _word_list(F.array(F.col("_c.searchText"))).alias("v_words"),
        id_set(F.col("pinned_ids")).alias("v_pinned"),
        id_set(F.col("excluded_ids")).alias("v_excluded"),
    )


def with_lower_text(tx: DataFrame) -> DataFrame:
    """Transactions with the lower-case texts that ``view_predicate`` searches, made once per row."""
    fields = ("currency_iso_code", "bank_name", "account_id", "description")
    return tx.select("*", *[F.lower(name).alias(f"l_{name}") for name in fields])


def view_predicate() -> Column:
    """Whether a transaction row (of ``with_lower_text``) fits the condition columns of a view row
    joined to it."""

    def open_or(bound: Column, test: Column) -> Column:
        return bound.isNull() | test

    def any_word(words: Column, field: Column) -> Column:
        return (F.size(words) == 0) | F.exists(words, lambda w: F.contains(field, w))

    col = F.col
    return (
        open_or(col("v_date_from"), col("date") >= col("v_date_from"))
        & open_or(col("v_date_to"), col("date") <= col("v_date_to"))
        & open_or(col("v_min"), col("amount") >= col("v_min"))
        & open_or(col("v_max"), col("amount") <= col("v_max"))
        & open_or(col("v_type"), col("type") == col("v_type"))
        & (
            (F.size("v_currencies") == 0)
            | F.array_contains(col("v_currencies"), col("l_currency_iso_code"))
        )
        & any_word(col("v_banks"), col("l_bank_name"))
        & any_word(col("v_accounts"), col("l_account_id"))
        & any_word(col("v_words"), col("l_description"))
    )
