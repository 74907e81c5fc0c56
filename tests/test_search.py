import datetime as dt
from decimal import Decimal

import pytest

from ledgerline.operators import search
from ledgerline.operators.criteria import Criteria, criteria_filter, scope_to_actor
from ledgerline.schemas import TRANSACTION

T0 = dt.datetime(2024, 1, 1)


def row(id, description="x", **over):
    base = dict(
        id=id, owner_id="u1", account_id="acct-1", bank_name="Capital One", date=dt.date(2024, 1, id),
        currency_iso_code="USD", amount=Decimal("10.00"), type="DEBIT", description=description,
        created_at=T0, updated_at=None, created_by=None, updated_by=None, deleted=False,
        deleted_at=None, deleted_by=None, file_import_id=None,
    )
    return {**base, **over}


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in TRANSACTION) for r in rows], TRANSACTION)


def ids(df):
    return sorted(r.id for r in df.collect())


CASES = [
    (["Amazon Prime Video", "Amazon Web Services", "Netflix"], dict(description="amazon"), [1, 2]),
    (["Amazon Prime", "Whole Foods", "Target Store"], dict(description="amazon target"), [1, 3]),
    (["100% Bonus", "1000 Points", "10000 Reward"], dict(description="100%"), [1]),
    (["A_B", "AXB"], dict(description="a_b"), [1]),
    (["C:\\temp", "C:/temp"], dict(search_text="c:\\"), [1]),
    (["a", "b"], dict(description="  "), [1, 2]),
    (["coffee shop", "coffee bar", "tea shop"], dict(description="coffee", search_text="shop"), [1]),
]


@pytest.mark.parametrize("texts,criteria,expected", CASES)
def test_text_criteria(spark, texts, criteria, expected):
    tx = frame(spark, *[row(i, t) for i, t in enumerate(texts, 1)])
    assert ids(criteria_filter(tx, Criteria(**criteria))) == expected


def test_search_text_ignores_bank(spark):
    tx = frame(spark, row(1, "Coffee Shop", bank_name="Capital One"), row(2, "Grocery"))
    assert ids(criteria_filter(tx, Criteria(description="capital"))) == []


def test_sets_ranges_and_blanks(spark):
    tx = frame(
        spark,
        row(1, currency_iso_code="usd", amount=Decimal("5.00")),
        row(2, currency_iso_code="THB", account_id=None, updated_at=T0),
        row(3, currency_iso_code="EUR", bank_name="Bangkok Bank", owner_id="U1"),
    )
    run = lambda **c: ids(criteria_filter(tx, Criteria(**c)))
    assert run(currency_iso_codes=("USD", " ", None)) == [1]
    assert run(currency_iso_codes=(" ", None)) == [1, 2, 3]
    assert run(account_ids=("ACCT", "zzz")) == [1, 3]
    assert run(bank_names=("bangkok nothing",)) == [3]
    assert run(owner_id="u1") == [1, 2]
    assert run(owner_id=" ") == [1, 2, 3]
    assert run(min_amount=Decimal("5.00"), max_amount=Decimal("5.00")) == [1]
    assert run(date_from=dt.date(2024, 1, 2), date_to=dt.date(2024, 1, 3)) == [2, 3]
    assert run(updated_after=T0) == [2]
    assert run() == [1, 2, 3]
    assert ids(criteria_filter(tx, None)) == [1, 2, 3]
    assert ids(criteria_filter(tx, Criteria.from_filter(currency_iso_code="eur"))) == [3]
    assert ids(scope_to_actor(tx, "U1")) == [3]


def test_open_ended_view_criteria():
    today = dt.date(2024, 6, 1)
    assert Criteria.from_view("u", True, today).date_to == today
    assert Criteria.from_view("u", False, today).date_to is None
    assert Criteria.from_view("u", True, today, date_to=T0.date()).date_to == T0.date()


def test_pages(spark):
    tx = frame(spark, *[row(i, deleted=i == 3, updated_at=T0 if i % 2 else None) for i in range(1, 8)])
    rows, meta = search.search_page(tx, None, page=1, size=4)
    assert [r.id for r in rows.collect()] == [2, 1]
    assert meta.first().asDict() == dict(
        page=1, size=4, number_of_elements=2, total_elements=6, total_pages=2, first=False, last=True
    )
    rows, _ = search.search_page(tx, None, sort=[("updated_at", "asc")], size=3)
    assert [r.id for r in rows.collect()] == [1, 5, 7]
    rows, _ = search.search_page(tx, None, sort=[("updated_at", "desc")], size=3)
    assert [r.id for r in rows.collect()] == [2, 4, 6]
    after = search.search_after(tx, None, dt.date(2024, 1, 4), 4, size=2)
    assert [r.id for r in after.collect()] == [2, 1]
    assert search.page_size(1000, most=1000) == 1000
    with pytest.raises(ValueError, match="page size"):
        search.page_size(1000)
    with pytest.raises(ValueError, match="Unsupported sort field"):
        search.search_page(tx, None, sort=[("deleted", "asc")])


def test_range_reaches_parquet(spark, tmp_path):
    path = str(tmp_path / "tx")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    frame(spark, row(1), row(2)).write.parquet(path)
    c = Criteria(date_from=dt.date(2024, 1, 2), min_amount=Decimal("1.00"))
    hits = search.search_page(spark.read.parquet(path), c)[0]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2024-01-02)" in plan and "GreaterThanOrEqual(amount" in plan
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize(
    "sort", [search.DEFAULT_SORT, [("updated_at", "desc"), ("amount", "asc")], [("description", "asc")]]
)
def test_ranked_pages_equal_sorted_ones(spark, sort):
    """Ties, nulls and a description that most rows share; pages inside, across and beyond the ranges."""
    tx = frame(
        spark,
        *[
            row(
                i, "hot" if i % 4 else f"d{i}", date=dt.date(2024, 1, 1 + i % 3), amount=Decimal(i % 5),
                updated_at=T0 if i % 2 else None, deleted=i == 9, type="CREDIT" if i == 7 else "DEBIT",
            )
            for i in range(1, 29)
        ],
    )
    c = Criteria(type="DEBIT")
    ranked = search.rank_hits(tx, c, sort, ranges=5)
    assert ranked.total == 26 and max(b - a for a, b in zip((0, *ranked.ends), ranked.ends)) < 16
    for page, size in [(0, 3), (2, 4), (1, 13), (5, 5), (9, 100)]:
        rows, meta = search.ranked_page(ranked, page, size)
        plain, plain_meta = search.search_page(tx, c, page, size, sort)
        assert rows.collect() == plain.collect()
        assert meta.collect() == plain_meta.collect()
    keys = search.page_keys(ranked, 0, 3)
    assert keys.count() == 3 and "_range" in keys.columns and not {"bank_name", "owner_id"} & set(keys.columns)


def test_ranked_pages_of_nothing(spark):
    ranked = search.rank_hits(frame(spark, row(1, deleted=True)), None, ranges=3)
    rows, meta = search.ranked_page(ranked, 0)
    assert ranked.total == 0 and rows.collect() == [] and meta.first().total_pages == 0
    with pytest.raises(ValueError):
        search.ranked_page(ranked, -1)
