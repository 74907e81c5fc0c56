import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.functions import values as V
from ledgerline.operators import inference

PAIRS = [
    ("X CORP. PAID FEATURESBASTROPTX", "X CORP. PAID FEATURES BASTROP     TX", True),
    ("Whole-Foods Market #123", "Whole Foods Market 123", True),
    ("PAYPAL DIGITAL SERVICES", "PAYPAL DIGITAL SERVICE", True),
    ("TRANSFER 1234567890", "TRANSFER 1234567891", False),
    ("PAYPAL DIGITAL SERVICES REF 1234567890 MONTHLY",
     "PAYPAL DIGITAL SERVICE REF 1234567890 MONTHLY", True),
    ("SUBSCRIPTION SERVICE PLAN REF 1 AUTH 2 MONTHLY PAYMENT",
     "SUBSCRIPTION SERVICE PLAN REF 2 AUTH 1 MONTHLY PAYMENT", False),
    ("BILL PAY REF 100 AUTH 55 MONTHLY PAYMENT", "BILLPAY REF 100 AUTH 55 MONTHLY PAYMENTS", True),
    ("PAYMENT TO LANDLORD REFERENCE 42", "PAYMENT TO LANDLORD REFERENCE", False),
    ("RENT PAYMENT MAY", "STARBUCKS STORE 1234", False),
    ("ABC", "ABD", False),
    ("A.B.", "ab", True),
    ("REF 1 23", "REF 12 3", True),
    ("--", "!!", True),
    ("ABCDEFGHIJ", "ABCDEFGHIX", True),
    ("ABCDEFGHI", "ABCDEFGHX", False),
    ("ＦＵＬＬＷＩＤＴＨ ﬁne", "fullwidth FINE", True),
]


def test_descriptions_match(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string, expected boolean")
    got = df.withColumn("got", X.descriptions_match(F.col("a"), F.col("b"))).collect()
    assert [(r.a, r.got) for r in got] == [(r.a, r.expected) for r in got]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


def test_normalize(spark):
    assert one(spark, X.normalize_description, " Café - Market #42 ") == "CAFEMARKET42"
    assert one(spark, X.normalize_description, "Straße ½") == "STRASSE12"
    assert one(spark, X.numeric_tokens, "a12b 3-045") == ["12", "3", "045"]
    assert one(spark, X.utf16_length, "a\U0001d400") == 3


@pytest.mark.parametrize(
    "text,blank",
    [(None, True), ("", True), (" \t\u2003\u001c", True), ("\u00a0", False), ("\u0085", False),
     (" a", False), ("\n", True)],
)
def test_blank(spark, text, blank):
    assert one(spark, X.is_blank, text) is blank


@pytest.mark.parametrize(
    "text,csv,signed",
    [("$1,234.56", "1234.56", "1234.56"), ("-5.00", "5.00", "-5.00"), ("(7.50)", "7.50", "-7.50"),
     ("8.00-", "8.00", "8.00"), ("1.2.3", None, None), ("abc", None, None), ("+9", "9", "9")],
)
def test_amounts(spark, text, csv, signed):
    number = lambda v: None if v is None else Decimal(v)
    assert one(spark, V.csv_amount, text) == number(csv)
    assert one(spark, V.signed_amount, text) == number(signed)


@pytest.mark.parametrize(
    "text,pattern,expected",
    [
        ("02/30/2024", "MM/dd/uuuu", dt.date(2024, 2, 29)),
        ("04/31/23", "MM/dd/uu", dt.date(2023, 4, 30)),
        ("02/32/2024", "MM/dd/uuuu", None),
        ("13/01/2024", "MM/dd/uuuu", None),
        ("1/2/2024", "MM/dd/uuuu", None),
        ("1/2/2024", "d/M/uuuu", dt.date(2024, 2, 1)),
        ("5 Nov 2024 10:30", "d MMM uuuu HH:mm", dt.date(2024, 11, 5)),
        ("5 Nov 2024", "d MMM uuuu HH:mm", dt.date(2024, 11, 5)),
        ("5 NOV 2024", "d MMM uuuu", None),
        ("November 5, 2024", "MMMM d, uuuu", dt.date(2024, 11, 5)),
        ("2024-11-05", "yyyy-MM-dd", dt.date(2024, 11, 5)),
        ("2024-11-05x", "uuuu-MM-dd", None),
        ("05.11.2024", "dd.MM.uuuu", dt.date(2024, 11, 5)),
        ("05x11y2024", "dd.MM.uuuu", None),
        ("11/05", "MM/dd", None),
        ("1999-01-31", "uuuu-MM-dd", dt.date(1999, 1, 31)),
    ],
)
def test_statement_date(spark, text, pattern, expected):
    df = spark.createDataFrame([(text, pattern)], "t string, p string")
    assert df.select(V.statement_date(F.col("t"), F.col("p"))).first()[0] == expected
    assert df.select(V.statement_date(F.col("t"), F.lit(pattern))).first()[0] == expected


def test_calendar_date_is_strict(spark):
    df = spark.createDataFrame([(2023, 2, 30), (2024, 2, 29), (2024, 13, 1)], "y int, m int, d int")
    got = df.select(V.calendar_date(F.col("y"), F.col("m"), F.col("d"))).collect()
    assert [r[0] for r in got] == [None, dt.date(2024, 2, 29), None]


@pytest.mark.parametrize(
    "text,expected",
    [("2024-01-05", "uuuu-MM-dd"), ("Nov 5, 2024", "MMM d, uuuu"), ("November 5", "MMMM d"),
     ("13/2/24", "dd/M/uu"), ("3/14", "M/dd"), ("hello", None)],
)
def test_table_date_format(spark, text, expected):
    found = inference.infer_table_date_format
    assert one(spark, lambda c: found(F.array(F.lit(""), c)), text) == expected
