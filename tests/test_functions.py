"""Scalar functions on awkward values."""

import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from monthmatch.functions import parse, text
from monthmatch.functions.fields import pack, unpack


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i INT, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(df)).collect()]


@pytest.mark.parametrize(
    ("written", "expected"),
    [
        ("20260115", dt.date(2026, 1, 15)),
        (" 20260115\t", dt.date(2026, 1, 15)),
        ("2026-01-15", dt.date(2026, 1, 15)),
        ("2026/01/15", dt.date(2026, 1, 15)),
        ("01/15/2026", dt.date(2026, 1, 15)),
        ("15/01/2026", dt.date(2026, 1, 15)),
        ("03/04/2026", dt.date(2026, 3, 4)),
        ("15-Jan-2026", dt.date(2026, 1, 15)),
        ("15-OCT-2026", dt.date(2026, 10, 15)),
        ("5 SEPT 2026T10:30", dt.date(2026, 9, 5)),
        ("15-Jan-26", dt.date(2026, 1, 15)),
        ("Jan 15, 2026", dt.date(2026, 1, 15)),
        ("jan. 5, 99 10:30", dt.date(1999, 1, 5)),
        ("2026 January 15", dt.date(2026, 1, 15)),
        ("15.01.2026", dt.date(2026, 1, 15)),
        ("01.02.2026 10:30", dt.date(2026, 1, 2)),
        ("31/12/75", dt.date(2075, 12, 31)),
        ("31/12/76", dt.date(1976, 12, 31)),
        ("26-01-15", dt.date(2015, 1, 26)),
        ("76-01-15", dt.date(1976, 1, 15)),
        ("00/01/15", None),
        ("13.13.2026", None),
        ("Jan 32, 2026", None),
        ("Janu 15, 2026", None),
        ("Jan 15 10:30", None),
        ("01.02-2026", None),
        ("1.5", None),
        ("2026-01-15 10:11:12", dt.date(2026, 1, 15)),
        ("20250199", None),
        ("2026115", None),
        ("NaT", None),
        ("none", None),
        ("", None),
        (None, None),
        ("later", None),
    ],
)
def test_parse_date(spark, written, expected):
    assert values(spark, lambda df: parse.parse_date(F.col("v")), [written]) == [expected]


def test_parse_date_like_pandas(spark):
    seps = [f"%d{a}%m{a}%Y" for a in "-/."] + [f"%m{a}%d{a}%y" for a in "-/."] + [f"%d{a}%m{a}%y" for a in "-/."]
    forms = [*seps, "%Y.%m.%d", "%d-%b-%y", "%d %B, %Y", "%b %d, %Y", "%B %d %Y", "%b-%d-%y", "%d.%b.%Y", "%Y-%b-%d", "%b. %d, %Y %H:%M"]
    days = [dt.datetime(1980, 1, 1, 9, 5) + dt.timedelta(days=997 * k) for k in range(28)]
    written = [style(day.strftime(form)) for day in days for form in forms for style in (str, str.upper)]
    wanted = [pd.to_datetime(w).date() for w in written]
    assert values(spark, lambda df: parse.parse_date(F.col("v")), written) == wanted


def test_parse_amount(spark):
    written = ["1,234.5", " 7 ", "1234.565", "-3", "+3", "1e3", "nan", "", None, "1_000", "inf", "1d", "x", ".5"]
    found = values(spark, lambda df: parse.parse_amount(F.col("v")), written)
    expected = ["1234.50", "7.00", "1234.57", "-3.00", "3.00", "1000.00", *[None] * 7, "0.50"]
    assert found == [None if e is None else Decimal(e) for e in expected]


def test_strip_takes_all_white_space():
    import sys

    spaces = {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}
    assert set(text.WHITE_SPACE) == spaces


def test_normalized(spark):
    written = ["  ab ", "\x1f　straße\n", None, "\t", "a b"]
    assert values(spark, lambda df: text.normalized("v"), written) == ["AB", "STRASSE", "", "", "A B"]


def test_stringify(spark):
    numbers = [233554000000.0, 0.1, 1.5e-05, 0.00012, 12345678.25, None, float("nan"), -3.0, 1e22, 1e-7]
    found = values(spark, lambda df: text.stringify(df, "v"), numbers, "double")
    assert found == [
        "233554000000", "0.1", "1.5e-05", "0.00012", "12345678.25", "", "", "-3",
        "10000000000000000000000", "1e-07",
    ]
    assert values(spark, lambda df: text.stringify(df, "v"), [" 007 ", None]) == ["007", ""]
    assert values(spark, lambda df: text.stringify(df, "v"), [7], "bigint") == ["7"]


def test_concat_keeps_the_slot_of_a_null(spark):
    df = spark.createDataFrame([("a", None, "b")], "x STRING, y STRING, z STRING")
    assert df.select(text.concat_fields(df, ["x", "y", "none", "z"])).first()[0] == "a|||b"


def test_previous_period(spark):
    found = values(spark, lambda df: parse.previous_period(F.col("v")), ["2026-01", "2026-12"])
    assert found == ["2025-12", "2026-11"]


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("ACME0626_IND.csv", ("ACME", "2026-06", "IND", 1)),
        ("ACME0626_BUS_2.csv", ("ACME", "2026-06", "BUS", 2)),
        ("abc120626_bus_2.csv", ("ABC12", "2026-06", "BUS", 2)),
        ("ACME0626_IND", ("ACME", "2026-06", "IND", 1)),
        ("CP1326_IND.csv", None),
        ("CP0026_IND.csv", None),
        ("0626_IND.csv", None),
        ("CP0626_INDIVIDUAL.csv", None),
        ("CP0626_IND_2_final.csv", None),
        ("CP0626.csv", None),
    ],
)
def test_submission_of(spark, name, expected):
    (found,) = values(spark, lambda df: parse.submission_of(F.col("v")), [name])
    assert (None if found is None else tuple(found)) == expected


def test_pack_and_unpack(spark):
    df = spark.createDataFrame([("A", None)], "NatIDNum STRING, TINum STRING")
    packed = df.select(pack(df, "IND").alias("IdentityFields"))
    assert packed.first()[0] == {"NatIDNum": "A", "TINum": ""}
    fields = ("NatIDNum", "TINum", "HomeTel")
    assert tuple(unpack(packed, fields).first()) == ("A", "", None)
    as_json = packed.select(F.to_json("IdentityFields").alias("IdentityFields"))
    assert tuple(unpack(as_json, fields).first()) == ("A", "", None)
