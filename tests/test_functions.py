import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mudlark.functions import numfmt, text, values
from mudlark.spec import ColumnSpec


@pytest.mark.parametrize(
    ("seen", "thousands", "decimal", "scale", "ambiguous"),
    [
        (["1'100.00", "12.5"], "'", ".", 2, False),
        (["1.234,56", "2,5"], ".", ",", 2, False),
        (["1,234"], ",", None, 0, True),
        (["1.234"], None, ".", 3, True),
        (["1,234,567"], ",", None, 0, False),
        (["1,5"], None, ",", 1, False),
        (["12", "13"], None, None, 0, False),
    ],
)
def test_number_formats(seen, thousands, decimal, scale, ambiguous):
    assert numfmt.infer(seen) == numfmt.NumberFormat(thousands, decimal, scale, ambiguous)


@pytest.mark.parametrize("seen", [["1,5", "2.5"], ["abc"], ["1,23,4.5.6"], []])
def test_no_number_format(seen):
    assert numfmt.infer(seen) is None


@given(st.integers(0, 10**12), st.integers(0, 99), st.sampled_from([("'", "."), (".", ","), (",", ".")]))
def test_format_round_trip(whole, cents, marks):
    t, d = marks
    shown = f"{whole:,}".replace(",", t) + d + f"{cents:02d}"
    found = numfmt.infer([shown])
    assert found is not None and not found.ambiguous and found.decimal == d


def test_names():
    assert [text.sanitize(x) for x in ("Preis (CHF)", "Größe", "2025", "", "a--b")] == ["preis_chf", "groesse", "c_2025", "col", "a_b"]
    assert text.unique(["Betrag", "Betrag", "", "x"]) == ["Betrag", "Betrag_2", "col_3", "x"]
    with pytest.raises(ValueError):
        text.java_pattern("(?=x)")


def parsed(spark, raw, **spec):
    c = ColumnSpec("x", **spec)
    value, problem = values.parse(F.col("raw"), c)
    r = spark.createDataFrame([(raw,)], "raw string").select(value.alias("v"), problem.alias("p")).first()
    return r["v"], r["p"]


@pytest.mark.parametrize(
    ("raw", "spec", "want"),
    [
        (" 1'234.50 ", {"dtype": "decimal", "precision": 10, "scale": 2, "thousands": "'"}, Decimal("1234.50")),
        ("1.005", {"dtype": "decimal", "precision": 10, "scale": 2}, Decimal("1.01")),
        ("-1.005", {"dtype": "decimal", "precision": 10, "scale": 2}, Decimal("-1.01")),
        ("(1.234,56)", {"dtype": "decimal", "precision": 10, "scale": 2, "thousands": ".", "decimal": ",", "negative": "parentheses"}, Decimal("-1234.56")),
        ("12-", {"dtype": "int64", "negative": "trailing_minus"}, -12),
        ("+7", {"dtype": "int64"}, 7),
        ("123", {"dtype": "decimal", "precision": 10, "scale": 2, "decimal_shift": -2}, Decimal("1.23")),
        ("5", {"dtype": "decimal", "precision": 10, "scale": 3, "decimal_shift": -3}, Decimal("0.005")),
        ("1.5", {"dtype": "int64", "decimal_shift": 2}, 150),
        ("1e3", {"dtype": "float64"}, 1000.0),
        ("n/a", {"dtype": "int64", "na_values": ("N/A",)}, None),
        ("", {"dtype": "date"}, None),
        ("Ja", {"dtype": "bool"}, True),
        ("1.2.2024", {"dtype": "date", "format": "%d.%m.%Y"}, dt.date(2024, 2, 1)),
        ("01.02.69", {"dtype": "date", "format": "%d.%m.%y"}, dt.date(2069, 2, 1)),
        ("01.02.70", {"dtype": "date", "format": "%d.%m.%y"}, dt.date(1970, 2, 1)),
        ("Feb 2024", {"dtype": "date", "format": "%b %Y"}, dt.date(2024, 2, 1)),
        ("61", {"dtype": "date", "epoch": "excel"}, dt.date(1900, 3, 1)),
        ("45658.5", {"dtype": "timestamp", "epoch": "excel"}, dt.datetime(2025, 1, 1, 12)),
        ("-1", {"dtype": "date", "epoch": "seconds"}, dt.date(1969, 12, 31)),
        ("1700000000000", {"dtype": "timestamp", "epoch": "millis"}, dt.datetime(2023, 11, 14, 22, 13, 20)),
        ("2024-01-02 03:04", {"dtype": "timestamp", "format": "%Y-%m-%d %H:%M"}, dt.datetime(2024, 1, 2, 3, 4)),
        ("2024-01-02", {"dtype": "timestamp", "format": "%Y-%m-%d %H:%M"}, dt.datetime(2024, 1, 2)),
        ('{"a":{"b/c":[1,"x"]}}', {"pointer": "/a/b~1c/1"}, "x"),
        ('{"a":1}', {"pointer": "/b"}, None),
    ],
)
def test_values(spark, raw, spec, want):
    assert parsed(spark, raw, **spec) == (want, None)


@pytest.mark.parametrize(
    ("raw", "spec"),
    [
        ("1,5", {"dtype": "decimal", "thousands": ","}),
        ("12,34", {"dtype": "int64", "thousands": ","}),
        ("NaN", {"dtype": "float64"}),
        ("1e400", {"dtype": "float64"}),
        ("1e-400", {"dtype": "float64"}),
        ("1e3", {"dtype": "decimal", "scale": 0}),
        ("1.234", {"dtype": "decimal", "precision": 9, "scale": 2, "round": "error"}),
        ("9223372036854775808", {"dtype": "int64"}),
        ("(5)", {"dtype": "int64"}),
        ("(-5)", {"dtype": "int64", "negative": "parentheses"}),
        ("01.02.25", {"dtype": "date", "format": "%d.%m.%Y"}),
        ("30.02.2024", {"dtype": "date", "format": "%d.%m.%Y"}),
        ("60", {"dtype": "date", "epoch": "excel"}),
        ("45658.5", {"dtype": "date", "epoch": "excel"}),
        ("maybe", {"dtype": "bool"}),
        ("", {"dtype": "int64", "nullable": False}),
        ('{"a":{}}', {"pointer": "/a"}),
    ],
)
def test_faults(spark, raw, spec):
    value, problem = parsed(spark, raw, **spec)
    assert value is None and problem


def test_shape(spark):
    seen = {"Ab12": "Aa99", "ABC-x": "A+-a", "1234567890": "9+", "a  b": "a a", "99.99.9999": "99.99.9999", "Straße 7": "Aa+ 9"}
    rows = spark.createDataFrame([(k,) for k in seen], "v string").select("v", text.shape(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in rows} == seen
