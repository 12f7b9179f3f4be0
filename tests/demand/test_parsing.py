import math

import pytest
from pyspark.sql import functions as F

from granary.functions import parsing

# text: day, or None for a rejected one
DAYS = {
    "2024-10-01": "2024-10-01", "2024": "2024-01-01", "2024-10": "2024-10-01", "2024-1-5": "2024-01-05", "2024-10-01T10": "2024-10-01", "2024-10-01 10:30:00.123456789": "2024-10-01",
    "20241001": "2024-10-01", "2024/10/01": "2024-10-01", "2024.10.01": "2024-10-01", "2024 10 01": "2024-10-01", "20241001T103000": "2024-10-01", "2024-10-01T1030": "2024-10-01",
    "2024-02-29": "2024-02-29", "1677-09-22": "1677-09-22", "2262-04-11": "2262-04-11",
    "2024-02-30": None, "2024-10-01T24:00:00": None, "nan": None, "NaT": None, "": None, "+2024-10-01": None, "102024-10-01": None, "2024/10.01": None, "now": None, "today": None,
    "1677-09-20": None, "2262-04-12": None, "2024-10-01T10:00:00Z": None, "2024-10-01T10:00:00+05:30": None, "2023-02-29": None, "x": None,
}
NUMBERS = {
    "1": 1.0, "1.": 1.0, ".5": 0.5, "1e3": 1000.0, "1_000": 1000.0, "+2": 2.0, "-0": -0.0, "inf": math.inf, "-Infinity": -math.inf, "nan": math.nan, "-nan": math.nan, "1_0.0_1e1_0": 10.01e10,
    "1d": None, "1f": None, "1__0": None, "_1": None, "0x10": None, "": None, ".": None, "1e": None, "abc": None, "1,5": None,
}


def applied(spark, texts, function):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", function(F.col("t")).alias("v")).collect()
    return {r["t"]: r["v"] for r in rows}


def test_days(spark):
    got = applied(spark, DAYS, lambda c: F.date_format(parsing.to_day(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == {t: d and d + " 00:00:00" for t, d in DAYS.items()}


def test_zones(spark):
    texts = {"2024-10-01T10:00:00Z": True, "2024-10-01T10:00:00+05:30": True, "2024-10-01 10:00-03": True, "2024-10-01": False, "2024-10-01T10:00": False, "2024-10-01T1030": False}
    assert applied(spark, texts, parsing.has_zone) == texts


def test_numbers(spark):
    got = applied(spark, NUMBERS, parsing.to_double)
    for text, want in NUMBERS.items():
        assert (got[text] is None) == (want is None), text
        assert want is None or got[text] == pytest.approx(want, nan_ok=True), text


def test_strip(spark):
    texts = {"  a ": "a", " a\t\n": "a", "": "", "　": "", "a b": "a b"}
    assert applied(spark, texts, parsing.strip) == texts
