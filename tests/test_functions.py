"""Golden cases for the scalar rules (whitespace, refs, numbers, dates, text)."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions import (coerce_locale_number, coerce_number, format_2dp, normalize_label,
                                  normalize_ref, parse_dayfirst, parse_monthfirst, sign_class, similarity,
                                  strip_text)


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_strip_unicode_whitespace(spark):
    assert one(spark, strip_text, " \t ab c  \n") == "ab c"
    assert one(spark, strip_text, "   ") == ""


def test_normalize_ref(spark):
    assert one(spark, normalize_ref, " 900.10\t") == "900,10"
    assert one(spark, normalize_ref, "1.2.3") == "1,2,3"
    assert one(spark, normalize_ref, "A.B 1.") == "A.B 1."
    assert one(spark, normalize_ref, "١٢.٥") == "١٢,٥"          # Arabic-Indic digits
    assert one(spark, normalize_ref, "  ") is None            # blank -> NULL


def test_coerce_number_traps(spark):
    assert one(spark, coerce_number, " 12.5 ") == 12.5
    assert one(spark, coerce_number, "1e3") == 1000
    assert one(spark, coerce_number, "12d") is None               # a double cast would accept it
    assert one(spark, coerce_number, "Infinity") is None
    assert one(spark, coerce_number, "1_000") is None
    assert one(spark, coerce_number, "") is None


def test_coerce_locale_number(spark):
    assert float(one(spark, coerce_locale_number, "1 234,5")) == 1234.5
    assert float(one(spark, coerce_locale_number, " 12 ")) == 12
    assert float(one(spark, coerce_locale_number, "abc")) == 0


def test_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("a", ""), (" ABC ", "abc"), (None, None)],
                               "a string, b string")
    got = [r[0] for r in df.select(similarity("a", "b")).collect()]
    assert abs(got[0] - (1 - 3 / 7)) < 1e-12
    assert got[1:] == [1.0, 0.0, 1.0, 1.0]


def test_label_sign_format(spark):
    assert one(spark, normalize_label, "  Référence\n  Fournisseur ") == "référence fournisseur"
    assert one(spark, sign_class, 1.5, "double") == "positive"
    assert one(spark, sign_class, -0.01, "double") == "negative"
    assert one(spark, sign_class, None, "double") == ""
    assert one(spark, lambda c: format_2dp(c), 3.456, "double") == "3.46"
    assert one(spark, lambda c: format_2dp(c), None, "double") == "0"


def test_date_orders(spark):
    assert one(spark, parse_dayfirst, "13/02/2025") == dt.date(2025, 2, 13)
    assert one(spark, parse_dayfirst, "02/13/2025") is None
    assert one(spark, parse_monthfirst, "02/13/2025") == dt.date(2025, 2, 13)
    assert one(spark, parse_dayfirst, "2025-02-13") == dt.date(2025, 2, 13)
    assert one(spark, parse_dayfirst, "1/2/25") is None               # no two-digit years
    assert one(spark, parse_dayfirst, "  ") is None
