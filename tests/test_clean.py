from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from acopio.functions import clean, fold


def values(spark, cells, rule):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    return [r[0] for r in rows.orderBy("k").select(rule(F.col("c")).alias("v")).collect()]


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (clean.text, {"  x y\u0085": "x y", " ": None, None: None, "a b": "a b"}),
        (clean.label, {" a \n b ": "a b", None: ""}),
        (clean.fiscal_id, {" b12 345 ": "B12 345"}),
        (clean.usable_fiscal_id, {"-": None, "–": None, "—": None, "−": None, " ": None, "temp-1": None, "a-1": "A-1", "b1": "B1"}),
        (clean.lot_key, {"_": None, " - ": None, "": None, "05": "5", "000": "0", "00A": "A", "a": "a"}),
        (clean.contractor_name, {"ACME SL B12345678": "ACME SL", "ACME SL": "ACME SL", "ACME B1": "ACME B1"}),
        (clean.contractor_id, {"ACME SL B12345678": "B12345678", "ACME SL": None}),
        (clean.member_name, {"B12345678 - ACME": "ACME", "ACME": "ACME"}),
        (clean.code_of, {"45000000 Obras  de": "45000000", "": None}),
        (clean.description_of, {"45000000 Obras  de": "Obras de", "45000000": None}),
        (clean.parse_amount, {"1.234.567,89 €": Decimal("1234567.890000"), "123,4": Decimal("123.400000"), "-1": None, "1.23": None, "x": None, "10 € (con IVE)": Decimal("10.000000")}),
        (clean.vat_basis, {"10 € con IVE": "INCLUSIVE", "10 sen IVE": "EXCLUSIVE", "10": None}),
        (clean.parse_count, {" 3 ": 3, "-1": None, "x": None}),
        (clean.numeric_id, {"12": 12, "1a": None}),
        (clean.listing_date, {"01-02-2024": date(2024, 2, 1), "31-02-2024": None, "1-2-2024": None}),
        (clean.record_date, {"01-02-2024": date(2024, 2, 1), "01-02-2024 10:30": date(2024, 2, 1), "01-02-2024 25:00": None, "01-02-2024 10:30:59": date(2024, 2, 1)}),
        (clean.failure_reason, {" a\n b ": "a b", " ": None, "x" * 501: "x" * 499 + "…", "y" * 500: "y" * 500}),
        (clean.duration, {"x" * 70: "x" * 64, "x" * 63 + "\U0001f600": "x" * 63, "x" * 62 + "\U0001f600": "x" * 62 + "\U0001f600", " a ": "a"}),
        (fold.name_fold, {"Construcións Á-B, S.L.": "construcionsabsl", "···": None, None: None}),
    ],
)
def test_rules(spark, rule, cases):
    assert values(spark, list(cases), rule) == list(cases.values())


def test_missing_key_is_an_error(spark):
    with pytest.raises(Exception, match="published key"):
        values(spark, [" "], clean.published_key)


def test_search_ignores_case_and_accents(spark):
    rows = spark.createDataFrame([("Álvaro",), ("Zamora",)], "c string")
    assert [r.c for r in rows.where(fold.contains_folded(F.col("c"), "alv")).collect()] == ["Álvaro"]
    assert rows.where(fold.contains_folded(F.col("c"), " ")).count() == 2


def test_fold_is_that_of_decomposition(spark):
    """Every character, alone and between letters."""
    import re
    import unicodedata

    chars = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{c}Z") for c in chars], "c string, t string")
    for r in rows.select("t", fold.name_fold("t").alias("f")).collect():
        want = re.sub("[^a-z0-9]+", "", unicodedata.normalize("NFD", r.t.lower())) or None
        assert r.f == want, r.t
