"""Scalar functions on hand-made vectors."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from civictally.functions import text as X
from civictally.functions import values as V


def evaluate(spark, function, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", function("x").alias("y")).orderBy("i").collect()]


def test_dates_valid(spark):
    given = ["2026-01-15", "2026-13-01", "2026-02-30", "01/15/2026", "not-a-date", None, "2026-01-15\n"]
    assert evaluate(spark, V.is_valid_date, given) == [True] + [False] * 6


def test_parse_dates(spark):
    day = dt.date(2026, 1, 5)
    given = ["1/5/2026", "01/05/2026", "2026-01-05T00:00:00.000", "2026-01-05", "2026-01-05T10:11:12", " 1/5/2026 ", "13/45/2026", "", None, "soon"]
    assert evaluate(spark, V.parse_date, given) == [day] * 6 + [None] * 4


def test_parse_amounts(spark):
    given = ["$1,234.50", "500.00", "", "text", "-66.81", "0.00", "nan", "inf", None, " 7 "]
    want = [Decimal("1234.50"), Decimal("500.00"), None, None, Decimal("-66.81"), Decimal("0.00"), None, None, None, Decimal("7.00")]
    assert evaluate(spark, V.parse_amount, given) == want


def test_amounts_valid(spark):
    assert evaluate(spark, V.is_valid_amount, [100.0, 99.5, -500.0, float("nan"), float("inf"), None], "double") == [True] * 3 + [False] * 3


def test_record_ids(spark):
    given = ["25-0542", "25-0600-S17", "ED-10", "EO-1", "not-a-record", "", None, "25-0542\n"]
    assert evaluate(spark, V.is_valid_record_id, given) == [True] * 4 + [False] * 4
    assert evaluate(spark, lambda x: V.record_url(x, "r="), ["25-0542", "ED-1", None]) == ["r=25-0542", None, None]


def test_urls(spark):
    given = ["https://data.example.org/x", "ftp://data.example.org", "", None, "https://example.org", "https://evil.example.com", "https://example.org:x@evil.com/"]
    assert evaluate(spark, lambda x: V.is_valid_url(x, ["example.org"]), given) == [True, False, False, False, True, False, False]
    assert evaluate(spark, V.source_host, ["https://www.example.org/a", "nothing"]) == ["example.org", "Source"]


@pytest.mark.parametrize(
    "name, work, kind",
    [
        ("Acme PAC", False, "pac"),
        ("Local 18", False, "pac"),
        ("Sample Realty LLC", False, "business"),
        ("Sample Realty LLC", True, "individual"),
        ("X Action Fund", False, "individual"),
        ("CITIZENS COMMITTEES", False, "individual"),
        ("Big COMMITTE", True, "pac"),
        ("Plumbing Inc.", False, "business"),
    ],
)
def test_donor_type(spark, name, work, kind):
    assert evaluate(spark, lambda x: V.donor_type(x, F.lit(work)), [name]) == [kind]


def test_display(spark):
    assert evaluate(spark, V.format_money, ["2.5", "-1234.5", "x", None]) == ["$3", "-$1,235", "$0", "$0"]
    assert evaluate(spark, V.iso_day, ["2026-01-05T09", "bad", None]) == ["2026-01-05", None, None]
    assert evaluate(spark, V.format_date, [dt.date(2026, 1, 5), None], "date") == ["Jan 5, 2026", "Undated"]
    assert evaluate(spark, V.latest_year, ["For Mayor 2022 and 2026", "none", None]) == [2026, None, None]
    assert evaluate(spark, X.escape_html, ["<a href='x'>&\"", None]) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;", ""]
    assert evaluate(spark, X.clean_field, [" N/A ", "none", "\t", "Acme ", None]) == [None, None, None, "Acme", None]
    assert evaluate(spark, X.strip_fences, ["```json\n{}\n```", "{}"]) == ["{}", "{}"]
    assert evaluate(spark, X.type_label, ["pac", "odd", "", None]) == ["PAC", "odd", "Unknown", "Unknown"]
    assert evaluate(spark, X.district_number, ["Council district 13", "Mayor"]) == ["13", None]
    assert evaluate(spark, lambda x: X.display_name(x, F.lit("Mayor")), [" replace_me", "Ann", "", None]) == ["Mayor", "Ann", "Mayor", "Mayor"]
    assert evaluate(spark, lambda x: X.client_ip(x, F.lit("s")), ["a, b", "", None]) == ["a", "s", "s"]
    assert evaluate(spark, X.question_ok, [" a ", " ", None, "x" * 301]) == [True, False, False, False]
    assert evaluate(spark, lambda x: X.context_field(x, 3), ["abcd", None]) == ["abc", ""]
