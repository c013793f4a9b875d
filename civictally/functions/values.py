"""Amounts, dates and their display as Column expressions (no ANSI errors: bad input gives null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civictally.functions.text import _c, strip

MONEY = "decimal(18,2)"


def parse_amount(x: Column | str) -> Column:
    """Decimal of a text with dollar sign and thousands commas, null if unreadable."""
    return F.regexp_replace(strip(x), r"[$,]", "").try_cast(MONEY)


def parse_date(x: Column | str) -> Column:
    """Date of M/D/YYYY, YYYY-M-D or the latter with a time, else null."""
    s = strip(x)
    us = F.try_to_date(s, "M/d/yyyy")
    day = F.regexp_extract(s, r"^(\d{4}-\d{1,2}-\d{1,2})(?:T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?)?\z", 1)
    return F.coalesce(us, F.try_to_date(F.nullif(day, F.lit("")), "yyyy-M-d"))


def latest_year(x: Column | str) -> Column:
    """Largest year 20xx named in a text (P5)."""
    years = F.regexp_extract_all(_c(x), F.lit(r"(20\d{2})"), 1)
    return F.array_max(F.transform(years, lambda y: y.cast("int")))


def is_valid_date(x: Column | str) -> Column:
    """Strictly YYYY-MM-DD and a calendar day."""
    ok = _c(x).rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(_c(x), "yyyy-MM-dd").isNotNull()
    return F.coalesce(ok, F.lit(False))


def is_valid_amount(x: Column | str) -> Column:
    """A finite number; negatives are corrections and stand. Texts and booleans are no
    numbers, whatever they say."""
    number = F.typeof(_c(x)).rlike("^(?:tinyint|smallint|int|bigint|float|double|decimal.*)$")
    c = _c(x).cast("string").try_cast("double")
    return number & F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def is_valid_record_id(x: Column | str) -> Column:
    """A council file number or a directive's number."""
    return F.coalesce(_c(x).rlike(r"^(?:\d{2}-\d{4}(?:-S\d+)?|(?:ED|EO)-\d+)\z"), F.lit(False))


def record_url(x: Column | str, root: str) -> Column:
    """The page of a council file, null for other records."""
    c = strip(x)
    return F.when(c.rlike(r"^\d{2}-\d{4}(?:-S\d+)?\z"), F.concat(F.lit(root), c))


def url_host(x: Column | str) -> Column:
    return F.lower(F.try_parse_url(_c(x), F.lit("HOST")))


def is_valid_url(x: Column | str, allowed: list[str] | None = None) -> Column:
    """http(s) with a host, within the allowed domains if given.

    The host is what a URL parser takes it to be, so user-info tricks fail.
    """
    host = url_host(x)
    ok = F.try_parse_url(_c(x), F.lit("PROTOCOL")).isin("http", "https") & (host != "")
    if allowed:
        inside = F.lit(False)
        for d in allowed:
            inside = inside | (host == d) | host.endswith("." + d)
        ok = ok & inside
    return F.coalesce(ok, F.lit(False))


def source_host(x: Column | str) -> Column:
    """Host without www., or a neutral word."""
    return F.coalesce(F.nullif(F.regexp_replace(url_host(x), r"^www\.", ""), F.lit("")), F.lit("Source"))


def iso_day(x: Column | str) -> Column:
    """Leading YYYY-MM-DD or null."""
    return F.nullif(F.regexp_extract(_c(x), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def format_date(d: Column | str, missing: str = "Undated") -> Column:
    """P18."""
    return F.coalesce(F.date_format(_c(d), "MMM d, yyyy"), F.lit(missing))


def format_money(x: Column | str) -> Column:
    """Whole dollars, halves away from zero; unreadable counts as 0."""
    v = F.round(F.coalesce(_c(x).try_cast(MONEY), F.lit(0).cast(MONEY)), 0)
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), F.format_number(F.abs(v), 0))


def number_or_zero(x: Column | str) -> Column:
    """P25."""
    return F.coalesce(_c(x).try_cast("double"), F.lit(0.0))


def clamp(x: Column | str, low: float, high: float) -> Column:
    """P34."""
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


# Words that tell a committee or a firm in a donor's name.
PAC_WORDS = r"(?i)\b(?:PAC|POLITICAL ACTION|COMMITTEE?|UNION|LOCAL \d+)\b"
BUSINESS_WORDS = (
    r"(?i)\b(?:INC|LLC|LLP|LP|CORP|CORPORATION|CO|COMPANY|GROUP|PARTNERS|ASSOCIATES|"
    r"ENTERPRISES|HOLDINGS|TRUST|FOUNDATION|LTD|REALTY|PROPERTIES|VENTURES)\.?\b"
)


def donor_type(name: Column | str, has_work: Column) -> Column:
    """Committee words first; a firm only if no row names a job or employer."""
    n = _c(name)
    return F.when(n.rlike(PAC_WORDS), "pac").when(~has_work & n.rlike(BUSINESS_WORDS), "business").otherwise("individual")


def refresh_due(ts: Column | str, zone: str) -> Column:
    """T-8: whether a moment (UTC) falls on the first Monday of a month in a time zone."""
    local = F.from_utc_timestamp(_c(ts), zone)
    return (F.dayofweek(local) == 2) & (F.dayofmonth(local) <= 7)
