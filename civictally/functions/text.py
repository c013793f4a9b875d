"""Text cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing value.
BLANK_WORDS = ("none", "n/a", "na", "unknown")

# The characters that are white space in any script.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(_c(x), F.lit(WHITE))


def blank_to_null(x: Column | str) -> Column:
    """Stripped; null if nothing is left."""
    s = strip(x)
    return F.when(s != "", s)


def clean_field(x: Column | str) -> Column:
    """Stripped; null if blank or a word for a missing value in any case."""
    s = strip(x)
    return F.when((s != "") & ~F.lower(s).isin(*BLANK_WORDS), s)


def escape_html(x: Column | str) -> Column:
    """The five markup characters as entities; null becomes an empty text (P20)."""
    c = F.coalesce(_c(x), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def display_name(name: Column | str, office: Column | str) -> Column:
    """The name, or the office while the name is blank or a placeholder."""
    n = F.coalesce(strip(name), F.lit(""))
    return F.when((n == "") | (F.upper(n) == "REPLACE_ME"), _c(office)).otherwise(_c(name))


def party_label(affiliation: Column | str) -> Column:
    """P22."""
    return F.coalesce(_c(affiliation), F.lit("Not publicly listed"))


# Labels of the donor types.
TYPE_LABELS = {"pac": "PAC", "business": "Business", "individual": "Individual"}


def type_label(x: Column | str) -> Column:
    """Known label, else the raw value, else Unknown."""
    c = _c(x)
    labelled = c
    for raw, label in TYPE_LABELS.items():
        labelled = F.when(c == raw, F.lit(label)).otherwise(labelled)
    return F.coalesce(F.when(c != "", labelled), F.lit("Unknown"))


def role_label(x: Column | str) -> Column:
    """P24."""
    return F.replace(_c(x), F.lit("_"), F.lit(" "))


def district_number(title: Column | str) -> Column:
    """The number after the word District in a title, as text, or null."""
    return F.nullif(F.regexp_extract(_c(title), r"(?i)District\s+(\d+)", 1), F.lit(""))


def context_field(x: Column | str, limit: int) -> Column:
    """At most ``limit`` characters of a text or number, empty if null."""
    return F.coalesce(F.left(_c(x).cast("string"), F.lit(limit)), F.lit(""))


def client_ip(forwarded: Column | str, socket: Column | str) -> Column:
    """First forwarded address, else the socket's, else unknown."""
    first = F.nullif(F.trim(F.split_part(_c(forwarded), F.lit(","), F.lit(1))), F.lit(""))
    return F.coalesce(first, F.nullif(_c(socket), F.lit("")), F.lit("unknown"))


def strip_fences(x: Column | str) -> Column:
    """Without a surrounding Markdown code fence."""
    return F.trim(F.regexp_replace(strip(x), r"(?i)^```(?:json)?\s*|\s*```\z", ""))


def question_ok(x: Column | str, limit: int = 300) -> Column:
    """Whether a question has 1 to ``limit`` characters once trimmed."""
    return F.coalesce(F.length(strip(x)).between(1, limit), F.lit(False))
