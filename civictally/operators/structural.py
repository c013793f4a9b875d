"""Rows that fail to parse: structural indexing of CSV records with numpy masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictally.functions.text import strip
from civictally.session import ship

QUOTE, COMMA, RETURN = 34, 44, 13


def index_records(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Locate the fields of many records lying in one byte buffer.

    ``start`` and ``end`` are each record's span, the spans in order and without
    overlap. The parity of the quotes before a byte within its record tells
    whether it lies inside quotes; commas outside quotes delimit. Returns whether
    each record is quoted properly, its number of fields, all field values laid
    end to end without delimiters and quotes, the offsets of the fields, and
    whether a record is spoilt by a quote in the middle of a field (not by a missing end).
    """
    n = len(start)
    size = len(data)
    quote = data == QUOTE
    before = np.zeros(size + 1, np.int64)
    np.cumsum(quote, out=before[1:])
    # which record a byte belongs to; bytes between records belong to none
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, start, 1)
    record = np.cumsum(mark[:size]) - 1
    inside = record >= 0
    inside[inside] = np.arange(size)[inside] < end[record[inside]]
    base = before[start] if n else np.zeros(0, np.int64)
    odd = np.zeros(size, bool)
    odd[inside] = ((before[:size][inside] - base[record[inside]]) & 1).astype(bool)
    comma = inside & (data == COMMA) & ~odd
    quote &= inside
    first = np.zeros(size + 1, bool)
    first[start[start < end]] = True
    first[1:][comma] = True  # the byte after a delimiter begins a field
    opening, closing = quote & ~odd, quote & odd
    after_quote = np.zeros(size, bool)
    after_quote[1:] = closing[:-1]
    after_quote &= ~first[:size]
    last = np.zeros(size, bool)
    last[end[start < end] - 1] = True
    follows = np.zeros(size, bool)
    follows[:-1] = comma[1:] | opening[1:]
    wrong = (opening & ~first[:size] & ~after_quote) | (closing & ~last & ~follows)
    bad = np.zeros(n, bool)
    bad[record[wrong]] = True
    spoilt = bad.copy()
    if n:
        bad |= ((before[end] - base) & 1).astype(bool)
    # kept bytes: no delimiters, no enclosing quotes, one of each doubled pair
    keep = inside & ~comma & ~closing & ~(opening & first[:size])
    kept = np.zeros(size + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    at = np.flatnonzero(comma)
    delimiters = np.bincount(record[at], minlength=n) if n else np.zeros(0, np.int64)
    # fields start at each record's start and after each delimiter
    field_start = np.sort(np.concatenate([start, at + 1]))
    offsets = np.append(kept[field_start], kept[size])
    return ~bad, delimiters + 1, data[keep], offsets, spoilt


def line_buffer(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an array of records, and where each begins and ends, less one trailing
    carriage return."""
    if isinstance(lines, pa.ChunkedArray):
        lines = lines.combine_chunks()
    lines = lines.cast(pa.large_binary()).fill_null(b"")
    _, offsets, body = lines.buffers()
    offsets = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    start, end = offsets[:-1], offsets[1:].copy()
    filled = end > start
    end[filled] -= data[end[filled] - 1] == RETURN
    return data, start, end


def _index_batch(lines: pa.Array) -> pa.Array:
    """Struct of ``well_quoted`` and ``fields`` for an array of records."""
    data, start, end = line_buffer(lines)
    ok, counts, values, ends, _ = index_records(data, start, end)
    text = pa.Array.from_buffers(
        pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]
    )
    groups = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    # a malformed record may be cut inside a character; its fields are not used
    try:
        fields = text.cast(pa.string())
    except pa.ArrowInvalid:
        fields = pa.array([v.decode("utf-8", "replace") for v in text.to_pylist()], pa.string())
    return pa.StructArray.from_arrays(
        [pa.array(ok), pa.ListArray.from_arrays(pa.array(groups), fields)], ["well_quoted", "fields"]
    )


def index_lines(df: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """``source`` (a struct of the kept columns), ``well_quoted`` and ``fields`` of each record."""
    ship(df.sparkSession)
    given = df.select(F.struct(*keep).alias("source"), F.col(line).cast("string").alias("line"))
    schema = T.StructType(
        [
            given.schema["source"],
            T.StructField("well_quoted", T.BooleanType()),
            T.StructField("fields", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _index_batch(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *found.flatten()], ["source", "well_quoted", "fields"])

    return given.mapInArrow(run, schema)


AMOUNT = r"^-?\$?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d{1,2})?\z"
US_DAY = r"^\d{1,2}/\d{1,2}/\d{4}\z"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}(?:T00:00:00(?:\.000)?)?\z"


def strict_amount(x):
    """Decimal of a properly written amount, else null; also null beyond the 36 digits before the point that a decimal holds."""
    return plain_amount(x).try_cast("decimal(38,2)")


def plain_amount(x):
    """Text of a properly written amount without dollar sign and commas, else null."""
    s = strip(x)
    return F.when(s.rlike(AMOUNT), F.regexp_replace(s, "[$,]", ""))


def strict_day(x):
    """Date of M/D/YYYY or ISO form within 1900 to 2099, else null."""
    s = strip(x)
    d = F.when(s.rlike(US_DAY), F.try_to_date(s, "M/d/yyyy")).when(
        s.rlike(ISO_DAY), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")
    )
    return F.when(F.year(d).between(1900, 2099), d)


# The columns of an exported record, in order.
EXPORT_COLUMNS = (
    "contribution_date", "contributor", "contrib_occupation", "contrib_employer", "committee_name", "committee_id",
    "period_beg_date", "period_end_date", "contribution_amount", "contribution_type", "election_date",
)


def parse_records(df: DataFrame, line: str, key: str, keep: list[str] | None = None) -> DataFrame:
    """Typed rows of CSV records, or the first reason why one cannot be read.

    Columns: ``source`` (struct of ``key`` and the kept columns), ``reason`` (null for a
    valid row, else quoting, column_count, bad_amount, bad_date or bad_period),
    ``record`` (struct of EXPORT_COLUMNS, null for a rejected row): dates as dates,
    the amount as decimal, other columns as the exact texts; and ``amount_text``, the amount of
    a valid row that no decimal holds (null for all others). Period end and
    election date are null where unreadable, which rejects nothing.

    One trailing carriage return is ignored. An empty or null line has one empty
    field and fails by its column count. Line breaks inside quotes belong to the field. Repeated
    rows come out as often as they are given, an empty table gives none, extra columns are
    carried in ``source`` only and so cannot clash. Any text length is read whole.

    Map-only: no shuffle, so no key can be hot.
    """
    keep = [key, *[k for k in keep or [] if k != key]]
    rows = index_lines(df, line, keep)
    f = {name: F.get("fields", F.lit(i)) for i, name in enumerate(EXPORT_COLUMNS)}
    typed = {
        "contribution_date": strict_day(f["contribution_date"]),
        "period_beg_date": strict_day(f["period_beg_date"]),
        "period_end_date": strict_day(f["period_end_date"]),
        "election_date": strict_day(f["election_date"]),
        "contribution_amount": strict_amount(f["contribution_amount"]),
    }
    amount_ok = F.coalesce(strip(f["contribution_amount"]).rlike(AMOUNT), F.lit(False))
    rows = rows.select(
        "source",
        "well_quoted",
        F.size("fields").alias("width"),
        amount_ok.alias("amount_ok"),
        plain_amount(f["contribution_amount"]).alias("amount_text"),
        F.struct(*[typed.get(name, f[name]).alias(name) for name in EXPORT_COLUMNS]).alias("typed"),
    )
    reason = (
        F.when(~F.col("well_quoted"), "quoting")
        .when(F.col("width") != len(EXPORT_COLUMNS), "column_count")
        .when(~F.col("amount_ok"), "bad_amount")
        .when(F.col("typed.contribution_date").isNull(), "bad_date")
        .when(F.col("typed.period_beg_date").isNull(), "bad_period")
    )
    rows = rows.select("source", reason.alias("reason"), "typed", "amount_text")
    valid = F.col("reason").isNull()
    unheld = F.when(valid & F.col("typed.contribution_amount").isNull(), F.col("amount_text"))
    return rows.select("source", "reason", F.when(valid, F.col("typed")).alias("record"), unheld.alias("amount_text"))
