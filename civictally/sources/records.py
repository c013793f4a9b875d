"""Exports read as records: record ends found by quote parity, files split, rejects kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civictally.operators.structural import QUOTE, index_lines, index_records, line_buffer
from civictally.session import cut, ship

#: Bits of a place that number the bytes within a file; the rest numbers the files.
FILE_BITS = 40


class _Split:
    """The lines of one piece of a file, in order, joined to records.

    A record begins at a line before which the quotes since the record's beginning are even in number; a line
    spoilt by a quote in the middle of a field opens none. A line
    that by itself is well quoted and has all columns always begins one, so an unclosed
    quote takes no valid record with it and a piece finds its place in the file by itself."""

    def __init__(self, path: str, start: int, odd: bool):
        self.path, self.start, self.odd = path, start, odd
        self.lines = 0
        # lines of the record that is not ended, and its place; None for a piece of an earlier record
        self.held: list[bytes] = []
        self.place: int | None = None

    def begins(self, lines: pa.Array, columns: int) -> np.ndarray:
        """Which lines begin a record; moves the parity on."""
        data, begin, end = line_buffer(lines)
        ok, counts, _, _, spoilt = index_records(data, begin, end)
        safe = ok & (counts >= columns)
        quotes = np.concatenate([[0], np.cumsum(data == QUOTE)])
        # between lines with an odd number of quotes and lines that surely begin a record nothing changes
        turns = np.flatnonzero((quotes[end] - quotes[begin]) & 1)
        resets = np.flatnonzero(safe)
        inside = np.zeros(len(ok), bool)
        at = 0
        for turn in [*turns.tolist(), len(ok)]:
            reset = int(np.searchsorted(resets, at))
            reset = int(resets[reset]) if reset < len(resets) else len(ok)
            if self.odd:
                inside[at : min(reset, turn) + 1] = True
            self.odd = self.odd and reset >= turn
            if turn < len(ok):
                self.odd = not self.odd and not spoilt[turn]
            at = turn + 1
        return safe | ~inside


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, bool], pa.Array]]:
    """The file, offset and parity of each piece with a run of its lines."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys[0] != keys[-1] else [0, len(keys)]
        for a, z in zip(cuts, cuts[1:]):
            yield keys[a], b.column(3).slice(a, z - a)


def _summaries(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Each piece for both parities that it may begin with: the parity at its end and the place of its last record."""
    splits: list[_Split] = []
    rows = []

    def done():
        if splits:
            rows.append((splits[0].path, splits[0].start, *(int(s.odd) for s in splits), *(s.place for s in splits)))

    for (path, start, _), lines in _pieces(batches):
        if not splits or (splits[0].path, splits[0].start) != (path, start):
            done()
            splits = [_Split(path, start, odd) for odd in (False, True)]
        for s in splits:
            first = np.flatnonzero(s.begins(lines, columns))
            if len(first):
                s.place = start + s.lines + int(first[-1])
            s.lines += len(lines)
    done()
    yield pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, r)) for r in rows], _PIECE)


_SUMMARY = "path string, start bigint, even_end int, odd_end int, even_last bigint, odd_last bigint"
_PIECE = pa.schema([("path", pa.string()), ("start", pa.int64()), ("even_end", pa.int32()), ("odd_end", pa.int32()), ("even_last", pa.int64()), ("odd_last", pa.int64())])


def _entered(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a file that begin inside a record: where that record begins."""
    rows, odd, last = [], 0, None
    for r in pdf.sort_values("start").itertuples():
        if odd:
            rows.append((r.path, r.start, last))
        place = r.odd_last if odd else r.even_last
        odd, last = (r.odd_end if odd else r.even_end), (last if pd.isna(place) else int(place))
    return pd.DataFrame(rows, columns=["path", "start", "from_place"])


def _joined(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Records with their place. A record that goes beyond its piece, or comes from an earlier one, is ``part``: the
    offset of the piece, else null."""
    split: _Split | None = None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "place", "part", "line"])

    def end(s: _Split, broken: bool):
        text = b"\n".join(s.held).decode("utf-8", "replace")
        return (s.path, s.place, s.start if broken or s.place is None else None, text)

    for (path, start, odd), lines in _pieces(batches):
        if split is None or (split.path, split.start) != (path, start):
            if split is not None and split.held:
                yield batch([end(split, split.odd)])
            split = _Split(path, start, odd)
        first = split.begins(lines, columns)
        texts = lines.cast(pa.large_binary()).to_pylist()
        rows = []
        for i, (text, new) in enumerate(zip(texts, first.tolist())):
            if new:
                if split.held:
                    rows.append(end(split, False))
                split.held, split.place = [], start + split.lines + i
            split.held.append(text or b"")
        split.lines += len(lines)
        if rows:
            yield batch(rows)
    if split is not None and split.held:
        yield batch([end(split, split.odd)])


def read_lines(spark: SparkSession, path: str | list[str], columns: int) -> DataFrame:
    """The records of CSV files as text, with their order: ``place``, ``line``.

    Files are read in pieces by line feeds, so a large file is many tasks, and quoted line breaks are
    found by the parity of the quotes before them. One pass takes the parity of each piece, a second one joins
    lines to records; only records that cross the end of a piece are shuffled, two rows a piece at most. The
    list of pieces that begin inside a record is broadcast (part of one row for each piece of the files).

    Records of the same file keep their order, files that of their names. Empty lines
    outside quotes are no records. A quote that is never closed ends at the next line that is well quoted and has
    all columns. Null or empty files give no rows.
    """
    ship(spark)
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    given = lines.select("path", "start", F.lit(False).alias("odd"), "value")
    sums = given.mapInArrow(partial(_summaries, columns=columns), _SUMMARY)
    inside = cut(sums.groupBy("path").applyInPandas(_entered, "path string, start bigint, from_place bigint"))
    known = lines.join(F.broadcast(inside), ["path", "start"], "left").select("path", "start", F.col("from_place").isNotNull().alias("odd"), "value")
    records = known.mapInArrow(partial(_joined, columns=columns), "path string, place bigint, part bigint, line string")
    records = records.join(F.broadcast(inside.withColumnRenamed("start", "part")), ["path", "part"], "left")
    records = records.withColumn("place", F.coalesce("place", "from_place"))
    whole = records.where("part is null").select("path", "place", "line")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda p: p["line"])
    crossing = records.where("part is not null").groupBy("path", "place").agg(F.array_join(pieces, "\n").alias("line"))
    found = whole.unionByName(crossing).where("line <> '' and line <> '\r'")
    return found.select(_numbered(text, F.col("path"), F.col("place")).alias("place"), "line", (F.col("place") == 0).alias("first"))


def _numbered(text: DataFrame, path: Column, place: Column) -> Column:
    """One number that orders the records of all files: a file's place among the names, then its own."""
    bare = lambda uri: re.sub("^[a-z0-9]+:/+", "/", uri)
    names = sorted(map(bare, text.inputFiles()))
    if len(names) < 2:
        return place
    rank = F.array_position(F.lit(names), F.regexp_replace(path, "^[a-z0-9]+:/+", "/")) - 1
    return rank * (1 << FILE_BITS) + place


def read_csv(spark: SparkSession, path: str | list[str], names: tuple[str, ...], order: str) -> tuple[DataFrame, DataFrame]:
    """The rows of exports with a header, all columns as text, and the records that are no rows.

    Rows: ``order`` and the named columns. Rejects: ``order``, ``line`` and ``reason`` (quoting, else
    column_count). The first record of each file is its header. Empty fields are null.
    """
    lines = read_lines(spark, path, len(names)).where("not first")
    found = index_lines(lines, "line", ["place", "line"])
    reason = F.when(~F.col("well_quoted"), "quoting").when(F.size("fields") != len(names), "column_count")
    found = found.select(F.col("source.place").alias(order), F.col("source.line").alias("line"), reason.alias("reason"), "fields")
    fields = [F.nullif(F.get("fields", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return found.where("reason is null").select(order, *fields), found.where("reason is not null").select(order, "line", "reason")
