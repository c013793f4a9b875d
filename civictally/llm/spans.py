"""Long exact spans shared between records: a count-min prefilter, then exact grouping."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictally.llm.grams import hash_words, mix, space_words, whole_windows, window_hashes
from civictally.operators.joins import BROADCAST_ROWS, lookup_join
from civictally.session import cut, remove_path, shared_dir, ship, stored

#: Rows of the count-min sketch, each with its own hash function.
DEPTH = 2
#: Cells of one block of a sketch row; a block is the unit that is merged.
BLOCK = 1 << 16
#: Most cells of a row (128 MB as bits), enough for some five billion words at the width of 60. A
#: larger corpus fills the sketch more, so that more windows reach the exact grouping; none is lost by it.
MAX_CELLS = 1 << 30
#: Words hashed at once in a task.
CHUNK_WORDS = 2_000_000
_CHARS_A_WORD = 6


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """Ids, joint words and words per text of about CHUNK_WORDS at a time; texts are never cut."""
    ids, words, counts = [], [], []
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = space_words(text)
            if found:
                ids.append(key)
                words += found
                counts.append(len(found))
                if len(words) >= CHUNK_WORDS:
                    yield ids, words, np.array(counts)
                    ids, words, counts = [], [], []
    if ids:
        yield ids, words, np.array(counts)


def minimizers(hashed: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` words the smallest hash of the shorter runs in it (two thirds as
    long). Equal runs have equal ones, and neighbours mostly share theirs, so a text has few."""
    short = max(1, 2 * width // 3)
    reach = width - short + 1
    grams = window_hashes(hashed, short)
    n = len(grams) - reach + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # minima of each block of ``reach`` up to and from a place: two of them make any minimum
    filled = np.concatenate([grams, np.full(-len(grams) % reach, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, reach)
    upto = np.minimum.accumulate(filled, axis=1).ravel()
    onward = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[:n], upto[reach - 1 : reach - 1 + n])


#: Multipliers that make the hash functions of the sketch's rows.
_ROWS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def _cells(values: np.ndarray, cells: int) -> list[np.ndarray]:
    """Cell of each value in each sketch row."""
    return [(mix(values * _ROWS[i] + np.uint64(i)) >> np.uint64(17)) & np.uint64(cells - 1) for i in range(DEPTH)]


def _proofs(words: list[str], starts: np.ndarray, width: int) -> list[bytes]:
    """A cryptographic digest of the words of each window: these, not their hashes, decide what is equal."""
    if not len(starts):
        return []
    text = " ".join(words).encode("utf-8", "surrogatepass")
    sizes = np.fromiter((len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
    begin = np.cumsum(sizes + 1) - sizes - 1
    view = memoryview(text)
    ends = (begin + sizes)[starts + width - 1]
    return [blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin[starts].tolist(), ends.tolist())]


def sketch_blocks(rows: list[np.ndarray]) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Partial sketch: row, block and its compressed bits, seen and seen again."""
    for r, cells in enumerate(rows):
        found, times = np.unique(cells.astype(np.int64), return_counts=True)
        cuts = np.flatnonzero(np.diff(found // BLOCK)) + 1
        for own, n in zip(np.split(found, cuts), np.split(times, cuts)):
            if len(own):
                seen, again = np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
                seen[own % BLOCK] = True
                again[own[n > 1] % BLOCK] = True
                yield r, int(own[0] // BLOCK), *(zlib.compress(np.packbits(x).tobytes(), 1) for x in (seen, again))


def merge_blocks(parts: Iterator[tuple[bytes, bytes]]) -> np.ndarray:
    """Bits of the cells that all partial sketches together count twice or more."""
    seen = again = np.zeros(BLOCK // 8, np.uint8)
    for one, two in parts:
        one, two = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (one, two))
        again = again | two | (seen & one)
        seen = seen | one
    return again


def _sketch(texts: DataFrame, width: int, cells: int, folder: str) -> None:
    """Write the merged count-min sketch, as one bit per cell that counts at least 2."""

    def partial(batches):
        for _, words, counts in _chunks(batches):
            at, owner = whole_windows(counts, width)
            low = minimizers(hash_words(words), width)[at]
            # a run of windows with one minimizer counts once
            first = np.ones(len(at), bool)
            first[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
            rows = _cells(low[first], cells)
            made = list(sketch_blocks(rows))
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    ["row", "block", "seen", "again"],
                )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = merge_blocks(zip(pdf["seen"], pdf["again"]))
        if not bits.any():
            return pd.DataFrame({"row": [], "block": [], "bits": []})
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "block": pdf["block"].iloc[:1], "bits": [zlib.compress(bits.tobytes(), 1)]})

    parts = texts.mapInArrow(partial, "row int, block int, seen binary, again binary")
    parts.groupBy("row", "block").applyInPandas(merge, "row int, block int, bits binary").write.parquet(folder)


def _opened(folder: str):
    """File system and path of a folder, for the Arrow library."""
    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", folder))
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _reachable(spark: SparkSession, folder: str) -> str:
    """The folder as the workers find it: itself, or where Arrow does not know its file
    system, a copy that Spark fetches to each executor."""
    try:
        _opened(folder)
        return folder
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        spark.sparkContext.addFile(folder, recursive=True)
        return f"{_FETCHED}{folder.rsplit('/', 1)[1]}"


_FETCHED = "fetched:"


@lru_cache(maxsize=1)
def _read_sketch(folder: str, cells: int) -> list[np.ndarray]:
    if folder.startswith(_FETCHED):
        folder = SparkFiles.get(folder[len(_FETCHED) :])
    fs, path = _opened(folder)
    rows = [np.zeros(cells // 8, np.uint8) for _ in range(DEPTH)]
    for b in ds.dataset(path, filesystem=fs, format="parquet").to_batches():
        for r, block, bits in zip(*(b.column(i).to_pylist() for i in range(3))):
            rows[r][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return rows


def _maybe_repeated(texts: DataFrame, width: int, cells: int, folder: str) -> DataFrame:
    """The windows that the sketch estimates to be repeated: doc, start, and the digest of the words."""
    schema = T.StructType(
        [
            T.StructField("doc", texts.schema[0].dataType),
            T.StructField("start", T.IntegerType()),
            T.StructField("proof", T.BinaryType()),
        ]
    )

    def find(batches):
        sketch = _read_sketch(folder, cells)
        for ids, words, counts in _chunks(batches):
            at, owner = whole_windows(counts, width)
            if not len(at):
                continue
            hit = np.ones(len(at), bool)
            for bits, c in zip(sketch, _cells(minimizers(hash_words(words), width)[at], cells)):
                hit &= (bits[c >> np.uint64(3)] >> (7 - (c & np.uint64(7))).astype(np.uint8)) & 1 > 0
            begin = np.cumsum(counts) - counts
            own = owner[hit]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids).take(pa.array(own)),
                    pa.array((at[hit] - begin[own]).astype(np.int32)),
                    pa.array(_proofs(words, at[hit], width), pa.binary()),
                ],
                ["doc", "start", "proof"],
            )

    return texts.mapInArrow(find, schema)


def shared_spans(
    df: DataFrame, key: str, text: str, width: int = 60, max_rows: int = BROADCAST_ROWS, max_cells: int = MAX_CELLS
) -> DataFrame:
    """How much of each record lies in spans of ``width`` words found in another one.

    Words are runs of non-white-space, compared exactly. First every task sketches
    all its windows of ``width`` words into a count-min sketch, each window by its minimizer, the
    smallest hash of the runs of two thirds of the words in it; neighbouring windows that share it
    count once. The partial sketches are merged by block. Equal windows have equal minimizers and a cell
    never counts less than its values, so a window that stands in two texts is always kept by the
    second pass, which groups just the kept windows by a cryptographic digest of their words and
    keeps those of two different records.

    Columns: the key and ``shared_words`` (word positions covered by such windows);
    only records with ``shared_words`` > 0 come out.

    Rows with a null key or text take no part. Rows with the same key are one record: what
    repeats only among them is not shared, and a position covered in any of them
    counts once. Records shorter than ``width`` words never share. Texts
    of any length are read whole. Other columns are not read.

    The sketch has about two cells for each expected minimizer (a fifth of a cell a word at the width of
    60) up to ``max_cells``; it lies in the shared
    folder and each worker reads it, so nothing passes through the driver. Shuffled are the
    compressed sketch blocks and the windows estimated repeated. A window held by a third
    of all records is combined on the map side when it is grouped and
    joined by broadcast when positions are looked up.
    """
    spark = df.sparkSession
    ship(spark)
    texts = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    # of w windows in a row two in w + 1 begin a new minimizer
    expected = chars // _CHARS_A_WORD * 2 // (width - max(1, 2 * width // 3) + 2)
    cells = min(max_cells, max(BLOCK, 1 << (2 * expected).bit_length()))
    folder = f"{shared_dir(spark)}/sketch-{uuid.uuid4().hex}"
    _sketch(texts, width, cells, folder)
    windows = stored(_maybe_repeated(texts, width, cells, _reachable(spark, folder)), "windows")
    remove_path(spark, folder)
    repeated = cut(
        windows.groupBy("proof")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
        .where("low <> high")
        .select("proof", "n")
    )
    found = lookup_join(windows, repeated, ["proof"], "n", max_rows).select("doc", "start").distinct()
    following = F.lead("start").over(W.partitionBy("doc").orderBy("start"))
    covered = found.select("doc", F.least(F.lit(width), F.coalesce(following - F.col("start"), F.lit(width))).alias("words"))
    return covered.groupBy("doc").agg(F.sum("words").cast("bigint").alias("shared_words")).withColumnRenamed("doc", key)
