"""Joins whose broadcast side is measured first, and what splits hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictally.session import cut

#: Rows and bytes up to which a table is shipped to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: A key holding more than this share of the weighted rows is joined by broadcast.
#: At most 1 / HOT_SHARE keys can do so, which bounds that broadcast.
HOT_SHARE = 0.001


def _width(df: DataFrame) -> Column:
    """Bytes of a row: its texts, and sixteen for each column."""
    bytes_of = F.lit(16 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            bytes_of = bytes_of + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            bytes_of = bytes_of + F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0))
    return bytes_of


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes, reading no more rows than needed."""
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(_width(df))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def dimension_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str | list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join (inner, left, left_semi or left_anti) a table unique by key: by broadcast when it was
    counted to be small. Else keys that hold more than HOT_SHARE of the facts (at most 1 / HOT_SHARE
    of them) are broadcast, so that their rows stay where they are, and the rest is shuffled."""
    if is_small(dim, max_rows):
        return fact.join(F.broadcast(dim), on, how)
    keys = [on] if isinstance(on, str) else on
    # null keys match nothing, wherever they are
    key = F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0, F.xxhash64(*keys))
    hot = hot_keys(fact, key)
    if not hot:
        return fact.join(dim, on, how)
    among = F.coalesce(key.isin(hot), F.lit(False))
    return fact.where(among).join(F.broadcast(dim.where(among)), on, how).unionByName(fact.where(~among).join(dim.where(~among), on, how))


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    weight: str,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of ``facts`` with a materialised ``lookup`` unique by ``keys``.

    ``weight`` is the number of fact rows of each key, as the lookup's own
    aggregation counted it. A small lookup is broadcast whole. Otherwise keys
    above HOT_SHARE of all weighted rows (at most 1 / HOT_SHARE of them) are
    broadcast, so that their rows stay where they are, and the rest is shuffled.
    """
    if is_small(lookup, max_rows):
        return facts.join(F.broadcast(lookup), keys)
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > F.lit(float(total) * HOT_SHARE)
    head = F.broadcast(lookup.where(hot))
    rest = facts.join(head.select(*keys), keys, "left_anti")
    return facts.join(head, keys).unionByName(rest.join(lookup.where(~hot), keys))


#: Rows that one task takes in any case: no key with fewer is split.
HOT_ROWS = 100_000
#: Items that the sketch of frequent keys tracks: its counts err by 0.02 % of the rows at most.
TRACKED = 10_000


def hot_keys(df: DataFrame, key: Column, share: float = HOT_SHARE) -> list:
    """Keys that hold more than ``share`` of the rows and HOT_ROWS, at most 1 / share of them. One scan of the
    key's columns with a sketch of fixed size; a key close to the share may or may not be named."""
    return hot_of(*df.select(key.alias("k")).agg(*key_counts(share)).first(), share)


def key_counts(share: float = HOT_SHARE) -> list[Column]:
    """What ``hot_of`` needs to know of the column ``k``."""
    return [F.expr(f"approx_top_k(k, {round(1 / share)}, {TRACKED})").alias("top"), F.count("k").alias("rows")]


def hot_of(top: list | None, rows: int, share: float = HOT_SHARE) -> list:
    return [x["item"] for x in top or [] if x["item"] is not None and x["count"] > max(rows * share, HOT_ROWS)]


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, suspect: Column | None = None, of: DataFrame | None = None) -> DataFrame:
    """Rows with their place, from 1, within the rows of the same keys. Hot keys are told by
    ``suspect``, an expression of the keys that rows of one key share (default: all keys), and looked
    for in ``of``, a table that is cheaper to read than ``df`` (default: itself).

    A window does it, but for hot keys: their rows are spread over tasks by ranges of the order, numbered
    there, and moved on by the rows in the ranges before. Order by a unique column last, else
    equal rows take their places in any order. Null keys are keys.
    """
    place = lambda *more: F.row_number().over(W.partitionBy(*keys, *more).orderBy(*order))
    key = F.xxhash64(*keys) if suspect is None else F.coalesce(F.xxhash64(suspect), F.lit(0))
    hot = hot_keys(df if of is None else of, key)
    if not hot:
        return df.withColumn(name, place())
    ranges = cut(df.where(key.isin(hot)).repartitionByRange(*keys, *order).withColumn("range__", F.spark_partition_id()))
    before = F.sum("rows__").over(W.partitionBy(*keys).orderBy("range__").rowsBetween(W.unboundedPreceding, -1))
    counts = ranges.groupBy(*keys, "range__").agg(F.count("*").alias("rows__")).withColumn("before__", F.coalesce(before, F.lit(0)))
    # one row for each hot key and task
    own = counts.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("range__").alias("at__"), "before__")
    same = F.col("range__") == F.col("at__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    split = ranges.withColumn(name, place("range__")).join(F.broadcast(own), same)
    split = split.withColumn(name, (F.col(name) + F.col("before__")).cast("int")).select(*df.columns, name)
    return df.where(~key.isin(hot)).withColumn(name, place()).unionByName(split)
