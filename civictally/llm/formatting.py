"""Duplicates hidden by formatting differences: digests of nested records, bottom up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictally.operators.joins import BROADCAST_ROWS, lookup_join
from civictally.session import cut


def words(x: Column | str) -> Column:
    """Words of a text in lower case: full stops and apostrophes vanish, any other
    character that is no letter, digit or accent mark separates. Null gives null."""
    c = F.col(x) if isinstance(x, str) else x
    bare = F.regexp_replace(F.lower(c), r"[.'‘’ʼ]", "")
    return F.filter(F.split(bare, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def _leaf(c: Column, kind: T.DataType) -> Column:
    """A value without parts as text that tells all its values apart."""
    return F.to_json(c) if isinstance(kind, T.VariantType) else F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _parts(c: Column, kind: T.DataType, free: bool, leaf: Callable, node: Callable) -> Column:
    """Fold a nested value bottom up: ``leaf`` makes the value of a leaf and ``node`` that of a node from
    its children's. Children are sorted where their order does not count: words of a text
    and members of an array if ``free``, entries of a map always. Null stays null."""
    if isinstance(kind, T.StringType) and free:
        return F.when(c.isNotNull(), node(F.array_sort(F.transform(words(c), lambda w: leaf(w, kind)))))
    if isinstance(kind, T.ArrayType):
        own = F.transform(c, lambda x: _parts(x, kind.elementType, free, leaf, node))
        return F.when(c.isNotNull(), node(F.array_sort(own) if free else own))
    if isinstance(kind, T.MapType):
        pair = lambda e: node(F.array(*[_parts(e[k], t, free, leaf, node) for k, t in (("key", kind.keyType), ("value", kind.valueType))]))
        return F.when(c.isNotNull(), node(F.array_sort(F.transform(F.map_entries(c), pair))))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), node(F.array(*[_parts(c[f.name], f.dataType, free, leaf, node) for f in kind.fields])))
    return leaf(c, kind)


#: Digest of a null in a node.
_NULL = -1


def _digest(c: Column, kind: T.DataType, free: bool) -> Column:
    leaf = lambda x, t: F.when(x.isNotNull(), F.xxhash64(_leaf(x, t)))
    # hashing leaves nulls out, so they get a digest of their own
    node = lambda own: F.xxhash64(F.transform(own, lambda d: F.coalesce(d, F.lit(_NULL).cast("bigint"))))
    return F.coalesce(_parts(c, kind, free, leaf, node), F.lit(_NULL).cast("bigint"))


def _structure(c: Column, kind: T.DataType, free: bool) -> Column:
    return _parts(c, kind, free, _leaf, F.to_json)


def formatting_duplicates(
    df: DataFrame, key: str, unordered: list[str], exact: list[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows that are one record but for formatting, with their number of copies.

    A record is a tree of any depth: structs, arrays and maps are its inner nodes, and so are the
    texts under ``unordered``, whose children are their words. Leaves are normalised and hashed, and
    bottom up every node is hashed from its children's digests, which are sorted first where their order does
    not count: words of a text and members of an array under ``unordered``, entries of any map. The
    root digest covers all columns. Rows are grouped by root
    digest; groups of one end there. The rest is confirmed by grouping again by the
    whole normalised structure, so equal digests of different records do no harm.

    Columns: ``copy_id`` (each row's key), ``first_id`` (smallest key of its record)
    and ``copies`` (rows of the record), for records of at least two rows only.

    Null equals null only, also for the unordered texts; texts without any word
    equal each other. Word order and case do not matter, the number of times that
    a word occurs does. Rows with a null key take part in nothing. An exactly
    repeated row with the same key counts as a copy of its own. Columns not named
    are not read. Empty tables give no rows.

    Only the key and an 8 byte digest are shuffled for all rows, combined on the
    map side, so a hot record (a third of all rows) sends one row per task. Members of repeated digests are
    looked up with the digests' own counts, so that a hot digest is broadcast and its rows stay where
    they are; the full structure is shuffled for them only.
    """
    kinds = [(F.col(c), df.schema[c].dataType, free) for columns, free in ((unordered, True), (exact, False)) for c in columns]
    children = [_digest(*k) for k in kinds]
    rows = df.where(F.col(key).isNotNull())
    digests = rows.select(F.col(key).alias("copy_id"), F.xxhash64(*children).alias("digest"))
    repeated = cut(digests.groupBy("digest").agg(F.count("*").alias("rows")).where("rows > 1"))
    structure = F.to_json(F.array(*[_structure(*k) for k in kinds]))
    full = rows.select(F.col(key).alias("copy_id"), F.xxhash64(*children).alias("digest"), *dict.fromkeys(unordered + exact))
    full = lookup_join(full, repeated, ["digest"], "rows", max_rows).drop("rows")
    members = cut(full.select("copy_id", "digest", structure.alias("structure")))
    records = members.groupBy("digest", "structure").agg(F.min("copy_id").alias("first_id"), F.count("*").alias("copies"))
    # compared in full, the structure is told by a cryptographic digest when rows are looked up
    proof = F.sha2("structure", 256).alias("proof")
    records = cut(records.where("copies > 1").select("digest", proof, "first_id", "copies"))
    rows = members.select("copy_id", "digest", proof)
    return lookup_join(rows, records, ["digest", "proof"], "copies", max_rows).select("copy_id", "first_id", "copies")
