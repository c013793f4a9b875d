"""Problems as rows: validators, cross-references, status and freshness."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civictally.functions.values import is_valid_amount, is_valid_date, is_valid_record_id, is_valid_url
from civictally.operators.joins import numbered
from civictally.session import ship

PROBLEM = "official_id string, builder string, rule string, detail string"


def problems(df: DataFrame, builder: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """V3, V4: a row for every rule that a row breaks. ``rules``: name to whether it is
    broken and what to say (P36). All rules are read in one pass."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("rule"), said.alias("detail"))) for n, (bad, said) in rules.items()])
    return df.select("official_id", F.lit(builder).alias("builder"), F.inline(F.filter(found, lambda p: p.isNotNull())))


def gift_rules(allowed: list[str]) -> dict[str, tuple[Column, Column]]:
    """V3 on flat gifts: donor, amount, contribution_date, source_url."""
    who = F.col("donor")
    return {
        "amount": (~is_valid_amount("amount"), F.format_string("donor '%s' has an invalid amount", who)),
        "date": (F.col("contribution_date").isNull(), F.format_string("donor '%s' has an undated contribution", who)),
        "url": (
            F.col("source_url").isNotNull() & ~is_valid_url("source_url", allowed),
            F.format_string("donor '%s' has an untrusted link %s", who, "source_url"),
        ),
    }


def item_rules(allowed: list[str]) -> dict[str, tuple[Column, Column]]:
    """V4 on record items: council_file, date, source_url."""
    what = F.coalesce("council_file", F.lit("none"))
    return {
        "record_id": (~is_valid_record_id("council_file"), F.format_string("'%s' is no record id", what)),
        "date": (~is_valid_date("date"), F.format_string("item %s has an invalid date", what)),
        "url": (F.col("source_url").isNotNull() & ~is_valid_url("source_url", allowed), F.format_string("item %s has an untrusted link", what)),
    }


def duplicate_keys(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys that occur more than once, with how often and where first."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(order).alias("first_seen")).where("occurrences > 1")


def duplicate_occurrences(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Every occurrence of a key after its first, numbered from 2."""
    return numbered(df, keys, [F.col(order).asc()], "occurrence").where("occurrence > 1")


def cross_reference(officials: DataFrame, registry: DataFrame, key: str = "official_id") -> DataFrame:
    """Officials without an entry, entries without an official, repeated officials."""
    a, b = officials.select(F.col(key).alias("official_id")), registry.select(F.col(key).alias("official_id"))
    said = lambda df, text: df.select("official_id", F.lit(text).alias("problem"))
    # one row for each further occurrence of an id
    extra = a.groupBy("official_id").agg(F.count("*").alias("n")).where("n > 1").select("official_id", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("i"))
    return (
        said(a.join(b, "official_id", "left_anti").distinct(), "missing from registry")
        .unionByName(said(b.join(a, "official_id", "left_anti").distinct(), "not in index"))
        .unionByName(said(extra, "duplicate official"))
    )


def build_status(officials: DataFrame, counts: DataFrame, found: DataFrame, builder: str, available: bool = True) -> DataFrame:
    """Ok, failed or skipped for each official; an unavailable source skips, and an
    official without rows is ok with none. ``counts``: official_id and records."""
    bad = found.where(F.col("builder") == builder).groupBy("official_id").agg(F.count("*").alias("problems"))
    rows = officials.select("official_id").join(bad, "official_id", "left").join(counts.select("official_id", "records"), "official_id", "left")
    failed = F.coalesce(F.col("problems"), F.lit(0)) > 0
    status = F.when(failed, "failed").otherwise("ok") if available else F.lit("skipped")
    records = F.when(status == "ok", F.coalesce("records", F.lit(0).cast("bigint"))).otherwise(0)
    return rows.select(
        "official_id",
        F.lit(builder).alias("builder"),
        status.alias("status"),
        records.cast("bigint").alias("records"),
        F.coalesce("problems", F.lit(0).cast("bigint")).alias("problems"),
    )


def build_summary(status: DataFrame, fatal: int = 0) -> DataFrame:
    """Counts by status, and whether the run is ok."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(n("ok"), n("failed"), n("skipped")).withColumn("run_ok", (F.lit(fatal) == 0) & (F.col("failed") == 0))


def freshness(status: DataFrame, today: str) -> DataFrame:
    """V8: one row an official with the state of each builder; success is today's only."""
    rows = status.withColumn("last_success_at", F.when(F.col("status") == "ok", F.lit(today)))
    return rows.groupBy("official_id").pivot("builder", ["funding", "record"]).agg(
        F.first("status").alias("status"), F.first("last_success_at").alias("last_success_at"), F.first("records").alias("records")
    )


# --- V1: the subset of JSON Schema that the documents use

_KINDS = {
    "object": dict,
    "array": list,
    "string": str,
    "number": (int, float),
    "integer": int,
    "boolean": bool,
    "null": type(None),
}
_NAMES = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}


def _fits(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _KINDS.get(kind, object))


def check_document(document, schema: dict, root: str = "$") -> list[str]:
    """Problems of a document, in document order; an explicit stack instead of recursion, so
    depth is bounded by memory only. A boolean is no number. A wrong type ends its branch."""
    found, stack = [], [(root, document, schema)]
    while stack:
        path, value, rule = stack.pop()
        kinds = rule.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if kinds and not any(_fits(value, k) for k in kinds):
            found.append(f"{path}: expected type {kinds}, got {_NAMES.get(type(value), 'other')}")
            continue
        if "enum" in rule and value not in rule["enum"]:
            found.append(f"{path}: {json.dumps(value)} is not an allowed value")
        below = []
        if isinstance(value, dict):
            known, other = rule.get("properties", {}), rule.get("additionalProperties")
            found += [f"{path}: missing required field '{name}'" for name in rule.get("required", ()) if name not in value]
            unknown = sorted(value.keys() - known.keys())
            if other is False and unknown:
                found.append(f"{path}: unexpected fields {unknown}")
            elif isinstance(other, dict):
                below += [(f"{path}.{k}", value[k], other) for k in unknown]
            below += [(f"{path}.{k}", value[k], sub) for k, sub in known.items() if k in value]
        elif isinstance(value, list) and "items" in rule:
            below += [(f"{path}[{i}]", v, rule["items"]) for i, v in enumerate(value)]
        stack += reversed(below)
    return found


def load_schema(path: str | Path) -> dict:
    """A schema with references to files beside it put in place."""
    path = Path(path)

    def resolved(node):
        if isinstance(node, list):
            return [resolved(x) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" in node:
            return load_schema(path.parent / node["$ref"])
        return {k: resolved(v) for k, v in node.items()}

    return resolved(json.loads(path.read_text()))


def schema_problems(df: DataFrame, key: str, document: str, schema: dict) -> DataFrame:
    """V1 for a column of JSON texts: ``key`` and ``problem``, a row for each. Null documents give
    a problem, as does a text that is no JSON."""
    ship(df.sparkSession)
    given = df.select(F.col(key), F.col(document).alias("document"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf["document"]):
                try:
                    rows += [(k, p) for p in check_document(json.loads(text), schema)]
                except (TypeError, ValueError):
                    rows.append((k, "$: no JSON document"))
            yield pd.DataFrame(rows, columns=[key, "problem"])

    kind = given.schema[key].dataType.simpleString()
    return given.mapInPandas(run, f"`{key}` {kind}, problem string")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """U4, A19."""
    return reduce(DataFrame.unionByName, parts)
