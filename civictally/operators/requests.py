"""Questions to an assistant: the decisions around the call, as columns.

The call itself is left to an injected function of the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictally.functions.text import question_ok, strip, strip_fences
from civictally.functions.values import source_host
from civictally.session import ship

CITATIONS = 8


def guard(method: Column, configured: bool, body: Column, question: Column, limited: Column) -> Column:
    """The first failing check decides: method, key, body, question, rate; 200 goes on to the call."""
    return (
        F.when(method != "POST", 405)
        .when(F.lit(not configured), 500)
        .when(body.isNull() | ~question_ok(question), 400)
        .when(F.coalesce(limited, F.lit(False)), 429)
        .otherwise(200)
    )


def represented(title: Column, city: str) -> Column:
    """The city as a whole for a mayor, else the title, else the city."""
    t = F.coalesce(title, F.lit(""))
    return F.when(t.rlike("(?i)mayor"), F.lit(f"the City of {city}")).when(t != "", t).otherwise(F.lit(city))


def prompt(name: Column, title: Column, party: Column, city: str) -> Column:
    """What the assistant is told about its subject."""
    t = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise("official")
    p = F.when(F.coalesce(party, F.lit("")) != "", F.concat(F.lit(" ("), party, F.lit(")"))).otherwise("")
    text = F.concat(F.lit("Subject: "), name, F.lit(", the "), t, p, F.lit(" representing "), represented(title, city))
    rules = ". Use public, verifiable facts and cite them. Reply with one JSON object with the fields in_scope (boolean) and answer (text)."
    return F.concat(text, F.lit(rules))


def citations(links: Column) -> Column:
    """The first links with their hosts as titles."""
    kept = F.slice(F.coalesce(links, F.array().cast("array<string>")), 1, CITATIONS)
    return F.transform(kept, lambda u: F.struct(source_host(u).alias("title"), u.alias("url")))


def outcome(content: Column, links: Column, decline: Column) -> Column:
    """Status, answer and citations of a raw reply. What is not marked in scope gets
    the fixed refusal, whatever it says; no JSON or no answer is a failed call."""
    text = F.coalesce(strip_fences(content), F.lit(""))
    parsed = F.from_json(text, "in_scope boolean, answer string", {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(text)
    answer = F.coalesce(strip(parsed["answer"]), F.lit(""))
    # an answer must be a JSON text, and the mark a JSON boolean
    is_text = F.schema_of_variant(F.try_variant_get(whole, "$.answer", "variant")) == "STRING"
    in_scope = F.coalesce(F.schema_of_variant(F.try_variant_get(whole, "$.in_scope", "variant")) == "BOOLEAN", F.lit(False)) & F.coalesce(parsed["in_scope"], F.lit(False))
    none = F.array().cast("array<struct<title:string,url:string>>")
    failed = whole.isNull() | (in_scope & ~(F.coalesce(is_text, F.lit(False)) & (answer != "")))
    return F.struct(
        F.when(failed, 502).otherwise(200).alias("status"),
        F.when(failed, F.lit(None)).when(in_scope, answer).otherwise(decline).alias("answer"),
        F.when(~failed & in_scope, citations(links)).otherwise(none).alias("citations"),
    )


def call(requests: DataFrame, question: str, system: str, ask: Callable[[str, str], tuple[str, list[str]]]) -> DataFrame:
    """The rows with ``content`` and ``links`` of an injected ``ask(system, question)``; an error gives nulls."""
    ship(requests.sparkSession)
    reply = [T.StructField("content", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            replies = []
            for s, q in zip(pdf[system], pdf[question]):
                try:
                    replies.append(ask(s, q))
                except Exception:  # noqa: BLE001 - one failed call is one failed row
                    replies.append((None, None))
            pdf["content"], pdf["links"] = [r[0] for r in replies], [r[1] for r in replies]
            yield pdf

    return requests.mapInPandas(run, T.StructType([*requests.schema.fields, *reply]))
