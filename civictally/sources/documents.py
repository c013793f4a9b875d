"""Shapes of the configuration and published documents, in the subset of JSON Schema that is checked.

Fixed values: the names of fields and the allowed words below are those of the published documents."""

from __future__ import annotations

TEXT, NUMBER, FLAG = {"type": "string"}, {"type": "number"}, {"type": "boolean"}


def maybe(kind: dict, *values) -> dict:
    """May be null; limited to the values if any."""
    return {"type": [kind["type"], "null"]} | ({"enum": [*values, None]} if values else {})


def one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def many(of: dict) -> dict:
    return {"type": "array", "items": of}


def fields(required: dict | None = None, optional: dict | None = None, other=None) -> dict:
    out = {"type": "object", "required": list(required or {}), "properties": {**(required or {}), **(optional or {})}}
    return out if other is None else out | {"additionalProperties": other}


LINK = fields({"name": TEXT, "url": TEXT})
PERIOD = {"type": ["object", "null"], "properties": {"from": maybe(TEXT), "to": maybe(TEXT)}}
PROVENANCE = fields(
    {"source_name": TEXT, "retrieved_at": TEXT, "methodology_version": TEXT},
    {"source_url": maybe(TEXT), "reporting_period": PERIOD, "meeting_date": maybe(TEXT), "record_id": maybe(TEXT)},
)
STAMPED = {"retrieved_at": TEXT, "methodology_version": TEXT}
GIFT = fields({"date": TEXT, "amount": NUMBER}, {"source_url": maybe(TEXT), "provenance": PROVENANCE})
DONOR = fields(
    {"name": TEXT, "type": one_of("individual", "pac", "business"), "total": NUMBER, "contributions": many(GIFT)}, {"employer": maybe(TEXT)}
)
REELECTION = {
    "type": ["object", "null"],
    "properties": {"active": FLAG, "election_date": maybe(TEXT), "committee": maybe(TEXT), "result": maybe(TEXT, "won", "lost", "runoff")},
}
FUNDING = fields(
    {
        "official": fields({"id": TEXT, "name": TEXT, "office": TEXT}, {"reelection": REELECTION}),
        "source": fields({"name": TEXT, "url": TEXT}, {"committees": many(TEXT), **STAMPED}),
        "donors": many(DONOR),
    }
)
ITEM = fields(
    {
        "council_file": TEXT,
        "title": TEXT,
        "role": one_of("proposed", "seconded", "voted_yes", "voted_no"),
        "date": TEXT,
        "outcome": one_of("passed", "failed", "pending"),
        "term": one_of("current", "previous"),
    },
    {"source_url": maybe(TEXT), "provenance": PROVENANCE},
)
RECORD = fields({"official_id": TEXT, "source": fields({"name": TEXT, "url": TEXT}, STAMPED), "items": many(ITEM)})
PARTY = fields(
    {
        "affiliation": one_of("Democrat", "Republican", "Independent", "Not publicly listed"),
        "source": {"type": ["object", "null"], "properties": {"name": TEXT, "url": TEXT}},
    }
)
OFFICIALS = many(fields({"id": TEXT, "name": TEXT, "office": TEXT}, {"party": PARTY}))
ENTRY = fields(
    {
        "funding": fields({"committees": many(TEXT)}, {"election_result": maybe(TEXT, "won", "lost", "runoff")}),
        "record": fields({"source": LINK, "fixture": TEXT}),
    }
)
REGISTRY = fields({"schema_version": TEXT, "officials": fields(other=ENTRY)})
STATUS = one_of("ok", "failed", "skipped")
COUNT = {"type": "integer"}
RESULT = fields(
    {"official_id": TEXT, "builder": one_of("funding", "record"), "status": STATUS, "record_count": COUNT, "problems": many(TEXT)},
    {"source_notes": many(TEXT)},
)
REPORT = fields(
    {"started_at": TEXT, "finished_at": TEXT, "ok": FLAG, "results": many(RESULT), "unavailable_sources": many(TEXT), "fatal_errors": many(TEXT), "summary": TEXT}
)
