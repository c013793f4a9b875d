"""From exported files to published documents, and the check of what is published.

    python -m civictally.plans.build build ROOT [--official ID ...] [--contributions CSV] [--statements CSV]
        [--service URL --service-statements URL [--cache-only]] [--markdown FILE]
    python -m civictally.plans.build validate ROOT

One plan covers all officials; the driver handles one small document an official at a time.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civictally.functions.values import parse_amount, parse_date
from civictally.operators import donors as D
from civictally.operators import quality as Q
from civictally.operators.publish import gate, plain, report_markdown, write_json
from civictally.operators.records import enrich_contributions, enrich_items
from civictally.session import cut, local_session
from civictally.sources import documents, files, schemas
from civictally.sources.paged import read_paged


@dataclass
class Config:
    """What differs from place to place."""

    root: Path
    source_name: str = "Contribution exports"
    source_url: str = "https://filings.example/"
    record_root: str = "https://clerk.example/record?file="
    allowed_hosts: list[str] = field(default_factory=lambda: ["filings.example", "clerk.example"])
    methodology: str = "1.0"
    top: int = 30

    @property
    def officials(self) -> Path:
        return self.root / "data/officials.json"

    @property
    def registry(self) -> Path:
        return self.root / "data/sources/registry.json"


def _dated(d: str) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def _funding(spark: SparkSession, cfg: Config, today: str, officials: DataFrame, registry: DataFrame, rows: DataFrame, statements: DataFrame):
    """Documents, problems and notes of the funding builder."""
    committees = files.registry_committees(registry)
    lookup = D.committee_lookup(committees, "committee_name", "official_id", "ord")
    days = ("contribution_date", "period_beg_date", "period_end_date", "election_date")
    rows = rows.withColumns({c: parse_date(c) for c in days} | {"contribution_amount": parse_amount("contribution_amount")})
    statements = statements.withColumns({c: parse_date(c) for c in ("period_from_date", "period_to_date")}).withColumn("stmt_link", files.link_text(F.col("stmt_link")))
    matched = cut(D.attach_officials(rows, lookup))
    gifts = D.donor_gifts(matched)
    top = cut(D.donor_rollup(gifts, "seq", cfg.top))
    kept = D.attach_filings(D.donor_contributions(gifts, top, "seq", rows), D.filing_links(statements, "seq"))
    found = Q.problems(kept, "funding", Q.gift_rules(cfg.allowed_hosts)).select("official_id", "builder", "detail").distinct()
    kept = enrich_contributions(kept, cfg.source_name, None, today, cfg.methodology)
    gift = F.struct("place", _dated("contribution_date").alias("date"), "amount", "source_url", "provenance")
    lists = kept.groupBy("official_id", "donor").agg(F.transform(F.array_sort(F.collect_list(gift)), lambda g: g.dropFields("place")).alias("contributions"))
    donor = F.struct("donor_rank", F.col("donor").alias("name"), F.col("donor_type").alias("type"), "total", "employer", "contributions")
    nested = top.join(lists, ["official_id", "donor"]).groupBy("official_id").agg(F.transform(F.array_sort(F.collect_list(donor)), lambda d: d.dropFields("donor_rank")).alias("donors"))
    election = D.reelection(matched, committees, today, registry.select("official_id", F.col("funding.election_result").alias("election_result")))
    running = F.struct("active", _dated("election_date").alias("election_date"), "committee", "result")
    own = registry.select("official_id", F.coalesce("funding.committees", F.array().cast("array<string>")).alias("committees"))
    out = officials.join(own, "official_id").join(election, "official_id", "left").join(nested, "official_id", "left")
    empty = F.array().cast(nested.schema["donors"].dataType)
    out = out.select(
        "official_id",
        F.struct(F.col("official_id").alias("id"), "name", "office", F.when(F.col("active").isNotNull(), running).otherwise(F.struct(F.lit(False).alias("active"), F.lit(None).cast("string").alias("election_date"), F.lit(None).cast("string").alias("committee"), F.lit(None).cast("string").alias("result"))).alias("reelection")).alias("official"),
        F.struct(F.lit(cfg.source_name).alias("name"), F.lit(cfg.source_url).alias("url"), "committees", F.lit(today).alias("retrieved_at"), F.lit(cfg.methodology).alias("methodology_version")).alias("source"),
        F.coalesce("donors", empty).alias("donors"),
    )
    note = F.when(F.size("committees") == 0, "no committee configured").when(F.col("n").isNull(), "no rows matched the committees")
    notes = own.join(matched.groupBy("official_id").agg(F.count("*").alias("n")), "official_id", "left").select("official_id", note.alias("note")).where("note is not null")
    gap = D.source_gap(matched).join(own, "official_id", "left_semi").select("official_id", F.lit("no row names an occupation or employer").alias("note"))
    return out, found, notes.unionByName(gap)


def _records(spark: SparkSession, cfg: Config, today: str, officials: DataFrame, registry: DataFrame):
    """Documents, problems and notes of the record builder."""
    entries = registry.select("official_id", F.col("record.source").alias("source"), F.col("record.fixture").alias("fixture"))
    # as many paths as officials: a list that is configuration
    there = [(r.official_id, r.fixture, (cfg.root / r.fixture).resolve().as_uri()) for r in entries.collect() if r.fixture and (cfg.root / r.fixture).exists()]
    paths = spark.createDataFrame(there, "official_id string, fixture string, uri string")
    missing = entries.join(paths.select("official_id"), "official_id", "left_anti")
    lost = missing.select("official_id", F.lit("record").alias("builder"), F.format_string("no record file %s", F.coalesce("fixture", F.lit(""))).alias("detail"))
    none = "official_id string, path string, pos int, council_file string, title string, role string, date string, outcome string, term string"
    items = files.read_record_items(spark, [u for *_, u in there]) if there else spark.createDataFrame([], none)
    items = items.drop("official_id").withColumn("uri", F.regexp_replace("path", "^file:/+", "file:///"))
    items = items.join(paths.select("official_id", "uri"), "uri").join(entries.select("official_id", "source"), "official_id")
    items = items.withColumns({"source_name": F.col("source.name"), "source_url": F.col("source.url")})
    items = cut(enrich_items(items, cfg.record_root, today, cfg.methodology))
    found = Q.problems(items, "record", Q.item_rules(cfg.allowed_hosts)).select("official_id", "builder", "detail")
    twice = Q.duplicate_keys(items, ["official_id", "council_file"], "pos")
    said = F.format_string("duplicate council_file '%s'", F.coalesce("council_file", F.lit("")))
    found = Q.union_all([found, lost, twice.select("official_id", F.lit("record").alias("builder"), said.alias("detail"))])
    item = F.struct("pos", "council_file", "title", "role", "date", "outcome", "term", "source_url", "provenance")
    nested = items.groupBy("official_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("pos")).alias("items"))
    empty = F.array().cast(nested.schema["items"].dataType)
    stamped = F.struct(F.col("source.name").alias("name"), F.col("source.url").alias("url"), F.lit(today).alias("retrieved_at"), F.lit(cfg.methodology).alias("methodology_version"))
    out = officials.select("official_id").join(entries, "official_id").join(nested, "official_id", "left")
    notes = out.where("items is null").select("official_id", F.lit("no curated items").alias("note"))
    return out.select("official_id", stamped.alias("source"), F.coalesce("items", empty).alias("items")), found, notes


def _publish(docs: DataFrame, found: DataFrame, shape: dict, folder: Path, name: str, builder: str, with_key: bool) -> tuple[dict, list[tuple[str, str, str]]]:
    """Write the documents without problems; sizes by official, and problems of their shape."""
    sizes, wrong = {}, []
    for row in gate(docs, found).toLocalIterator():
        doc = plain(row)
        key = doc["official_id"]
        if not with_key:
            doc.pop("official_id")
        bad = Q.check_document(doc, shape)
        wrong += [(key, builder, p) for p in bad]
        if not bad:
            write_json(folder / key / name, doc)
            sizes[key] = len(doc["donors" if builder == "funding" else "items"])
    return sizes, wrong


class SourceUnavailable(Exception):
    """Neither a source nor an earlier copy of it could be read."""


def from_service(spark: SparkSession, cfg: Config, contributions: str, statements: str, cache_only: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Contributions and filings of the paged service, landed under data/raw/service. Where the
    service fails the last landed copy serves; with ``cache_only`` it is not called at all."""
    folder = cfg.root / "data/raw/service"
    names = {"contributions": (contributions, tuple(schemas.SERVICE_FIELDS.values())), "statements": (statements, schemas.STATEMENT_COLUMNS)}
    try:
        return tuple(read_paged(spark, url, schemas.strings(*columns), str(folder / name), cache_only, **options) for name, (url, columns) in names.items())
    except Exception as e:
        raise SourceUnavailable(str(e).splitlines()[0]) from e


def build(
    spark: SparkSession,
    cfg: Config,
    today: str | None = None,
    contributions: str | None = None,
    statements: str | None = None,
    chosen: list[str] | None = None,
    skip_freshness: bool = False,
    service: Callable[[], tuple[DataFrame, DataFrame]] | None = None,
    markdown: str | Path | None = None,
) -> dict:
    """Build all (or the chosen) officials; the report, which is also written, whatever happens.

    Officials fail each for themselves: one with problems keeps its earlier documents.
    A cross-reference problem is fatal and builds nothing. A source that is not there (no exports, or a
    service that fails without an earlier copy) is reported as unavailable and skips the funding of all.
    Records of an export that are no rows are written to data/rejects, and their number is reported. An
    error of any stage becomes a fatal one and is raised again once the report is written.
    ``service`` gives the rows of the paged service (see from_service) instead of files. ``markdown`` is a
    file for the report as text.
    """
    report = {"started_at": _now(), "results": [], "unavailable_sources": [], "fatal_errors": []}
    fresh: dict = {}
    try:
        _build(spark, cfg, today or date.today().isoformat(), contributions, statements, chosen, service, report, fresh)
    except Exception as e:
        report["fatal_errors"].append(f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}")
        raise
    finally:
        _report(spark, cfg, report, None if skip_freshness else fresh, markdown)
    return report


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def _report(spark: SparkSession, cfg: Config, report: dict, fresh: dict | None, markdown: str | Path | None) -> None:
    by = [r["status"] for r in report["results"]]
    report["ok"] = not report["fatal_errors"] and "failed" not in by
    report["summary"] = f"{by.count('ok')} builder run(s) ok, {by.count('failed')} failed, {by.count('skipped')} skipped, {len(report['unavailable_sources'])} source(s) unavailable"
    report["finished_at"] = _now()
    write_json(cfg.root / "data/build_report.json", report)
    if markdown:
        status = [(r["official_id"], r["builder"], r["status"], r["record_count"]) for r in report["results"]]
        said = [(r["official_id"], r["builder"], p) for r in report["results"] for p in r["problems"]]
        tables = spark.createDataFrame(status, "official_id string, builder string, status string, records int"), spark.createDataFrame(said, "official_id string, builder string, detail string")
        Path(markdown).write_text(report_markdown(*tables, report["unavailable_sources"], report["fatal_errors"]) + "\n")
    if fresh:
        write_json(cfg.root / "data/freshness.json", {"generated_at": report["finished_at"], "officials": fresh})


def _sources(spark: SparkSession, cfg: Config, contributions: str | None, statements: str | None, service, report: dict) -> tuple[DataFrame, DataFrame] | None:
    """Contributions and filings, or None where they are unavailable, which the report then says."""
    said = report["unavailable_sources"]
    if service is not None:
        try:
            rows, filed = service()
        except SourceUnavailable as e:
            said.append(f"funding: the service failed and there is no earlier copy: {e}")
            return None
        return tuple(x.withColumn("seq", F.monotonically_increasing_id()) for x in (files.from_service(rows), filed))
    csv = contributions or str(cfg.root / "data/raw/contributions.csv")
    if not Path(csv).exists():
        said.append(f"funding: no contributions at {csv}; skipped for all officials")
        return None
    rejects = cut(files.rejected_contributions(spark, csv))
    # one row a reason
    wrong = {r.reason: r.n for r in rejects.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect()}
    if wrong:
        folder = cfg.root / "data/rejects/contributions"
        rejects.write.mode("overwrite").json(str(folder))
        said.append(f"funding: records of {csv} that are no rows: " + ", ".join(f"{n} {reason}" for reason, n in wrong.items()) + f"; see {folder}")
    return files.read_contributions(spark, csv), files.read_statements(spark, statements or str(cfg.root / "data/raw/statements_filed.csv"))


def _build(spark: SparkSession, cfg: Config, today: str, contributions: str | None, statements: str | None, chosen: list[str] | None, service, report: dict, fresh: dict) -> None:
    everyone = files.read_officials(spark, str(cfg.officials)).select("ord", F.col("id").alias("official_id"), "name", "office")
    registry = files.read_registry(spark, str(cfg.registry))
    # one short line for each mismatch of two configuration files
    report["fatal_errors"] += [f"official '{r.official_id}': {r.problem}" for r in Q.cross_reference(everyone, registry).orderBy("problem", "official_id").collect()]
    if report["fatal_errors"]:
        return
    officials = everyone.where(F.col("official_id").isin(chosen)) if chosen else everyone
    results = {"funding": ({}, {}, {}, False)}
    found = _sources(spark, cfg, contributions, statements, service, report)
    if found:
        # of all the rows only those of the officials that are built
        own = registry.join(officials.select("official_id"), "official_id", "left_semi")
        results["funding"] = (*_run("funding", cfg, *_funding(spark, cfg, today, officials, own if chosen else registry, *found)), True)
    results["record"] = (*_run("record", cfg, *_records(spark, cfg, today, officials, registry)), True)
    for r in officials.orderBy("ord").toLocalIterator():
        fresh[r.official_id] = {}
        for builder, count in (("funding", "donor_count"), ("record", "item_count")):
            sizes, wrong, notes, available = results[builder]
            own = wrong.get(r.official_id, [])
            status = "skipped" if not available else "failed" if own else "ok"
            n = sizes.get(r.official_id, 0)
            report["results"].append({"official_id": r.official_id, "builder": builder, "status": status, "record_count": n, "problems": own, "source_notes": notes.get(r.official_id, [])})
            fresh[r.official_id][builder] = {"status": status, "last_success_at": today if status == "ok" else None, count: n}


#: Problems of one official that the report spells out; their number is always said.
SPELT = 100


def _run(builder: str, cfg: Config, docs: DataFrame, found: DataFrame, notes: DataFrame):
    """Sizes, problems and notes by official. Problems are counted and cut to SPELT an official in Spark."""
    shape = documents.FUNDING if builder == "funding" else documents.RECORD
    found = cut(found)
    sizes, wrong = _publish(docs, found, shape, cfg.root / "data/officials", f"{builder}.json", builder, builder == "record")
    listed: dict[str, list[str]] = {}
    # a null text sorts first, as elsewhere
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("official_id").orderBy("detail"))).where(F.col("r") <= SPELT)
    counts = found.groupBy("official_id").agg(F.count("*").alias("n"))
    for r in ranked.join(counts, "official_id").orderBy("official_id", "r").toLocalIterator():
        own = listed.setdefault(r.official_id, [])
        own.append(r.detail)
        if r.r == SPELT < r.n:
            own.append(f"and {r.n - SPELT} more")
    for key, _, p in wrong:
        listed.setdefault(key, []).append(p)
    said: dict[str, list[str]] = {}
    for r in notes.orderBy("official_id").toLocalIterator():
        said.setdefault(r.official_id, []).append(r.note)
    return sizes, listed, said


def validate(spark: SparkSession, cfg: Config) -> list[str]:
    """V5, V6: problems of all published documents, nothing rebuilt."""
    for path in (cfg.officials, cfg.registry):
        if not path.exists():
            return [f"missing {path}"]
    out = [f"officials.json: {p}" for p in Q.check_document(json.loads(cfg.officials.read_text()), documents.OFFICIALS)]
    out += [f"registry.json: {p}" for p in Q.check_document(json.loads(cfg.registry.read_text()), documents.REGISTRY)]
    officials = files.read_officials(spark, str(cfg.officials)).select("ord", F.col("id").alias("official_id"))
    out += [f"official '{r.official_id}': {r.problem}" for r in Q.cross_reference(officials, files.read_registry(spark, str(cfg.registry))).orderBy("problem", "official_id").collect()]
    folder = cfg.root / "data/officials"
    for name, shape in (("funding.json", documents.FUNDING), ("record.json", documents.RECORD)):
        texts = spark.read.text(str(folder), wholetext=True, recursiveFileLookup=True, pathGlobFilter=name) if folder.exists() else spark.createDataFrame([], "value string")
        texts = texts.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("official_id"), "value") if folder.exists() else texts.selectExpr("'' as official_id", "value")
        texts = cut(texts.join(officials.select("official_id"), "official_id", "left_semi"))
        absent = officials.join(texts, "official_id", "left_anti").select("official_id", F.lit("missing").alias("problem"))
        found = absent.unionByName(Q.schema_problems(texts, "official_id", "value", shape)).unionByName(_rules(texts, name, cfg.allowed_hosts))
        out += [f"{r.official_id}/{name}: {r.problem}" for r in found.orderBy("official_id", "problem").toLocalIterator()]
    return out


def _rules(texts: DataFrame, name: str, allowed: list[str]) -> DataFrame:
    """What a published document must keep beyond its shape."""
    if name == "funding.json":
        donors = "array<struct<name:string,contributions:array<struct<source_url:string>>>>"
        rows = texts.select("official_id", F.posexplode(F.from_json("value", f"donors {donors}")["donors"]).alias("pos", "d")).select("official_id", "pos", "d.*")
        twice = Q.duplicate_keys(rows, ["official_id", "name"], "pos").select("official_id", F.format_string("duplicate donor '%s'", F.col("name")).alias("problem"))
        links = rows.select("official_id", F.col("name").alias("donor"), F.explode("contributions.source_url").alias("source_url"))
        rules = {"url": Q.gift_rules(allowed)["url"]}
        return twice.unionByName(Q.problems(links, "funding", rules).select("official_id", F.col("detail").alias("problem")))
    items = "array<struct<council_file:string,date:string,source_url:string>>"
    rows = texts.select("official_id", F.posexplode(F.from_json("value", f"items {items}")["items"]).alias("pos", "i")).select("official_id", "pos", "i.*")
    twice = Q.duplicate_keys(rows, ["official_id", "council_file"], "pos").select("official_id", F.format_string("duplicate council_file '%s'", F.col("council_file")).alias("problem"))
    rules = {k: v for k, v in Q.item_rules(allowed).items() if k != "date"}
    return twice.unionByName(Q.problems(rows, "record", rules).select("official_id", F.col("detail").alias("problem")))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what", choices=("build", "validate"))
    parser.add_argument("root", type=Path)
    parser.add_argument("--official", action="append")
    parser.add_argument("--contributions")
    parser.add_argument("--statements")
    parser.add_argument("--service", help="address of the service's contributions")
    parser.add_argument("--service-statements", help="address of the service's filings")
    parser.add_argument("--cache-only", action="store_true", help="read what was landed before and do not call the service")
    parser.add_argument("--skip-freshness", action="store_true")
    parser.add_argument("--markdown", type=Path)
    parser.add_argument("--json", action="store_true")
    given = parser.parse_args(args)
    spark, cfg = local_session(), Config(given.root)
    if given.what == "build":
        called = given.service or given.cache_only
        service = (lambda: from_service(spark, cfg, given.service, given.service_statements, given.cache_only)) if called else None
        report = build(spark, cfg, None, given.contributions, given.statements, given.official, given.skip_freshness, service, given.markdown)
        print(json.dumps(report, indent=2) if given.json else report["summary"])
        return 0 if report["ok"] else 1
    found = validate(spark, cfg)
    print(json.dumps({"ok": not found, "problems": found}, indent=2) if given.json else "\n".join(found) or "all published data is valid")
    return 1 if found else 0


if __name__ == "__main__":
    raise SystemExit(main())
