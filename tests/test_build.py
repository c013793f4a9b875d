"""The whole way from files to published documents."""

import csv
import json

import pytest
from test_donors import HEADER, ROWS

from civictally.operators.quality import check_document
from civictally.plans.build import Config, build, from_service, validate
from civictally.sources import documents, schemas


@pytest.fixture
def root(tmp_path):
    link = {"name": "Records", "url": "https://clerk.example/"}
    officials = [{"id": "official-a", "name": "A", "office": "Mayor"}, {"id": "official-b", "name": "B", "office": "Clerk"}]
    entry = lambda x, cs: {"funding": {"committees": cs}, "record": {"source": link, "fixture": f"data/sources/records/{x}.json"}}
    registry = {"schema_version": "1.0", "officials": {"official-a": entry("official-a", ["Friends of Rosa Baltehas 2026"]), "official-b": entry("official-b", ["Nobody 2020"])}}
    item = lambda f, **x: {"council_file": f, "title": "T", "role": "proposed", "date": "2025-01-02", "outcome": "passed", "term": "current"} | x
    put = {
        "data/officials.json": officials,
        "data/sources/registry.json": registry,
        "data/sources/records/official-a.json": {"official_id": "official-a", "items": [item("31-0417"), item("31-0520-S2", role="voted_yes"), item("EO-7")]},
        "data/sources/records/official-b.json": {"official_id": "official-b", "items": []},
    }
    for path, doc in put.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(doc))
    (tmp_path / "data/raw").mkdir()
    (tmp_path / "data/raw/contributions.csv").write_text("\n".join([HEADER, *ROWS]) + "\n")
    filings(tmp_path, "https://filings.example/view/?document_id=480217")
    return tmp_path


def filings(root, link):
    (root / "data/raw/statements_filed.csv").write_text(f"cmt_id,period_from_date,period_to_date,stmt_link\n1000045,01/01/2026,06/30/2026,{link}\n")


def read(root, path):
    return json.loads((root / path).read_text())


def test_build(spark, root):
    report = build(spark, Config(root), "2026-08-01")
    assert report["ok"] and report["summary"].startswith("4 builder run(s) ok"), report
    assert check_document(read(root, "data/build_report.json"), documents.REPORT) == []
    funding = read(root, "data/officials/official-a/funding.json")
    assert [(d["name"], d["type"], d["total"], d["employer"], len(d["contributions"])) for d in funding["donors"]] == [
        ("Dimmolovo Nurses PAC", "pac", 1250, None, 1),
        ("Tariq Lokmedil", "individual", 730, "Oven Works", 2),
    ]
    gift = funding["donors"][1]["contributions"][0]
    assert gift["date"] == "2026-01-12" and gift["amount"] == 420 and gift["source_url"].endswith("=480217")
    assert gift["provenance"]["reporting_period"] == {"from": "2026-01-01", "to": "2026-06-30"}
    assert funding["official"]["reelection"] == {"active": True, "election_date": "2026-11-03", "committee": "Friends of Rosa Baltehas 2026", "result": None}
    assert read(root, "data/officials/official-b/funding.json")["donors"] == []
    notes = {(r["official_id"], r["builder"]): r["source_notes"] for r in report["results"]}
    assert notes["official-b", "funding"] == ["no rows matched the committees"] and notes["official-b", "record"] == ["no curated items"]
    items = read(root, "data/officials/official-a/record.json")["items"]
    assert [i["source_url"] for i in items] == ["https://clerk.example/record?file=31-0417", "https://clerk.example/record?file=31-0520-S2", None]
    assert items[2]["provenance"]["source_url"] == "https://clerk.example/"
    assert read(root, "data/freshness.json")["officials"]["official-a"]["funding"] == {"status": "ok", "last_success_at": "2026-08-01", "donor_count": 2}
    assert validate(spark, Config(root)) == []


def test_failures_are_isolated(spark, root):
    build(spark, Config(root), "2026-08-01")
    before = (root / "data/officials/official-a/funding.json").read_bytes()
    filings(root, "https://evil.example.com/x")
    (root / "data/sources/records/official-a.json").unlink()
    report = build(spark, Config(root), "2026-08-02")
    status = {(r["official_id"], r["builder"]): r["status"] for r in report["results"]}
    assert status == {("official-a", "funding"): "failed", ("official-a", "record"): "failed", ("official-b", "funding"): "ok", ("official-b", "record"): "ok"}
    assert (root / "data/officials/official-a/funding.json").read_bytes() == before and not report["ok"]
    (root / "data/raw/contributions.csv").unlink()
    report = build(spark, Config(root), "2026-08-03", chosen=["official-b"])
    assert report["ok"] and [r["status"] for r in report["results"]] == ["skipped", "ok"] and report["unavailable_sources"]


def test_source_gap_and_markdown(spark, root):
    path = root / "data/raw/contributions.csv"
    build(spark, Config(root), "2026-08-01")
    gap = "no row names an occupation or employer"
    report = read(root, "data/build_report.json")
    assert gap not in [n for r in report["results"] for n in r["source_notes"]]
    rows = list(csv.DictReader(path.open()))
    with path.open("w", newline="") as f:
        out = csv.DictWriter(f, rows[0])
        out.writeheader()
        out.writerows({k: "" if "Occupation" in k or "Employer" in k else v for k, v in r.items()} for r in rows)
    report = build(spark, Config(root), "2026-08-01", markdown=root / "report.md")
    notes = {(r["official_id"], r["builder"]): r["source_notes"] for r in report["results"]}
    assert notes["official-a", "funding"] == [gap] and gap not in notes["official-b", "funding"]
    text = (root / "report.md").read_text()
    assert text.startswith(f"**{report['summary']}**\n") and "| official-a | funding | ok | 2 | — |" in text


def test_fatal_and_validation(spark, root):
    report = build(spark, Config(root), "2026-08-01", skip_freshness=True)
    assert report["ok"] and not (root / "data/freshness.json").exists()
    doc = read(root, "data/officials/official-a/record.json")
    doc["items"][0]["council_file"] = doc["items"][1]["council_file"] = "odd"
    doc["items"][2]["role"] = "slept"
    (root / "data/officials/official-a/record.json").write_text(json.dumps(doc))
    (root / "data/officials/official-b/funding.json").unlink()
    said = "\n".join(validate(spark, Config(root)))
    for part in ("official-b/funding.json: missing", "duplicate council_file 'odd'", "'odd' is no record id", '"slept" is not an allowed value'):
        assert part in said
    officials = read(root, "data/officials.json") + [{"id": "official-c", "name": "C", "office": "X"}]
    (root / "data/officials.json").write_text(json.dumps(officials))
    report = build(spark, Config(root), "2026-08-01")
    assert report["fatal_errors"] == ["official 'official-c': missing from registry"] and not report["results"] and not report["ok"]


def test_malformed_records_are_reported(spark, root):
    path = root / "data/raw/contributions.csv"
    path.write_text(path.read_text() + '05/01/2026,"Tariq Lokmedil,Baker,Oven Works\n' + ROWS[0] + ",twelfth\n" + ROWS[1] + "\n")
    report = build(spark, Config(root), "2026-08-01")
    assert report["ok"] and ": 1 column_count, 1 quoting; see " in report["unavailable_sources"][0]
    assert read(root, "data/officials/official-a/funding.json")["donors"][1]["total"] == 420 + 2 * 310
    assert spark.read.json(str(root / "data/rejects/contributions")).count() == 2


def test_report_is_written_when_a_stage_fails(spark, root):
    (root / "data/sources/registry.json").write_text('{"schema_version": "1.0", "officials": 7}')

    def broken():
        raise RuntimeError("disk is full")

    registry = {"schema_version": "1.0", "officials": {x: {"funding": {"committees": []}, "record": {}} for x in ("official-a", "official-b")}}
    (root / "data/sources/registry.json").write_text(json.dumps(registry))
    with pytest.raises(RuntimeError):
        build(spark, Config(root), "2026-08-01", service=broken, markdown=root / "report.md")
    report = read(root, "data/build_report.json")
    assert report["fatal_errors"] == ["RuntimeError: disk is full"] and not report["ok"] and "disk is full" in (root / "report.md").read_text()


def test_service_and_its_failure(spark, root):
    nowhere = "http://127.0.0.1:9/rows.json"
    call = lambda **x: lambda: from_service(spark, Config(root), nowhere, nowhere, tries=1, timeout=1, **x)
    for given in ({}, {"cache_only": True}):
        report = build(spark, Config(root), "2026-08-01", service=call(**given))
        assert [r["status"] for r in report["results"] if r["builder"] == "funding"] == ["skipped", "skipped"]
        assert report["ok"] and "no earlier copy" in report["unavailable_sources"][0]
    # a landed copy serves, with and without a call
    names = {v: k.replace("_", " ").title().replace(" Id", " ID") for k, v in schemas.SERVICE_FIELDS.items()}
    rows = list(csv.DictReader((root / "data/raw/contributions.csv").open()))
    landed = spark.createDataFrame([tuple(r[names[c]] for c in names) for r in rows], schemas.strings(*names))
    landed.write.parquet(str(root / "data/raw/service/contributions"))
    spark.createDataFrame([("1000045", "01/01/2026", "06/30/2026", '{"url": "https://filings.example/view/?document_id=5"}')], schemas.strings(*schemas.STATEMENT_COLUMNS)).write.parquet(str(root / "data/raw/service/statements"))
    for given in ({}, {"cache_only": True}):
        report = build(spark, Config(root), "2026-08-01", service=call(**given))
        assert report["ok"] and not report["unavailable_sources"]
        notes = {(r["official_id"], r["builder"]): r["source_notes"] for r in report["results"]}
        assert notes["official-a", "funding"] == ["no row names an occupation or employer"]
    assert [d["total"] for d in read(root, "data/officials/official-a/funding.json")["donors"]] == [1250, 730]
