"""The donor roll-up on files as they are exported."""

import datetime as dt

from civictally.operators import donors as D
from civictally.operators.records import enrich_contributions
from civictally.sources import files

HEADER = "Contribution Date,Contributor,Contrib Occupation,Contrib Employer,Committee Name,Committee ID,Period Beg Date,Period End Date,Contribution Amount,Contribution Type,Election Date"
ROWS = [
    '01/12/2026,Tariq Lokmedil,Baker,Oven Works,Friends of Rosa Baltehas 2026,1000045,01/01/2026,06/30/2026,420.00,Monetary Contributions (Itemized),11/03/2026',
    '02/15/2026,Tariq Lokmedil,Baker,Oven Works,Friends of Rosa Baltehas 2026,1000045,01/01/2026,06/30/2026,310.00,Monetary Contributions (Itemized),11/03/2026',
    '03/01/2026,Dimmolovo Nurses PAC,None,None,Friends of Rosa Baltehas 2026,1000045,01/01/2026,06/30/2026,"1,250.00",Monetary Contributions (Itemized),11/03/2026',
    '04/01/2026,Harbor Trust,None,None,Friends of Rosa Baltehas 2026,1000045,01/01/2026,06/30/2026,4800.00,Misc. Increase(s) to Cash,11/03/2026',
    '04/02/2026,Nobody,None,None,Friends of Rosa Baltehas 2026,1000045,01/01/2026,06/30/2026,about fifty,Monetary Contributions (Itemized),11/03/2026',
]


def typed(df):
    from civictally.functions.values import parse_amount, parse_date

    dates = {c: parse_date(c) for c in ("contribution_date", "period_beg_date", "period_end_date", "election_date")}
    return df.withColumns(dates | {"contribution_amount": parse_amount("contribution_amount")})


def loaded(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿" + "\n".join([HEADER, *ROWS]) + "\n")
    (tmp_path / "s.csv").write_text(
        "cmt_id,period_from_date,period_to_date,stmt_link\n1000045,01/01/2026,06/30/2026,https://f.example/?document_id=1\n1000045,01/01/2026,06/30/2026,later\n"
    )
    from civictally.functions.values import parse_date

    rows = typed(files.read_contributions(spark, str(tmp_path / "c.csv")))
    statements = files.read_statements(spark, str(tmp_path / "s.csv")).withColumns({c: parse_date(c) for c in ("period_from_date", "period_to_date")})
    return rows, statements


def test_rollup(spark, tmp_path):
    rows, statements = loaded(spark, tmp_path)
    committees = spark.createDataFrame(
        [(" friends of rosa baltehas 2026 ", "official-z", 0), ("Friends of Rosa Baltehas 2026", "official-a", 1)], "committee_name string, official_id string, ord int"
    )
    matched = D.attach_officials(rows, D.committee_lookup(committees, "committee_name", "official_id", "ord"))
    gifts = D.donor_gifts(matched)
    donors = D.donor_rollup(gifts, "seq")
    got = [(r.donor_rank, r.donor, r.donor_type, float(r.total), r.employer, r.gifts) for r in donors.orderBy("donor_rank").collect()]
    assert got == [(1, "Dimmolovo Nurses PAC", "pac", 1250.0, None, 1), (2, "Tariq Lokmedil", "individual", 730.0, "Oven Works", 2)]
    gifts = D.attach_filings(D.donor_contributions(gifts, donors, "seq"), D.filing_links(statements, "seq"))
    assert {r.source_url for r in gifts.collect()} == {"https://f.example/?document_id=1"}
    nested = D.nest_donors(donors, gifts).first()
    assert [d.name for d in nested.donors] == ["Dimmolovo Nurses PAC", "Tariq Lokmedil"] and len(nested.donors[1].contributions) == 2
    made = enrich_contributions(gifts, "Exports", "https://f.example", "2026-08-01", "1").first().provenance
    assert made.record_id == "1000045" and made.reporting_period["from"] == "2026-01-01"
    own = committees.where("ord = 1")
    held = spark.createDataFrame([("official-a", "won")], "official_id string, election_result string")
    before = D.reelection(matched, own, "2026-11-03", held).first()
    after = D.reelection(matched, own, "2026-11-04", held).first()
    assert (before.active, before.result, before.election_date) == (True, None, dt.date(2026, 11, 3))
    assert (after.active, after.result) == (False, "won")


def test_missing_statements(spark, tmp_path):
    df = files.read_statements(spark, str(tmp_path / "none.csv"))
    assert df.count() == 0 and "stmt_link" in df.columns


def test_ties_in_order_of_appearance(spark):
    rows = [("a", n, 10.0, i) for i, n in enumerate(["z", "y", "x", "z"])]
    df = spark.createDataFrame(rows, "official_id string, donor string, amount double, seq int").selectExpr(
        "*", "null as contrib_employer", "null as contrib_occupation", "null as contribution_date"
    )
    df = df.selectExpr("official_id", "donor", "cast(amount as decimal(18,2)) amount", "seq", "cast(contrib_employer as string) contrib_employer",
                       "cast(contrib_occupation as string) contrib_occupation", "cast(contribution_date as date) contribution_date")
    got = [r.donor for r in D.donor_rollup(df, "seq", 2).orderBy("donor_rank").collect()]
    assert got == ["z", "y"]


def test_documents(spark, tmp_path):
    (tmp_path / "o.json").write_text('[{"id": "a", "name": "A", "office": "Mayor", "party": null}, {"id": "b", "name": "B", "office": "Clerk"}]')
    (tmp_path / "r.json").write_text('{"schema_version": "1", "officials": {"b": {"funding": {"committees": ["X", "Y"]}}, "a": {"funding": {"committees": ["X"]}}}}')
    (tmp_path / "items.json").write_text('{"official_id": "a", "items": [{"council_file": "31-0417", "date": "2025-01-01"}]}')
    assert [r.id for r in files.read_officials(spark, str(tmp_path / "o.json")).orderBy("ord").collect()] == ["a", "b"]
    committees = files.registry_committees(files.read_registry(spark, str(tmp_path / "r.json")))
    lookup = {r.committee_key: r.official_id for r in D.committee_lookup(committees, "committee_name", "official_id", "ord").collect()}
    assert lookup == {"x": "a", "y": "b"}
    assert files.read_record_items(spark, str(tmp_path / "items.json")).first().council_file == "31-0417"
    api = spark.createDataFrame([("n", "c")], "con_name string, cmt_nm string").selectExpr("*", *[f"'x' as {c}" for c in ("con_date", "cmt_id", "per_beg_date", "per_end_date", "con_amount", "con_type", "election_date")])
    assert files.from_service(api).first().contributor == "n"
