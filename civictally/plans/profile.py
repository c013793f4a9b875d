"""Queries of the donor roll-up and the profile views over the domain tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civictally.functions.text import display_name, party_label, type_label
from civictally.functions.values import BUSINESS_WORDS, PAC_WORDS, format_date, format_money
from civictally.operators import donors as D
from civictally.operators import serving as S
from civictally.operators.layout import treemap
from civictally.operators.records import enrich_contributions
from civictally.plans.registry import query, table

AS_OF = "2026-06-15"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"


def clean_sql(x: str) -> str:
    return f"CASE WHEN {strip_sql(x)} <> '' AND lower({strip_sql(x)}) NOT IN ('none', 'n/a', 'na', 'unknown') THEN {strip_sql(x)} END"


LOOKUP = f"lookup AS (SELECT lower({strip_sql('cmt_nm')}) AS k, max_by(official_id, cmt_id) AS official_id FROM committees WHERE {strip_sql('cmt_nm')} <> '' GROUP BY 1)"
MATCHED = f"matched AS (SELECT c.*, l.official_id FROM contributions c JOIN lookup l ON lower({strip_sql('c.committee_name')}) = l.k)"
GIFTS = f"""gifts AS (SELECT *, {strip_sql('contributor')} AS donor, contribution_amount AS amount, {clean_sql('contrib_employer')} AS emp,
    {clean_sql('contrib_occupation')} AS occ FROM matched WHERE lower({strip_sql('contribution_type')}) IN ('monetary contributions (itemized)', 'non-monetary contributions (itemized)')
    AND {strip_sql('contributor')} <> '' AND contribution_amount IS NOT NULL)"""
DONORS = f"""donors AS (SELECT *, row_number() OVER (PARTITION BY official_id ORDER BY total DESC, first_seen) AS donor_rank FROM (
    SELECT official_id, donor, sum(amount)::DECIMAL(18,2) AS total, count(*) AS gifts, min_by(emp, row_id) FILTER (WHERE emp IS NOT NULL) AS employer,
        CASE WHEN regexp_matches(donor, '{PAC_WORDS}') THEN 'pac' WHEN NOT bool_or(emp IS NOT NULL OR occ IS NOT NULL) AND regexp_matches(donor, '{BUSINESS_WORDS}') THEN 'business'
        ELSE 'individual' END AS donor_type, max(contribution_date) AS latest_date, min(row_id) AS first_seen FROM gifts GROUP BY official_id, donor))"""
TOP = f"WITH {LOOKUP}, {MATCHED}, {GIFTS}, {DONORS}, top AS (SELECT * FROM donors WHERE donor_rank <= 30) "
LINKS = f"""links AS (SELECT {strip_sql('cmt_id')} AS id, period_from_date AS f, period_to_date AS t, min_by({strip_sql('stmt_link')}, stmt_id) AS source_url FROM statements_filed
    WHERE {strip_sql('cmt_id')} <> '' AND {strip_sql('stmt_link')} <> '' AND period_from_date IS NOT NULL AND period_to_date IS NOT NULL GROUP BY 1, 2, 3)"""


def lookup(spark, d):
    return D.committee_lookup(table(spark, d, "committees"), "cmt_nm", "official_id", "cmt_id")


def matched(spark, d):
    return D.attach_officials(table(spark, d, "contributions"), lookup(spark, d))


def gifts(spark, d):
    return D.donor_gifts(matched(spark, d))


def top(spark, d):
    return D.donor_rollup(gifts(spark, d), "row_id", 30)


def links(spark, d):
    return D.filing_links(table(spark, d, "statements_filed"), "stmt_id")


@query(
    "donor_rollup_top30",
    TOP + "SELECT official_id, donor_rank::INT AS donor_rank, donor, donor_type, total::DOUBLE AS total, gifts, employer, latest_date FROM top",
)
def donor_rollup_top30(spark, d):
    return top(spark, d).select("official_id", "donor_rank", "donor", "donor_type", F.col("total").cast("double").alias("total"), "gifts", "employer", "latest_date")


@query(
    "committee_inner_join",
    f"WITH {LOOKUP}, {MATCHED} SELECT official_id, count(*) AS rows_matched, sum(contribution_amount)::DOUBLE AS amount FROM matched GROUP BY official_id",
)
def committee_inner_join(spark, d):
    rows = matched(spark, d).groupBy("official_id")
    return rows.agg(F.count("*").alias("rows_matched"), F.sum("contribution_amount").cast("double").alias("amount"))


@query(
    "filing_left_join",
    f"WITH {LINKS} SELECT row_id, source_url FROM contributions c LEFT JOIN links l ON {strip_sql('c.committee_id')} = l.id AND c.period_beg_date = l.f AND c.period_end_date = l.t",
)
def filing_left_join(spark, d):
    rows = table(spark, d, "contributions").select("row_id", "committee_id", "period_beg_date", "period_end_date")
    return D.attach_filings(rows, links(spark, d)).select("row_id", "source_url")


@query(
    "donor_contributions",
    TOP
    + f""", {LINKS} SELECT g.official_id, t.donor_rank::INT AS donor_rank, g.row_id, l.source_url,
        row_number() OVER (PARTITION BY g.official_id, g.donor ORDER BY g.contribution_date ASC NULLS FIRST, g.row_id)::INT AS place
        FROM gifts g JOIN top t ON g.official_id = t.official_id AND g.donor = t.donor
        LEFT JOIN links l ON {strip_sql('g.committee_id')} = l.id AND g.period_beg_date = l.f AND g.period_end_date = l.t""",
)
def donor_contributions(spark, d):
    return kept_gifts(spark, d).select("official_id", "donor_rank", "row_id", "source_url", "place")


def kept_gifts(spark, d):
    return D.attach_filings(D.donor_contributions(gifts(spark, d), top(spark, d), "row_id", table(spark, d, "contributions")), links(spark, d))


@query(
    "reelection_status",
    f"""WITH {LOOKUP}, {MATCHED}, dates AS (SELECT official_id, max(election_date) AS election_date FROM matched GROUP BY 1),
    own AS (SELECT official_id, max(list_max(list_transform(regexp_extract_all(cmt_nm, '(20\\d{{2}})', 1), lambda y: y::INT))) AS year, min_by(cmt_nm, cmt_id) AS committee FROM committees GROUP BY 1),
    r AS (SELECT official_id, election_date, committee, coalesce(election_date >= DATE '{AS_OF}', year >= 2026, false) AS active FROM own LEFT JOIN dates USING (official_id))
    SELECT official_id, election_date, committee, active, CASE WHEN active AND NOT coalesce(election_date < DATE '{AS_OF}', false) THEN 'Running for re-election'
        WHEN election_date < DATE '{AS_OF}' THEN 'Election already held' ELSE 'Not currently in an active re-election campaign' END AS status FROM r""",
)
def reelection_status(spark, d):
    committees = table(spark, d, "committees").select("official_id", F.col("cmt_nm").alias("committee_name"), F.col("cmt_id").alias("ord"))
    rows = D.reelection(matched(spark, d), committees, AS_OF)
    status = D.banner(F.col("election_date"), F.col("active"), F.col("result"), AS_OF)
    return rows.select("official_id", "election_date", "committee", "active", status.alias("status"))


@query(
    "source_gap_note",
    f"""WITH {LOOKUP}, {MATCHED} SELECT 'export' AS form, official_id FROM matched GROUP BY official_id HAVING bool_and(contrib_occupation IS NULL AND contrib_employer IS NULL)
    UNION ALL SELECT DISTINCT 'service', official_id FROM matched""",
)
def source_gap_note(spark, d):
    """F13 for the rows as exported, and as the service gives them, which names no occupation or employer."""
    rows = matched(spark, d)
    served = rows.withColumns({c: F.lit(None).cast("string") for c in ("contrib_occupation", "contrib_employer")})
    found = [D.source_gap(x).select(F.lit(form).alias("form"), "official_id") for form, x in (("export", rows), ("service", served))]
    return found[0].unionByName(found[1])


@query(
    "type_histogram_zero_fill",
    TOP
    + """, grid AS (SELECT DISTINCT official_id, unnest(['individual', 'pac', 'business']) AS donor_type FROM top)
    SELECT g.official_id, g.donor_type, count(t.donor) AS donors FROM grid g LEFT JOIN top t USING (official_id, donor_type) GROUP BY 1, 2
    UNION ALL SELECT official_id, 'all', count(*) FROM top GROUP BY 1""",
)
def type_histogram_zero_fill(spark, d):
    return S.type_histogram(top(spark, d))


@query(
    "filtered_summary",
    TOP + "SELECT official_id, count(*) FILTER (WHERE donor_type = 'pac') AS shown, count(*) AS donors, coalesce(sum(total) FILTER (WHERE donor_type = 'pac'), 0)::DOUBLE AS shown_total FROM top GROUP BY 1",
)
def filtered_summary(spark, d):
    return S.filtered_summary(top(spark, d), "pac").withColumn("shown_total", F.col("shown_total").cast("double"))


@query(
    "filtered_summary_text",
    TOP
    + """SELECT official_id, 'Showing ' || count(*) FILTER (WHERE donor_type = 'pac') || ' of ' || count(*) || ' PAC donor' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' · '
        || (CASE WHEN round(coalesce(sum(total) FILTER (WHERE donor_type = 'pac'), 0), 0) < 0 THEN '-' ELSE '' END) || '$'
        || format('{:,}', abs(round(coalesce(sum(total) FILTER (WHERE donor_type = 'pac'), 0), 0))::BIGINT) AS said FROM top GROUP BY 1""",
)
def filtered_summary_text(spark, d):
    return S.filtered_summary(top(spark, d), "pac").select("official_id", S.summary_text(F.lit("PAC")).alias("said"))


@query(
    "map_markers",
    TOP
    + r"""SELECT o.official_id, CASE WHEN office ILIKE '%mayor%' THEN 'Mayor' WHEN regexp_extract(office, '(\d+)', 1) <> '' THEN 'District ' || regexp_extract(office, '(\d+)', 1) ELSE office END AS place,
        o.name AS title, t.total, t.donors, t.top_donor FROM officials o
        LEFT JOIN (SELECT official_id, sum(total)::DOUBLE AS total, count(*) AS donors, min_by(donor, donor_rank) AS top_donor FROM top GROUP BY 1) t USING (official_id)""",
)
def map_markers(spark, d):
    summary = S.funding_summary(top(spark, d)).withColumn("total", F.col("total").cast("double"))
    return S.markers(table(spark, d, "officials"), summary)


@query(
    "funding_summary_topdonor",
    TOP + "SELECT official_id, sum(total)::DOUBLE AS total, count(*) AS donors, min_by(donor, donor_rank) AS top_donor FROM top GROUP BY 1",
)
def funding_summary_topdonor(spark, d):
    return S.funding_summary(top(spark, d)).withColumn("total", F.col("total").cast("double"))


@query(
    "reporting_period",
    TOP + "SELECT g.official_id, min(contribution_date) AS period_from, max(contribution_date) AS period_to FROM gifts g JOIN top t USING (official_id, donor) WHERE t.total > 0 GROUP BY 1",
)
def reporting_period(spark, d):
    kept = gifts(spark, d).join(top(spark, d).select("official_id", "donor", "total"), ["official_id", "donor"])
    return S.reporting_period(kept)


@query(
    "first_linked_contribution",
    TOP
    + f""", {LINKS}, c AS (SELECT g.official_id, g.donor, l.source_url, row_number() OVER (PARTITION BY g.official_id, g.donor ORDER BY g.contribution_date NULLS FIRST, g.row_id) AS place
        FROM gifts g JOIN top t USING (official_id, donor) JOIN links l ON {strip_sql('g.committee_id')} = l.id AND g.period_beg_date = l.f AND g.period_end_date = l.t)
    SELECT official_id, donor, min_by(source_url, place) AS source_url FROM c GROUP BY 1, 2""",
)
def first_linked_contribution(spark, d):
    return S.first_linked(kept_gifts(spark, d))


_ORDERS = {
    "name": "lower(coalesce(donor, ''))",
    "employer": "lower(coalesce(employer, ''))",
    "latest": "coalesce(latest_date::VARCHAR, '')",
    "count": "gifts",
    "type": "lower(coalesce(donor_type, ''))",
    "total": "total",
}


@query(
    "sort_by_key_stable",
    TOP
    + " UNION ALL ".join(
        f"SELECT '{k}' AS sort_key, '{direction}' AS direction, official_id, donor_rank::INT AS donor_rank, row_number() OVER (PARTITION BY official_id ORDER BY {x} {direction}, donor_rank)::INT AS place FROM top"
        for k, x in _ORDERS.items()
        for direction in ("asc", "desc")
    ),
)
def sort_by_key_stable(spark, d):
    return S.every_order(top(spark, d))


@query(
    "share_of_total",
    TOP + "SELECT official_id, donor_rank::INT AS donor_rank, round(greatest(total, 0.01)::DOUBLE / sum(greatest(total, 0.01)) OVER (PARTITION BY official_id)::DOUBLE * 100, 6) AS share FROM top WHERE total > 0",
)
def share_of_total(spark, d):
    return S.shares(top(spark, d)).select("official_id", "donor_rank", F.round("share", 6).alias("share"))


@query("treemap_layout")
def treemap_layout(spark, d):
    """Sequential by nature: tested by its invariants, see ``treemap_areas``."""
    return treemap(top(spark, d))


@query(
    "treemap_areas",
    TOP
    + """, sized AS (SELECT *, greatest(total, 0.01)::DOUBLE AS size FROM top WHERE total > 0)
    SELECT official_id, donor_rank::INT AS donor_rank, round(size / sum(size) OVER (PARTITION BY official_id) * 800 * 440, 3) AS area, true AS inside,
        row_number() OVER (PARTITION BY official_id ORDER BY size DESC, donor_rank)::INT AS place, count(*) OVER (PARTITION BY official_id) AS tiles FROM sized""",
)
def treemap_areas(spark, d):
    """Each tile's area is its donor's share of the drawing, tiles lie within it and come largest first."""
    tiles = treemap(top(spark, d))
    edge = 1e-6
    inside = (F.col("x") >= -edge) & (F.col("y") >= -edge) & (F.col("x") + F.col("w") <= 800 + edge) & (F.col("y") + F.col("h") <= 440 + edge)
    own = W.partitionBy("official_id")
    place = F.row_number().over(own.orderBy(F.round(F.col("w") * F.col("h"), 6).desc(), "donor_rank")).alias("place")
    return tiles.select("official_id", "donor_rank", F.round(F.col("w") * F.col("h"), 3).alias("area"), inside.alias("inside"), place, F.count("*").over(own).alias("tiles"))


@query(
    "donor_table",
    TOP
    + """SELECT official_id, donor_rank::INT AS donor_rank, CASE donor_type WHEN 'pac' THEN 'PAC' WHEN 'business' THEN 'Business' ELSE 'Individual' END AS type_label,
        (CASE WHEN round(total, 0) < 0 THEN '-' ELSE '' END) || '$' || format('{:,}', abs(round(total, 0))::BIGINT) AS total_label,
        coalesce(strftime(latest_date, '%b %-d, %Y'), 'Undated') AS latest_label FROM top""",
)
def donor_table(spark, d):
    """The visible cells of the donor table."""
    return top(spark, d).select(
        "official_id", "donor_rank", type_label("donor_type").alias("type_label"), format_money("total").alias("total_label"), format_date("latest_date").alias("latest_label")
    )


@query(
    "nested_donors",
    TOP + "SELECT official_id, count(*) AS donors, sum(gifts)::BIGINT AS contributions FROM top GROUP BY 1",
)
def nested_donors(spark, d):
    """The published nesting, told by its sizes."""
    nested = D.nest_donors(top(spark, d), kept_gifts(spark, d))
    sizes = F.aggregate("donors", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["contributions"]))
    return nested.select("official_id", F.size("donors").cast("bigint").alias("donors"), sizes.alias("contributions"))


@query(
    "left_lookup_default",
    "SELECT f.official_id, coalesce(min(o.name), 'Unlisted') AS name FROM (SELECT DISTINCT official_id FROM funding) f LEFT JOIN officials o USING (official_id) GROUP BY 1",
)
def left_lookup_default(spark, d):
    return S.with_default(table(spark, d, "funding").select("official_id").distinct(), table(spark, d, "officials"), "official_id", "name", "Unlisted")


_CITY = ("Mayor", "City Attorney", "City Controller")


@query(
    "union_lookup",
    f"""SELECT official_id, CASE WHEN office IN {_CITY} THEN 'citywide' WHEN regexp_extract(office, '(\\d+)', 1) <> '' THEN 'District ' || regexp_extract(office, '(\\d+)', 1) END AS place FROM officials""",
)
def union_lookup(spark, d):
    rows = table(spark, d, "officials")
    number = F.regexp_extract("office", r"(\d+)", 1)
    districts = rows.where(~F.col("office").isin(*_CITY) & (number != "")).select("official_id", F.concat(F.lit("District "), number).alias("place"))
    citywide = rows.where(F.col("office").isin(*_CITY)).select("official_id", F.lit("citywide").alias("place"))
    return S.place_lookup(rows.select("official_id"), districts, citywide)


@query(
    "profile_header",
    f"""SELECT official_id, CASE WHEN coalesce({strip_sql('name')}, '') IN ('', 'REPLACE_ME') THEN office ELSE name END AS shown_name,
        coalesce(party_affiliation, 'Not publicly listed') AS party FROM officials""",
)
def profile_header(spark, d):
    """P21, P22, J7."""
    return table(spark, d, "officials").select("official_id", display_name("name", "office").alias("shown_name"), party_label("party_affiliation").alias("party"))


@query(
    "profile_complete",
    "SELECT o.official_id, count(*) AS donors, sum(total)::DOUBLE AS total FROM officials o JOIN funding f USING (official_id) WHERE EXISTS (SELECT 1 FROM committees c WHERE c.official_id = o.official_id) GROUP BY 1",
)
def profile_complete(spark, d):
    """Officials that have both kinds of data."""
    both = table(spark, d, "officials").join(table(spark, d, "committees"), "official_id", "left_semi")
    rows = table(spark, d, "funding").join(both.select("official_id"), "official_id")
    return rows.groupBy("official_id").agg(F.count("*").alias("donors"), F.sum("total").cast("double").alias("total"))


@query(
    "bounding_box",
    "SELECT min(p_retailprice) AS south, min(p_size::DOUBLE) AS west, max(p_retailprice) AS north, max(p_size::DOUBLE) AS east FROM part",
)
def bounding_box(spark, d):
    points = table(spark, d, "part").select(F.col("p_retailprice").alias("lat"), F.col("p_size").cast("double").alias("lon"))
    return S.bounding_box(points, "lat", "lon")


@query(
    "first_k_array",
    """SELECT user_id, list(event_id ORDER BY ts, event_id)::VARCHAR AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 8 GROUP BY 1""",
)
def first_k_array(spark, d):
    rows = S.first_k(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_id", 8)
    ids = F.transform("first_values", lambda x: x.cast("string"))
    return rows.select("user_id", F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("ids"))


@query(
    "gift_provenance",
    f"""WITH {LINKS} SELECT row_id, coalesce(source_url, 'https://filings.example/') AS source_url, nullif({strip_sql('committee_id')}, '') AS record_id,
        period_beg_date::VARCHAR AS period_from, period_end_date::VARCHAR AS period_to FROM contributions c
        LEFT JOIN links l ON {strip_sql('c.committee_id')} = l.id AND c.period_beg_date = l.f AND c.period_end_date = l.t""",
)
def gift_provenance(spark, d):
    """Where each contribution is filed, and for which period."""
    rows = D.attach_filings(table(spark, d, "contributions"), links(spark, d))
    made = enrich_contributions(rows, "Exports", "https://filings.example/", AS_OF, "1")
    period = F.col("provenance.reporting_period")
    return made.select("row_id", F.col("provenance.source_url").alias("source_url"), "provenance.record_id", period["from"].alias("period_from"), period["to"].alias("period_to"))
