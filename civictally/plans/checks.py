"""Queries of scalar functions, data quality, status, limits and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from civictally.functions import text as X
from civictally.functions import values as V
from civictally.operators import quality as Q
from civictally.operators import requests as R
from civictally.operators.donors import DONOR_TYPES
from civictally.operators.limits import cooldown, rate_limit
from civictally.operators.publish import gate, report_lines
from civictally.operators.records import enrich_items, record_filter, term_items
from civictally.plans.profile import GIFTS, LOOKUP, MATCHED, clean_sql, gifts, strip_sql
from civictally.plans.registry import query, table
from civictally.sources.files import link_text, request_body

TODAY = "2026-08-17"
HOSTS = ["filings.example", "clerk.example"]


@query(
    "clean_fields",
    f"SELECT row_id, {clean_sql('contrib_employer')} AS employer, {clean_sql('contrib_occupation')} AS occupation FROM contributions",
)
def clean_fields(spark, d):
    return table(spark, d, "contributions").select("row_id", X.clean_field("contrib_employer").alias("employer"), X.clean_field("contrib_occupation").alias("occupation"))


@query(
    "parse_amounts",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS amount FROM lineitem",
)
def parse_amounts(spark, d):
    written = F.concat(F.lit(" $"), F.format_number("l_extendedprice", 2), F.lit(" "))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.parse_amount(written).cast("double").alias("amount"))


@query("parse_dates_multi", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def parse_dates_multi(spark, d):
    day, n = F.col("o_orderdate"), F.col("o_orderkey") % 4
    written = (
        F.when(n == 0, F.date_format(day, "M/d/yyyy"))
        .when(n == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(n == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    return table(spark, d, "orders").select("o_orderkey", V.parse_date(written).alias("day"))


@query(
    "classify_names",
    f"""SELECT funding_id, CASE WHEN regexp_matches(name, '{V.PAC_WORDS}') THEN 'pac' WHEN ({clean_sql('employer')}) IS NULL AND regexp_matches(name, '{V.BUSINESS_WORDS}')
        THEN 'business' ELSE 'individual' END AS inferred FROM funding WHERE name IS NOT NULL""",
)
def classify_names(spark, d):
    rows = table(spark, d, "funding").where("name is not null")
    return rows.select("funding_id", V.donor_type("name", X.clean_field("employer").isNotNull()).alias("inferred"))


@query(
    "first_nonblank_pick",
    f"SELECT official_id, min_by({clean_sql('employer')}, funding_id) FILTER (WHERE ({clean_sql('employer')}) IS NOT NULL) AS employer FROM funding GROUP BY 1",
)
def first_nonblank_pick(spark, d):
    employer = X.clean_field("employer")
    rows = table(spark, d, "funding").groupBy("official_id")
    return rows.agg(F.min_by(employer, F.when(employer.isNotNull(), F.col("funding_id"))).alias("employer"))


@query(
    "year_extract_max",
    r"SELECT cmt_id, list_max(list_transform(regexp_extract_all(cmt_nm, '(20\d{2})', 1), lambda y: y::INT)) AS year FROM committees",
)
def year_extract_max(spark, d):
    return table(spark, d, "committees").select("cmt_id", V.latest_year("cmt_nm").alias("year"))


_URL = r"regexp_extract(trim(u), '^(https?)://([^/?#]+)', 2)"


@query(
    "url_allowlist",
    f"""WITH s AS (SELECT stmt_id, CASE WHEN stmt_link LIKE '{{%' THEN json_extract_string(stmt_link, '$.url') ELSE stmt_link END AS u FROM statements_filed)
    SELECT stmt_id, coalesce(lower({_URL}) IN ('filings.example', 'clerk.example'), false) AS allowed, CASE WHEN {_URL} <> '' THEN lower({_URL}) ELSE 'Source' END AS host FROM s""",
)
def url_allowlist(spark, d):
    u = F.trim(link_text(F.col("stmt_link")))
    return table(spark, d, "statements_filed").select("stmt_id", V.is_valid_url(u, HOSTS).alias("allowed"), V.source_host(u).alias("host"))


_RECORD_ID = "CASE o_orderkey % 4 WHEN 0 THEN '25-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') WHEN 1 THEN '25-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '-S' || (o_orderkey % 9)::VARCHAR WHEN 2 THEN 'ED-' || (o_orderkey % 100)::VARCHAR ELSE 'X-' || o_orderkey::VARCHAR END"
ROOT = "https://clerk.example/record?file="


@query(
    "record_id_check",
    f"""SELECT o_orderkey, o_orderkey % 4 <> 3 AS valid, CASE WHEN o_orderkey % 4 < 2 THEN '{ROOT}' || ({_RECORD_ID}) END AS url,
        coalesce(CASE WHEN o_orderkey % 4 < 2 THEN '{ROOT}' || ({_RECORD_ID}) END, 'https://clerk.example/') AS provenance_url FROM orders""",
)
def record_id_check(spark, d):
    rows = _items(spark, d)
    return enrich_items(rows, ROOT, TODAY, "1").select("o_orderkey", V.is_valid_record_id("council_file").alias("valid"), F.col("source_url").alias("url"), F.col("provenance.source_url").alias("provenance_url"))


def _items(spark, d):
    k = F.col("o_orderkey")
    n = F.lpad((k % 10000).cast("string"), 4, "0")
    file = (
        F.when(k % 4 == 0, F.concat(F.lit("25-"), n))
        .when(k % 4 == 1, F.concat(F.lit("25-"), n, F.lit("-S"), (k % 9).cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("ED-"), (k % 100).cast("string")))
        .otherwise(F.concat(F.lit("X-"), k.cast("string")))
    )
    return table(spark, d, "orders").select(
        "o_orderkey",
        file.alias("council_file"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "proposed").when(F.col("o_orderstatus") == "O", "voted_yes").otherwise("voted_no").alias("role"),
        F.when(k % 3 == 0, "passed").otherwise("pending").alias("outcome"),
        F.lit("Records").alias("source_name"),
        F.lit("https://clerk.example/").alias("source_url"),
    )


@query(
    "record_filters",
    """SELECT role_label, count(*) AS items, count(*) FILTER (WHERE proposed) AS proposed, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE voted) AS voted FROM (
        SELECT CASE o_orderstatus WHEN 'F' THEN 'proposed' WHEN 'O' THEN 'voted yes' ELSE 'voted no' END AS role_label, o_orderstatus = 'F' AS proposed, o_orderkey % 3 = 0 AS passed, o_orderstatus <> 'F' AS voted FROM orders) GROUP BY 1""",
)
def record_filters(spark, d):
    n = lambda kind: F.count_if(record_filter(kind))
    rows = _items(spark, d).groupBy(X.role_label("role").alias("role_label"))
    return rows.agg(n("all").alias("items"), n("proposed").alias("proposed"), n("passed").alias("passed"), n("voted").alias("voted"))


@query(
    "date_valid",
    "SELECT o_orderkey, o_orderkey % 3 = 0 AS valid FROM orders",
)
def date_valid(spark, d):
    day, n = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 3
    written = F.when(n == 0, day).when(n == 1, F.concat(F.substring(day, 1, 5), F.lit("02-30"))).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", V.is_valid_date(written).alias("valid"))


@query(
    "amount_valid",
    "SELECT o_orderkey, o_orderkey % 4 < 2 AS valid FROM orders",
)
def amount_valid(spark, d):
    n = F.col("o_orderkey") % 4
    value = F.when(n == 0, F.col("o_totalprice")).when(n == 1, -F.col("o_totalprice")).when(n == 2, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return table(spark, d, "orders").select("o_orderkey", V.is_valid_amount(value).alias("valid"))


@query(
    "display_values",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_day, strftime(o_orderdate, '%b %-d, %Y') AS shown_date,
        '$' || format('{:,}', round(o_totalprice::DECIMAL(18,2), 0)::BIGINT) AS shown_money, least(greatest(o_totalprice, 320.0), 560.0) AS clamped FROM orders""",
)
def display_values(spark, d):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "orders").select(
        "o_orderkey", V.iso_day(stamp).alias("iso_day"), V.format_date("o_orderdate").alias("shown_date"), V.format_money("o_totalprice").alias("shown_money"), V.clamp("o_totalprice", 320.0, 560.0).alias("clamped")
    )


@query(
    "html_escape",
    """SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM documents""",
)
def html_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", X.escape_html("text").alias("escaped"))


@query(
    "district_context",
    """SELECT official_id, nullif(regexp_extract(office, '(?i)District\\s+(\\d+)', 1), '') AS district, left(name, 10) AS short_name,
        CASE WHEN office = 'Mayor' THEN 'citywide' ELSE 'for ' || office END AS scope FROM officials""",
)
def district_context(spark, d):
    """P27, P28, P35."""
    scope = F.when(F.col("office") == "Mayor", "citywide").otherwise(F.format_string("for %s", "office"))
    return table(spark, d, "officials").select("official_id", X.district_number("office").alias("district"), X.context_field("name", 10).alias("short_name"), scope.alias("scope"))


@query(
    "duplicate_keys",
    "SELECT text, count(*) AS occurrences, min(doc_id) AS first_seen FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_keys(spark, d):
    return Q.duplicate_keys(table(spark, d, "documents"), ["text"], "doc_id")


@query(
    "duplicate_occurrences",
    "SELECT funding_id, occurrence FROM (SELECT funding_id, row_number() OVER (PARTITION BY official_id, name ORDER BY funding_id)::INT AS occurrence FROM funding) WHERE occurrence > 1",
)
def duplicate_occurrences(spark, d):
    return Q.duplicate_occurrences(table(spark, d, "funding"), ["official_id", "name"], "funding_id").select("funding_id", "occurrence")


@query(
    "orphans_both_ways",
    """SELECT DISTINCT o.o_orderkey::VARCHAR AS official_id, 'missing from registry' AS problem FROM orders o ANTI JOIN lineitem l ON o.o_orderkey = l.l_orderkey
    UNION ALL SELECT DISTINCT l.l_orderkey::VARCHAR, 'not in index' FROM lineitem l ANTI JOIN orders o ON o.o_orderkey = l.l_orderkey""",
)
def orphans_both_ways(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("official_id"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("official_id")).distinct()
    return Q.cross_reference(orders, items)


def _problems(spark, d):
    """V3 and A6 over the funding table: bad totals and donors listed twice."""
    rows = table(spark, d, "funding")
    rules = {
        "amount": (~V.is_valid_amount("total"), F.format_string("funding %s has an invalid total", "funding_id")),
        "negative": (F.col("total") < 0, F.format_string("funding %s has a negative total", "funding_id")),
    }
    twice = Q.duplicate_keys(rows, ["official_id", "name"], "funding_id").where("name is not null")
    said = twice.select("official_id", F.lit("funding").alias("builder"), F.lit("duplicate").alias("rule"), F.format_string("duplicate donor '%s'", "name").alias("detail"))
    return Q.union_all([Q.problems(rows, "funding", rules), said])


_PROBLEMS = """problems AS (
    SELECT official_id, 'amount' AS rule, format('funding {} has an invalid total', funding_id) AS detail FROM funding WHERE total IS NULL
    UNION ALL SELECT official_id, 'negative', format('funding {} has a negative total', funding_id) FROM funding WHERE total < 0
    UNION ALL SELECT official_id, 'duplicate', 'duplicate donor ''' || name || '''' FROM funding WHERE name IS NOT NULL GROUP BY official_id, name HAVING count(*) > 1)"""


@query("quality_problems", f"WITH {_PROBLEMS} SELECT official_id, 'funding' AS builder, rule, detail FROM problems")
def quality_problems(spark, d):
    return _problems(spark, d)


@query(
    "gift_problems",
    f"WITH {LOOKUP}, {MATCHED}, {GIFTS} SELECT official_id, 'date' AS rule, count(*) AS problems FROM gifts WHERE contribution_date IS NULL GROUP BY 1",
)
def gift_problems(spark, d):
    """V3 over the flat gifts of the roll-up."""
    rows = gifts(spark, d).withColumn("source_url", F.lit(None).cast("string"))
    return Q.problems(rows, "funding", Q.gift_rules(HOSTS)).groupBy("official_id", "rule").agg(F.count("*").alias("problems"))


def _status(spark, d):
    rows = table(spark, d, "funding")
    counts = rows.groupBy("official_id").agg(F.count("*").alias("records"))
    officials = table(spark, d, "officials")
    committees = table(spark, d, "committees").groupBy("official_id").agg(F.count("*").alias("records"))
    found = _problems(spark, d).where("rule <> 'duplicate'")
    return Q.build_status(officials, counts, found, "funding").unionByName(Q.build_status(officials, committees, found, "record"))


_STATUS = f"""{_PROBLEMS}, bad AS (SELECT official_id, count(*) AS problems FROM problems WHERE rule <> 'duplicate' GROUP BY 1),
    status AS (SELECT official_id, 'funding' AS builder, CASE WHEN problems > 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN problems > 0 THEN 0 ELSE coalesce(records, 0) END AS records, coalesce(problems, 0) AS problems
        FROM officials LEFT JOIN bad USING (official_id) LEFT JOIN (SELECT official_id, count(*) AS records FROM funding GROUP BY 1) USING (official_id)
    UNION ALL SELECT official_id, 'record', 'ok', coalesce(records, 0), 0 FROM officials LEFT JOIN (SELECT official_id, count(*) AS records FROM committees GROUP BY 1) USING (official_id))"""


@query("build_status_report", f"WITH {_STATUS} SELECT * FROM status")
def build_status_report(spark, d):
    return _status(spark, d)


@query(
    "build_summary",
    f"WITH {_STATUS} SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') = 0 AS run_ok FROM status",
)
def build_summary(spark, d):
    return Q.build_summary(_status(spark, d))


@query(
    "freshness_pivot",
    f"""WITH {_STATUS} SELECT f.official_id, f.status AS funding_status, CASE WHEN f.status = 'ok' THEN '{TODAY}' END AS funding_last_success_at, f.records AS funding_records,
        r.status AS record_status, CASE WHEN r.status = 'ok' THEN '{TODAY}' END AS record_last_success_at, r.records AS record_records
    FROM status f JOIN status r ON f.official_id = r.official_id AND f.builder = 'funding' AND r.builder = 'record'""",
)
def freshness_pivot(spark, d):
    return Q.freshness(_status(spark, d), TODAY)


@query(
    "report_markdown",
    f"""WITH {_STATUS} SELECT s.official_id, s.builder, '| ' || s.official_id || ' | ' || s.builder || ' | ' || s.status || ' | ' || s.records || ' | ' || coalesce(p.said, '—') || ' |' AS line
    FROM status s LEFT JOIN (SELECT official_id, string_agg(detail, '; ' ORDER BY detail) AS said FROM problems WHERE rule <> 'duplicate' GROUP BY 1) p ON s.official_id = p.official_id AND s.builder = 'funding'""",
)
def report_markdown(spark, d):
    return report_lines(_status(spark, d), _problems(spark, d).where("rule <> 'duplicate'"))


@query(
    "publish_gate",
    f"WITH {_PROBLEMS} SELECT official_id, funding_id FROM funding f WHERE NOT EXISTS (SELECT 1 FROM problems p WHERE p.official_id = f.official_id AND rule <> 'duplicate')",
)
def publish_gate(spark, d):
    return gate(table(spark, d, "funding").select("official_id", "funding_id"), _problems(spark, d).where("rule <> 'duplicate'"))


SCHEMA = {
    "type": "object",
    "required": ["k", "note"],
    "properties": {"k": {"type": "integer", "enum": list(range(50))}, "note": {"type": "string"}},
    "additionalProperties": False,
}


@query(
    "schema_validate",
    """SELECT event_id, problem FROM (SELECT event_id, '$: missing required field ''note''' AS problem FROM events
        UNION ALL SELECT event_id, '$.k: ' || (json_extract(props, '$.k'))::VARCHAR || ' is not an allowed value' FROM events WHERE json_extract(props, '$.k')::INT >= 50)""",
)
def schema_validate(spark, d):
    return Q.schema_problems(table(spark, d, "events"), "event_id", "props", SCHEMA)


@query("json_field_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field_extract(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.get_json_object(X.strip_fences(fenced), "$.k").alias("k"))


@query(
    "rate_limit_fixed_window",
    """WITH RECURSIVE e AS (SELECT event_id, user_id::VARCHAR || ':' || event_type AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT key, event_id, us, n, us AS start, 1 AS hits FROM e WHERE n = 1
        UNION ALL SELECT e.key, e.event_id, e.us, e.n, CASE WHEN e.us - w.start > 21600000000 THEN e.us ELSE w.start END, CASE WHEN e.us - w.start > 21600000000 THEN 1 ELSE w.hits + 1 END
        FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
    SELECT event_id, hits::BIGINT AS hits, hits > 1 AS limited FROM w""",
)
def rate_limit_fixed_window(spark, d):
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type"))
    return rate_limit(table(spark, d, "events"), key, "ts", "event_id", 1, 6 * 3600).select(F.col("order").alias("event_id"), "hits", "limited")


@query(
    "cooldown_gate",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT user_id, event_id, n, us AS last, true AS accepted FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.us - w.last >= 21600000000 THEN e.us ELSE w.last END, e.us - w.last >= 21600000000 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT event_id, accepted FROM w""",
)
def cooldown_gate(spark, d):
    return cooldown(table(spark, d, "events"), F.col("user_id"), "ts", "event_id", 6 * 3600).select(F.col("order").alias("event_id"), "accepted")


@query(
    "request_guard_status",
    rf"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 405 WHEN length({strip_sql("coalesce(text, '')")}) BETWEEN 1 AND 300 THEN 200 ELSE 400 END AS status,
        CASE WHEN doc_id % 2 = 0 THEN '10.0.0.' || (doc_id % 250) ELSE 'unknown' END AS client FROM documents""",
)
def request_guard_status(spark, d):
    """Method, body and question in order."""
    body = F.to_json(F.struct(F.col("text").alias("question")))
    method = F.when(F.col("doc_id") % 11 == 0, "GET").otherwise("POST")
    forwarded = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.0.0."), (F.col("doc_id") % 250).cast("string"), F.lit(", 10.9.9.9")))
    rows = table(spark, d, "documents").select("doc_id", method.alias("method"), request_body(body).alias("body"), forwarded.alias("forwarded"))
    status = R.guard(F.col("method"), True, F.col("body"), F.col("body.question"), F.lit(False))
    return rows.select("doc_id", status.alias("status"), X.client_ip("forwarded", F.lit(None).cast("string")).alias("client"))


@query(
    "donor_type_filter",
    f"SELECT contribution_type, count(*) AS n FROM contributions WHERE lower({strip_sql('contribution_type')}) IN {DONOR_TYPES} GROUP BY 1",
)
def donor_type_filter(spark, d):
    """F1."""
    rows = table(spark, d, "contributions").where(F.lower(X.strip("contribution_type")).isin(*DONOR_TYPES))
    return rows.groupBy("contribution_type").agg(F.count("*").alias("n"))


@query(
    "scope_gate",
    """SELECT event_id, CASE WHEN event_id % 5 IN (2, 4) THEN 502 ELSE 200 END AS status,
        CASE event_id % 5 WHEN 0 THEN 'Answer ' || json_extract_string(props, '$.k') WHEN 1 THEN 'Declined' WHEN 3 THEN 'Declined' END AS answer,
        CASE WHEN event_id % 5 = 0 THEN least(event_id % 12, 8) ELSE 0 END::BIGINT AS citations FROM events""",
)
def scope_gate(spark, d):
    """Replies marked in scope, not in scope, broken, of another shape, empty."""
    n, k = F.col("event_id") % 5, F.get_json_object("props", "$.k")
    reply = (
        F.when(n == 0, F.concat(F.lit('```json\n{"in_scope": true, "answer": " Answer '), k, F.lit('"}\n```')))
        .when(n == 1, F.lit('{"in_scope": false, "answer": "never shown"}'))
        .when(n == 2, F.lit("no json"))
        .when(n == 3, F.lit('{"in_scope": "true", "answer": "x"}'))
        .otherwise(F.lit('{"in_scope": true, "answer": "  "}'))
    )
    links = F.when(F.col("event_id") % 12 > 0, F.array_repeat(F.lit("https://www.example.org/a"), (F.col("event_id") % 12).cast("int")))
    out = table(spark, d, "events").select("event_id", R.outcome(reply, links, F.lit("Declined")).alias("o"))
    return out.select("event_id", "o.status", "o.answer", F.size("o.citations").cast("bigint").alias("citations"))


@query(
    "question_context",
    """SELECT official_id, 'Subject: ' || name || ', the ' || office || CASE WHEN party_affiliation IS NULL THEN '' ELSE ' (' || party_affiliation || ')' END || ' representing '
        || CASE WHEN office ILIKE '%mayor%' THEN 'the City of Riverside' ELSE office END AS told FROM officials""",
)
def question_context(spark, d):
    """P35."""
    told = R.prompt(F.col("name"), F.col("office"), F.col("party_affiliation"), "Riverside")
    return table(spark, d, "officials").select("official_id", F.regexp_replace(told, r"\. Use public.*", "").alias("told"))


@query(
    "refresh_due",
    """SELECT event_id, isodow(l) = 1 AND day(l) <= 7 AS due FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS l FROM events)""",
)
def refresh_due(spark, d):
    """T-8."""
    return table(spark, d, "events").select("event_id", V.refresh_due(F.col("ts").cast("timestamp"), "America/Chicago").alias("due"))


_ITEM_PROBLEMS = """SELECT o_custkey::VARCHAR AS official_id, rule, count(*) AS problems FROM (
    SELECT o_custkey, unnest(list_filter([CASE WHEN o_orderkey % 4 = 3 THEN 'record_id' END, CASE WHEN o_orderkey % 5 = 0 THEN 'date' END,
        CASE WHEN o_orderkey % 4 < 2 THEN 'url' END], lambda x: x IS NOT NULL)) AS rule FROM orders) GROUP BY ALL"""


@query("item_problems", _ITEM_PROBLEMS)
def item_problems(spark, d):
    """V4 on record items: bad numbers, days that are none, pages outside the allowed hosts."""
    owners = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("official_id"))
    rows = _items(spark, d).withColumn("date", F.when(F.col("o_orderkey") % 5 == 0, F.lit("2024-02-30")).otherwise(F.col("date")))
    rows = enrich_items(rows, ROOT, TODAY, "1").join(owners, "o_orderkey")
    found = Q.problems(rows, "record", Q.item_rules(["filings.example"]))
    return found.groupBy("official_id", "rule").agg(F.count("*").alias("problems"))


@query(
    "term_items",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0""",
)
def passed_in_term(spark, d):
    """The passed items of the current term."""
    term = F.when(F.col("o_orderkey") % 2 == 0, "current").otherwise("past")
    rows = _items(spark, d).withColumns({"term": term, "pos": F.col("o_orderkey")})
    return term_items(rows, "current", "passed").select("o_orderkey", "date")


@query(
    "item_provenance",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN '{ROOT}' || ({_RECORD_ID}) END AS page, coalesce(CASE WHEN o_orderkey % 4 < 2 THEN '{ROOT}' || ({_RECORD_ID}) END, 'https://clerk.example/') AS source_url,
        'Records' AS source_name, '{TODAY}' AS retrieved_at, '1' AS methodology_version, strftime(o_orderdate, '%Y-%m-%d') AS meeting_date FROM orders""",
)
def item_provenance(spark, d):
    """The source of every item, its page or else the records as a whole."""
    made = enrich_items(_items(spark, d), ROOT, TODAY, "1")
    parts = ("source_url", "source_name", "retrieved_at", "methodology_version", "meeting_date")
    return made.select("o_orderkey", F.col("source_url").alias("page"), *[F.col(f"provenance.{p}").alias(p) for p in parts])


@query(
    "amount_types",
    "SELECT o_orderkey, true AS decimal_valid, true AS integer_valid, false AS text_valid, false AS boolean_valid, false AS null_valid FROM orders",
)
def amount_types(spark, d):
    """A number is valid, what only looks like one is not."""
    total = F.col("o_totalprice")
    given = {"decimal": total.cast("decimal(18,2)"), "integer": F.col("o_orderkey"), "text": total.cast("string"), "boolean": total > 0, "null": F.lit(None).cast("double")}
    return table(spark, d, "orders").select("o_orderkey", *[V.is_valid_amount(c).alias(f"{name}_valid") for name, c in given.items()])
