"""Queries of the general data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from civictally.functions.text import strip
from civictally.operators.references import Reference, Table, orphan_cascade
from civictally.operators.snapshots import snapshot_changes
from civictally.operators.structural import EXPORT_COLUMNS, parse_records
from civictally.plans.registry import query, table

SNAPSHOT_FIELDS = ["contribution_amount", "contribution_date", "committee_id"]

_CHANGES_SQL = """
    WITH n AS (SELECT s, lag(s) OVER (ORDER BY s) AS p FROM (SELECT DISTINCT snapshot_no AS s FROM contribution_snapshots WHERE snapshot_no IS NOT NULL)),
    v AS (SELECT snapshot_no AS s, record_id AS k, list_sort(list(DISTINCT coalesce(contribution_amount::VARCHAR, '~'))) AS a,
                 list_sort(list(DISTINCT coalesce(contribution_date::VARCHAR, '~'))) AS b, list_sort(list(DISTINCT coalesce(committee_id, '~'))) AS c
          FROM contribution_snapshots WHERE record_id IS NOT NULL AND snapshot_no IS NOT NULL GROUP BY 1, 2),
    q AS (SELECT coalesce(x.s, y.s) AS snapshot_no, coalesce(x.k, y.k) AS record_id,
                 CASE WHEN y.k IS NULL THEN 'added' WHEN x.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
                 x.a IS DISTINCT FROM y.a AS da, x.b IS DISTINCT FROM y.b AS db, x.c IS DISTINCT FROM y.c AS dc
          FROM (SELECT v.* FROM v JOIN n USING (s) WHERE n.p IS NOT NULL) x
          FULL JOIN (SELECT n.s, k, a, b, c FROM v JOIN n ON v.s = n.p) y ON x.s = y.s AND x.k = y.k)
"""


def _changes(spark, d):
    return snapshot_changes(table(spark, d, "contribution_snapshots"), "snapshot_no", "record_id", SNAPSHOT_FIELDS)


@query("p2_found", _CHANGES_SQL + "SELECT snapshot_no, record_id, change_kind FROM q WHERE da OR db OR dc")
def p2_found(spark, d):
    return _changes(spark, d).select("snapshot_no", "record_id", "change_kind")


@query(
    "p2_changed_fields",
    _CHANGES_SQL
    + """SELECT snapshot_no, change_kind, f AS changed_field, count(*) AS records FROM (
        SELECT snapshot_no, change_kind, unnest(CASE WHEN change_kind <> 'changed' THEN [NULL]
            ELSE list_filter([CASE WHEN da THEN 'contribution_amount' END, CASE WHEN db THEN 'contribution_date' END,
                 CASE WHEN dc THEN 'committee_id' END], lambda x: x IS NOT NULL) END) AS f FROM q WHERE da OR db OR dc) GROUP BY 1, 2, 3""",
)
def p2_changed_fields(spark, d):
    """Records by snapshot, kind of change and field."""
    rows = _changes(spark, d).select("snapshot_no", "change_kind", F.explode_outer("changed_fields").alias("changed_field"))
    return rows.groupBy("snapshot_no", "change_kind", "changed_field").agg(F.count("*").alias("records"))


def document_number(x):
    """The number given as document_id in a link, without leading zeros; null without one."""
    digits = F.regexp_extract(x, r"(?i)document_id\s*=\s*(\d+)", 1)
    return F.when(digits != "", _no_zeros(digits))


def _no_zeros(x):
    return F.regexp_replace(x, r"^0+(?=\d)", "")


REFERENCES = [
    Reference("contributions", "committee_id", "committees"),
    Reference("statements_filed", "cmt_id", "committees"),
    Reference("statements_filed", "stmt_link", "filing_documents", document_number, _no_zeros),
    Reference("committees", "official_id", "officials"),
    Reference("funding", "official_id", "officials"),
]


def _graph(spark, d):
    return {
        "contributions": Table(table(spark, d, "contributions"), "row_id", at="received_at", period="period_beg_date"),
        "statements_filed": Table(table(spark, d, "statements_filed"), "stmt_id", at="filed_at", period="period_from_date"),
        "committees": Table(table(spark, d, "committees"), "cmt_id", at="loaded_at", loaded="loaded_at", deleted="deleted_at"),
        "filing_documents": Table(table(spark, d, "filing_documents"), "document_id", loaded="loaded_at", deleted="deleted_at"),
        "officials": Table(table(spark, d, "officials"), "official_id"),
        "funding": Table(table(spark, d, "funding"), "funding_id", period="retrieved_at"),
    }


_ORPHANS_SQL = r"""
    WITH refs AS (
        SELECT 'contributions.committee_id' AS source_field, row_id AS row_key, trim(committee_id) AS k, received_at AS came, period_beg_date AS p FROM contributions
        UNION ALL SELECT 'statements_filed.cmt_id', stmt_id, trim(cmt_id), filed_at, period_from_date FROM statements_filed
        UNION ALL SELECT 'statements_filed.stmt_link', stmt_id, ltrim(nullif(regexp_extract(stmt_link, '(?i)document_id\s*=\s*(\d+)', 1), ''), '0'),
                  filed_at, period_from_date FROM statements_filed),
    targets AS (SELECT 'c' AS t, trim(cmt_id) AS k, loaded_at, deleted_at FROM committees
        UNION ALL SELECT 'd', document_id::VARCHAR, loaded_at, deleted_at FROM filing_documents),
    j AS (SELECT source_field, row_key, coalesce(strftime(p, '%Y-%m'), 'none') AS period_month,
            CASE WHEN t.k IS NULL THEN 'missing' WHEN deleted_at <= came THEN 'deleted' WHEN loaded_at > came THEN 'late' END AS reason
          FROM refs r LEFT JOIN targets t ON r.k = t.k AND t.t = CASE WHEN source_field LIKE '%link' THEN 'd' ELSE 'c' END
          WHERE r.k <> '')
"""


@query("p4_found", _ORPHANS_SQL + "SELECT source_field, row_key, period_month, reason FROM j WHERE reason IS NOT NULL")
def p4_found(spark, d):
    """The rows of the cascade's relation that its first round found, of the three references asked for."""
    found = orphan_cascade(_graph(spark, d), REFERENCES).where("kind = 'direct'")
    found = found.where(F.col("source_field").isin(*[r.name for r in REFERENCES[:3]]))
    return found.select("source_field", F.col("row_key").cast("bigint").alias("row_key"), "period_month", "reason")


@query(
    "p4_report",
    _ORPHANS_SQL
    + """, bad AS (SELECT cmt_id FROM committees c WHERE trim(official_id) <> '' AND NOT EXISTS (SELECT 1 FROM officials o WHERE trim(o.official_id) = trim(c.official_id))),
    links AS (SELECT 'contributions.committee_id' AS source_field, row_id AS row_key, trim(committee_id) AS k, period_beg_date AS p FROM contributions
        UNION ALL SELECT 'statements_filed.cmt_id', stmt_id, trim(cmt_id), period_from_date FROM statements_filed),
    everything AS (SELECT source_field, period_month, reason, 'direct' AS kind FROM j WHERE reason IS NOT NULL
        UNION ALL SELECT 'committees.official_id', 'none', 'missing', 'direct' FROM bad
        UNION ALL SELECT 'funding.official_id', coalesce(strftime(retrieved_at, '%Y-%m'), 'none'), 'missing', 'direct' FROM funding f
            WHERE trim(official_id) <> '' AND NOT EXISTS (SELECT 1 FROM officials o WHERE trim(o.official_id) = trim(f.official_id))
        UNION ALL SELECT l.source_field, coalesce(strftime(l.p, '%Y-%m'), 'none'), 'inherited', 'inherited' FROM links l JOIN bad b ON l.k = trim(b.cmt_id)
            WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.source_field = l.source_field AND j.row_key = l.row_key AND reason IS NOT NULL))
    SELECT source_field, period_month, reason, kind, count(*) AS orphans FROM everything GROUP BY ALL""",
)
def p4_report(spark, d):
    """Orphans of the whole graph by table, period, reason and kind."""
    found = orphan_cascade(_graph(spark, d), REFERENCES)
    return found.groupBy("source_field", "period_month", "reason", "kind").agg(F.count("*").alias("orphans"))


#: A chain of four references below the regions.
CHAIN = [
    Reference("nation", "n_regionkey", "region"),
    Reference("customer", "c_nationkey", "nation"),
    Reference("supplier", "s_nationkey", "nation"),
    Reference("orders", "o_custkey", "customer"),
    Reference("lineitem", "l_orderkey", "orders"),
]


@query(
    "p4_cascade",
    """
    WITH RECURSIVE edges AS (
        SELECT 'nation.n_regionkey' AS source_field, 'nation' AS child, n_nationkey AS id, 'region' AS parent, n_regionkey AS ref FROM nation
        UNION ALL SELECT 'customer.c_nationkey', 'customer', c_custkey, 'nation', c_nationkey FROM customer
        UNION ALL SELECT 'supplier.s_nationkey', 'supplier', s_suppkey, 'nation', s_nationkey FROM supplier
        UNION ALL SELECT 'orders.o_custkey', 'orders', o_orderkey, 'customer', o_custkey FROM orders
        UNION ALL SELECT 'lineitem.l_orderkey', 'lineitem', l_orderkey, 'orders', l_orderkey FROM lineitem),
    there AS (SELECT 'region' AS t, r_regionkey AS id FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT 'nation', n_nationkey FROM nation
        UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'orders', o_orderkey FROM orders),
    direct AS (SELECT e.* FROM edges e LEFT JOIN there p ON p.t = e.parent AND p.id = e.ref WHERE p.id IS NULL AND e.ref IS NOT NULL),
    lost AS (SELECT child, id, 0 AS depth FROM direct
        UNION SELECT e.child, e.id, l.depth + 1 FROM lost l JOIN edges e ON e.parent = l.child AND e.ref = l.id),
    least AS (SELECT child, id, min(depth) AS depth FROM lost GROUP BY ALL),
    found AS (SELECT source_field, 'missing' AS reason, 'direct' AS kind, 0 AS depth FROM direct
        UNION ALL SELECT e.source_field, 'inherited', 'inherited', l.depth + 1 FROM edges e JOIN least l ON e.parent = l.child AND e.ref = l.id)
    SELECT source_field, reason, kind, depth, count(*) AS orphans FROM found GROUP BY ALL
    """,
)
def p4_cascade(spark, d):
    """What hangs on a withdrawn region: its nations directly, their customers and suppliers, orders and lines by inheritance."""
    keys = {"nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    tables = {name: Table(table(spark, d, name), key) for name, key in keys.items()}
    tables["region"] = Table(table(spark, d, "region").where("r_name <> 'ASIA'"), "r_regionkey")
    found = orphan_cascade(tables, CHAIN)
    return found.groupBy("source_field", "reason", "kind", "depth").agg(F.count("*").alias("orphans"))


def _records(spark, d):
    return parse_records(table(spark, d, "contribution_lines"), "raw_line", "line_id", ["file_name", "line_no"])


_TRIMMED = r"regexp_replace(f[{}], '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"
_DAY = r"""CASE WHEN regexp_full_match({0}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN year(try_strptime({0}, '%m/%d/%Y'))
    WHEN regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}(T00:00:00(\.000)?)?') THEN year(try_strptime(left({0}, 10), '%Y-%m-%d')) END"""
_RECORDS_SQL = rf"""
    WITH l AS (SELECT line_id, file_name, regexp_replace(coalesce(raw_line, ''), '\r\z', '') AS line FROM contribution_lines),
    s AS (SELECT line_id, file_name, regexp_full_match(line, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS quoted,
        list_transform(regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM l),
    t AS (SELECT *, {_TRIMMED.format(9)} AS amount, {_TRIMMED.format(1)} AS day, {_TRIMMED.format(7)} AS period FROM s),
    r AS (SELECT line_id, file_name, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 11 THEN 'column_count'
        WHEN NOT regexp_full_match(amount, '-?\$?(\d+|\d{{1,3}}(,\d{{3}})+)(\.\d{{1,2}})?') THEN 'bad_amount'
        WHEN NOT coalesce(({_DAY.format("day")}) BETWEEN 1900 AND 2099, false) THEN 'bad_date'
        WHEN NOT coalesce(({_DAY.format("period")}) BETWEEN 1900 AND 2099, false) THEN 'bad_period' END AS reason FROM t)
"""


@query("p5_found", _RECORDS_SQL + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL")
def p5_found(spark, d):
    return _records(spark, d).where("reason is not null").select("source.line_id", "reason")


_DATE = r"""CASE WHEN regexp_full_match({0}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN try_strptime({0}, '%m/%d/%Y')::DATE
    WHEN regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}(T00:00:00(\.000)?)?') THEN try_strptime(left({0}, 10), '%Y-%m-%d')::DATE END"""
_LOADED = {0: _DATE, 6: _DATE, 7: _DATE, 10: _DATE, 8: "regexp_replace({0}, '[$,]', '', 'g')::DOUBLE"}


@query(
    "p5_loaded",
    _RECORDS_SQL
    + "SELECT line_id, "
    + ", ".join((_LOADED[i].format(_TRIMMED.format(i + 1)) if i in _LOADED else f"f[{i + 1}]") + f" AS {c}" for i, c in enumerate(EXPORT_COLUMNS))
    + " FROM t JOIN r USING (line_id) WHERE reason IS NULL",
)
def p5_loaded(spark, d):
    """The valid records as typed rows, amounts as doubles."""
    held = F.col("record.contribution_amount").cast("double")
    amount = F.coalesce(held, F.col("amount_text").cast("double")).alias("contribution_amount")
    columns = [amount if c == "contribution_amount" else F.col(f"record.{c}") for c in EXPORT_COLUMNS]
    return _records(spark, d).where("reason is null").select("source.line_id", *columns)


@query("p5_report", _RECORDS_SQL + "SELECT file_name, coalesce(reason, 'valid') AS outcome, count(*) AS records FROM r GROUP BY 1, 2")
def p5_report(spark, d):
    """Records read and rejected by file and reason."""
    return _records(spark, d).groupBy("source.file_name", F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("records"))
