"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civictally.llm.canonical import map_to_canonical
from civictally.llm.formatting import formatting_duplicates
from civictally.llm.leakage import find_leaks
from civictally.llm.mixture import mix_sources
from civictally.llm.spans import shared_spans
from civictally.llm.topn import top_n
from civictally.llm.variants import name_variants, variant_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(
    "p1_found",
    """
    SELECT official_id, funding_id FROM (
        SELECT official_id, funding_id,
               row_number() OVER (PARTITION BY official_id ORDER BY total DESC, name ASC NULLS FIRST, funding_id ASC) AS r
        FROM funding WHERE total IS NOT NULL) WHERE r <= 10
    """,
)
def p1_found(spark, d):
    rows = table(spark, d, "funding").select("official_id", "funding_id", "name", "total")
    return top_n(rows, "official_id", "total", [F.col("name").asc(), F.col("funding_id").asc()], 10).select(
        "official_id", "funding_id"
    )


COPY_FIELDS = [
    "contribution_date", "contrib_occupation", "contrib_employer", "committee_id", "period_beg_date", "period_end_date",
    "contribution_amount", "contribution_type", "election_date",
]

WORDS_SQL = (
    "list_sort(list_filter(string_split_regex(regexp_replace(lower({0}), '[.''‘’ʼ]', '', 'g'), "
    "'[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda w: w <> ''))"
)
_COPIES_SQL = f"""
    WITH n AS (SELECT row_id, {WORDS_SQL.format("contributor")} AS a, {WORDS_SQL.format("committee_name")} AS b, {", ".join(COPY_FIELDS)}
               FROM contributions WHERE row_id IS NOT NULL),
    g AS (SELECT row_id, min(row_id) OVER w AS first_id, count(*) OVER w AS copies FROM n
          WINDOW w AS (PARTITION BY a, b, {", ".join(COPY_FIELDS)}))
"""


def _copies(spark, d):
    return formatting_duplicates(table(spark, d, "contributions"), "row_id", ["contributor", "committee_name"], COPY_FIELDS)


@query("p7_found", _COPIES_SQL + "SELECT first_id AS first_row_id, row_id AS copy_row_id FROM g WHERE row_id > first_id")
def p7_found(spark, d):
    found = _copies(spark, d).where("copy_id > first_id")
    return found.select(F.col("first_id").alias("first_row_id"), F.col("copy_id").alias("copy_row_id"))


@query("p7_copies", _COPIES_SQL + "SELECT first_id AS row_id, copies FROM g WHERE row_id = first_id AND copies > 1")
def p7_copies(spark, d):
    """One row per repeated record with its number of copies."""
    return _copies(spark, d).where("copy_id = first_id").select(F.col("first_id").alias("row_id"), "copies")


def _grams_sql(table: str, key: str, words: str, width: int) -> str:
    """Every run of ``width`` words of each text of a table."""
    return f"""SELECT {key}, i, array_to_string(w[i:i + {width - 1}], ' ') AS gram FROM (
        SELECT {key}, w, unnest(range(1, len(w) - {width - 2})) AS i FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL) WHERE len(w) >= {width})"""


_LETTERS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_SPACED = r"list_filter(string_split_regex(text, '[\s\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+'), lambda x: x <> '')"


@query(
    "p8_found",
    f"""SELECT DISTINCT d.doc_id, e.item_id FROM ({_grams_sql("documents", "doc_id", _LETTERS, 13)}) d
        JOIN ({_grams_sql("eval_items", "item_id", _LETTERS, 13)}) e USING (gram)""",
)
def p8_found(spark, d):
    return p8_leaks(spark, d).where("longest_run >= 13").select("doc_id", "item_id")


@query("p8_leaks")
def p8_leaks(spark, d):
    """Leaked passages, exact or edited, with the quality of their alignment.

    An edited copy is not found where its longest common run is under 13 words and its
    alignment under half of the item's score, or where it holds none of the seeds looked up (the
    rarest of each eight words), which all its common runs being under eight words allows."""
    found = find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return found.where("longest_run >= 13 or item_share >= 0.5")


@query(
    "p10_found",
    f"""WITH g AS ({_grams_sql("documents", "doc_id", _SPACED, 60)}), r AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1)
    SELECT doc_id, count(*) AS shared_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 60)) AS place FROM g JOIN r USING (gram)) GROUP BY doc_id""",
)
def p10_found(spark, d):
    return shared_spans(table(spark, d, "documents"), "doc_id", "text", 60)


@query("p3_found")
def p3_found(spark, d):
    gifts, funding = table(spark, d, "contributions"), table(spark, d, "funding")
    return map_to_canonical(
        [
            ("contributions.contrib_employer", gifts, "row_id", "contrib_employer", "employer"),
            ("contributions.contrib_occupation", gifts, "row_id", "contrib_occupation", "occupation"),
            ("funding.employer", funding, "funding_id", "employer", "employer"),
        ],
        table(spark, d, "reference_values"),
    )


@query("p6_found")
def p6_found(spark, d):
    donors = name_variants(
        [
            ("contributions", table(spark, d, "contributions"), "committee_id", "row_id", "contributor"),
            ("funding", table(spark, d, "funding"), "official_id", "funding_id", "name"),
        ]
    )
    return variant_pairs(donors)


def _mixed(spark, d):
    return mix_sources(table(spark, d, "documents"), "source", "text", table(spark, d, "mix_targets"))


@query("p9_mixture")
def p9_mixture(spark, d):
    """The combined texts as blocks of tokens."""
    return _mixed(spark, d)[0]


@query("p9_shares")
def p9_shares(spark, d):
    """The share that each source reached."""
    return _mixed(spark, d)[1]


@query(
    "p9_limits",
    """SELECT source, true AS within_limit, true AS used_if_wanted, true AS sums_to_one FROM
        (SELECT source, sum(target_share) AS share FROM mix_targets WHERE source IS NOT NULL GROUP BY source)""",
)
def p9_limits(spark, d):
    """What the report must keep: no text beyond its limit, nothing used of a source without texts or share, shares that sum to 1."""
    report = _mixed(spark, d)[1]
    within = (F.col("tokens_used") <= F.col("tokens_available") * F.col("max_repeats")) & (F.col("most_uses") <= F.col("max_repeats"))
    wanted = ((F.col("tokens_used") == 0) | ((F.col("tokens_available") > 0) & (F.col("target_share") > 0))).alias("used_if_wanted")
    sums = (F.abs(F.sum("share_reached").over(W.partitionBy(F.lit(1))) - 1) < 1e-9).alias("sums_to_one")
    # one row a source
    checked = report.select("source", "target_share", within.alias("within_limit"), wanted, sums)
    return checked.where("target_share is not null").drop("target_share")
