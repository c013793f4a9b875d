"""Donor roll-up: contributions to officials, links to filings, ranked donors, re-election."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civictally.functions.text import blank_to_null, clean_field, strip
from civictally.functions.values import MONEY, donor_type, latest_year
from civictally.operators.joins import dimension_join, numbered
from civictally.session import cut

# Contribution types that name a donor's gift.
DONOR_TYPES = ("monetary contributions (itemized)", "non-monetary contributions (itemized)")


def match_key(x: Column | str) -> Column:
    """Lower case without surrounding white space; null if blank."""
    return F.lower(blank_to_null(x))


def committee_lookup(committees: DataFrame, name: str, official: str, order: str) -> DataFrame:
    """A3: one official a committee name, the last entry wins: ``committee_key``, ``official_id``."""
    keyed = committees.select(match_key(name).alias("committee_key"), F.col(official).alias("official_id"), F.col(order).alias("o"))
    return keyed.where("committee_key is not null").groupBy("committee_key").agg(F.max_by("official_id", "o").alias("official_id"))


def attach_officials(contributions: DataFrame, lookup: DataFrame) -> DataFrame:
    """Contributions of registered committees with their official."""
    return dimension_join(contributions.withColumn("committee_key", match_key("committee_name")), lookup, "committee_key", "inner")


def filing_links(statements: DataFrame, order: str) -> DataFrame:
    """A2: one link for each committee and period, the first one wins; blank parts give none."""
    rows = statements.select(
        blank_to_null("cmt_id").alias("committee_id"),
        F.col("period_from_date").alias("period_beg_date"),
        F.col("period_to_date").alias("period_end_date"),
        blank_to_null("stmt_link").alias("link"),
        F.col(order).alias("o"),
    ).dropna()
    return rows.groupBy("committee_id", "period_beg_date", "period_end_date").agg(F.min_by("link", "o").alias("source_url"))


def attach_filings(contributions: DataFrame, links: DataFrame) -> DataFrame:
    """Contributions with the link of their filing, null if there is none."""
    keyed = contributions.withColumn("committee_id", blank_to_null("committee_id"))
    return dimension_join(keyed, links, ["committee_id", "period_beg_date", "period_end_date"], "left")


def donor_gifts(rows: DataFrame) -> DataFrame:
    """itemized gifts with a name and an amount; ``donor`` is the stripped name."""
    kept = rows.where(F.lower(strip("contribution_type")).isin(*DONOR_TYPES))
    kept = kept.withColumn("donor", blank_to_null("contributor")).withColumn("amount", F.col("contribution_amount").cast(MONEY))
    return kept.where("donor is not null and amount is not null")


def donor_rollup(gifts: DataFrame, order: str, n: int | None = 30) -> DataFrame:
    """Donors of each official with totals, ranked; ties in the order they first appear.

    ``gifts``: official_id, donor, amount, contrib_occupation, contrib_employer and ``order``.
    Sums combine on the map side; a donor or an official with a third of all gifts
    sends one row per task, and the rank filter prunes before its shuffle. The gifts themselves are
    not collected: see donor_contributions.
    """
    employer = clean_field("contrib_employer")
    work = F.coalesce(employer, clean_field("contrib_occupation")).isNotNull()
    donors = gifts.groupBy("official_id", "donor").agg(
        F.sum("amount").cast(MONEY).alias("total"),
        F.count("*").alias("gifts"),
        F.min_by(employer, F.when(employer.isNotNull(), F.col(order))).alias("employer"),
        F.bool_or(work).alias("has_work"),
        F.max("contribution_date").alias("latest_date"),
        F.min(order).alias("first_seen"),
    )
    donors = donors.withColumn("donor_type", donor_type("donor", F.col("has_work"))).drop("has_work")
    rank = F.row_number().over(W.partitionBy("official_id").orderBy(F.col("total").desc(), F.col("first_seen").asc()))
    ranked = donors.withColumn("donor_rank", rank)
    return ranked if n is None else ranked.where(F.col("donor_rank") <= n)


def donor_contributions(gifts: DataFrame, donors: DataFrame, order: str, source: DataFrame | None = None) -> DataFrame:
    """O1: gifts of the kept donors with their place by date (undated first, then as given).
    ``source``: the contributions that the gifts come from, in which hot donors are looked for."""
    # a few donors an official, made once: a hot one stays where its gifts are
    ranked = cut(donors.select("official_id", "donor", "donor_rank"))
    kept = dimension_join(gifts, ranked, ["official_id", "donor"], "inner")
    return numbered(kept, ["official_id", "donor"], [F.col("contribution_date").asc_nulls_first(), F.col(order).asc()], "place", blank_to_null("contributor"), source)


def nest_donors(donors: DataFrame, contributions: DataFrame) -> DataFrame:
    """The published shape: one row an official, donors in rank order with their contributions."""
    c = F.struct("place", "contribution_date", "amount", "source_url")
    lists = contributions.groupBy("official_id", "donor").agg(F.array_sort(F.collect_list(c)).alias("contributions"))
    d = donors.join(lists, ["official_id", "donor"], "left")
    entry = F.struct("donor_rank", F.col("donor").alias("name"), F.col("donor_type").alias("type"), "total", "employer", "contributions")
    return d.groupBy("official_id").agg(F.array_sort(F.collect_list(entry)).alias("donors"))


def source_gap(rows: DataFrame) -> DataFrame:
    """officials none of whose rows names an occupation or employer at all."""
    gap = F.bool_and(F.col("contrib_occupation").isNull() & F.col("contrib_employer").isNull())
    return rows.groupBy("official_id").agg(gap.alias("gap")).where("gap").select("official_id")


def reelection(rows: DataFrame, committees: DataFrame, as_of: str, results: DataFrame | None = None) -> DataFrame:
    """A4: latest election of each official over all its rows; without one the latest year
    in its committee names decides whether the campaign is active. ``committees`` has official_id,
    committee_name and an order ``ord``; ``results`` official_id and election_result."""
    dates = rows.groupBy("official_id").agg(F.max("election_date").alias("election_date"))
    own = committees.groupBy("official_id").agg(
        F.max(latest_year("committee_name")).alias("year"), F.min_by("committee_name", "ord").alias("committee")
    )
    out = own.join(dates, "official_id", "left")
    today = F.lit(as_of).cast("date")
    active = F.coalesce(F.col("election_date") >= today, F.col("year") >= F.year(today), F.lit(False))
    out = out.select("official_id", "election_date", "committee", active.alias("active"))
    if results is None:
        return out.withColumn("result", F.lit(None).cast("string"))
    out = out.join(results.select("official_id", "election_result"), "official_id", "left")
    return out.withColumn("result", F.when(~F.col("active"), F.col("election_result"))).drop("election_result")


# What is said of a held election.
RESULT_LABELS = {"won": "Won re-election", "lost": "Lost re-election", "runoff": "Advanced to a runoff"}


def banner(election_date: Column, active: Column, result: Column, as_of: str) -> Column:
    """F11, T-6: status at reading time; the date overrules the stored flag."""
    held = F.coalesce(election_date < F.lit(as_of).cast("date"), F.lit(False))
    said = F.lit("Election already held")
    for code, label in RESULT_LABELS.items():
        said = F.when(result == code, label).otherwise(said)
    return (
        F.when(active & ~held, "Running for re-election")
        .when(held, said)
        .otherwise("Not currently in an active re-election campaign")
    )
