"""Public-action records and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civictally.functions.text import blank_to_null
from civictally.functions.values import record_url


def provenance(
    source_name: Column,
    source_url: Column,
    retrieved_at: Column,
    methodology: str,
    period: tuple[Column, Column] | None = None,
    meeting_date: Column | None = None,
    record_id: Column | None = None,
) -> Column:
    """Where a fact comes from, as one struct; parts that do not apply are null."""
    null = F.lit(None).cast("string")
    begins, ends = period or (null, null)
    return F.struct(
        source_name.alias("source_name"),
        source_url.alias("source_url"),
        retrieved_at.alias("retrieved_at"),
        F.when(F.lit(period is not None), F.struct(begins.alias("from"), ends.alias("to"))).alias("reporting_period"),
        (meeting_date if meeting_date is not None else null).alias("meeting_date"),
        (record_id if record_id is not None else null).alias("record_id"),
        F.lit(methodology).alias("methodology_version"),
    )


def enrich_contributions(gifts: DataFrame, name: str, url: str | None, retrieved_at: str, methodology: str) -> DataFrame:
    """Each gift with the provenance of its filing; ``source_url`` comes from attach_filings,
    ``url`` stands for it where a gift has none (None: nothing does)."""
    return gifts.withColumn(
        "provenance",
        provenance(
            F.lit(name),
            F.coalesce("source_url", F.lit(url)),
            F.lit(retrieved_at),
            methodology,
            (F.col("period_beg_date").cast("string"), F.col("period_end_date").cast("string")),
            record_id=blank_to_null("committee_id"),
        ),
    )


def enrich_items(items: DataFrame, root: str, retrieved_at: str, methodology: str) -> DataFrame:
    """Record items with their page and provenance. ``items`` has council_file and date,
    and source_name and source_url of the official's records as a whole."""
    page = record_url("council_file", root)
    made = provenance(
        F.col("source_name"), F.coalesce(page, F.col("source_url")), F.lit(retrieved_at), methodology, meeting_date=F.col("date"), record_id=F.col("council_file")
    )
    return items.withColumns({"provenance": made, "source_url": page})


def record_filter(kind: str) -> Column:
    """all, proposed, passed or voted."""
    return {
        "all": F.lit(True),
        "proposed": F.col("role") == "proposed",
        "passed": F.col("outcome") == "passed",
        "voted": F.startswith("role", F.lit("voted_")),
    }[kind]


def term_items(items: DataFrame, term: str, kind: str = "all") -> DataFrame:
    """Items of a term under a filter, newest first, ties as listed."""
    return items.where((F.col("term") == term) & record_filter(kind)).orderBy(F.col("date").desc(), F.col("pos").asc())
