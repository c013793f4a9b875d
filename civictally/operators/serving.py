"""Profile queries: filters, sorts, summaries, shares and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civictally.functions.values import format_money

# Sort keys of the donor table and their first direction.
SORT_DEFAULTS = {"name": "asc", "type": "asc", "employer": "asc", "count": "desc", "latest": "desc", "total": "desc"}
KNOWN_TYPES = ("individual", "pac", "business")


def sort_key(key: str) -> Column:
    """O3: what a donor is sorted by; an unknown key means the total."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return {
        "name": low(F.col("donor")),
        "type": low(F.col("donor_type")),
        "employer": low(F.col("employer")),
        "count": F.col("gifts"),
        "latest": F.coalesce(F.col("latest_date").cast("string"), F.lit("")),
    }.get(key, F.col("total"))


def next_sort(key: str, direction: str, chosen: str) -> tuple[str, str]:
    """The same column turns round, another one takes its first direction."""
    if chosen == key:
        return key, "asc" if direction == "desc" else "desc"
    return chosen, SORT_DEFAULTS.get(chosen, "desc")


def sorted_donors(donors: DataFrame, key: str, direction: str, donor_kind: str = "all") -> DataFrame:
    """Donors of each official in table order, ties by rank in both directions, with
    their ``place``. The given donors are the ranked ones, a bounded number each."""
    kept = donors if donor_kind == "all" else donors.where(F.col("donor_type") == donor_kind)
    k = sort_key(key)
    order = W.partitionBy("official_id").orderBy(k.asc() if direction == "asc" else k.desc(), F.col("donor_rank").asc())
    return kept.withColumn("place", F.row_number().over(order))


def every_order(donors: DataFrame) -> DataFrame:
    """The place of each donor in every order of the table: ``sort_key``, ``direction``, ``place``.

    One pass over the ranked donors, a bounded number for each official: their keys are exploded, and places are
    given within an official and key by a text that sorts as the key does, numbers filled with zeros."""
    # money to the cent and counts as numbers of one width; those below zero are counted from the other end
    far = F.lit(10**18).cast("decimal(20,0)")
    digits = lambda c: F.lpad((c.cast("decimal(18,2)") * 100 + far).cast("decimal(20,0)").cast("string"), 20, "0")
    values = [F.struct(F.lit(k).alias("sort_key"), (digits(sort_key(k)) if k in ("count", "total") else sort_key(k)).alias("value")) for k in SORT_DEFAULTS]
    rows = donors.select("official_id", "donor_rank", F.explode(F.array(*values)).alias("s")).select("official_id", "donor_rank", "s.*")
    places = []
    for direction in ("asc", "desc"):
        value = F.col("value").asc() if direction == "asc" else F.col("value").desc()
        places.append(F.struct(F.lit(direction).alias("direction"), F.row_number().over(W.partitionBy("official_id", "sort_key").orderBy(value, "donor_rank")).alias("place")))
    return rows.select("official_id", "donor_rank", "sort_key", F.array(*places).alias("p")).select("official_id", "donor_rank", "sort_key", F.explode("p").alias("p")).select(
        "sort_key", "p.direction", "official_id", "donor_rank", "p.place"
    )


def type_histogram(donors: DataFrame, known: tuple[str, ...] = KNOWN_TYPES) -> DataFrame:
    """A10: donors by type for each official, known types also with none, and all together."""
    counted = donors.groupBy("official_id", "donor_type").agg(F.count("*").alias("donors"))
    ids = counted.select("official_id").distinct()
    grid = ids.select("official_id", F.explode(F.array(*[F.lit(t) for t in known])).alias("donor_type"))
    filled = counted.unionByName(grid.withColumn("donors", F.lit(0).cast("bigint"))).groupBy("official_id", "donor_type").agg(F.sum("donors").alias("donors"))
    total = counted.groupBy("official_id").agg(F.sum("donors").alias("donors")).withColumn("donor_type", F.lit("all"))
    return filled.unionByName(total)


def filtered_summary(donors: DataFrame, donor_kind: str) -> DataFrame:
    """Shown donors and their sum, of all donors."""
    shown = F.col("donor_type") == donor_kind if donor_kind != "all" else F.lit(True)
    return donors.groupBy("official_id").agg(
        F.count_if(shown).alias("shown"),
        F.count("*").alias("donors"),
        F.coalesce(F.sum(F.when(shown, F.col("total"))), F.lit(0)).cast("decimal(18,2)").alias("shown_total"),
    )


def summary_text(label: Column) -> Column:
    """A12 as it is shown; ``label`` names the type, null for all. The whole count is that of all donors."""
    kind = F.coalesce(F.concat(F.lit(" "), label), F.lit(""))
    noun = F.when(F.col("donors") == 1, " donor").otherwise(" donors")
    return F.concat(F.lit("Showing "), F.col("shown").cast("string"), F.lit(" of "), F.col("donors").cast("string"), kind, noun, F.lit(" · "), format_money("shown_total"))


def markers(officials: DataFrame, summary: DataFrame) -> DataFrame:
    """What a map shows of each official; without readable funding the sums are null, not zero."""
    number = F.regexp_extract("office", r"(\d+)", 1)
    place = F.when(F.col("office").rlike("(?i)mayor"), "Mayor").when(number != "", F.concat(F.lit("District "), number)).otherwise(F.col("office"))
    rows = officials.join(summary, "official_id", "left")
    return rows.select("official_id", place.alias("place"), F.coalesce("name", place).alias("title"), "total", "donors", "top_donor")


def funding_summary(donors: DataFrame) -> DataFrame:
    """Sum and number of donors, and the first of the largest."""
    return donors.groupBy("official_id").agg(
        F.sum("total").cast("decimal(18,2)").alias("total"),
        F.count("*").alias("donors"),
        F.min_by("donor", F.struct(-F.col("total"), F.col("donor_rank"))).alias("top_donor"),
    )


def reporting_period(contributions: DataFrame) -> DataFrame:
    """First and last day of the contributions of donors with a positive total."""
    return contributions.where("total > 0").groupBy("official_id").agg(
        F.min("contribution_date").alias("period_from"), F.max("contribution_date").alias("period_to")
    )


def first_linked(contributions: DataFrame) -> DataFrame:
    """The earliest contribution with a link, by donor."""
    linked = contributions.where("source_url is not null")
    return linked.groupBy("official_id", "donor").agg(F.min_by("source_url", "place").alias("source_url"))


def shares(donors: DataFrame) -> DataFrame:
    """Each positive donor's percentage of what is shown, at least a cent each."""
    size = F.greatest(F.col("total"), F.lit("0.01").cast("decimal(18,2)"))
    whole = F.sum(size).over(W.partitionBy("official_id"))
    return donors.where("total > 0").withColumn("share", (size.cast("double") / whole.cast("double")) * 100)


def with_default(rows: DataFrame, other: DataFrame, on: str, column: str, default: str) -> DataFrame:
    """A looked-up text or a default; of several matches the first by text."""
    one = other.groupBy(on).agg(F.min(column).alias(column))
    return rows.join(one, on, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def place_lookup(officials: DataFrame, districts: DataFrame, citywide: DataFrame) -> DataFrame:
    """The place of each official, citywide before district. Both have official_id and place."""
    both = citywide.withColumn("first", F.lit(0)).unionByName(districts.withColumn("first", F.lit(1)))
    one = both.groupBy("official_id").agg(F.min_by("place", F.struct("first", "place")).alias("place"))
    return officials.join(one, "official_id", "left")


def bounding_box(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """A16."""
    return points.agg(F.min(lat).alias("south"), F.min(lon).alias("west"), F.max(lat).alias("north"), F.max(lon).alias("east"))


def first_k(rows: DataFrame, group: str, order: list[Column], value: str, k: int = 8) -> DataFrame:
    """The first ``k`` values of each group in order, without gathering the rest."""
    n = F.row_number().over(W.partitionBy(group).orderBy(*order))
    kept = rows.withColumn("n", n).where(F.col("n") <= k)
    return kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("n", value))).alias("v")).select(group, F.transform("v", lambda x: x[value]).alias("first_values"))
