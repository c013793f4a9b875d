"""References to records that do not exist, direct and inherited."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civictally.functions.text import strip
from civictally.operators.joins import BROADCAST_ROWS, dimension_join
from civictally.operators.quality import union_all
from civictally.session import cut


@dataclass(frozen=True)
class Table:
    """A table of the foreign-key graph. ``key`` is its row's id; ``ref_key`` what
    others refer to (default: the same); ``at`` when a row came in; ``loaded`` and
    ``deleted`` bound its existence as a target; ``period`` its reporting date."""

    df: DataFrame
    key: str
    ref_key: str | None = None
    at: str | None = None
    loaded: str | None = None
    deleted: str | None = None
    period: str | None = None


@dataclass(frozen=True)
class Reference:
    """``child.column`` refers to ``parent``. ``extract`` makes the reference from the
    column (default: stripped text), ``normalise`` is applied to both sides."""

    child: str
    column: str
    parent: str
    extract: object = field(default=strip)
    normalise: object = field(default=lambda c: c)

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}"


def _targets(t: Table, ref: Reference) -> DataFrame:
    """One row per referable key. Of several rows the earliest load counts, and the
    key is deleted only if all of them are, at the last deletion."""
    none = F.lit(None).cast("timestamp")
    rows = t.df.select(
        ref.normalise(strip(F.col(t.ref_key or t.key).cast("string"))).alias("k"),
        (F.col(t.loaded) if t.loaded else none).alias("loaded"),
        (F.col(t.deleted) if t.deleted else none).alias("deleted"),
    ).where("k is not null and k <> ''")
    return rows.groupBy("k").agg(
        # a row without a load time was always there
        F.when(F.count("*") == F.count("loaded"), F.min("loaded")).alias("loaded"),
        F.when(F.count("*") == F.count("deleted"), F.max("deleted")).alias("deleted"),
        F.lit(True).alias("there"),
    )


def _links(t: Table, ref: Reference) -> DataFrame:
    month = F.coalesce(F.date_format(F.col(t.period), "yyyy-MM"), F.lit("none")) if t.period else F.lit("none")
    at = F.col(t.at) if t.at else F.lit(None).cast("timestamp")
    return t.df.select(
        F.col(t.key).cast("string").alias("row_key"),
        ref.normalise(ref.extract(F.col(ref.column).cast("string"))).alias("k"),
        at.alias("at"),
        month.alias("period_month"),
    ).where("k is not null and k <> ''")


def orphan_cascade(tables: dict[str, Table], references: list[Reference], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Orphan references of a foreign-key graph.

    Columns: ``source_field`` (table.column), ``row_key`` (string), ``period_month``
    (yyyy-MM or none), ``reason`` (missing, deleted, late; for inherited ones the word
    inherited), ``kind`` (direct or inherited) and ``depth`` (0 for direct ones, else the round
    that found it: the number of references between it and a direct one).

    All orphans are rows of one relation that is iterated. Its first round holds the direct
    ones: references whose target had no valid row as the child came in: no such key, else deleted at
    or before that moment, else loaded after it. Each further round semi-joins the valid
    references with the keys of the rows that the round before orphaned, down the
    foreign-key graph, until no round gains a row; so chains and cycles of any length end. A
    reference is reported once, direct before inherited, at its least depth.

    Null or blank keys are no references. A null arrival time is neither before a
    deletion nor before a load. Rows with a null id are reported with a null
    ``row_key``. Repeated rows are reported as often as they come. Empty tables give no
    targets and no links. Columns not named are not read.

    Target tables are broadcast only when counted to be small; else a hot target key is
    broadcast by itself and the rest is shuffled. Every round is written to the shared folder;
    between rounds only the keys of newly orphaned parent rows are kept.
    """
    parents = {r.parent for r in references}

    def judged(r: Reference) -> DataFrame:
        reason = (
            F.when(F.col("there").isNull(), "missing")
            .when(F.col("deleted") <= F.col("at"), "deleted")
            .when(F.col("loaded") > F.col("at"), "late")
        )
        links = dimension_join(_links(tables[r.child], r), _targets(tables[r.parent], r), "k", "left", max_rows)
        return links.select(F.lit(r.name).alias("source_field"), "row_key", "period_month", reason.alias("reason"), "k")

    def rows_of(relation: DataFrame, child: str) -> DataFrame:
        """The rows of a table that a round orphaned; a null id names none."""
        return relation.where(F.col("source_field").isin(*[r.name for r in references if r.child == child])).select("row_key").dropna().distinct()

    def ref_keys(r: Reference, rows: DataFrame) -> DataFrame:
        """The keys by which others refer to the rows ``rows`` of the parent of a reference."""
        t = tables[r.parent]
        ids = t.df.select(F.col(t.key).cast("string").alias("row_key"), r.normalise(strip(F.col(t.ref_key or t.key).cast("string"))).alias("k"))
        return ids.join(rows, "row_key", "left_semi").select("k").where("k is not null").distinct()

    links = {r.name: judged(r) for r in references}
    shape = ("source_field", "row_key", "period_month", "reason", "kind", "depth")
    direct = union_all([links[r.name].where("reason is not null") for r in references])
    rounds = [cut(direct.select(*shape[:4], F.lit("direct").alias("kind"), F.lit(0).alias("depth")))]
    # rows orphaned so far, by table that has children, and keys already handed down, by reference
    found, told = {}, {}
    frontier = {p: rows_of(rounds[0], p) for p in parents if any(r.child == p for r in references)}
    while frontier:
        gained = []
        for r in references:
            if r.parent not in frontier:
                continue
            keys = ref_keys(r, frontier[r.parent])
            keys = cut(keys.join(told[r.name], "k", "left_anti") if r.name in told else keys)
            if not keys.isEmpty():
                told[r.name] = cut(told[r.name].union(keys)) if r.name in told else keys
                gained.append(dimension_join(links[r.name].where("reason is null"), keys, "k", "left_semi", max_rows))
        if not gained:
            break
        inherited = [F.lit("inherited").alias("reason"), F.lit("inherited").alias("kind"), F.lit(len(rounds)).alias("depth")]
        rounds.append(cut(union_all(gained).select(*shape[:3], *inherited)))
        for p in frontier:
            found[p] = cut(found[p].union(frontier[p])) if p in found else frontier[p]
        frontier = {}
        for p in parents:
            rows = rows_of(rounds[-1], p) if any(r.child == p for r in references) else None
            if rows is not None:
                rows = cut(rows.join(found[p], "row_key", "left_anti") if p in found else rows)
                if not rows.isEmpty():
                    frontier[p] = rows
    return union_all(rounds)
