"""Typed readers of the exported files and configuration documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictally.sources import schemas
from civictally.sources.records import read_csv


def read_contributions(spark: SparkSession, path: str | list[str], order: str = "seq") -> DataFrame:
    """An export with header, byte-order mark and quoting; names in lower snake case, all columns as text.
    Records that are no rows are left out: see ``rejected_contributions``."""
    return _contributions(spark, path, order)[0]


def rejected_contributions(spark: SparkSession, path: str | list[str], order: str = "seq") -> DataFrame:
    """The records of an export that cannot be read: their place, text and the reason."""
    return _contributions(spark, path, order)[1]


def _contributions(spark: SparkSession, path: str | list[str], order: str) -> tuple[DataFrame, DataFrame]:
    return read_csv(spark, path, tuple(h.lower().replace(" ", "_") for h in schemas.CONTRIBUTION_HEADERS), order)


def read_statements(spark: SparkSession, path: str, order: str = "seq") -> DataFrame:
    """Filings; a missing file is an empty table."""
    try:
        return read_csv(spark, path, schemas.STATEMENT_COLUMNS, order)[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        fields = schemas.strings(*schemas.STATEMENT_COLUMNS).fields
        return spark.createDataFrame([], T.StructType([*fields, T.StructField(order, T.LongType())]))


def from_service(rows: DataFrame) -> DataFrame:
    """Rows of the paged service under the export's names; it gives no occupation or employer."""
    named = [F.col(api).alias(name) for name, api in schemas.SERVICE_FIELDS.items()]
    return rows.select(*named, F.lit(None).cast("string").alias("contrib_occupation"), F.lit(None).cast("string").alias("contrib_employer"))


def link_text(x: Column) -> Column:
    """A link given as text or as an object with a url."""
    return F.coalesce(F.when(x.rlike(r"^\s*\{"), F.get_json_object(x, "$.url")), F.when(~x.rlike(r"^\s*\{"), x))


def read_officials(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array; ``ord`` is the place in it."""
    return spark.read.schema(schemas.OFFICIALS).option("multiLine", True).json(path).withColumn("ord", F.monotonically_increasing_id())


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row an official of the registry, in the order of its keys."""
    df = spark.read.schema(schemas.REGISTRY).option("multiLine", True).json(path)
    return df.select(F.posexplode("officials").alias("ord", "official_id", "entry")).select(
        "ord", "official_id", F.col("entry.funding").alias("funding"), F.col("entry.record").alias("record")
    )


def registry_committees(registry: DataFrame) -> DataFrame:
    """Registered committee names in order: ``official_id``, ``committee_name``, ``ord``."""
    rows = registry.select("official_id", "ord", F.posexplode("funding.committees").alias("at", "committee_name"))
    return rows.select("official_id", "committee_name", F.struct("ord", "at").alias("ord"))


def read_record_items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Items of record files with their place; a file without items gives none."""
    df = spark.read.schema(schemas.RECORD_FILE).option("multiLine", True).json(paths)
    items = df.select("official_id", F.col("_metadata.file_path").alias("path"), F.posexplode("items").alias("pos", "item"))
    return items.select("official_id", "path", "pos", "item.*")


def read_published(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All published documents of one kind in one scan, with the official's folder
    as ``folder``; a missing document is a missing row, to be left-joined."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern)
    return df.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def request_body(x: Column) -> Column:
    """A request's body; null if it is no JSON object."""
    return F.when(x.rlike(r"^\s*\{"), F.from_json(x, schemas.REQUEST))
