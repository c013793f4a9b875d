"""Paged HTTP JSON service as a Spark data source, with retries and a landed copy."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from civictally.session import ship

# Defaults of the service's client.
PAGE, TIMEOUT, TRIES, LONGEST_WAIT = 5000, 30, 3, 10


def fetch_json(url: str, token: str | None = None, timeout: float = TIMEOUT, tries: int = TRIES, sleep=time.sleep) -> list[dict]:
    """GET with up to ``tries`` attempts and waits of 2, 4, 8 ... at most LONGEST_WAIT seconds."""
    headers = {"X-App-Token": token} if token else {}
    for attempt in range(1, tries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                return json.load(r)
        except OSError:
            if attempt == tries:
                raise
            sleep(min(2**attempt, LONGEST_WAIT))
    return []


class Pages(InputPartition):
    def __init__(self, first: int, step: int):
        super().__init__(first)
        self.first, self.step = first, step


class PagedReader(DataSourceReader):
    """``numPartitions`` tasks take every n-th page each, until a short page."""

    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.url = options["url"]
        self.page = int(options.get("pagesize", PAGE))
        self.tasks = int(options.get("numpartitions", 1))
        self.where, self.order = options.get("where"), options.get("order", ":id")
        self.token = options.get("token")
        self.timeout, self.tries = float(options.get("timeout", TIMEOUT)), int(options.get("tries", TRIES))

    def partitions(self) -> list[Pages]:
        return [Pages(i, self.tasks) for i in range(self.tasks)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        at = partition.first
        while True:
            # a stable order makes pages disjoint whatever the server does
            query = {"$limit": self.page, "$offset": at * self.page, "$order": self.order}
            if self.where:
                query["$where"] = self.where
            rows = fetch_json(f"{self.url}?{urllib.parse.urlencode(query)}", self.token, self.timeout, self.tries)
            for row in rows:
                values = (row.get(n) for n in self.names)
                yield tuple(v if v is None or isinstance(v, str) else json.dumps(v) for v in values)
            if len(rows) < self.page:
                return
            at += partition.step


class PagedSource(DataSource):
    """Format ``paged_json``; options url, pageSize, numPartitions, where, order, token, timeout, tries."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def _landed(spark: SparkSession, schema: StructType, landed: str) -> DataFrame:
    """The landed copy; where a run ended while it was replaced, the one put aside."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(landed).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lost = not fs.exists(path(landed)) and fs.exists(path(f"{landed}.before"))
    return spark.read.schema(schema).parquet(f"{landed}.before" if lost else landed)


def read_paged(spark: SparkSession, url: str, schema: StructType, landed: str | None = None, landed_only: bool = False, **options) -> DataFrame:
    """Rows of the service, all columns as text.

    S5: with ``landed`` the rows are written there and read back, so later runs of a plan see
    the same pages; if the service fails, the last landed copy serves. ``landed_only`` never calls
    the service and fails if there is no copy.
    """
    if landed_only:
        return _landed(spark, schema, landed)
    ship(spark)
    spark.dataSource.register(PagedSource)
    live = spark.read.format("paged_json").schema(schema).options(url=url, **options).load()
    if not landed:
        return live
    try:
        live.write.mode("overwrite").parquet(f"{landed}.next")
    except PySparkException:
        return _landed(spark, schema, landed)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(landed).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # the earlier copy is put aside until the new one is in its place
    aside = path(f"{landed}.before")
    fs.delete(aside, True)
    if fs.exists(path(landed)):
        fs.rename(path(landed), aside)
    fs.rename(path(f"{landed}.next"), path(landed))
    fs.delete(aside, True)
    return spark.read.schema(schema).parquet(landed)
