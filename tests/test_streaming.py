"""The streaming limiter gives what the batch one gives."""

import random

from pyspark.sql import functions as F

from civictally.operators.limits import rate_limit
from civictally.streaming.limits import land_requests, rate_limit_stream

FIELDS = "id bigint, k string, s bigint"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(((i, rng.choice("abc"), rng.randrange(2000)) for i in range(400)), key=lambda r: r[2])
    for n in range(4):
        part = spark.createDataFrame(rows[n * 100 : (n + 1) * 100], FIELDS).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    limited = rate_limit_stream(stream.withColumn("ts", F.timestamp_seconds("s")), "k", "ts", "id", 3, 60, late="2000 seconds")
    query = land_requests(limited, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True)
    query.awaitTermination(120)
    got = {r.request_id: (r.hits, r.limited) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame(rows, FIELDS).withColumn("ts", F.timestamp_seconds("s"))
    assert got == {r.order: (r.hits, r.limited) for r in rate_limit(batch, F.col("k"), "ts", "id", 3, 60).collect()}
