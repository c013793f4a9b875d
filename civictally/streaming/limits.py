"""Request limits over a stream: the batch fold with its state kept by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from civictally.operators.limits import MAX_REQUESTS, WINDOW_SECONDS, fixed_window
from civictally.session import ship


def rate_limit_stream(requests: DataFrame, key: str, ts: str, request_id: str, most: int = MAX_REQUESTS, window_seconds: float = WINDOW_SECONDS, late: str = "1 minute") -> DataFrame:
    """T-1 on a stream: ``key``, ``request_id`` (bigint), ``hits`` and ``limited`` in append mode.

    The state of a key is the start and the count of its open window. It is dropped when the
    watermark passes the window's end, so state is bounded by the keys of the last window. Requests
    later than ``late`` may have lost their window and begin a new one; within a micro-batch
    they are put in time order. Null keys are one key; rows without a time are left out.
    """
    ship(requests.sparkSession)
    span = int(window_seconds * 1_000_000)

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        # one key's requests of one micro-batch; the trigger bounds them
        rows = pd.concat(list(frames)).sort_values(["us", "request_id"])
        hits, start, count = fixed_window(rows["us"].to_numpy(), start, count, span)
        state.update((start, count))
        state.setTimeoutTimestamp(max(start + span, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)
        yield pd.DataFrame({"key": keys[0], "request_id": rows["request_id"].to_numpy(), "hits": hits, "limited": np.asarray(hits) > most})

    rows = requests.where(F.col(ts).isNotNull()).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(request_id).cast("bigint").alias("request_id"), F.col(ts).cast("timestamp").alias("at")
    )
    rows = rows.withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(
        fold, "key string, request_id bigint, hits bigint, limited boolean", "start bigint, count bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def land_requests(requests: DataFrame, path: str, checkpoint: str, **trigger):
    """Append a stream of limited requests to a table; exactly once by its checkpoint."""
    return requests.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start(path)
