"""Limits that depend on what was admitted before: fixed windows and cool-down (T-1, T-2, T-4, T-5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictally.session import ship

# The limiter's defaults, and the client's pause in seconds.
MAX_REQUESTS, WINDOW_SECONDS, COOLDOWN_SECONDS = 5, 600, 8


def setting(value, default: int) -> int:
    """T-4: a positive number, else the default."""
    try:
        n = int(float(value))
    except (TypeError, ValueError, OverflowError):
        return default
    return n if n > 0 else default


def fixed_window(times: np.ndarray, start: int | None, count: int, window: int, inclusive: bool = False):
    """Number of each hit in its window, and the window left open. ``times`` ascend, in
    microseconds. A window begins with the hit that is more than ``window`` (or, with
    ``inclusive``, as much as that) after the start of the last one."""
    out = np.empty(len(times), np.int64)
    at = 0
    side = "left" if inclusive else "right"
    while at < len(times):
        if start is None:
            start, count = int(times[at]), 0
        end = at + int(np.searchsorted(times[at:], start + window, side))
        out[at:end] = np.arange(count + 1, count + 1 + end - at)
        count += end - at
        at = end
        if at < len(times):
            start = None
    return out, start, count


def _by_key(df: DataFrame, key: Column, ts: str, order: str, fold, result: T.StructField) -> DataFrame:
    """Rows in time order within each key, folded in one pass with a state of one key at a
    time. Nothing is collected: a key's rows stream through the task that has them."""
    ship(df.sparkSession)
    rows = df.select(key.cast("string").alias("key"), F.col(order).alias("order"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    rows = rows.where("us is not null").repartition("key").sortWithinPartitions("key", "us", "order")
    schema = T.StructType([rows.schema["key"], rows.schema["order"], result])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).dictionary_encode()
            codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            us = b.column(2).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(codes)) + 1, len(codes))
            out, at = [], 0
            for end in cuts:
                name = keys[at].as_py()
                if not begun or name != last:
                    last, state, begun = name, None, True
                values, state = fold(us[at:end], state)
                out.append(values)
                at = int(end)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(out))], schema.names)

    return rows.mapInArrow(run, schema)


def rate_limit(df: DataFrame, key: Column, ts: str, order: str, most: int = MAX_REQUESTS, window_seconds: float = WINDOW_SECONDS, inclusive: bool = False) -> DataFrame:
    """T-1 (and T-2 with ``inclusive``): ``key``, ``order``, ``hits`` (place within the window) and
    ``limited``. Refused hits count too. Rows without a time are no hits; null keys are one key."""
    span = int(window_seconds * 1_000_000)

    def fold(us, state):
        start, count = state or (None, 0)
        out, start, count = fixed_window(us, start, count, span, inclusive)
        return out, (start, count)

    out = _by_key(df, key, ts, order, fold, T.StructField("hits", T.LongType()))
    return out.withColumn("limited", F.col("hits") > most)


def cooldown(df: DataFrame, key: Column, ts: str, order: str, seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """T-5: ``key``, ``order``, ``accepted``: whether at least ``seconds`` passed since the last
    accepted one; refused attempts do not move the clock."""
    span = int(seconds * 1_000_000)

    def fold(us, last):
        out = np.zeros(len(us), bool)
        at = 0 if last is None else int(np.searchsorted(us, last + span))
        while at < len(us):
            out[at] = True
            last = int(us[at])
            at = max(at + 1, int(np.searchsorted(us, last + span)))
        return out, last

    return _by_key(df, key, ts, order, fold, T.StructField("accepted", T.BooleanType()))
