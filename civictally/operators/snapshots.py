"""What changed between full snapshots: signed key-field-value cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictally.operators.joins import hot_of, key_counts

PRESENCE = -1


def snapshot_changes(df: DataFrame, snapshot: str, key: str, fields: list[str]) -> DataFrame:
    """Records that appeared, vanished or differ between consecutive snapshots.

    Every distinct row becomes one cell per field plus a marker that its key is
    present. A cell counts +1 in the pair of deliveries that its snapshot ends
    and -1 in the pair that it begins; cells whose signs do not cancel are
    differences. A surviving marker tells added from removed; without one the
    record changed.

    Columns: ``snapshot_no`` (the later one), ``record_id`` (named as the input's
    columns), ``change_kind`` (added, removed, changed), ``changed_fields`` (names
    in the given order; empty for added and removed).

    Null equals null and differs from any value. Rows delivered twice count once; two
    different rows of one key in one snapshot are both kept as its set of values.
    Rows without a snapshot or without a key belong to no delivery or record and
    are left out. The first snapshot and an empty table give nothing. Other columns
    are not read.

    One shuffle drops repeated rows (combined on the map side first), one places
    the distinct rows by key; all later groupings reuse that placement. Keys that hold
    more than a thousandth of all rows are grouped by cell instead.
    """
    rows = df.select(
        F.col(snapshot).alias("s"), F.col(key).alias("k"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]
    ).where("s is not null and k is not null")
    # one scan tells the deliveries, a short list by nature, and the keys with a large share of all rows
    seen = rows.agg(F.array_sort(F.collect_set("s")).alias("deliveries"), *key_counts()).first()
    numbers = seen.deliveries
    pairs = [(s, s if i else None, numbers[i + 1] if i + 1 < len(numbers) else None) for i, s in enumerate(numbers)]
    kind = rows.schema["s"].dataType
    following = df.sparkSession.createDataFrame(pairs, T.StructType([T.StructField(n, kind) for n in ("s", "ends", "begins")]))
    paired = rows.distinct().join(F.broadcast(following), "s")
    # a record with a large share of all rows is not brought to one task: its cells are spread by value
    hot = hot_of(seen.top, seen.rows)
    if not hot:
        return _differences(paired.repartition("k"), snapshot, key, fields)
    others = _differences(paired.where(~F.col("k").isin(hot)).repartition("k"), snapshot, key, fields)
    return others.unionByName(_differences(paired.where(F.col("k").isin(hot)), snapshot, key, fields))


def _differences(paired: DataFrame, snapshot: str, key: str, fields: list[str]) -> DataFrame:
    """Cells that do not cancel, by record and pair of deliveries."""
    cells = paired.select(
        "k",
        F.explode(
            F.array(
                F.struct(F.col("ends").alias("pair"), F.lit(1).alias("sign")),
                F.struct(F.col("begins").alias("pair"), F.lit(-1).alias("sign")),
            )
        ).alias("p"),
        F.array(
            F.struct(F.lit(PRESENCE).alias("field"), F.lit(None).cast("string").alias("value")),
            *[F.struct(F.lit(i).alias("field"), F.col(f"f{i}").alias("value")) for i in range(len(fields))],
        ).alias("cells"),
    ).where("p.pair is not null")
    cells = cells.select("k", "p.pair", "p.sign", F.inline("cells"))
    # sets of cells on each side: a value delivered in two rows of one key counts once
    signed = cells.groupBy("k", "pair", "field", "value").agg(
        (F.max(F.greatest("sign", F.lit(0))) - F.max(F.greatest(-F.col("sign"), F.lit(0)))).alias("net")
    )
    left = signed.where("net <> 0").groupBy("k", "pair").agg(
        F.max(F.when(F.col("field") == PRESENCE, F.col("net"))).alias("marker"),
        F.array_sort(F.collect_set(F.when(F.col("field") >= 0, F.col("field")))).alias("ids"),
    )
    names = F.array(*[F.lit(f) for f in fields])
    kind = F.when(F.col("marker") == 1, "added").when(F.col("marker") == -1, "removed").otherwise("changed")
    return left.select(
        F.col("pair").alias(snapshot),
        F.col("k").alias(key),
        kind.alias("change_kind"),
        F.when(F.col("marker").isNull(), F.transform("ids", lambda i: F.element_at(names, i + 1)))
        .otherwise(F.array().cast("array<string>"))
        .alias("changed_fields"),
    )
