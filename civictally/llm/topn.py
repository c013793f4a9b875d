"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, score: str, order: list[Column], n: int) -> DataFrame:
    """The ``n`` leading rows of every group by ``score`` descending, then ``order``.

    A row_number window with a rank filter: the optimiser puts a group limit before
    the shuffle, so of a group with millions of rows at most ``n`` leave each
    task, and another after it. No group is collected anywhere.

    Rows with a null score are no items; a null group is a group of its own. Text
    compares by bytes, nulls first in an ascending order. ``order`` must end with a
    unique column to make ties the same on every run; rows equal in all of it are
    kept in any order. Smaller groups give all their rows, an empty table none. The
    result has the input's columns; a column named like the rank is not touched.
    """
    rank = "rank__"
    while rank in df.columns:
        rank += "_"
    w = W.partitionBy(group).orderBy(F.col(score).desc(), *order)
    return df.where(F.col(score).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).drop(rank)
