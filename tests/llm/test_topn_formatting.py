"""Top N and formatting duplicates on hand-made rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from civictally.llm.formatting import formatting_duplicates, words
from civictally.llm.topn import top_n

SCHEMA = "g string, score decimal(18,2), name string, id bigint, rank__ int"


def test_top_n(spark):
    rows = [("a", 5, "b", 1, 0), ("a", 5, "B", 2, 0), ("a", 5, None, 3, 0), ("a", None, "z", 4, 0), ("a", 9, "é", 5, 0), ("a", 5, "b", 6, 0), (None, 1, "x", 7, 0), ("b", 1, "x", 8, 0), ("b", 1, "x", 8, 0)]
    df = spark.createDataFrame([(g, None if s is None else Decimal(s), n, i, r) for g, s, n, i, r in rows], SCHEMA)
    got = top_n(df, "g", "score", [F.col("name").asc(), F.col("id").asc()], 3)
    assert got.columns == df.columns
    assert sorted((r.g or "", r.id) for r in got.collect()) == [("", 7), ("a", 2), ("a", 3), ("a", 5), ("b", 8), ("b", 8)]
    assert top_n(df.where("false"), "g", "score", [F.col("id").asc()], 3).count() == 0


def test_group_limit_is_planned(spark):
    df = spark.createDataFrame([("a", 1, 1)], "g string, score int, id int")
    plan = top_n(df, "g", "score", [F.col("id").asc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_words(spark):
    given = [" Smith,\tJohn Q. ", "O'Brien-Lee", "ÉLAN élan", "...", "", None]
    df = spark.createDataFrame(list(enumerate(given)), "i int, x string")
    got = [r.w for r in df.select("i", words("x").alias("w")).orderBy("i").collect()]
    assert got == [["smith", "john", "q"], ["obrien", "lee"], ["élan", "élan"], [], [], None]


COPY = "id bigint, a string, b string, amount decimal(18,2), digest string, copies int"


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_duplicates(spark, max_rows):
    one = Decimal(1)
    rows = [
        (1, "Smith, John", "Cmte One", one, "d", 1), (2, "john smith", "ONE cmte", one, "e", 2), (3, "John  Smith.", "Cmte One", Decimal(2), "", 3),
        (4, "John Smith John", "Cmte One", one, "", 4), (5, None, "Cmte", None, "", 5), (6, None, "cmte", None, "", 6), (7, "", "cmte", None, "", 7),
        (8, "...", "Cmte", None, "", 8), (None, "john smith", "One Cmte", one, "", 9), (9, "x", None, None, "", 0), (9, "x", None, None, "", 0),
        (10, "long " * 5000, "q", one, "", 0), (11, "LONG, " * 5000, "q", one, "", 0), (12, "Jöhn Smith", "Cmte One", one, "", 1),
    ]
    df = spark.createDataFrame(rows, COPY)
    got = formatting_duplicates(df, "id", ["a", "b"], ["amount"], max_rows).collect()
    assert sorted((r.first_id, r.copy_id, r.copies) for r in got) == [
        (1, 1, 2), (1, 2, 2), (5, 5, 2), (5, 6, 2), (7, 7, 2), (7, 8, 2), (9, 9, 2), (9, 9, 2), (10, 10, 2), (10, 11, 2),
    ]
    assert formatting_duplicates(df.where("false"), "id", ["a", "b"], ["amount"], max_rows).count() == 0


@pytest.mark.parametrize("max_rows", [0, 100_000])
def test_hot_record(spark, max_rows):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("Hot, Name")).otherwise(F.concat(F.lit("n"), "id")).alias("a"))
    got = formatting_duplicates(df, "id", ["a"], [], max_rows)
    assert got.count() == 2000 and got.where("first_id = 0 and copies = 2000").count() == 2000


def test_nested_and_binary_columns(spark):
    df = spark.createDataFrame([(1, "a b", [1, 2], b"x"), (2, "b a", [1, 2], b"x"), (3, "b a", [12], b"x")], "id int, a string, n array<int>, z binary")
    got = formatting_duplicates(df, "id", ["a"], ["n", "z"]).where("copy_id > first_id").collect()
    assert [(r.first_id, r.copy_id) for r in got] == [(1, 2)]


def test_trees_of_any_depth(spark):
    kind = "id int, a string, n struct<x:array<string>, m:map<string,struct<p:int,q:array<int>>>>, u array<string>, extra string"
    one, two = (1, [1, 2]), (None, [])
    rows = [
        (1, "B, a", (["k", "l"], {"s": one, "t": two}), ["Jo Lee", "Al"], "x"), (2, "a b", (["k", "l"], {"t": two, "s": one}), ["AL", "lee, jo"], "y"),
        (3, "a b", (["l", "k"], {"s": one, "t": two}), ["Al", "Jo Lee"], "x"), (4, "a b", (["k", "l"], {"s": (1, [2, 1]), "t": two}), ["Al", "Jo Lee"], "x"),
        (5, "a b", (["k", "l"], {"s": one, "t": (None, None)}), ["Al", "Jo Lee"], "x"), (6, "a b", (["k", "l"], {"s": one, "t": two}), ["Al Jo", "Lee"], "x"),
        (7, None, None, None, "x"), (8, None, None, None, "z"), (9, None, (None, None), None, "x"), (10, None, None, [None], "x"), (11, None, None, [], "x"),
    ]
    got = formatting_duplicates(spark.createDataFrame(rows, kind), "id", ["a", "u"], ["n"]).where("copy_id > first_id").collect()
    assert sorted((r.first_id, r.copy_id) for r in got) == [(1, 2), (7, 8)]


def test_hot_digest_stays_where_it_is(spark):
    """With the broadcast switch at 0 the rows of a record with a third of all rows are not shuffled by digest."""
    df = spark.range(0, 30_000, 1, 6).select("id", F.when(F.col("id") % 3 == 0, F.lit("Hot, Name")).otherwise(F.concat(F.lit("n"), F.col("id") % 5000)).alias("a"))
    got = formatting_duplicates(df, "id", ["a"], [], 0)
    hot = got.where("first_id = 0")
    sizes = [r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
    assert got.count() == 30_000 and sum(sizes) == 10_000 and max(sizes) <= 2 * 10_000 / 6
