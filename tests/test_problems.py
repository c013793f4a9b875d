"""Snapshot changes, orphan references and record parsing on hand-made and random rows."""

import datetime as dt
import random

import pytest

from civictally.operators.references import Reference, Table, orphan_cascade
from civictally.operators.snapshots import snapshot_changes
from civictally.operators.structural import EXPORT_COLUMNS, parse_records

SNAPSHOT = "snapshot_no int, record_id bigint, contribution_amount decimal(18,2), committee_id string, change_kind string"


def changes(spark, rows):
    df = spark.createDataFrame(rows, SNAPSHOT)
    got = snapshot_changes(df, "snapshot_no", "record_id", ["contribution_amount", "committee_id"]).collect()
    return {(r.snapshot_no, r.record_id): (r.change_kind, tuple(r.changed_fields)) for r in got}


def test_snapshots(spark):
    from decimal import Decimal as N

    rows = [
        (1, 1, N(5), "a", "x"), (1, 2, N(5), "a", "x"), (1, 3, None, None, "x"), (1, 4, N(1), "a", "x"), (1, 4, N(1), "a", "y"),
        (3, 1, N(6), "a", "x"), (3, 3, None, None, "z"), (3, 4, N(1), None, "x"), (3, 5, N(1), "b", "x"), (3, 5, N(1), "b", "x"),
        (9, 1, N(6), "a", "x"), (9, 3, N(0), None, "x"), (9, 4, N(1), None, "x"), (9, None, N(1), None, "x"), (None, 7, N(1), "a", "x"),
    ]
    assert changes(spark, rows) == {
        (3, 1): ("changed", ("contribution_amount",)),
        (3, 2): ("removed", ()),
        (3, 4): ("changed", ("committee_id",)),
        (3, 5): ("added", ()),
        (9, 3): ("changed", ("contribution_amount",)),
        (9, 5): ("removed", ()),
    }
    assert changes(spark, []) == {}
    assert changes(spark, rows[:4]) == {}


def test_snapshot_with_two_versions_of_a_record(spark):
    from decimal import Decimal as N

    rows = [(1, 1, N(5), "a", ""), (1, 1, N(6), "a", ""), (2, 1, N(5), "a", ""), (3, 1, N(5), "a", "")]
    assert changes(spark, rows) == {(2, 1): ("changed", ("contribution_amount",))}


def test_snapshots_with_a_hot_record(spark, monkeypatch):
    monkeypatch.setattr("civictally.operators.joins.HOT_ROWS", 0)
    from decimal import Decimal as N

    rows = [(s, 1, N(i), "a", "") for s in (1, 2) for i in range(s, 300 + s)] + [(s, i, N(i), "a", "") for s in (1, 2) for i in range(2, 300)]
    assert changes(spark, rows) == {(2, 1): ("changed", ("contribution_amount",))}


T = dt.datetime


def graph(spark, gifts, committees, officials):
    return {
        "gifts": Table(spark.createDataFrame(gifts, "row_id bigint, committee_id string, at timestamp, kind string, k string"), "row_id", at="at"),
        "committees": Table(
            spark.createDataFrame(committees, "cmt_id string, official_id string, loaded_at timestamp, deleted_at timestamp, k int"), "cmt_id", at="loaded_at", loaded="loaded_at", deleted="deleted_at"
        ),
        "officials": Table(spark.createDataFrame(officials, "official_id string"), "official_id"),
    }


REFS = [Reference("gifts", "committee_id", "committees"), Reference("committees", "official_id", "officials")]


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_orphans(spark, max_rows):
    day = [T(2024, 1, d) for d in range(1, 10)]
    committees = [("c1", "o1", day[2], None, 1), ("c2", "gone", day[0], None, 1), ("c3", "o1", day[0], day[4], 1), ("c4", None, None, None, 1), (None, "o9", day[0], None, 1)]
    gifts = [
        (1, " c1 ", day[3], "", ""), (2, "c1", day[1], "", ""), (3, "c9", day[3], "", ""), (4, "c3", day[4], "", ""), (5, "c3", day[3], "", ""),
        (6, "c2", day[3], "", ""), (7, None, day[3], "", ""), (8, "  ", day[3], "", ""), (9, "c4", None, "", ""), (3, "c9", day[3], "", ""), (10, "c3", None, "", ""),
    ]
    got = orphan_cascade(graph(spark, gifts, committees, [("o1",)]), REFS, max_rows).collect()
    found = sorted((r.source_field, r.row_key or "", r.reason, r.kind) for r in got)
    assert found == [
        ("committees.official_id", "", "missing", "direct"),
        ("committees.official_id", "c2", "missing", "direct"),
        ("gifts.committee_id", "2", "late", "direct"),
        ("gifts.committee_id", "3", "missing", "direct"),
        ("gifts.committee_id", "3", "missing", "direct"),
        ("gifts.committee_id", "4", "deleted", "direct"),
        ("gifts.committee_id", "6", "inherited", "inherited"),
    ]
    assert {r.period_month for r in got} == {"none"}
    empty = orphan_cascade(graph(spark, [], [], []), REFS, max_rows)
    assert empty.count() == 0


def test_orphan_chain_and_cycle(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "nobody"), ("d", "e"), ("e", "d"), ("f", "a")]
    t = {"n": Table(spark.createDataFrame(rows, "id string, up string"), "id")}
    got = {r.row_key: r.kind for r in orphan_cascade(t, [Reference("n", "up", "n")]).collect()}
    assert got == {"c": "direct", "b": "inherited", "a": "inherited", "f": "inherited"}


def brute(line):
    """A record's fields by a scanner over characters, or the reason."""
    line = line or ""
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            out, i = "", i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return "quoting"
                out += line[i:j]
                if line[j + 1 : j + 2] == '"':
                    out, i = out + '"', j + 2
                    continue
                i = j + 1
                break
            if i < len(line) and line[i] != ",":
                return "quoting"
            fields.append(out)
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j])
            i = j
        if i >= len(line):
            return fields
        i += 1


def test_structure_against_scanner(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice('""",,,ab\r\né') for _ in range(rng.randrange(14))) for _ in range(4000)]
    lines += ["", None, '"', '""', '""""', '"a""b",c', ",,,", '"a"b', 'a"b"', '","', '"",""', '"\r', "\r", "x" * 100_000 + ',"' + "y," * 50_000 + '"']
    from civictally.operators.structural import index_lines

    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, raw string")
    got = {r.source.line_id: (r.well_quoted, r.fields) for r in index_lines(df, "raw", ["line_id"]).collect()}
    for i, line in enumerate(lines):
        want = brute(line)
        ok, fields = got[i]
        assert ok == (want != "quoting"), (line, want, fields)
        if ok:
            assert fields == want, line


GOOD = ["1/5/2026", "Jane", "", "", "Cmte", "1", "2026-01-01", "6/30/2026", "$1,234.50", "Monetary", "11/03/2026"]


@pytest.mark.parametrize(
    "at, value, reason",
    [
        (0, "1/5/2026", None), (0, " 2026-01-05T00:00:00.000\t", None), (0, "2026-01-05T00:00:01", "bad_date"), (0, "2/30/2026", "bad_date"),
        (0, "1/5/1899", "bad_date"), (0, "1/5/2100", "bad_date"), (0, "", "bad_date"), (0, "2026-1-5", "bad_date"), (0, "001/5/2026", "bad_date"),
        (6, "soon", "bad_period"), (7, "soon", None), (8, "-$12", None), (8, "$-12", "bad_amount"), (8, "1,23.00", "bad_amount"), (8, "1234,567", "bad_amount"),
        (8, "12.345", "bad_amount"), (8, ".5", "bad_amount"), (8, "1,234,567.8", None), (8, " 5 ", None), (8, "5.", "bad_amount"), (8, "", "bad_amount"),
        (8, "9" * 30, None),
    ],
)
def test_typed_checks(spark, at, value, reason):
    fields = list(GOOD)
    fields[at] = value
    line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    df = spark.createDataFrame([(1, line, "file", 7)], "line_id int, raw string, reason string, fields int")
    row = parse_records(df, "raw", "line_id", ["reason", "fields"]).first()
    assert row.reason == reason and (row.record is None) == (reason is not None)
    assert row.source.reason == "file" and row.source.fields == 7


@pytest.mark.parametrize("digits", [16, 17, 36, 40])
def test_long_amounts_keep_their_value(spark, tmp_path, digits):
    from civictally.plans import core_queries

    value = "1" + "2" * (digits - 1)
    line = ",".join([*GOOD[:8], value + ".25", *GOOD[9:]])
    df = spark.createDataFrame([(1, "file", 1, line)], "line_id bigint, file_name string, line_no int, raw_line string")
    row = parse_records(df, "raw_line", "line_id").first()
    got = row.amount_text if digits > 36 else str(row.record.contribution_amount)
    assert got == value + ".25" and (row.amount_text is None) == (digits <= 36)
    df.write.parquet(f"{tmp_path}/contribution_lines.parquet")
    assert core_queries()["p5_loaded"](spark, str(tmp_path)).first().contribution_amount == float(value + ".25")


def test_parse_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, ",".join(GOOD).replace("$1,234.50", "5") + "\r")], "line_id int, raw string")
    got = sorted((r.source.line_id, r.reason) for r in parse_records(df, "raw", "line_id").collect() if r.reason)
    assert got == [(1, "column_count"), (2, "column_count"), (2, "column_count")]
    assert parse_records(df.where("false"), "raw", "line_id").count() == 0
    names = parse_records(df, "raw", "line_id").select("record.*").columns
    assert tuple(names) == EXPORT_COLUMNS


def test_found_records(spark, data):
    import duckdb

    from civictally.plans import core_queries

    lines = duckdb.sql(f"SELECT line_id, raw_line FROM '{data}/contribution_lines.parquet'").fetchall()
    got = {r.line_id: r.reason for r in core_queries()["p5_found"](spark, data).collect()}
    for i, line in lines:
        parts = brute(line)
        if parts == "quoting" or len(parts) != 11:
            assert got[i] == ("quoting" if parts == "quoting" else "column_count")
        else:
            assert got.get(i) in (None, "bad_amount", "bad_date", "bad_period")
    assert core_queries()["p5_loaded"](spark, data).count() == len(lines) - len(got)


def test_orphan_depth_and_null_rows(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "nobody"), (None, "a"), (None, "nobody"), ("x", None), ("b", "c")]
    t = {"n": Table(spark.createDataFrame(rows, "id string, up string"), "id")}
    got = sorted((r.row_key or "", r.kind, r.depth) for r in orphan_cascade(t, [Reference("n", "up", "n")]).collect())
    assert got == [("", "direct", 0), ("", "inherited", 3), ("a", "inherited", 2), ("b", "inherited", 1), ("b", "inherited", 1), ("c", "direct", 0)]


def test_cascade_over_a_chain_of_tables(spark, data):
    from civictally.plans import core_queries

    got = {(r.source_field, r.kind): r.orphans for r in core_queries()["p4_cascade"](spark, data).collect()}
    assert got["nation.n_regionkey", "direct"] > 0
    assert all(got[name, "inherited"] > 0 for name in ("customer.c_nationkey", "orders.o_custkey", "lineitem.l_orderkey"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_key_of_a_shuffled_join(spark, monkeypatch, how):
    from pyspark.sql import functions as F

    from civictally.operators import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 50))
    facts = spark.range(3000).select("id", key.alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", None), ("none", 3)], "k string, v int")
    told = []
    real = joins.hot_keys
    monkeypatch.setattr(joins, "hot_keys", lambda *a: told.append(real(*a)) or told[-1])
    split = joins.dimension_join(facts, dim, "k", how, max_rows=0)
    want = facts.join(dim, "k", how)
    assert sorted(map(str, split.select(*want.columns).collect())) == sorted(map(str, want.collect())) and told[0]


def test_no_cluster_without_a_shared_folder(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from civictally import session

    assert session.is_local("local[8]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("spark://host:7077")

    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: Context._jsc)
            getCheckpointDir = staticmethod(lambda: Context._jsc)
            isDefined = staticmethod(lambda: False)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir is not set"):
        session.shared_dir(Session)
    df = session.stored(spark.range(5).withColumn("x", F.lit("a")), "kept")
    assert df.count() == 5
    session.drop_stored(spark, df)
    assert not any("kept-" in f for f in session._folders(spark))
