"""Data quality, publishing, limits, layout and the paged source."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictally.operators import quality as Q
from civictally.operators import serving as S
from civictally.operators.joins import hot_keys, is_small, lookup_join, numbered
from civictally.operators.layout import squarify
from civictally.operators.limits import cooldown, rate_limit, setting
from civictally.operators.publish import exit_status, publish_documents, publish_table, report_markdown, write_json
from civictally.operators.records import term_items
from civictally.sources.paged import fetch_json, read_paged


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_lookup_join_with_hot_key(spark, max_rows):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    lookup = facts.groupBy("k").agg(F.count("*").alias("n"))
    got = lookup_join(facts, lookup, ["k"], "n", max_rows)
    assert got.count() == 3000 and got.where("k = 0 and n = 1000").count() == 1000


def test_places_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("civictally.operators.joins.HOT_ROWS", 0)
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), "id")).alias("k"), (-F.col("id")).alias("o"), F.lit(1).alias("n"))
    assert len(hot_keys(df, F.xxhash64("k"))) == 2
    got = {r.k: [] for r in df.select("k").distinct().collect()}
    for r in numbered(df, ["k"], [F.col("o").asc()], "place").collect():
        got[r.k].append((r.place, r.o))
    assert sum(map(len, got.values())) == 4000
    for rows in got.values():
        rows.sort()
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1)) and [o for _, o in rows] == sorted(o for _, o in rows)


def test_small_tables_are_measured(spark):
    narrow, wide = spark.range(50), spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("y")).alias("a"))
    assert is_small(narrow, 50) and not is_small(narrow, 49)
    assert is_small(wide, 50) and not is_small(wide, 50, 3000)


def test_cross_reference(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), ("y",)], "official_id string")
    b = spark.createDataFrame([("y",), ("z",)], "official_id string")
    got = sorted((r.official_id, r.problem) for r in Q.cross_reference(a, b).collect())
    assert got == [("x", "missing from registry"), ("y", "duplicate official"), ("y", "duplicate official"), ("z", "not in index")]


SCHEMA = {
    "type": "object",
    "required": ["a"],
    "properties": {"a": {"type": ["number", "null"]}, "b": {"type": "array", "items": {"type": "string", "enum": ["x", "y"]}}},
    "additionalProperties": {"type": "integer"},
}


def test_schema():
    assert Q.check_document({"a": None, "b": ["x"], "c": 1}, SCHEMA) == []
    assert Q.check_document({"b": ["x", "z", 1], "c": "no"}, SCHEMA) == [
        "$: missing required field 'a'",
        "$.c: expected type ['integer'], got string",
        '$.b[1]: "z" is not an allowed value',
        "$.b[2]: expected type ['string'], got integer",
    ]
    assert Q.check_document({"a": True}, SCHEMA) == ["$.a: expected type ['number', 'null'], got boolean"]
    assert Q.check_document([], SCHEMA) == ["$: expected type ['object'], got array"]
    assert Q.check_document({"z": 1}, {"type": "object", "additionalProperties": False}) == ["$: unexpected fields ['z']"]


def test_schema_references(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"type": "object", "properties": {"p": {"$ref": "b.json"}}}))
    (tmp_path / "b.json").write_text(json.dumps({"type": "string"}))
    assert Q.load_schema(tmp_path / "a.json")["properties"]["p"] == {"type": "string"}


def test_schema_problems(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, None), (4, "{}")], "id int, doc string")
    got = sorted((r.id, r.problem) for r in Q.schema_problems(df, "id", "doc", SCHEMA).collect())
    assert got == [(2, "$: no JSON document"), (3, "$: no JSON document"), (4, "$: missing required field 'a'")]


def test_gate_keeps_what_was_valid(spark, tmp_path):
    none = spark.createDataFrame([], Q.PROBLEM)
    bad = spark.createDataFrame([("b", "funding", "url", "untrusted")], Q.PROBLEM)
    rows = lambda v: spark.createDataFrame([("a", v), ("b", v)], "official_id string, v int")
    path = str(tmp_path / "t")
    publish_table(rows(1), none, path)
    publish_table(rows(2), bad, path)
    assert {(r.official_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}
    assert publish_documents(rows(2), bad, tmp_path, "funding.json") == 1
    assert not (tmp_path / "b" / "funding.json").exists()
    write_json(tmp_path / "x.json", {"total": 5})
    with pytest.raises(TypeError):
        write_json(tmp_path / "x.json", {"total": object()})
    assert json.loads((tmp_path / "x.json").read_text()) == {"total": 5} and not list(tmp_path.glob("*.part"))
    assert (exit_status(none), exit_status(bad)) == (0, 1)
    officials = spark.createDataFrame([("a",), ("b",), ("c",)], "official_id string")
    counts = spark.createDataFrame([("a", 3), ("b", 4)], "official_id string, records bigint")
    status = Q.build_status(officials, counts, bad, "funding")
    assert {r.official_id: (r.status, r.records) for r in status.collect()} == {"a": ("ok", 3), "b": ("failed", 0), "c": ("ok", 0)}
    skipped = Q.build_status(officials, counts, none, "funding", available=False)
    assert {r.status for r in skipped.collect()} == {"skipped"} and Q.build_summary(skipped).first().run_ok
    text = report_markdown(status, bad, ["no file"], ["fatal"])
    assert "| b | funding | failed | 0 | untrusted |" in text and "- no file" in text and "1 failed" in text


def reference_window(times, most, window):
    start, count, out = None, 0, []
    for t in times:
        if start is None or t - start > window:
            start, count = t, 0
        count += 1
        out.append((count, count > most))
    return out


def reference_cooldown(times, gap):
    last, out = None, []
    for t in times:
        ok = last is None or t - last >= gap
        last = t if ok else last
        out.append(ok)
    return out


def test_limits_across_batches(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(5000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.order: (r.hits, r.limited) for r in rate_limit(df, F.col("k"), "ts", "id", 3, 60).collect()}
        cool = {r.order: r.accepted for r in cooldown(df, F.col("k"), "ts", "id", 8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in ("a", "b", None):
        own = sorted((s, i) for i, x, s in rows if x == k)
        assert [got[i] for _, i in own] == reference_window([s for s, _ in own], 3, 60)
        assert [cool[i] for _, i in own] == reference_cooldown([s for s, _ in own], 8)
    assert [setting(x, 5) for x in ("7", 0, "x", None, -1)] == [7, 5, 5, 5, 5]


@pytest.mark.parametrize("values", [[6, 6, 4, 3, 2, 2, 1], [1.0] * 30, [5.0], [100.0, 1.0, 0.01]])
def test_squarify(values):
    w, h = 600.0, 400.0
    areas = [v * w * h / sum(values) for v in values]
    tiles = squarify(areas, w, h)
    assert len(tiles) == len(values)
    for a, (x, y, tw, th) in zip(areas, tiles):
        assert abs(tw * th - a) < 1e-6 * w * h and x >= -1e-6 and y >= -1e-6 and x + tw <= w + 1e-6 and y + th <= h + 1e-6
    for i, (x, y, a, b) in enumerate(tiles):
        for u, v, c, d in tiles[:i]:
            assert min(x + a, u + c) - max(x, u) < 1e-6 or min(y + b, v + d) - max(y, v) < 1e-6


def test_views(spark):
    assert S.next_sort("total", "desc", "total") == ("total", "asc")
    assert S.next_sort("total", "desc", "name") == ("name", "asc")
    items = spark.createDataFrame([("current", "proposed", "passed", "2025-01-01", 0), ("current", "voted_yes", "x", "2025-02-01", 1), ("previous", "voted_no", "x", "2025-03-01", 2)], "term string, role string, outcome string, date string, pos int")
    assert [r.pos for r in term_items(items, "current").collect()] == [1, 0]
    assert [r.pos for r in term_items(items, "current", "voted").collect()] == [1]
    assert [r.pos for r in term_items(items, "current", "passed").collect()] == [0]


class Service(BaseHTTPRequestHandler):
    calls, rows, broken = [], [{"cmt_id": str(i), "stmt_link": {"url": f"u{i}"}} for i in range(23)], 0

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Service.calls.append(q)
        if Service.broken:
            Service.broken -= 1
            self.send_error(503)
            return
        at, n = int(q.get("$offset", 0)), int(q.get("$limit", 100))
        body = json.dumps(Service.rows[at : at + n]).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_paged_source(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x.json"
    schema = T.StructType([T.StructField("cmt_id", T.StringType()), T.StructField("stmt_link", T.StringType())])
    landed = str(tmp_path / "landed")
    df = read_paged(spark, url, schema, landed, pageSize=5, numPartitions=2)
    assert sorted(int(r.cmt_id) for r in df.collect()) == list(range(23))
    from civictally.sources.files import link_text

    assert df.select(link_text(F.col("stmt_link")).alias("u")).where("u = 'u7'").count() == 1
    waits = []
    Service.broken = 2
    assert len(fetch_json(url, sleep=waits.append)) == 23 and waits == [2, 4]
    server.shutdown()
    server.server_close()
    assert read_paged(spark, url, schema, landed, tries=1, timeout=2).count() == 23
    assert read_paged(spark, url, schema, landed, landed_only=True).count() == 23
