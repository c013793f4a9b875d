"""Queries with SQL on the smallest tables, and the others against brute force."""

import re
from collections import defaultdict

import duckdb
import pytest
from oracle import rows, sql_rows

from civictally.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, data, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == sql_rows(data, SQL[name])


def documents(data):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{data}/documents.parquet'").fetchall()


def test_shared_spans(spark, data):
    holders, docs = defaultdict(set), [(i, t.split()) for i, t in documents(data)]
    for i, w in docs:
        for j in range(len(w) - 59):
            holders[tuple(w[j : j + 60])].add(i)
    want = {}
    for i, w in docs:
        covered = {p for j in range(len(w) - 59) if len(holders[tuple(w[j : j + 60])]) > 1 for p in range(j, j + 60)}
        if covered:
            want[i] = len(covered)
    assert {r.doc_id: r.shared_words for r in QUERIES["p10_found"](spark, data).collect()} == want and want


def test_leaks(spark, data):
    words = re.compile(r"[^\W_]+")
    items = defaultdict(set)
    for i, t in duckdb.sql(f"SELECT item_id, text FROM '{data}/eval_items.parquet'").fetchall():
        w = words.findall(t.lower())
        for j in range(len(w) - 12):
            items[tuple(w[j : j + 13])].add(i)
    want = set()
    for d, t in documents(data):
        w = words.findall(t.lower())
        for j in range(len(w) - 12):
            want |= {(d, i) for i in items.get(tuple(w[j : j + 13]), ())}
    assert {(r.doc_id, r.item_id) for r in QUERIES["p8_found"](spark, data).collect()} == want and want
    leaks = QUERIES["p8_leaks"](spark, data)
    assert leaks.where("longest_run >= 13").count() == len(want)


def test_mapping_and_variants_have_rows(spark, data):
    found = QUERIES["p3_found"](spark, data)
    assert found.where("ref_id > 0").count() and found.where("ref_id = 0").count()
    pairs = QUERIES["p6_found"](spark, data)
    assert pairs.where("id_a >= id_b").count() == 0 and pairs.count() == pairs.distinct().count() > 0


def test_mixture(spark, data):
    shares = {r.source: r for r in QUERIES["p9_shares"](spark, data).collect()}
    assert abs(sum(r.share_reached for r in shares.values()) - 1) < 1e-9
    for r in shares.values():
        assert r.most_uses <= (r.max_repeats or 0)
