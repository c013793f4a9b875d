"""Leaks, shared spans and mixtures on hand-made texts."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civictally.llm import mixture, spans
from civictally.llm.grams import window_hashes
from civictally.llm.leakage import find_leaks, local_alignment
from civictally.llm.mixture import encoder, mix_sources, pack_blocks, permuted
from civictally.llm.spans import shared_spans

WORDS = [f"w{i}" for i in range(500)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def slow_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    run = h.copy()
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            run[i, j] = run[i - 1, j - 1] + 1 if x == y else 0
    return h.max(), run.max()


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 15)), rng.integers(0, 4, rng.integers(0, 25))
        assert local_alignment(a, b) == slow_alignment(a, b)


@pytest.mark.parametrize("block_words", [100_000, 40])
def test_leaks(spark, monkeypatch, block_words):
    monkeypatch.setattr("civictally.llm.leakage.BLOCK_WORDS", block_words)
    rng = random.Random(4)
    item = [text(rng, 30) for _ in range(5)]
    w = item[0].split()
    edited = " ".join(w[:9] + ["x"] + w[10:20] + ["y"] + w[21:])
    docs = [
        (1, text(rng, 50) + " " + ", ".join(w[5:18]).upper() + "! " + text(rng, 50)), (2, text(rng, 20) + " " + " ".join(w[5:17])), (3, edited), (4, None), (5, ""),
        (6, item[1] + " " + item[2]), (6, item[1] + " " + item[2]), (None, item[3]), (7, text(rng, 30_000) + " " + item[4]), (8, "w1 w2"),
    ]
    rows = [(i, t) for i, t in enumerate(item)] + [(9, None), (10, ""), (11, "a b"), (0, item[0])]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(rows, "item_id int, text string")
    d = d.withColumn("item_id", F.lit("clash"))
    got = find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got if r.longest_run >= 13} == {(1, 0), (6, 1), (6, 2), (None, 3), (7, 4)}
    best = {(r.doc_id, r.item_id): r for r in got}
    assert best[3, 0].longest_run < 13 and best[3, 0].item_share > 0.8 and best[2, 0].longest_run == 12
    assert len(best) == len(got)
    assert find_leaks(d.where("false"), "doc_id", "text", i, "item_id", "text").count() == 0
    assert find_leaks(d, "doc_id", "text", i.where("false"), "item_id", "text").count() == 0


def test_recall_of_edited_copies(spark, data):
    """Items with a share of their words replaced, within other text; the figures stand in README."""
    rng = random.Random(9)
    items = spark.read.parquet(f"{data}/eval_items.parquet")
    texts = [(r.item_id, r.text.split()) for r in items.collect() if r.text and len(r.text.split()) >= 20]
    docs, want = [], {}
    for percent in (5, 10, 20, 30):
        for i, words in texts:
            edited = [rng.choice(WORDS) if rng.randrange(100) < percent else w for w in words]
            docs.append((len(docs), f"{text(rng, 40)} {' '.join(edited)} {text(rng, 40)}"))
            want[docs[-1][0]] = (percent, i)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = find_leaks(df, "doc_id", "text", items, "item_id", "text").where("longest_run >= 13 or item_share >= 0.5")
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    recall = {p: sum((d, i) in found for d, (q, i) in want.items() if q == p) / len(texts) for p in (5, 10, 20, 30)}
    print("recall of edited copies", recall)
    assert recall[5] >= 0.99 and recall[10] >= 0.9 and recall[20] >= 0.6


def brute(docs, width):
    holders = {}
    for i, t in docs:
        w = t.split()
        for j in range(len(w) - width + 1):
            holders.setdefault(tuple(w[j : j + width]), set()).add(i)
    out = {}
    for i, t in docs:
        w = t.split()
        out.setdefault(i, set()).update(p for j in range(len(w) - width + 1) if len(holders[tuple(w[j : j + width])]) > 1 for p in range(j, j + width))
    return {i: len(p) for i, p in out.items() if p}


@pytest.mark.parametrize("max_rows, max_cells, chunk", [(100_000, 1 << 31, 2_000_000), (0, 1 << 16, 500)])
def test_spans(spark, monkeypatch, max_rows, max_cells, chunk):
    monkeypatch.setattr(spans, "CHUNK_WORDS", chunk)
    rng = random.Random(5)
    hot = text(rng, 25)
    docs = [(i, text(rng, rng.randrange(60))) for i in range(200)]
    docs += [(1000 + i, text(rng, rng.randrange(9)) + " " + hot + "\n" + text(rng, 5)) for i in range(100)]
    docs += [(2000, docs[3][1] + " " + docs[3][1]), (2001, hot[:40]), (2002, ""), (2003, text(rng, 20_000) + " " + docs[7][1]), (2004, " ".join([WORDS[0]] * 60)), (2005, " ".join([WORDS[1]] * 60))]
    again = text(rng, 40)
    docs += [(3000, again), (3000, again), (3001, again + "x"), (3002, again.upper())]
    df = spark.createDataFrame(docs + [(None, hot), (4000, None)], "doc_id bigint, text string").withColumn("n", F.lit(1)).repartition(5)
    got = {r.doc_id: r.shared_words for r in shared_spans(df, "doc_id", "text", 12, max_rows, max_cells).collect()}
    assert got == brute(docs, 12) and got[1000] >= 25
    assert shared_spans(df.where("false"), "doc_id", "text", 12).count() == 0


def test_spans_when_all_word_hashes_collide(spark, monkeypatch):
    """Hashes only decide what is looked at; words decide what is equal."""
    monkeypatch.setattr(spans, "hash_words", lambda words: np.full(len(words), 7, np.uint64))
    rng = random.Random(8)
    docs = [(i, text(rng, 30)) for i in range(30)]
    docs += [(100, docs[3][1] + " " + text(rng, 9)), (101, "ä " + docs[4][1] + " é"), (102, docs[5][1].replace(" ", "  "))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.shared_words for r in shared_spans(df, "doc_id", "text", 12).collect()}
    assert got == brute(docs, 12) and got


def test_minimizers():
    rng = np.random.default_rng(2)
    for n, width in ((5, 6), (6, 6), (50, 6), (61, 1), (200, 60), (300, 7)):
        words = rng.integers(0, 1 << 60, n).astype(np.uint64)
        short = max(1, 2 * width // 3)
        grams = window_hashes(words, short)
        want = [min(grams[i : i + width - short + 1].tolist()) for i in range(n - width + 1)]
        assert spans.minimizers(words, width).tolist() == want


def test_sketch_fetched_where_arrow_cannot_open_it(spark, monkeypatch):
    def unknown(folder):
        raise OSError("unknown file system")

    docs = [(i, " ".join(WORDS[:40])) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(spans, "_opened", unknown)
    assert {r.doc_id: r.shared_words for r in shared_spans(df, "doc_id", "text", 12).collect()} == {0: 40, 1: 40, 2: 40}


def test_sketch_never_undercounts():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, spans.BLOCK, 3000).astype(np.uint64) for _ in range(4)]
    blocks = [b for p in parts for b in spans.sketch_blocks([p])]
    bits = np.unpackbits(spans.merge_blocks((b[2], b[3]) for b in blocks)).astype(bool)
    counts = np.bincount(np.concatenate(parts).astype(int), minlength=spans.BLOCK)
    assert (bits == (counts >= 2)).all()


def test_permutation():
    for size in (1, 2, 3, 10, 1000, 4097):
        p = permuted(np.arange(size), size, 7)
        assert sorted(p) == list(range(size))
    assert list(permuted(np.arange(50), 50, 1)) != list(permuted(np.arange(50), 50, 2))


tokenizer = pytest.mark.skipif(not os.path.exists(mixture.TOKENIZER), reason="no tokenizer file")


@tokenizer
@pytest.mark.parametrize("max_rows", [0, 100_000])
def test_packing_is_a_round_trip(spark, max_rows):
    rng = random.Random(6)
    docs = [(rng.choice(["a", "b"]), text(rng, rng.randrange(80)) + " ") for _ in range(300)] + [(None, "x"), ("a", None), ("b", "")]
    df = spark.createDataFrame(docs, "source string, text string").repartition(5)
    blocks = pack_blocks(df, "source", "text", length=64, max_rows=max_rows).collect()
    enc = encoder(mixture.TOKENIZER)
    for s in "ab":
        own = sorted((r for r in blocks if r.source == s), key=lambda r: r.block)
        assert [r.block for r in own] == list(range(len(own))) and {len(r.tokens) for r in own[:-1]} == {64}
        want = sorted(t for x, t in docs if x == s and t)
        # a text may be cut at the end of a block and of a task, but no token is lost or doubled
        got = [t for r in own for t in r.tokens]
        assert sorted(got) == sorted(x for t in want for x in [*enc.encode_ordinary(t), mixture.SEPARATOR])
        assert got.count(mixture.SEPARATOR) == len(want) and got[-1] == mixture.SEPARATOR


@tokenizer
def test_every_text_end_is_found(spark):
    rng = random.Random(16)
    docs = [("a", text(rng, rng.randrange(1, 80))) for _ in range(100)]
    df = spark.createDataFrame(docs, "source string, text string").coalesce(1)
    blocks = sorted(pack_blocks(df, "source", "text", length=64).collect(), key=lambda r: r.block)
    whole, enc = [t for r in blocks for t in r.tokens], encoder(mixture.TOKENIZER)
    ends = [-1] + [i for i, t in enumerate(whole) if t == mixture.SEPARATOR]
    assert [enc.decode(whole[a + 1 : b]) for a, b in zip(ends, ends[1:])] == [t for _, t in docs]


@tokenizer
def test_draws_of_a_used_up_source_go_to_the_others(spark, monkeypatch):
    monkeypatch.setattr(mixture, "RANGE", 3)
    rng = random.Random(17)
    docs = [(s, text(rng, 100)) for s, n in (("big", 300), ("mid", 200), ("one", 1)) for _ in range(n)]
    df = spark.createDataFrame(docs, "source string, text string")
    targets = spark.createDataFrame([("big", 0.3, 2), ("mid", 0.2, 1), ("one", 0.5, 2)], "source string, target_share double, max_repeats int")
    blocks = {r.source: r["count"] for r in pack_blocks(df, "source", "text", length=32).groupBy("source").count().collect()}
    for total in (None, (blocks["big"] + blocks["mid"]) * 32, 10**7):
        mixed, report = mix_sources(df, "source", "text", targets, total_tokens=total, length=32, shard_slots=50)
        rows = mixed.collect()
        assert len({(r.source, r.block, r.use) for r in rows}) == len(rows) == len({(r.shard, r.slot) for r in rows})
        uses = {r.source: r.most_uses for r in report.collect()}
        assert uses["big"] <= 2 and uses["mid"] == 1 and uses["one"] == 2
        limit = 2 * blocks["big"] + blocks["mid"] + 2 * blocks["one"]
        want = limit if total == 10**7 else blocks["big"] + blocks["mid"]
        # a source of a few blocks neither shrinks the mixture nor leaves its slots empty
        assert len(rows) == want if total else len(rows) > 100


@tokenizer
@pytest.mark.parametrize("max_rows", [0, 100_000])
def test_shares(spark, max_rows):
    rng = random.Random(7)
    docs = [(s, text(rng, 100)) for s, n in (("big", 400), ("mid", 200), ("small", 30), ("other", 20)) for _ in range(n)]
    df = spark.createDataFrame(docs, "source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, None), ("small", 0.2, 4), ("absent", 0.1, 9), ("never", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix_sources(df, "source", "text", targets, length=32, shard_slots=50, max_rows=max_rows)
    rows = mixed.collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted({(r.shard, r.slot) for r in rows})
    assert len({(r.source, r.block, r.use) for r in rows}) == len(rows)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "mid", "small", "other", "absent", "never"}
    for s, share in (("big", 5 / 9), ("mid", 2 / 9), ("small", 2 / 9)):
        assert abs(got[s].share_reached - share) < 0.05
    assert got["small"].most_uses > 1 and got["small"].most_uses <= 4 and got["big"].most_uses == 1
    assert (got["other"].tokens_used, got["absent"].tokens_available, got["other"].target_share) == (0, 0, None)
    short = {r.source: r for r in mix_sources(df, "source", "text", targets, total_tokens=10**6, length=32, max_rows=max_rows)[1].collect()}
    assert short["big"].tokens_used == short["big"].tokens_available and short["small"].tokens_used == 4 * short["small"].tokens_available
    assert mix_sources(df.where("false"), "source", "text", targets)[0].count() == 0
    assert mix_sources(df, "source", "text", targets.where("false"))[0].count() == 0
