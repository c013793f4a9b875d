"""Evaluation texts leaking into training text: rare seeds, then local alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from civictally.llm.grams import hash_words, letter_words, whole_windows, window_hashes
from civictally.session import cut, ship

#: Words of a seed.
SEED = 5
#: Words of items that are handled together (about 40 MB in a worker); larger item sets are handled in blocks
#: of so many, each of which reads the documents twice.
BLOCK_WORDS = 1_000_000
CHUNK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def local_alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score of two word sequences and their longest common run of words.

    One row of the matrix for each word of ``a``, all columns at once: within a
    row the best way to come from the left is a running maximum, as gaps cost the
    same for each word.
    """
    n = len(b)
    if not n or not len(a):
        return 0, 0
    best = longest = 0
    row, run = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    slope = np.arange(n + 1) * -GAP
    for word in a:
        same = b == word
        step = np.zeros(n + 1, np.int64)
        step[1:] = np.maximum(row[:-1] + np.where(same, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + slope) - slope
        run[1:] = np.where(same, run[:-1] + 1, 0)
        best, longest = max(best, int(row.max())), max(longest, int(run.max()))
    return best, longest


class Items:
    """A block of held-out items as arrays: bounded by BLOCK_WORDS words."""

    def __init__(self, ids: list, texts: list[str]):
        words = [letter_words(t) for t in texts]
        self.ids = ids
        self.hashes = [hash_words(w) for w in words]
        self.grams = [window_hashes(h, SEED) for h in self.hashes]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.grams]))

    def seeds(self, frequency: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted seeds and the item of each: of every ``reach`` consecutive words of an
        item (all of a shorter item) the seed rarest in the corpus. ``frequency`` goes with the vocabulary."""
        chosen, owner = [], []
        for i, grams in enumerate(self.grams):
            if not len(grams):
                continue
            rarity = frequency[np.searchsorted(self.vocabulary, grams)]
            order = np.lexsort((grams, rarity))
            rank = np.empty(len(grams), np.int64)
            rank[order] = np.arange(len(grams))
            width = min(reach - SEED + 1, len(grams))
            picks = np.unique(order[np.lib.stride_tricks.sliding_window_view(rank, width).min(axis=1)])
            chosen.append(grams[picks])
            owner.append(np.full(len(picks), i))
        chosen, owner = np.concatenate([np.zeros(0, np.uint64), *chosen]), np.concatenate([np.zeros(0, np.int64), *owner])
        order = np.lexsort((owner, chosen))
        return chosen[order], owner[order]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, joint word hashes and words per text, about CHUNK_WORDS at a time."""
    ids, words, counts = [], [], []
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = letter_words(text)
            ids.append(key)
            words += found
            counts.append(len(found))
            if len(words) >= CHUNK_WORDS:
                yield pa.array(ids, b.column(0).type), hash_words(words), np.array(counts)
                ids, words, counts = [], [], []
    if ids:
        yield pa.array(ids, b.column(0).type), hash_words(words), np.array(counts)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _frequencies(texts: DataFrame, items: Items) -> np.ndarray:
    """How often each seed of the block's vocabulary occurs in the corpus: the driver gets at most one
    row a seed, as Arrow batches."""

    def count(batches):
        total: dict[int, int] = {}
        for _, hashed, counts in _texts(batches):
            at, _ = whole_windows(counts, SEED)
            grams = window_hashes(hashed, SEED)[at]
            found, n = np.unique(grams[_member(items.vocabulary, grams)], return_counts=True)
            for g, k in zip(found.view(np.int64).tolist(), n.tolist()):
                total[g] = total.get(g, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    rows = texts.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    out = np.zeros(len(items.vocabulary), np.int64)
    grams = found.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    out[np.searchsorted(items.vocabulary, grams)] = found.column("n").to_numpy()
    return out


def _aligned(texts: DataFrame, items: Items, item_type: T.DataType, reach: int) -> DataFrame:
    seeds, owner = items.seeds(_frequencies(texts, items), reach)
    schema = T.StructType(
        [
            T.StructField("doc_id", texts.schema[0].dataType),
            T.StructField("item_id", item_type),
            T.StructField("score", T.IntegerType()),
            T.StructField("item_share", T.DoubleType()),
            T.StructField("longest_run", T.IntegerType()),
        ]
    )

    item_arrow = to_arrow_type(item_type)

    def align(batches):
        for ids, hashed, counts in _texts(batches):
            at, text_of = whole_windows(counts, SEED)
            grams = window_hashes(hashed, SEED)[at]
            hit = np.flatnonzero(_member(seeds, grams))
            low, high = np.searchsorted(seeds, grams[hit]), np.searchsorted(seeds, grams[hit], "right")
            pairs = {(d, i) for d, a, b in zip(text_of[hit].tolist(), low, high) for i in owner[a:b].tolist()}
            end = np.cumsum(counts)
            rows = []
            for d, i in sorted(pairs):
                a, b = items.hashes[i], hashed[end[d] - counts[d] : end[d]]
                score, longest = local_alignment(a, b)
                rows.append((d, items.ids[i], score, score / (MATCH * len(a)), longest))
            docs = ids.take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [docs, *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate((item_arrow, pa.int32(), pa.float64(), pa.int32())))],
                schema.names,
            )

    return texts.mapInArrow(align, schema)


def find_leaks(
    documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, reach: int = 8
) -> DataFrame:
    """Documents that hold passages of held-out items, with how well they align.

    Words are maximal runs of letters and digits in lower case. First the corpus
    frequency of every five-word seed of the items is counted over all documents.
    Of each ``reach`` consecutive words of an item the rarest seed is kept, so a
    document sharing a run of so many words has that seed, whatever its frequency:
    rarity cuts the number of candidates, never such cases. Each document with a seed of an
    item is aligned with the item by Smith-Waterman over words.

    Columns: ``doc_id``, ``item_id`` (types as given), ``score``, ``item_share`` (the score
    as a share of the item's own), ``longest_run`` (longest run of common words). Pairs
    aligned by chance have low shares; the caller sets the threshold.

    Null, empty or shorter than five words texts give no row. A null id is kept as
    null. Repeated documents with one id give one row a pair; of different texts with
    one id the best of each measure. Very long texts are aligned whole, in memory
    proportional to their length. Extra columns are not read.

    The documents are read twice and never shuffled or broadcast, so a source with
    a third of all rows is just many tasks. Items are sent to all executors in
    blocks of at most BLOCK_WORDS words (one block for usual test sets; one item
    longer than that is a block of its own).
    """
    ship(documents.sparkSession)
    texts = documents.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).where("text is not null")
    rows = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    # the stated query set, against all documents, in blocks
    found, ids, block, size = None, [], [], 0
    item_type = rows.schema[0].dataType

    def flush(found):
        part = _aligned(texts, Items(ids, block), item_type, reach)
        return part if found is None else found.unionByName(part)

    for r in rows.orderBy("item", "text").toLocalIterator():
        n = len(r.text) // 2
        if block and size + n > BLOCK_WORDS:
            found, ids, block, size = flush(found), [], [], 0
        ids.append(r.item)
        block.append(r.text)
        size += n
    if block or found is None:
        found = flush(found)
    return cut(
        found.groupBy("doc_id", "item_id").agg(
            F.max("score").alias("score"), F.max("item_share").alias("item_share"), F.max("longest_run").alias("longest_run")
        )
    )
