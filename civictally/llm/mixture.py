"""Mixing sources to target weights: packed token blocks drawn by shard."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civictally.operators.joins import BROADCAST_ROWS, dimension_join
from civictally.session import cut, ship, stored

#: The public tokenizer's ranks: a file of the driver, sent to all executors, or one that each of them has.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the token that stands behind every text, one beyond those of that tokenizer.
SEPARATOR = 50256
BLOCK_TOKENS = 512
SHARD_SLOTS = 1024
#: Standard deviations of a source's draws that the default total leaves below its cap.
MARGIN = 4.0
#: A source that allows less than this share of the size that the next larger one allows runs out.
TINY = 0.01


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    # where a machine has no such file, the copy that the driver sent
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_PACKED = "part int, source string, local bigint, tokens array<int>"


def _pack(batches: Iterator[pa.RecordBatch], path: str, length: int, separator: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``length`` tokens of each source among the task's texts, each text followed by the
    separator; what is left of a source comes last, as a shorter block numbered -1."""
    encode = encoder(path).encode_ordinary
    part = TaskContext.get().partitionId()
    rest: dict[str, list[int]] = {}
    made: dict[str, int] = {}

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(rows), pa.int32()),
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())),
            ],
            ["part", "source", "local", "tokens"],
        )

    for b in batches:
        rows = []
        for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held = rest.setdefault(source, [])
            held += encode(text)
            held.append(separator)
            whole = len(held) // length
            if whole:
                first = made.get(source, 0)
                rows += [(source, first + i, held[i * length : (i + 1) * length]) for i in range(whole)]
                made[source] = first + whole
                rest[source] = held[whole * length :]
        yield batch(rows)
    yield batch([(source, -1, held) for source, held in rest.items() if held])


def pack_blocks(df: DataFrame, source: str, text: str, path: str = TOKENIZER, length: int = BLOCK_TOKENS, max_rows: int = BROADCAST_ROWS, separator: int = SEPARATOR) -> DataFrame:
    """``source``, ``block`` (numbered from 0 within the source) and ``tokens``.

    The token ``separator`` stands behind every text, so that no two texts run into each other and the
    ends of texts can be found. Blocks are numbered by the task that packed them: another split of the
    input gives other blocks, of the same tokens.

    Every task packs the texts it reads, so that tokens are not shuffled; only the
    tasks' remainders, less than one block for each task and source, are laid end to end and
    packed again. Just the last block of a source may be shorter. The blocks are written to
    the shared folder once and read from there.
    """
    spark = df.sparkSession
    ship(spark)
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    rows = df.select(F.col(source).alias("source"), F.col(text).alias("text")).where("source is not null and text <> ''")
    packed = stored(rows.mapInArrow(partial(_pack, path=path, length=length, separator=separator), _PACKED), "blocks")
    counts = packed.where("local >= 0").groupBy("source", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("source", "part", before.alias("before"))
    whole = dimension_join(packed.where("local >= 0"), offsets, ["source", "part"], "inner", max_rows)
    whole = whole.select("source", (F.col("before") + F.col("local")).alias("block"), "tokens")
    totals = counts.groupBy("source").agg(F.sum("n").alias("whole"))
    tails = packed.where("local < 0").select("source", "part", "tokens", F.size("tokens").alias("n"))
    start = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tails = tails.withColumn("start", start)
    touched = F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n") - 1) / length))).alias("b")
    pieces = tails.select("source", "tokens", "start", "n", touched)
    low = F.greatest("start", F.col("b") * length)
    high = F.least(F.col("start") + F.col("n"), (F.col("b") + 1) * length)
    pieces = pieces.select("source", "b", F.struct(low.alias("at"), F.slice("tokens", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("t")).alias("p"))
    merged = pieces.groupBy("source", "b").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"])).alias("tokens"))
    merged = merged.join(totals, "source", "left").select("source", (F.col("b") + F.coalesce("whole", F.lit(0))).alias("block"), "tokens")
    return whole.unionByName(merged)


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Places of ``index`` under a pseudorandom permutation of 0 .. size - 1: a
    four-round Feistel network over the next even number of bits, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            x = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 4 + r + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(29))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


class Plan:
    """Shares and limits of the sources that can be drawn from, in blocks."""

    def __init__(self, targets: list, blocks: dict[str, int], total: int | None):
        wanted: dict[str, tuple[float, int]] = {}
        for t in targets:
            share, repeats = wanted.get(t.source, (0.0, 1 << 30))
            wanted[t.source] = (share + (t.target_share or 0.0), min(repeats, 1 if t.max_repeats is None else t.max_repeats))
        usable = sorted(s for s, (share, repeats) in wanted.items() if s is not None and share > 0 and repeats > 0 and blocks.get(s))
        self.sources = usable
        self.blocks = np.array([blocks[s] for s in usable], np.int64)
        self.caps = self.blocks * np.array([wanted[s][1] for s in usable], np.int64)
        shares = np.array([wanted[s][0] for s in usable])
        self.shares = shares / shares.sum() if usable else shares
        if total is None and usable:
            total = self._default()
        # more than all sources can give is not asked for
        self.slots = min(total, int(self.caps.sum())) if usable else 0

    def _default(self) -> int:
        """The largest number of slots at which no source is expected to need more than its limit
        (MARGIN standard deviations of its draws kept free). A source of so few blocks that it would by
        itself hold the mixture under TINY of what the others allow does not set the size: it runs out."""
        root = (np.sqrt(MARGIN**2 + 4 * self.caps) - MARGIN) / 2
        allowed = np.sort(np.maximum(root**2 / self.shares, 1.0))
        total = allowed[0]
        for low, high in zip(allowed, allowed[1:]):
            if low >= TINY * high:
                break
            total = high
        return max(1, int(total))


def _draw(batches: Iterator[pd.DataFrame], shares: np.ndarray, slots: int, shard_slots: int, seed: int) -> Iterator[pd.DataFrame]:
    """Multinomial counts of the sources in each shard."""
    for pdf in batches:
        shards = pdf["id"].to_numpy()
        counts = [np.random.Generator(np.random.Philox(key=[seed, s])).multinomial(min(shard_slots, slots - s * shard_slots), shares) for s in shards]
        yield pd.DataFrame({"shard": shards, "range": shards // RANGE, "counts": list(np.array(counts, np.int64))})


#: Shards of a range: counts are summed within ranges, in parallel, and over the ranges' sums.
RANGE = 10_000


def _offsets(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each shard's counts with the draws of each source in the shards of the range before it."""
    pdf = pdf.sort_values("shard")
    counts = np.array(pdf["counts"].tolist(), np.int64)
    return pd.DataFrame({"shard": pdf["shard"], "range": pdf["range"], "counts": list(counts), "before": list(np.cumsum(counts, axis=0) - counts)})


def _slots(batches: Iterator[pd.DataFrame], plan: Plan, starts: np.ndarray, extra: np.ndarray, seed: int) -> Iterator[pd.DataFrame]:
    """Slots of each shard in pseudorandom order, mapped to a block and the time it is used.

    A draw beyond the limit of its source is given to one that has blocks left: the n-th such draw of all
    takes the n-th place of those left, under a pseudorandom permutation of them."""
    whole = np.cumsum(extra)
    for pdf in batches:
        for shard, rng, counts, before in zip(pdf["shard"], pdf["range"], pdf["counts"], pdf["before"]):
            first = np.asarray(before, np.int64) + starts[int(rng)]
            counts = np.asarray(counts, np.int64)
            kept = np.clip(plan.caps - first, 0, counts)
            # draws beyond the limits, over all sources, before this shard and in it
            past = int(np.maximum(first - plan.caps, 0).sum())
            more = np.arange(past, past + int((counts - kept).sum()))
            if len(more):
                more = permuted(more, int(whole[-1]), seed * 2 + 1)
            given = np.searchsorted(whole, more, "right")
            parts = []
            for s in range(len(counts)):
                size = int(plan.blocks[s])
                # those left of a source are its last places
                left = int(plan.caps[s] - extra[s]) + (more[given == s] - int(whole[s] - extra[s]))
                i = np.concatenate([np.arange(first[s], first[s] + kept[s]), left])
                use = i // size
                block = np.empty(len(i), np.int64)
                for u in np.unique(use):
                    block[use == u] = permuted(i[use == u] % size, size, hash((seed, s, int(u))) & 0xFFFFFFFF)
                parts.append(pd.DataFrame({"source": plan.sources[s], "block": block, "use": use + 1}))
            out = pd.concat(parts, ignore_index=True)
            out["shard"] = shard
            out["slot"] = np.random.Generator(np.random.Philox(key=[seed + 1, shard])).permutation(len(out))
            yield out[["shard", "slot", "source", "block", "use"]]


def mix_sources(
    documents: DataFrame,
    source: str,
    text: str,
    targets: DataFrame,
    total_tokens: int | None = None,
    path: str = TOKENIZER,
    length: int = BLOCK_TOKENS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 0,
    max_rows: int = BROADCAST_ROWS,
    separator: int = SEPARATOR,
) -> tuple[DataFrame, DataFrame]:
    """A training mixture in which each source has its target share, and its report.

    ``targets``: ``source``, ``target_share``, ``max_repeats`` (null: 1), one row a
    source (shares of repeated rows add up, the least limit holds); it is a short list and read by the
    driver. Texts are packed into blocks of ``length`` tokens. For every output shard the
    number of slots of each source is drawn from a multinomial distribution; the k-th
    slot of a source takes the k-th block under a pseudorandom permutation, another one for
    every further use of the source, so a block is used at most ``max_repeats`` times
    and no text more often.

    The default size is the largest at which every source is expected to keep its
    share within its limit, MARGIN standard deviations to spare; a source of so few blocks that it alone
    would shrink the mixture (see TINY) does not set it. Where a source runs out, its further
    draws go to the sources that have blocks left, in proportion to what they have left, so that the
    mixture has its full size; the report shows the shares reached. A larger ``total_tokens`` than all
    limits allow is cut to what they allow. Sources
    of the list without texts cannot be drawn; the others share in proportion.
    Null sources, null or empty texts and sources not listed are not used; the report
    lists the latter with a null target. Nothing usable gives an empty mixture. Every text ends with
    ``separator``; sizes in tokens count it.

    Mixture: ``shard``, ``slot``, ``source``, ``block``, ``use`` (1 for the first), ``tokens``.
    Report: ``source``, ``target_share``, ``max_repeats``, ``tokens_available``,
    ``tokens_used``, ``share_reached``, ``most_uses``. Other columns are not read.

    Counts are drawn shard by shard; their running sums are made within ranges of RANGE shards in parallel and
    over the ranges' sums on the driver (one number for each source and 10,000 shards).
    Tokens are written once and shuffled only in the join of blocks with slots, and
    there only if the slots are too many to be sent to all executors. Block
    numbers are spread evenly, so a source with a third of all texts is no hot key.
    """
    spark = documents.sparkSession
    blocks = pack_blocks(documents, source, text, path, length, max_rows, separator)
    sizes = blocks.select("source", F.size("tokens").alias("n")).groupBy("source").agg(F.count("*").alias("blocks"), F.sum("n").alias("tokens_available"))
    listed = targets.select("source", "target_share", "max_repeats").where("source is not null")
    wanted = listed.collect()
    names = [t.source for t in wanted]
    # one row a listed source
    available = {r.source: r for r in sizes.where(F.col("source").isin(names)).collect()}
    plan = Plan(wanted, {s: r.blocks for s, r in available.items()}, None if total_tokens is None else -(-total_tokens // length))
    shards = -(-plan.slots // shard_slots)
    draw = partial(_draw, shares=plan.shares, slots=plan.slots, shard_slots=shard_slots, seed=seed)
    drawn = cut(spark.range(shards).mapInPandas(draw, "shard bigint, range bigint, counts array<bigint>"))
    # one row a range and source: the sums of RANGE shards
    sums = drawn.select("range", F.posexplode("counts").alias("s", "n")).groupBy("range", "s").agg(F.sum("n").alias("n"))
    totals = np.zeros((-(-shards // RANGE) + 1, len(plan.sources)), np.int64)
    for r in sums.toLocalIterator():
        totals[r.range + 1, r.s] = r.n
    starts = np.cumsum(totals, axis=0)
    # what a source that is not drawn up to its limit has left
    extra = np.maximum(plan.caps - starts[-1], 0) if shards else plan.caps
    placed = drawn.groupBy("range").applyInPandas(_offsets, "shard bigint, range bigint, counts array<bigint>, before array<bigint>")
    fill = partial(_slots, plan=plan, starts=starts, extra=extra, seed=seed)
    slots = placed.mapInPandas(fill, "shard bigint, slot bigint, source string, block bigint, use bigint")
    mixture = blocks.join(F.broadcast(slots) if plan.slots <= max_rows else slots, ["source", "block"])
    mixture = mixture.select("shard", "slot", "source", "block", "use", "tokens")

    used = mixture.select("source", "use", F.size("tokens").alias("n")).groupBy("source").agg(F.sum("n").alias("tokens_used"), F.max("use").alias("most_uses"))
    # at most one row a listed source
    total = F.sum("tokens_used").over(W.partitionBy(F.lit(1)))
    used = used.withColumn("share_reached", F.col("tokens_used") / total)
    listed = listed.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    report = sizes.drop("blocks").join(listed, "source", "full").join(used, "source", "left")
    zero = F.lit(0).cast("bigint")
    return mixture, report.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("tokens_available", zero).alias("tokens_available"),
        F.coalesce("tokens_used", zero).alias("tokens_used"),
        F.coalesce("most_uses", zero).alias("most_uses"),
        F.coalesce("share_reached", F.lit(0.0)).alias("share_reached"),
    )
