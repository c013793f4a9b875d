"""Variant spellings of names: phonetic blocks, Jaro-Winkler and nicknames, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civictally.llm.components import connected_components
from civictally.llm.grams import hash_words, mix
from civictally.llm.names import Name, asking_keys, block_keys, compare, normal_form, parsed
from civictally.session import drop_stored, ship, stored

#: Least comparison score of a link.
ACCEPT = 0.9


def name_variants(fields: list[tuple[str, DataFrame, str, str, str]], accept: float = ACCEPT) -> DataFrame:
    """Texts of a group that name one and the same person or organisation.

    ``fields``: label, table, group column, id column (bigint), name column. Columns:
    ``source_table``, ``grp`` (group, stripped), ``id`` (smallest id of the exact text in
    the group), ``donor`` (a number shared by the texts of one donor within the group).

    Every distinct text is reduced to a normal form; texts of one form are one
    donor. Forms meet in blocks by the phonetic codes of their sorted words, or of all
    words but one with an end of the last; pairs are compared word by word by
    Jaro-Winkler and a nickname table. Two words that are both listed as names of their own
    link nothing, however alike; whether two forms are linked depends on these forms only, not on
    the table. A form that leaves something open (initials for a given name, or a second given name
    that others leave out) is linked to the best form that tells it only, so that two relatives are
    not joined by it. Accepted pairs are clustered by connected components.

    Null or blank groups and names, null ids, and texts that name no donor
    (unitemized sums, matching funds, interest) give no row. Repeated rows collapse. Texts
    are read whole. Other columns are not read; empty tables give no rows.

    Exact texts are combined on the map side before anything else, so that a group
    or a name with a third of all rows costs one row per task. Blocks hold distinct
    forms of one group that agree in the sound of all words but one and in an end of that one, so
    a block grows with the spellings of one name, not with rows; blocks are joined, not
    collected, and the components run over accepted links only.
    """
    spark = fields[0][1].sparkSession
    ship(spark)
    texts = None
    for label, df, group, key, name in fields:
        grp = F.regexp_replace(F.col(group).cast("string"), r"(?U)^\s+|\s+\z", "")
        part = df.select(F.lit(label).alias("source_table"), grp.alias("grp"), F.col(name).alias("text"), F.col(key).cast("bigint").alias("id"))
        texts = part if texts is None else texts.unionByName(part)
    texts = texts.where("grp <> '' and text is not null and id is not null").groupBy("source_table", "grp", "text").agg(F.min("id").alias("id"))

    def normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [normal_form(t) for t in pdf["text"]]
            yield pdf[pdf["text"] != ""].rename(columns={"text": "form"})

    texts = texts.mapInPandas(normalise, "source_table string, grp string, form string, id bigint")
    # a form is known by a hash; only two forms of one group could be confused by it
    texts = stored(texts.select("source_table", "grp", "form", "id", F.xxhash64("source_table", "grp", "form").alias("node")), "names")
    forms = texts.groupBy("node").agg(F.min("form").alias("form"), F.min(F.xxhash64("source_table", "grp")).alias("place"), F.count("*").alias("texts"))

    blocks = stored(forms.mapInArrow(_keyed, "node bigint, form string, texts bigint, met array<bigint>, ask array<bigint>, found array<bigint>"), "names")
    a = blocks.select(F.explode("met").alias("key"), F.col("node").alias("a"))
    b = blocks.select(F.explode("met").alias("key"), F.col("node").alias("b"))
    pairs = a.join(b, "key").where("a < b").select("a", "b").distinct()
    ask = blocks.select(F.explode("ask").alias("key"), F.col("node").alias("a"))
    found = blocks.select(F.explode("found").alias("key"), F.col("node").alias("b"))
    asked = ask.join(found, "key").where("a <> b").select("a", "b").distinct()
    pairs = pairs.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    named = blocks.select(F.col("node").alias("a"), F.col("form").alias("form_a"))
    others = blocks.select(F.col("node").alias("b"), F.col("form").alias("form_b"), F.col("texts").alias("weight"))
    pairs = pairs.join(named, "a").join(others, "b")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["score"] = [compare(x, y) for x, y in zip(pdf["form_a"], pdf["form_b"])]
            pdf = pdf[pdf["score"] >= accept].copy()
            pdf["whole"] = [len(parsed(f).full) > 1 for f in pdf["form_b"]]
            yield pdf[["a", "b", "asked", "whole", "weight", "score"]]

    scored = stored(pairs.mapInPandas(score, "a bigint, b bigint, asked boolean, whole boolean, weight bigint, score double"), "names")
    drop_stored(spark, blocks)
    best = scored.where("asked").groupBy("a").agg(F.max_by("b", F.struct("whole", "score", "weight", "b")).alias("b"))
    links = scored.where("not asked").select("a", "b").unionByName(best)
    members = connected_components(links)
    drop_stored(spark, scored)
    return texts.join(members, "node", "left").select("source_table", "grp", "id", F.coalesce("component", "node").alias("donor"))


#: Forms whose keys a Python worker keeps: one donor's form comes in many groups.
KEPT_FORMS = 50_000
_keys_of: dict[str, list[np.ndarray]] = {}


def _hashed_keys(forms: list[str]) -> list[list[np.ndarray]]:
    """For each kind of key (met, ask, found) the hashed keys of each form."""
    if len(_keys_of) > KEPT_FORMS:
        _keys_of.clear()
    new = list(dict.fromkeys(f for f in forms if f not in _keys_of))
    names = [Name(f) for f in new]
    own = [(block_keys(n), *asking_keys(n)) for n in names]
    flat = [k for keys in own for kind in keys for k in kind]
    ends = np.cumsum([len(kind) for keys in own for kind in keys])
    hashed = np.split(hash_words(flat), ends[:-1]) if own else []
    for i, f in enumerate(new):
        _keys_of[f] = hashed[3 * i : 3 * i + 3]
    return [[_keys_of[f][kind] for f in forms] for kind in range(3)]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        places = b.column("place").to_numpy().astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        lists = []
        for keys in _hashed_keys(b.column("form").to_pylist()):
            counts = np.array([len(k) for k in keys], np.int64)
            # keys of one text in two groups are two keys
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]) ^ np.repeat(places, counts)
            lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(mix(flat).view(np.int64))))
        yield pa.RecordBatch.from_arrays(
            [b.column("node"), b.column("form"), b.column("texts"), *lists], ["node", "form", "texts", "met", "ask", "found"]
        )


def variant_pairs(donors: DataFrame) -> DataFrame:
    """All pairs of texts of one donor: ``source_table``, ``id_a`` < ``id_b``."""
    a = donors.select("source_table", "grp", "donor", F.col("id").alias("id_a"))
    b = donors.select("source_table", "grp", "donor", F.col("id").alias("id_b"))
    return a.join(b, ["source_table", "grp", "donor"]).where("id_a < id_b").select("source_table", "id_a", "id_b")
