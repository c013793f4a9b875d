"""Mapping free-entered values to a canonical list: token repair, then soft TF-IDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civictally.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, is_small, lookup_join
from civictally.session import cut

# Words that stand for no value.
NO_VALUE = ("none", "n/a", "na", "unknown")
# Words of a legal form or article, which tell no two names apart. A parameter of
# the operator, so that a list in another language brings its own.
EMPTY_WORDS = ("the", "llc", "inc", "ltd")
#: Least score at which an entry is taken.
ACCEPT = 0.7
ABBREVIATION = 0.9
#: Least letters of a token that is repaired by two edits; shorter ones by a single edit.
TWO_EDITS = 6
#: Edits of long texts are looked for by deletions among so many first letters, which
#: finds all of them, as both texts are cut at the same length.
PREFIX = 8
#: Most letters of a listed word that has contractions.
LONG_WORD = 32
#: Longest name without spaces that must be met exactly: shorter ones are abbreviations.
EXACT_UP_TO = 6


def tokens(x: Column) -> Column:
    """Words of an entry: lower case, without remarks in brackets, full stops and apostrophes."""
    t = F.regexp_replace(F.lower(x), r"\([^)]*\)", " ")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[.'’]", "")
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shorter(t: Column) -> Column:
    """Each text that lacks one of the characters."""
    places = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))


def _variants(t: Column, edits: int = 1) -> Column:
    """The first PREFIX letters of a text and each text that lacks one, or two, of them: two texts
    so many edits apart (a swap of neighbours is one) have one in common. At most
    37 short texts, however long the text."""
    start = F.substring(t, 1, PREFIX)
    once = _shorter(start)
    out = [F.array(start), once]
    if edits > 1:
        out.append(F.flatten(F.transform(once, _shorter)))
    return F.array_distinct(F.concat(*out))


def _token_variants(t: Column) -> Column:
    return F.when(F.length(t) >= TWO_EDITS - 1, _variants(t, 2)).otherwise(_variants(t))


def _edits(a: Column, b: Column) -> Column:
    """Edits between two texts, null beyond two; swapped neighbours are one edit."""
    distance = F.levenshtein(a, b, 2)
    swapped = (distance == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.when(F.abs(F.length(a) - F.length(b)) <= 2, F.when(swapped, 1).when(distance >= 0, distance))


def _similarity(a: Column, b: Column, edits: Column) -> Column:
    """1 less the edits per character of the longer text."""
    return 1 - edits / F.greatest(F.length(a), F.length(b))


def _openings(word: Column) -> Column:
    """The first letter with any two later ones in their order, and with any later one: every
    contraction of the word begins with one of these."""
    first = F.substr(word, F.lit(1), F.lit(1))
    rest = F.split(F.substring(word, 2, LONG_WORD), "")
    pairs = F.flatten(F.transform(rest, lambda x, i: F.transform(F.slice(rest, i + 2, LONG_WORD), lambda y: F.concat(x, y))))
    found = F.transform(F.array_distinct(F.concat(rest, pairs)), lambda x: F.concat(first, x))
    return F.when(F.length(word).between(3, LONG_WORD), found).otherwise(F.array().cast("array<string>"))


def _abbreviation(short: Column, word: Column) -> Column:
    """Up to ABBREVIATION for a prefix, less for a contraction sharing a shorter beginning."""
    lengths = F.sequence(F.lit(1), F.length(short))
    common = F.size(F.filter(lengths, lambda i: F.substr(short, F.lit(1), i) == F.substr(word, F.lit(1), i)))
    return ABBREVIATION - 0.1 * (1 - common / F.length(short))


def _hint(df: DataFrame, max_rows: int) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows) else df


def _list_hint(posting: DataFrame, max_rows: int) -> Callable[[DataFrame], DataFrame]:
    """How tables made from the list's words are joined: by broadcast if the largest of them, the
    deletions, beginnings or openings of all words, is small. One job measures them all."""
    n = F.length("word").cast("double")
    parts = [F.lit(40.0), n, F.pow(F.least(n, F.lit(LONG_WORD)), F.lit(2)) / 2]
    rows, size = posting.agg(F.greatest(*[F.coalesce(F.sum(p), F.lit(0.0)) for p in parts]), F.coalesce(F.sum(F.greatest(*[p * (n + 64) for p in parts])), F.lit(0.0))).first()
    return F.broadcast if rows <= max_rows and size <= BROADCAST_BYTES else lambda df: df


def match_values(
    values: DataFrame, reference: DataFrame, accept: float = ACCEPT, max_rows: int = BROADCAST_ROWS, empty_words: tuple[str, ...] = EMPTY_WORDS
) -> DataFrame:
    """The reference item meant by each distinct value.

    ``values``: ``kind``, ``value``, distinct; ``reference``: ``ref_id``, ``kind``,
    ``canonical_name``, ``short_name``. Result: ``kind``, ``value``, ``ref_id`` (0 if
    none) and ``score``.

    Every distinct token that is no word of the list is joined to the list's words
    through texts lacking one or two characters, so that all words within two edits are found
    (one for tokens under TWO_EDITS letters), or as a prefix or contraction of a word; a contraction
    is looked up by its first three letters among those that the words allow. The entry without its spaces is such a
    token as well, set against the names without theirs, a name that begins with *not* also as a
    word with *un*: that repairs lost and misplaced spaces by one edit. Corrected tokens are then
    weighted by their rarity in the list. A name can only reach ``accept`` if it shares one of the
    weightiest tokens of the entry, those without which the rest is too light; these alone look up
    candidates, which are then scored by all their words. So a word that half of all entries and names
    have meets nobody by itself. A tie between
    two names, or a score below ``accept``, is unmatched.
    """
    ref = reference.where("ref_id is not null and kind is not null and canonical_name is not null")
    words_of = ref.select("kind", "ref_id", F.array_distinct(_without(tokens(F.col("canonical_name")), empty_words)).alias("words"))
    posting = words_of.select("kind", "ref_id", F.explode("words").alias("word"))
    sizes = words_of.groupBy("kind").agg(F.count("*").alias("names"))
    rarity = (
        posting.groupBy("kind", "word").agg(F.count("*").alias("n")).join(sizes, "kind")
        .select("kind", "word", F.log1p(F.col("names") / F.col("n")).alias("weight"))
    )
    posting = posting.join(rarity, ["kind", "word"])
    norms = posting.groupBy("kind", "ref_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("name_norm"))
    posting = cut(posting.join(norms, ["kind", "ref_id"]))
    words = cut(posting.select("kind", "word", "weight").distinct())
    small = _list_hint(posting, max_rows)
    name = tokens(F.col("canonical_name"))
    denied = F.when((F.get(name, F.lit(0)) == "not") & (F.size(name) == 2), F.concat(F.lit("un"), F.get(name, F.lit(1))))
    written = [(F.array_join(name, ""), False), (denied, True), (F.array_join(tokens(F.col("short_name")), ""), True)]
    squashed = ref.select("kind", "ref_id", F.explode(F.array(*[F.struct(w.alias("word"), F.lit(e).alias("exact")) for w, e in written])).alias("s"))
    squashed = squashed.select("kind", "ref_id", "s.*").where("word <> ''")

    raw = tokens(F.col("value"))
    split = values.select("kind", "value", F.array_join(raw, "").alias("joined"), F.array_distinct(_without(raw, empty_words)).alias("tokens"))
    split = cut(split)
    own = split.select("kind", "value", F.explode("tokens").alias("token"))

    # token repair over distinct tokens
    distinct = own.select("kind", "token").distinct()
    listed = small(words.withColumnRenamed("word", "token"))
    judged = cut(distinct.join(listed, ["kind", "token"], "left"))
    known, unknown = judged.where("weight is not null"), judged.where("weight is null").select("kind", "token")
    near = words.select("kind", "word", "weight", F.explode(_token_variants(F.col("word"))).alias("variant"))
    edits = _edits(F.col("token"), F.col("word"))
    edited = (
        unknown.select("kind", "token", F.explode(_token_variants(F.col("token"))).alias("variant"))
        .where("variant <> ''")
        .join(small(near), ["kind", "variant"])
        .where((edits == 1) | ((edits == 2) & (F.length("token") >= TWO_EDITS) & (F.length("word") >= TWO_EDITS)))
        .select("kind", "token", "word", "weight", _similarity(F.col("token"), F.col("word"), edits).alias("sim"))
    )
    shorter = F.length("token") < F.length("word")
    prefixes = words.select(
        "kind", "word", "weight", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr("word", F.lit(1), i))).alias("token")
    )
    shortened = unknown.join(small(prefixes), ["kind", "token"]).where(shorter)
    opened = words.select("kind", "word", "weight", F.explode(_openings(F.col("word"))).alias("opening"))
    inner = F.array_join(F.split("token", ""), "%")
    contracted = (
        unknown.where(F.length("token") >= 2)
        .withColumn("opening", F.substring("token", 1, 3))
        .join(small(opened), ["kind", "opening"])
        .where(F.length("token") <= F.length("word") * 0.75)
        .where(F.like(F.col("word"), F.concat(inner, F.lit("%"))))
    )
    columns = ["kind", "token", "word", "weight", "sim"]
    repaired = known.select("kind", "token", F.col("token").alias("word"), "weight", F.lit(1.0).alias("sim"))
    sim = _abbreviation(F.col("token"), F.col("word"))
    for part in (edited, shortened.withColumn("sim", sim), contracted.withColumn("sim", sim)):
        repaired = repaired.unionByName(part.select(*columns))
    repaired = repaired.groupBy("kind", "token", "word", "weight").agg(F.max("sim").alias("sim")).where("sim >= 0.5")
    # a token weighs as much as the word nearest to it
    every = F.collect_list(F.struct("word", "sim")).alias("words")
    repaired = cut(repaired.groupBy("kind", "token").agg(F.max_by("weight", F.struct("sim", "weight")).alias("token_weight"), every))

    # soft TF-IDF over corrected tokens; a token without any correction weighs as much as the rarest word
    most = sizes.select("kind", F.log1p(F.col("names") / 0.5).alias("most"))
    weighted = own.join(repaired, ["kind", "token"], "left").join(small(most), "kind")
    weight = F.coalesce("token_weight", "most")
    parts = F.array_sort(F.collect_list(F.struct((-weight).alias("light"), "token", F.coalesce("words", F.array().cast("array<struct<word:string,sim:double>>")).alias("words"))))
    entries = weighted.groupBy("kind", "value").agg(parts.alias("parts"))
    square = F.aggregate("parts", F.lit(0.0), lambda total, p: total + p["light"] * p["light"])
    entries = cut(entries.select("kind", "value", "parts", square.alias("square")))
    # what the tokens from a place on weigh together; lighter ones cannot reach a score of ``accept`` alone
    beyond = lambda i: F.aggregate(F.slice("parts", i + 1, F.size("parts")), F.lit(0.0), lambda total, p: total + p["light"] * p["light"])
    heavy = F.filter("parts", lambda p, i: beyond(i) >= (accept * accept - 1e-6) * F.col("square"))
    probes = entries.select("kind", "value", F.explode(heavy).alias("p")).select("kind", "value", F.explode("p.words.word").alias("word")).distinct()
    met = probes.join(small(posting.select("kind", "word", "ref_id")), ["kind", "word"]).select("kind", "value", "ref_id").distinct()
    named = posting.groupBy("kind", "ref_id", "name_norm").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("listed"))
    # a word of the name counts once, for the token nearest to it
    soft = F.flatten(F.transform("parts", lambda p: F.transform(p["words"], lambda w: F.struct(w["word"].alias("word"), (-p["light"] * w["sim"]).alias("part")))))
    scored = met.join(entries.select("kind", "value", "square", soft.alias("soft")), ["kind", "value"]).join(small(named), ["kind", "ref_id"])
    nearest = lambda word: F.array_max(F.transform(F.filter("soft", lambda x: x["word"] == word), lambda x: x["part"]))
    dot = F.aggregate(F.map_entries("listed"), F.lit(0.0), lambda total, e: total + F.coalesce(nearest(e["key"]), F.lit(0.0)) * e["value"])
    scores = scored.select("kind", "value", "ref_id", (dot / F.col("name_norm") / F.sqrt("square")).alias("score"))

    # whole entries without spaces, by the same repair
    whole = split.select("kind", "value", "joined").where("joined <> ''")
    close = squashed.select(
        "kind", "ref_id", "exact", F.col("word").alias("name"), F.explode(_variants(F.col("word"))).alias("variant")
    )
    edits = _edits(F.col("joined"), F.col("name"))
    spaced = (
        whole.select("kind", "value", "joined", F.explode(_variants(F.col("joined"))).alias("variant"))
        .join(small(close), ["kind", "variant"])
        .where((F.col("name") == F.col("joined")) | ((edits == 1) & ~F.col("exact") & (F.length("name") > EXACT_UP_TO)))
        .select("kind", "value", "ref_id", _similarity(F.col("joined"), F.col("name"), edits).alias("score"))
    )
    ranked = scores.unionByName(spaced).groupBy("kind", "value", "ref_id").agg(F.round(F.max("score"), 9).alias("score")).where(F.col("score") >= accept)
    # the best name, and how many are as good
    top = ranked.groupBy("kind", "value").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "ref_id"))).alias("r"))
    tied = F.coalesce(F.get("r", F.lit(1))["minus"] == F.get("r", F.lit(0))["minus"], F.lit(False))
    winner = top.where(~tied).select("kind", "value", F.get("r", F.lit(0))["ref_id"].alias("ref_id"), (-F.get("r", F.lit(0))["minus"]).alias("score"))
    return values.select("kind", "value").join(winner, ["kind", "value"], "left").select(
        "kind", "value", F.coalesce("ref_id", F.lit(0)).alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def _without(t: Column, empty: tuple[str, ...]) -> Column:
    """Without words that say nothing, unless there are no others."""
    kept = F.filter(t, lambda w: ~w.isin(*empty))
    return F.when(F.size(kept) > 0, kept).otherwise(t)


def map_to_canonical(
    fields: list[tuple[str, DataFrame, str, str, str]], reference: DataFrame, max_rows: int = BROADCAST_ROWS, **options
) -> DataFrame:
    """The item meant by every typed value of several fields.

    ``fields``: label, table, key column, value column and kind of each. Columns:
    ``source_field``, ``row_key`` (bigint), ``ref_id`` (0 if the list has none).

    Values that are null, blank, a word for no value, or exactly a listed name of
    the kind give no row. All others give one row for each row they come from, so
    repeated rows and null keys are kept. Values of punctuation only are
    unmatched. An empty list leaves all unmatched. Other columns are not read.

    Matching runs once for each distinct value. Its result is looked up by a join in
    which a value typed in a third of all rows is broadcast, not shuffled.
    """
    names = reference.where("canonical_name is not null").select("kind", F.col("canonical_name").alias("value")).distinct()
    rows = None
    for label, df, key, value, kind in fields:
        part = df.select(F.lit(label).alias("source_field"), F.col(key).cast("bigint").alias("row_key"), F.lit(kind).alias("kind"), F.col(value).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    stripped = F.regexp_replace("value", r"(?U)^\s+|\s+\z", "")
    rows = rows.where(F.col("value").isNotNull() & (stripped != "") & ~F.lower(stripped).isin(*NO_VALUE))
    counted = rows.groupBy("kind", "value").agg(F.count("*").alias("rows")).join(_hint(names, max_rows), ["kind", "value"], "left_anti")
    counted = cut(counted)
    matched = cut(counted.join(match_values(counted, reference, max_rows=max_rows, **options), ["kind", "value"]))
    return lookup_join(rows, matched, ["kind", "value"], "rows", max_rows).select("source_field", "row_key", "ref_id")
