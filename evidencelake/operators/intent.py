"""What a research question asks for: slots filled from vocabulary tables, a goal, and the question with synonyms added.

A vocabulary names things by slot: (slot, name, canonical, position), several names a canonical one. Questions are cut into runs of
tokens as long as the longest name has, which meet the names by an equi-join, so a vocabulary may have any size; of the names found
for a slot the longest wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Goals by cue, the first that a question holds. Fixed values.
GOALS = (
    ("calibration", ("calibrat", "experimental calibration", "standardize")), ("review", ("review", "overview", "state of the art", "summar")), ("identification", ("identif", "classify", "discriminate", "detect")), ("application", ("appl", "case study", "example", "field study")),
)
#: Names that a question is widened by, at most, for each slot. Fixed value.
SYNONYMS = 10

#: Names up to which a vocabulary is sent to all tasks; a larger one meets the questions by a sorted join.
NAMES = 100_000


def tokens(text: Column) -> Column:
    """Runs of letters, digits, plus and dash in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}+-]+"), F.lit(0))


def slots(queries: DataFrame, vocabulary: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(id, slot, canonical, name, at): for every question and slot the name found in it with most tokens; of equals the one with
    more letters, then the one that stands first (at, from 0), then the smaller position, then canonical.

    Names and questions meet as tokens, so a name inside a longer word is not found. Null texts, and names that are null or have no
    token, fill nothing. Questions that repeat an id are one.
    """
    names = vocabulary.select("slot", "canonical", "position", "name", tokens(F.col("name")).alias("t")).where(F.size("t") > 0).withColumns({"n": F.size("t"), "phrase": F.array_join("t", " ")}).drop("t")
    counts = {r.n: r.k for r in names.groupBy("n").agg(F.count("*").alias("k")).collect()}  # as many as names differ in length
    lengths = sorted(counts) or [1]
    asked = queries.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(F.col("t"), i + 1, n), " ").alias("phrase")))
        return F.when(F.size("t") >= n, every)

    spots = asked.select("id", F.explode(F.flatten(F.filter(F.array(*map(runs, lengths)), lambda r: r.isNotNull()))).alias("s")).select("id", "s.*")
    # an estimate does not see how many runs a question has, so which side may be sent whole is said here
    hits = spots.join(F.broadcast(names), "phrase") if sum(counts.values()) <= NAMES else spots.hint("merge").join(names, "phrase")
    rank = F.struct((-F.col("n")).alias("n"), (-F.length("phrase")).alias("chars"), "at", "position", "canonical", "name")
    return hits.groupBy("id", "slot").agg(F.min(rank).alias("b")).select("id", "slot", "b.canonical", "b.name", "b.at")


def goal(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for name, cues in reversed(GOALS):
        out = F.when(reduce(lambda a, b: a | b, (low.contains(c) for c in cues)), name).otherwise(out)
    return out


def intents(queries: DataFrame, vocabulary: DataFrame, id_col: str = "query_id", text_col: str = "query", needed: tuple[str, ...] = ("material", "method")) -> DataFrame:
    """(id, query, slots, goal, understood): a map from slot to canonical name; understood with one of the slots that are needed."""
    found = slots(queries, vocabulary, id_col, text_col).groupBy(F.col("id").alias("fid")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "canonical")))).alias("slots"))
    joined = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("query")).join(found, F.col("id").eqNullSafe(F.col("fid")), "left")
    filled = F.coalesce("slots", F.map_from_entries(F.array().cast("array<struct<slot: string, canonical: string>>")))
    known = F.exists(F.array(*map(F.lit, needed)), lambda s: F.map_contains_key(filled, s))
    return joined.select("id", "query", filled.alias("slots"), goal(F.col("query")).alias("goal"), known.alias("understood"))


def expanded(queries: DataFrame, vocabulary: DataFrame, id_col: str = "query_id", text_col: str = "query", most: int = SYNONYMS) -> DataFrame:
    """(id, expanded): every question with the other names of what fills its slots behind it, ``most`` a slot in order of position;
    names that are the question itself, or come twice in any case, are added once."""
    others = vocabulary.where("name IS NOT NULL").groupBy("slot", "canonical").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda s: s["name"]), 1, most).alias("names"))
    found = slots(queries, vocabulary, id_col, text_col).join(others, ["slot", "canonical"])
    added = found.groupBy(F.col("id").alias("fid")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", "names"))), lambda s: s["names"])).alias("names"))
    joined = queries.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("q")).join(added, F.col("id").eqNullSafe(F.col("fid")), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    low = F.transform(names, lambda n: F.lower(n))
    fresh = F.filter(names, lambda n, i: (F.array_position(low, F.lower(n)) == i + 1) & (F.lower(n) != F.lower("q")))
    return joined.select("id", F.array_join(F.concat(F.array("q"), fresh), " ").alias("expanded"))
