"""Terms of a vocabulary counted in texts in one pass, by an automaton of all terms.

The vocabulary is a table. It reaches the tasks in slices of a checked size, each as the automaton of its terms; a text is run
through a slice once, whatever the number of terms, and only labels with a score leave the task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms and characters of a slice at most: about 40 MB as an automaton.
SLICE_TERMS, SLICE_CHARS = 50_000, 1_000_000


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        out.add_word(term, k)
    out.make_automaton()
    return out


def term_counts(found: ahocorasick.Automaton, lengths: list[int], text: str) -> dict[int, int]:
    """How often each term occurs, its own occurrences not overlapping, taken from the left."""
    counts: dict[int, int] = defaultdict(int)
    free: dict[int, int] = {}
    for last, k in found.iter(text):
        if last - lengths[k] + 1 >= free.get(k, 0):
            counts[k] += 1
            free[k] = last + 1
    return counts


def slices(vocabulary: DataFrame, most_terms: int = SLICE_TERMS, most_chars: int = SLICE_CHARS) -> Iterator[list[tuple[str, str, float]]]:
    """The rows (word, label, weight) of a vocabulary in runs of a bounded size; empty and null words are left out."""
    rows = vocabulary.where(F.length("word") > 0).groupBy("word", "label").agg(F.sum("weight").alias("weight"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars"), F.max(F.length("word")).alias("longest")).first()
    if size.longest and size.longest > most_chars:
        raise ValueError("a term of the vocabulary is longer than a slice may be")
    parts = max(1, -(-size.n // most_terms), -(-size.chars // most_chars))
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("word", "label"), F.lit(parts)) == k)
        run: list[tuple[str, str, float]] = []
        chars = 0
        for r in part.toLocalIterator():  # hashing deals unevenly, so a part may make more than one run
            if run and (len(run) == most_terms or chars + len(r.word) > most_chars):
                yield run
                run, chars = [], 0
            run.append((r.word, r.label, float(r.weight)))
            chars += len(r.word)
        if run:
            yield run


def label_scores(docs: DataFrame, id_col: str, text: Column, vocabulary: DataFrame, **limits: int) -> DataFrame:
    """(id, label, score): the weighted counts of a vocabulary's (label, word, weight) words in each row's text, labels above or
    below 0 only. A word counts wherever it occurs, inside other words too; case is folded. Rows that repeat an id add up.

    A null or empty text has no score; null weights count 0.
    """
    source = docs.select(F.col(id_col).alias("id"), F.lower(text).alias("text"))
    terms = vocabulary.select("label", F.lower("word").alias("word"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    shape = T.StructType([source.schema["id"], T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    out = None
    for run in slices(terms, **limits):
        found = source.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(run)), shape)
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], shape)
    return out.groupBy("id", "label").agg(F.sum("score").alias("score")).where("score <> 0")


def _scorer(held):
    def run(batches):
        words = sorted({w for w, _, _ in held.value})
        place = {w: k for k, w in enumerate(words)}
        uses = defaultdict(list)
        for w, label, weight in held.value:
            uses[place[w]].append((label, weight))
        lengths, found = [len(w) for w in words], automaton(words)
        for batch in batches:
            rows, labels, scores = [], [], []
            for k, t in enumerate(batch.column(1)):  # one text at a time leaves the batch
                mine: dict[str, float] = defaultdict(float)
                for term, n in term_counts(found, lengths, t.as_py() or "").items():
                    for label, weight in uses[term]:
                        mine[label] += n * weight
                rows += [k] * len(mine)
                labels += mine.keys()
                scores += mine.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["id", "label", "score"])

    return run


def best_labels(docs: DataFrame, id_col: str, text: Column, vocabulary: DataFrame, default: str | None = "general", **limits: int) -> DataFrame:
    """(id, label, score): the label that scores most for every id, of equals the one with the smallest ``position`` in the
    vocabulary, then by name, null first; the default and 0 where none scores above 0."""
    places = vocabulary.groupBy(F.col("label").alias("placed")).agg(F.min("position").alias("position"))
    scored = label_scores(docs, id_col, text, vocabulary, **limits).where("score > 0").join(places, F.col("label").eqNullSafe(F.col("placed")))
    best = scored.groupBy(F.col("id").alias("bid")).agg(F.min(F.struct((-F.col("score")).alias("less"), "position", "label")).alias("b"))
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    joined = ids.join(best, F.col("id").eqNullSafe(F.col("bid")), "left")
    return joined.select("id", F.when(F.col("b").isNotNull(), F.col("b.label")).otherwise(F.lit(default)).alias("label"), F.coalesce(-F.col("b.less"), F.lit(0.0)).alias("score"))
