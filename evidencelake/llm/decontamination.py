"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive hashes of GRAM words the least (the last of equals) is a fingerprint, in documents and items
alike, so that a shared span of GRAM + WINDOW - 1 = SPAN words shares one. Documents' fingerprints are joined with the items';
each hit is extended to the windows of SPAN words around it, which are looked up among the items' windows by 128 bits of hash.
Items shorter than SPAN are one window of their own length and are looked up at every word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .names import free_name
from .simhash import row_key

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: Item windows up to which the items' index is sent to all executors (40 bytes each); beyond, fingerprints are joined.
BROADCAST_WINDOWS = 1_000_000
_U = np.uint64


def winnow(words: tokens.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a chunk and the word numbers at which they begin, each once."""
    starts = words.window_starts(SPAN)
    if not len(starts):
        return np.zeros(0, dtype=_U), starts
    grams = tokens.span_hashes(hashes, at := np.arange(max(0, len(hashes) - GRAM + 1)), at + GRAM)
    best, where = grams[starts], starts.copy()
    for k in range(1, WINDOW):
        other = grams[starts + k]
        less = other <= best
        best = np.where(less, other, best)
        where = np.where(less, starts + k, where)
    fresh = np.ones(len(where), dtype=bool)
    fresh[1:] = where[1:] != where[:-1]
    return best[fresh], where[fresh]


def windows_around(words: tokens.Words, at: np.ndarray) -> np.ndarray:
    """Starts of the SPAN-word windows that hold the GRAM words at each place, each once, within their documents."""
    if not len(at):
        return at
    doc = np.searchsorted(words.of, at, side="right") - 1
    starts = at[:, None] - np.arange(WINDOW)[None, :]
    good = (starts >= words.of[doc][:, None]) & (starts + SPAN <= words.of[doc + 1][:, None])
    return np.unique(starts[good])


def window_keys(words: tokens.Words, starts: np.ndarray, n: int) -> np.ndarray:
    """128 bits of hash for each window of n words, as two columns."""
    return np.stack([tokens.span_hashes(words.hashes(seed), starts, starts + n, seed) for seed in (0, 1)], axis=1)


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, n, h1, h2, fp) for every window of every item; fp, its fingerprint, is null for items shorter than SPAN."""

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for c in tokens.chunks(batch.column(1)):
                words = c.lowered().words(tokens.ALNUM)
                out = []
                for d in range(c.n):
                    n = int(words.counts[d])
                    if not n:
                        continue
                    length = min(n, SPAN)
                    starts = np.arange(words.of[d], words.of[d] + n - length + 1)
                    keys = window_keys(words, starts, length).view(np.int64)
                    fps = [None] * len(starts)
                    if n >= SPAN:
                        grams = tokens.span_hashes(words.hashes(), at := np.arange(words.of[d], words.of[d + 1] - GRAM + 1), at + GRAM)
                        fps = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(axis=1).view(np.int64).tolist()
                    out += [(names[c.first + d], length, a, b, fp) for (a, b), fp in zip(keys.tolist(), fps, strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["item", "n", "h1", "h2", "fp"])

    source = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "item string, n int, h1 long, h2 long, fp long")


_HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW = [pa.int64(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]


class Index:
    """The items' windows and fingerprints in sorted arrays."""

    def __init__(self, rows: pa.Table):
        h1, h2 = (rows[c].to_numpy().view(_U) for c in ("h1", "h2"))
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        first = np.ones(len(h1), dtype=bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.h1, self.h2 = h1[first], h2[first]
        self.lists = np.append(np.flatnonzero(first), len(h1))
        self.items = rows["item"].take(pa.array(order)).to_pylist()
        self.fps = np.unique(rows["fp"].drop_null().to_numpy().view(_U))
        self.lengths = sorted(rows["n"].unique().to_pylist())

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The number of each window key, -1 where no item has it."""
        lo = np.searchsorted(self.h1, keys[:, 0])
        out = np.full(len(keys), -1)
        for step in range(2):  # two keys that agree in their first half are next to each other
            at = np.minimum(lo + step, len(self.h1) - 1)
            out = np.where((self.h1[at] == keys[:, 0]) & (self.h2[at] == keys[:, 1]), at, out)
        return out


def held_in(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a sorted array has."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def merged_spans(starts: np.ndarray, n: np.ndarray) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(zip(starts.tolist(), (starts + n).tolist(), strict=True)):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"begin": a, "end": b})
    return out


def hits_with_index(docs: DataFrame, index: Index) -> DataFrame:
    """Documents (id, text) against a whole index: (id, n_words, spans, items), without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = held.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for c in tokens.chunks(batch.column(1)):
                words = c.lowered().words(tokens.ALNUM)
                hashes = words.hashes()
                found_at, found_n, found = [], [], []
                for n in index.lengths:
                    if n == SPAN:
                        fps, at = winnow(words, hashes)
                        starts = windows_around(words, at[held_in(index.fps, fps)])
                    else:
                        starts = words.window_starts(n)
                        if len(starts):
                            first = tokens.span_hashes(hashes, starts, starts + n)
                            starts = starts[held_in(index.h1, first)]
                    if len(starts):
                        place = index.place(window_keys(words, starts, n))
                        found_at.append(starts[place >= 0])
                        found.append(place[place >= 0])
                        found_n.append(np.full(len(found[-1]), n))
                at, ns, place = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (found_at, found_n, found))
                doc = np.searchsorted(words.of, at, side="right") - 1
                hit = {}
                for d in np.unique(doc).tolist():
                    mine = doc == d
                    names = {i for p in np.unique(place[mine]).tolist() for i in index.items[index.lists[p] : index.lists[p + 1]] if i is not None}
                    hit[d] = merged_spans(at[mine] - words.of[d], ns[mine]), sorted(names)
                n_words += words.counts.tolist()
                spans += [hit[d][0] if d in hit else [] for d in range(c.n)]
                items += [hit[d][1] if d in hit else [] for d in range(c.n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, type=t) for x, t in zip((n_words, spans, items), _ARROW, strict=True))], names=["id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], *_HITS.fields]))


def hits_by_join(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same by shuffles, for items of any number: fingerprints meet the items' on their hash, then windows on theirs.

    A fingerprint carries the keys of the windows around it, so that texts are read once and not shuffled. Common fingerprints
    meet one row each, as the items' are made distinct first; a window meets the items that hold it after being made distinct
    in its document.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for c in tokens.chunks(batch.column(1)):
                words = c.lowered().words(tokens.ALNUM)
                hashes = words.hashes()
                keys = {}
                for n in lengths:
                    starts = words.window_starts(n)
                    keys[n] = starts, window_keys(words, starts, n).view(np.int64) if len(starts) else np.zeros((0, 2), dtype=np.int64)
                doc, rows = words.doc(), []
                if SPAN in keys:
                    fps, at = winnow(words, hashes)
                    starts, window = keys[SPAN]
                    for fp, p in zip(fps.view(np.int64).tolist(), at.tolist(), strict=True):
                        lo, hi = np.searchsorted(starts, [p - WINDOW + 1, p + 1])
                        rows.append((int(doc[p]), fp, [(int(s - words.of[doc[p]]), SPAN, int(a), int(b)) for s, (a, b) in zip(starts[lo:hi], window[lo:hi], strict=True) if doc[s] == doc[p]]))
                for n in lengths:
                    if n < SPAN:
                        rows += [(int(doc[s]), None, [(int(s - words.of[doc[s]]), n, int(a), int(b))]) for s, (a, b) in zip(*keys[n], strict=True)]
                rows += [(d, None, []) for d in range(c.n)]
                take = pa.array([c.first + r[0] for r in rows])
                window = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), batch.column(2).take(take), pa.array([int(words.counts[r[0]]) for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.int64()), pa.array([[dict(zip(("at", "n", "h1", "h2"), w, strict=True)) for w in r[2]] for r in rows], type=window)],
                    names=["id", "rid", "n_words", "fp", "windows"],
                )

    shape = T.StructType([docs.schema["id"], T.StructField("rid", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("windows", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])))])
    marked = docs.withColumn("rid", F.xxhash64("text")).mapInArrow(run, shape)
    known = windows.where("fp IS NOT NULL").select("fp").distinct()
    near = marked.where("fp IS NOT NULL").join(known, "fp", "left_semi").select("id", "rid", "windows").union(marked.where("fp IS NULL AND size(windows) > 0").select("id", "rid", "windows"))
    spots = near.select("id", "rid", F.explode("windows").alias("w")).select("id", "rid", "w.*").distinct()
    found = spots.join(windows.select("item", "n", "h1", "h2").distinct(), ["n", "h1", "h2"])
    hits = found.groupBy("id", "rid").agg(F.collect_set(F.struct("at", "n")).alias("at"), F.array_sort(F.collect_set("item")).alias("items"))
    base = marked.where("fp IS NULL AND size(windows) = 0").select("id", "rid", "n_words").withColumnRenamed("id", "__id").withColumnRenamed("rid", "__rid")
    joined = base.join(hits, base["__id"].eqNullSafe(hits["id"]) & (base["__rid"] == hits["rid"]), "left")
    merge = F.udf(lambda at: merged_spans(np.array([a[0] for a in at]), np.array([a[1] for a in at])) if at else [], _HITS["spans"].dataType)
    return joined.select(F.col("__id").alias("id"), "n_words", merge("at").alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def benchmark_hits(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, n_words, spans, items) for every document row: its words that lie in an item's window, as merged spans of word
    numbers, and the ids of the items whose windows occur, as strings in order.

    Words are runs of digits, letters a-z (A-Z lower-cased) and all code points above ASCII. Null and wordless texts have no
    words and no hits; items without words are passed over; a null item id marks words but is not listed; repeated rows of
    either table are handled one by one. Empty tables give no rows, or no hits. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    windows = item_windows(items, item_id_col, item_text_col)
    if windows.limit(broadcast_windows + 1).count() <= broadcast_windows:
        return hits_with_index(source, Index(windows.toArrow()))
    return hits_by_join(source, windows, [r.n for r in windows.select("n").distinct().orderBy("n").collect()])


def clean_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` without those whose text has a hit. Each row is judged by itself, rows without an id and rows that
    share one too."""
    name = free_name(docs, "__row")
    keyed = docs.withColumn(name, row_key(id_col, text_col))
    found = benchmark_hits(spark, keyed, items, name, text_col, **params).where(F.size("spans") > 0).select(F.col("id").alias(name)).distinct()
    return keyed.join(found, name, "left_anti").select(*docs.columns)
