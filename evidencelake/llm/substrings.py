"""Repeated passages by recompression.

Every document is parsed in rounds. A round first names each run of equal neighbours, then each pair of a symbol that a coin
calls left with a following one that it calls right. Names and coins are hashes of what they stand for, so all tasks agree on
them without a common dictionary, and equal passages get equal symbols but for some at their ends: where a run or a pair could
reach beyond. For a window of words the symbols that cannot depend on anything outside form an interior range; the longest of
them after ROUNDS rounds (or after the last that left any) is the window's anchor. Equal windows have equal anchors, so a
window whose anchor stands in no other text has no copy. Neighbouring windows share their anchor, so anchors are many times
fewer than windows; the windows of shared anchors are verified by their own hashes of 96 bits.

Rows meet on a hash in a shuffle and are walked in sorted order, one at a time. Before, each task settles what it can see: a
symbol or window that a task finds shared sends two rows on, not one for each occurrence, so a passage that many documents
share is no hot group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .scratch import Scratch

WINDOW, ROUNDS = 50, 4
#: Rows without an id count as one document that comes after all others.
LAST = 2**63 - 1
#: Bytes of text that a task looks over together before rows go on.
LOOK_OVER = 1 << 22
_U = np.uint64
_RUN, _PAIR = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Flags of the rows that differ from the row before in any column."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def longest(symbols: np.ndarray, span: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range of symbols the one of most words, by a table of the best in ranges of 1, 2, 4, ... symbols.

    Of equally long ones the greatest name wins, and of its places the first.
    """
    weight = np.minimum(span, 255).astype(_U) << _U(56) | symbols >> _U(8)
    best, out, length = np.arange(len(symbols)), np.zeros(len(lo), dtype=np.int64), hi - lo
    size = 1
    while True:
        now = np.flatnonzero((length >= size) & (length < 2 * size))
        a, b = best[lo[now]], best[hi[now] - size]
        out[now] = np.where(weight[b] > weight[a], b, a)
        if not (length >= 2 * size).any():
            return out
        a, b = best[: len(best) - size], best[size:]
        best = np.where(weight[b] > weight[a], b, a)
        size *= 2


def anchors(symbols: np.ndarray, doc: np.ndarray, starts: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The anchor symbol and its place, for the windows that begin at ``starts``. ``doc`` parts the documents."""
    lo, hi = starts.copy(), starts + window
    end, at = len(symbols), np.arange(len(symbols))
    name, place = np.empty(len(starts), dtype=_U), np.empty(len(starts), dtype=np.int64)
    open_ = np.arange(len(starts))

    def choose(which: np.ndarray) -> None:
        best = longest(symbols, np.diff(np.append(at, end)), lo[which], hi[which])
        name[open_[which]], place[open_[which]] = symbols[best], at[best]

    def narrow(new_lo: np.ndarray, new_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that the next symbols leave nothing of take their anchor from the present ones."""
        nonlocal open_
        empty = new_lo >= new_hi
        if empty.any():
            choose(np.flatnonzero(empty))
        open_ = open_[~empty]
        return new_lo[~empty], new_hi[~empty]

    with np.errstate(over="ignore"):
        for turn in range(rounds):
            first = np.flatnonzero(_changes(symbols, doc))  # runs of equal symbols
            length = np.diff(np.append(first, len(symbols)))
            of = np.repeat(np.arange(len(first)), length)
            lo, hi = narrow(of[lo] + 1, of[hi - 1])
            names = symbols[first]
            symbols = np.where(length > 1, tokens.splitmix(names * _RUN + length.astype(_U)), names)
            doc, at = doc[first], at[first]
            right = (tokens.splitmix(symbols + _U(turn + 1) * _PAIR) & _U(1)).astype(bool)  # pairs of a left and a right one
            joined = np.zeros(len(symbols), dtype=bool)
            joined[1:] = right[1:] & ~right[:-1] & (doc[1:] == doc[:-1])
            first = np.flatnonzero(~joined)
            of = np.cumsum(~joined) - 1
            lo, hi = narrow(of[lo] + right[lo], of[hi - 1] + right[hi - 1])
            names = symbols[first]
            pair = tokens.splitmix(tokens.splitmix(names * _PAIR) + symbols[np.minimum(first + 1, len(symbols) - 1)])
            symbols = np.where(np.append(joined[1:], False)[first], pair, names)
            doc, at = doc[first], at[first]
        choose(np.arange(len(open_)))
    return name, place


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == _U else c) for c in columns], names=names)


_ANCHOR = ["kind", "key", "rid", "doc", "span"]
_ANCHOR_DDL = "kind int, key long, rid long, doc long, span long"
DOC, OPEN, SETTLED = 0, 1, 2


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """Rows of three kinds: a document of at least a window; an anchor that others may share; one that a task finds shared.

    rid is the hash of the text. An anchor row stands for the windows that begin at word span >> 32, as many as the low half
    of span says. A row of span 0 tells others that the anchor stands in its text, and asks for nothing itself.
    """

    def settle(rows: list[list[np.ndarray]]):
        key, rid, doc, span = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((span, doc, rid, key))
        key, rid, doc, span = (c[order] for c in (key, rid, doc, span))
        first = np.flatnonzero(_changes(key))
        last = np.append(first[1:], len(key)) - 1
        several = rid[first] != rid[last]
        shared = several[np.cumsum(_changes(key)) - 1]
        yield _batch(_ANCHOR, np.where(shared, SETTLED, OPEN).astype(np.int32), key, rid, doc, span)
        ends = np.concatenate((first[several], last[several]))
        yield _batch(_ANCHOR, np.full(len(ends), OPEN, dtype=np.int32), key[ends], rid[ends], doc[ends], np.zeros(len(ends), dtype=np.int64))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, rids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in tokens.chunks(batch.column(2)):
                words = c.words()
                rows = slice(c.first, c.first + c.n)
                whole = np.flatnonzero(words.counts >= window)
                zero = np.zeros(len(whole), dtype=np.int64)
                yield _batch(_ANCHOR, zero.astype(np.int32), zero, rids[rows][whole], ids[rows][whole], zero)
                starts, d = words.window_starts(window), words.doc()
                if len(starts):
                    name, place = anchors(words.hashes(), d, starts, window)
                    first = np.flatnonzero(_changes(name, place, d[starts]))
                    n = np.diff(np.append(first, len(starts)))
                    own = d[starts[first]]
                    held.append([name[first], rids[rows][own], ids[rows][own], (starts[first] - words.of[own]) << 32 | n])
                size += len(c.data)
                if held and size > LOOK_OVER:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    return docs.mapInArrow(run, _ANCHOR_DDL)


def shared_anchors(rows: DataFrame) -> DataFrame:
    """Of open anchor rows sorted by key and text, those whose key stands in two texts: (rid, doc, span).

    A task holds one batch and, of a key that it has seen in one text only, that text's rows of the least document: the others
    are copies of it and need no search.
    """

    def run(batches):
        left = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if left is not None:
                columns = [np.concatenate(x) for x in zip(left, columns, strict=True)]
            key, rid, doc, span = columns
            if not len(key):
                continue
            first = np.flatnonzero(_changes(key))
            group = np.cumsum(_changes(key)) - 1
            shared = np.zeros(len(first), dtype=bool)
            shared[group[rid != rid[first][group]]] = True
            out = shared[group] & (span > 0)
            yield _batch(["rid", "doc", "span"], *(c[out] for c in columns[1:]))
            last = np.flatnonzero(group == group[-1])
            if shared[-1]:  # what follows of this key is shared: one row of the first text is enough to show it
                left = [c[last[:1]].copy() for c in columns]
                left[1][:], left[3][:] = ~rid[last[-1]], 0
            else:
                left = [c[last[doc[last] == doc[last[0]]]] for c in columns]

    opened = rows.where(F.col("kind") == OPEN).select("key", "rid", "doc", "span")
    return opened.repartition("key").sortWithinPartitions("key", "rid", "doc").mapInArrow(run, "rid long, doc long, span long")


_WINDOW = ["settled", "h1", "h2", "doc", "rid", "at"]
_WINDOW_DDL = "settled boolean, h1 long, h2 int, doc long, rid long, at int"


def window_rows(texts: DataFrame, window: int) -> DataFrame:
    """The windows that texts with their shared anchors ask to verify, by hash; ``at`` is its first word. A
    window that the same task has found in a smaller document is settled."""

    def settle(rows: list[list[np.ndarray]]):
        h1, h2, doc, rid, at = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((at, rid, doc, h2, h1))
        h1, h2, doc, rid, at = (c[order] for c in (h1, h2, doc, rid, at))
        change = _changes(h1, h2)
        settled = doc > doc[np.flatnonzero(change)][np.cumsum(change) - 1]
        yield _batch(_WINDOW, settled, h1, h2, doc, rid, at)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, rids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            spans = batch.column(3)
            for c in tokens.chunks(batch.column(2)):
                words = c.words()
                mark = np.zeros(len(words.starts) + 1, dtype=np.int64)
                for d in range(c.n):
                    s = spans[c.first + d].values.to_numpy()
                    np.add.at(mark, words.of[d] + (s >> 32), 1)
                    np.add.at(mark, words.of[d] + (s >> 32) + (s & 0xFFFFFFFF), -1)
                starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                if len(starts):
                    own = words.doc()[starts]
                    a, b = (tokens.span_hashes(words.hashes(seed), starts, starts + window, seed) for seed in (0, 1))
                    rows = slice(c.first, c.first + c.n)
                    held.append([a, (b >> _U(32)).astype(np.uint32).view(np.int32), ids[rows][own], rids[rows][own], (starts - words.of[own]).astype(np.int32)])
                size += len(c.data)
                if held and size > LOOK_OVER:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    return texts.mapInArrow(run, _WINDOW_DDL)


def covered_windows(rows: DataFrame) -> DataFrame:
    """Of window rows sorted by hash and document, those of a larger document than the first: (doc, rid, at)."""

    def run(batches):
        left = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if left is not None:
                columns = [np.concatenate(x) for x in zip(left, columns, strict=True)]
            h1, h2, doc, rid, at = columns
            if not len(h1):
                continue
            change = _changes(h1, h2)
            first = np.flatnonzero(change)
            out = doc > doc[first][np.cumsum(change) - 1]
            left = [c[first[-1] : first[-1] + 1] for c in columns]
            yield _batch(["doc", "rid", "at"], doc[out], rid[out], at[out])

    opened = rows.where("NOT settled").drop("settled")
    return opened.repartition("h1").sortWithinPartitions("h1", "h2", "doc").mapInArrow(run, "doc long, rid long, at int")


def asked_windows(source: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The windows to verify, and the rows that copy a whole text of a smaller document."""
    rows = scratch.keep(anchor_rows(source.select("doc", "rid", "text"), window), "anchors")
    long = rows.where(F.col("kind") == DOC).select("rid", "doc").distinct()
    whole = source.select("rid", F.xxhash64(F.lit(1), "text").alias("more"), "doc").distinct().join(long, ["rid", "doc"])  # equal by 128 bits
    least = whole.groupBy("rid", "more").agg(F.min("doc").alias("least"))
    copies = scratch.keep(whole.join(least, ["rid", "more"]).where("doc > least").select("rid", "doc").distinct(), "copies")
    found = rows.where(F.col("kind") == SETTLED).select("rid", "doc", "span").union(shared_anchors(rows))
    found = found.join(copies, ["rid", "doc"], "left_anti")
    spans = found.groupBy("rid", "doc").agg(F.collect_set("span").alias("spans"))
    asked = source.select("doc", "rid", "text").join(spans.hint("shuffle_hash"), ["doc", "rid"]).select("doc", "rid", "text", "spans")
    windows = scratch.keep(window_rows(asked, window), "windows")
    scratch.drop(rows)
    return windows, copies


def cut_words(batches, window: int):
    """(id, n_words, n_removed, kept) of rows (id, text, starts of windows that go, whether all goes)."""
    for batch in batches:
        counts, removed, kept = [], [], []
        for c in tokens.chunks(batch.column(1)):
            words = c.words()
            gone = np.zeros(len(words.starts) + 1, dtype=np.int64)
            for d in range(c.n):
                starts = batch.column(2)[c.first + d]
                if batch.column(3)[c.first + d].as_py():
                    gone[words.of[d]] += 1
                    gone[words.of[d + 1]] -= 1
                elif starts.is_valid:
                    begin = words.of[d] + starts.values.to_numpy()
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, begin + window, -1)
            stay = np.cumsum(gone[:-1]) == 0
            sums = np.concatenate(([0], np.cumsum(~stay)))
            to = np.concatenate(([0], np.cumsum(np.where(stay, words.ends - words.starts + 1, 0))))
            out = np.full(to[-1], 32, dtype=np.uint8)
            letter = np.ones(to[-1], dtype=bool)
            letter[to[1:][stay] - 1] = False
            inside = np.zeros(len(c.data) + 1, dtype=np.int64)
            inside[words.starts[stay]] += 1
            inside[words.ends[stay]] -= 1
            out[letter] = c.data[np.cumsum(inside[:-1]) > 0]
            text = out.tobytes()
            bounds = to[words.of].tolist()
            kept += [text[a : max(a, b - 1)] for a, b in zip(bounds, bounds[1:], strict=False)]
            counts.append(words.counts)
            removed.append(sums[words.of[1:]] - sums[words.of[:-1]])
        n, less = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (counts, removed))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(less), pa.array(kept, type=pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept) for every row: kept has, joined by one space, the words that are in no window of
    ``window`` words whose sequence also starts in a document with a smaller id.

    Words are runs of anything but ASCII white space. Windows are judged on the input. Null texts and texts without words give
    an empty kept; texts shorter than a window lose nothing. Rows without an id count as one document after all others; rows
    that repeat an id are one document, so they do not remove each other's words. An empty table gives an empty one.

    Texts are read three times and shuffled twice; copies of a whole text are found by its hash and enter no search.
    """
    scratch = Scratch(spark, "passages")
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("rid"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    windows, copies = asked_windows(source, window, scratch)
    scratch.release()
    covered = windows.where("settled").select("doc", "rid", "at").union(covered_windows(windows))
    covered = scratch.keep(covered.groupBy("doc", "rid").agg(F.collect_set("at").alias("starts")), "covered")
    scratch.drop(windows)
    scratch.release()
    marks = covered.select("doc", "rid", "starts", F.lit(False).alias("all")).union(copies.select("doc", "rid", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("all")))
    marks = marks.groupBy("doc", "rid").agg(F.first("starts", ignorenulls=True).alias("starts"), F.max("all").alias("all"))
    joined = source.join(marks.hint("shuffle_hash"), ["doc", "rid"], "left").select("id", "text", "starts", F.coalesce("all", F.lit(False)).alias("all"))
    shape = T.StructType([joined.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(lambda batches: cut_words(batches, window), shape)
