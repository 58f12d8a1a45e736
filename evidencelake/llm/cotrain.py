"""Quality classifier by co-training.

Two linear classifiers see a document from two sides: one its content (which words and punctuation runs it has), one its page
metadata (language, source, size, layout and character shares). Both learn from a bounded sample of labelled documents. Over
some rounds each labels all other documents, and those it is surest of, as many of each class as the class's share asks for,
join the training set of the other. A logistic calibration on labelled documents kept aside weighs the two views; the combined
probability scores all documents. One pair of views is trained for quality and one for toxicity. Features are taken from the
texts once and kept as bytes; rounds and scoring read these.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .scratch import Scratch

#: Labelled documents the classifiers learn from, at most; drawn by hash.
LABELLED = 8_000
#: A round gives each view about so many documents of which the other is surest, with a logit past SURE.
ROUNDS, EXCHANGED, SURE = 3, 400, 2.0
BINS_A_UNIT, DRAWS = 100, 1 << 20
CONTENT_BITS, META_BITS, SIGMAS = 16, 10, 4.0
TARGETS = ("quality", "toxic")
#: A document is kept from this quality on and below this toxicity. Short clean texts show little: half would lose many.
LEAST_QUALITY, MOST_TOXIC = 0.25, 0.5
_U = np.uint64
_MARKS = np.ones(256, dtype=bool)
_MARKS[list(tokens.WHITE)] = False
_MARKS[tokens.ALNUM] = False
_MARKS[65:91] = False
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


@dataclass
class Rows:
    """Binary features: those of row k are ids[of[k]:of[k + 1]]."""

    ids: np.ndarray
    of: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(w[self.ids])))
        return total[self.of[1:]] - total[self.of[:-1]]

    def back(self, err: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, weights=np.repeat(err, np.diff(self.of)), minlength=size)

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.of)[rows]
        of = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(self.of[rows] - of[:-1], n) + np.arange(of[-1])
        return Rows(self.ids[at], of)


def _distinct(doc: np.ndarray, ids: np.ndarray, n: int, bits: int) -> Rows:
    pairs = np.unique(doc.astype(np.int64) << bits | ids.astype(np.int64))
    return Rows(pairs & ((1 << bits) - 1), np.searchsorted(pairs >> bits, np.arange(n + 1)))


def content_rows(c: tokens.Chunk) -> Rows:
    """Hashed distinct words (runs of letters and digits, A-Z lower-cased) and punctuation runs of each document."""
    words, marks = c.lowered().words(tokens.ALNUM), c.words(_MARKS)
    top = _U(64 - CONTENT_BITS)
    ids = np.concatenate((words.hashes() >> top, marks.hashes(1) >> top))
    return _distinct(np.concatenate((words.doc(), marks.doc())), ids, c.n, CONTENT_BITS)


def meta_rows(c: tokens.Chunk, lang: list, source: list) -> Rows:
    """Hashed metadata: language, source, and the size, layout and character shares of each document in steps."""
    words = c.words()

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[c.bounds[1:]] - total[c.bounds[:-1]]).astype(float)

    size, n = np.maximum(np.diff(c.bounds), 1), np.maximum(words.counts, 1)
    inside = tokens.NOT_WHITE[c.data]
    different = np.diff(_distinct(words.doc(), words.hashes() >> _U(32), c.n, 32).of)
    values = (
        np.log2(size), np.log2(n), 10 * different / n, 20 * per_doc(_UPPER[c.data]) / size, 20 * per_doc(_MARKS[c.data]) / size, 20 * per_doc(_DIGIT[c.data]) / size,
        np.log2(1 + per_doc(c.data == 10)), per_doc(inside) / n, 20 * per_doc(c.data >= 128) / size,
    )
    keys = [np.floor(v).astype(np.int64) + 1000 * k for k, v in enumerate(values)]
    keys += [np.array([hash_text(f"{name}={x}") for x in column], dtype=np.int64) for name, column in (("lang", lang), ("source", source))]
    ids = (tokens.splitmix(np.concatenate(keys).view(_U) + _U(1)) >> _U(64 - META_BITS)).astype(np.int64)
    return _distinct(np.tile(np.arange(c.n), len(keys)), ids, c.n, META_BITS)


def hash_text(text: str) -> int:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return int(tokens.span_hashes(tokens._BYTE_KEY[data], np.array([0]), np.array([len(data)]))[0] >> _U(2))


def fit(rows: Rows, y: np.ndarray, bits: int, turns: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, by AdaGrad over the whole of the given rows.

    Only features whose shares in the two classes differ by SIGMAS standard errors take part.
    """
    size, n1 = 1 << bits, max(1.0, y.sum())
    n0 = max(1.0, len(y) - y.sum())
    in1, in0 = rows.back(y, size), rows.back(1 - y, size)
    p = np.clip((in1 + in0) / len(y), 1e-9, 1 - 1e-9)
    use = np.abs(in1 / n1 - in0 / n0) >= SIGMAS * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    use &= in1 + in0 >= 3
    which = use[rows.ids]
    sums = np.concatenate(([0], np.cumsum(which)))
    rows = Rows(rows.ids[which], sums[rows.of])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, bias = np.zeros(size), float(np.log(share / (1 - share)))
    seen, seen_bias = np.full(size, 1e-8), 1e-8
    for _ in range(turns):
        err = 1 / (1 + np.exp(-np.clip(rows.dot(w) + bias, -30, 30))) - y
        g = rows.back(err, size) / len(y) + decay * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
        b = float(err.mean())
        seen_bias += b * b
        bias -= 0.3 * b / np.sqrt(seen_bias)
    return w, bias


def calibrate(logits: np.ndarray, y: np.ndarray, turns: int = 100, penalty: float = 1.0) -> np.ndarray:
    """Weights of the views' logits and a bias, by damped Newton steps; a penalty keeps the views near equal."""
    x = np.column_stack((logits, np.ones(len(y))))
    prior = np.append(np.full(logits.shape[1], 1 / logits.shape[1]), 0.0)

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float(np.logaddexp(0, z).sum() - y @ z + penalty / 2 * ((beta - prior) ** 2).sum())

    beta = prior.copy()
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - y) + penalty * (beta - prior)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty * np.eye(len(beta)), g)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return beta


@dataclass
class Classifier:
    """Both views and their calibration, for one target."""

    views: list[tuple[np.ndarray, float]]
    beta: np.ndarray

    def logits(self, rows: list[Rows]) -> np.ndarray:
        return np.column_stack([np.clip(r.dot(w) + b, -20, 20) for r, (w, b) in zip(rows, self.views, strict=True)])

    def probability(self, rows: list[Rows]) -> np.ndarray:
        x = self.logits(rows)
        return 1 / (1 + np.exp(-np.clip(x @ self.beta[:-1] + self.beta[-1], -30, 30)))


def joined(a: Rows, b: Rows) -> Rows:
    return Rows(np.concatenate((a.ids, b.ids)), np.concatenate((a.of, a.of[-1] + b.of[1:])))


@dataclass
class Pair:
    """Both views of one target in training: what each has been given of the other's surest documents, by id."""

    labelled: list[Rows]
    y: np.ndarray
    learn: np.ndarray
    given: list[dict]  # id: (label, content, meta)

    def fitted(self) -> list[tuple[np.ndarray, float]]:
        out = []
        for v, bits in enumerate((CONTENT_BITS, META_BITS)):
            more = [self.given[v][k] for k in sorted(self.given[v], key=str)]
            rows = joined(self.labelled[v].take(self.learn), _rows([m[1 + v] for m in more]))
            out.append(fit(rows, np.concatenate((self.y[self.learn], [float(m[0]) for m in more])), bits))
        return out

    def wanted(self, exchanged: int) -> dict[int, int]:
        """How many documents of each label a round exchanges."""
        yes = int(round(exchanged * float(self.y[self.learn].mean())))
        return {1: yes, 0: exchanged - yes}

    def classifier(self, aside: np.ndarray) -> Classifier:
        out = Classifier(self.fitted(), np.array([0.5, 0.5, 0.0]))
        rest = np.flatnonzero(aside)
        if len(rest) > 10 and 0 < self.y[rest].mean() < 1:
            out.beta = calibrate(out.logits([r.take(rest) for r in self.labelled]), self.y[rest])
        return out


def surest(pool: DataFrame, views: list[list[tuple[np.ndarray, float]]], wanted: list[dict[int, int]]) -> dict[tuple[int, int, int], list]:
    """For each target, view and label: rows (id, content, meta) of all the pool of which the view is surest, about as many as wanted.

    Logits are counted in bins over the whole pool; the bin in which the wanted number is reached is drawn from by hash of the id.
    """
    held = pool.sparkSession.sparkContext.broadcast(views)
    sides = [(t, v, label) for t in range(len(views)) for v in (0, 1) for label in (0, 1)]

    def bins(batch):
        rows = [_rows(batch.column(c).to_pylist()) for c in ("content", "meta")]
        for k, (t, v, label) in enumerate(sides):
            w, bias = held.value[t][v]
            logit = (rows[v].dot(w) + bias) * (1 if label else -1)
            yield k, np.where(logit > SURE, np.minimum(logit, 20) * BINS_A_UNIT, -1).astype(np.int64)

    def count(batches):
        total = np.zeros((len(sides), 20 * BINS_A_UNIT + 1), dtype=np.int64)
        for batch in batches:
            for k, b in bins(batch):
                total[k] += np.bincount(b[b >= 0], minlength=total.shape[1])
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(total[k, b])], names=["k", "bin", "n"])

    counts = np.zeros((len(sides), 20 * BINS_A_UNIT + 1), dtype=np.int64)
    for r in pool.select("content", "meta").mapInArrow(count, "k long, bin long, n long").groupBy("k", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r.k, r.bin] = r.n
    cuts = []
    for (t, _, label), n in zip(sides, counts, strict=True):
        above = np.cumsum(n[::-1])[::-1]
        at = int((above >= wanted[t][label]).sum()) - 1  # the last bin with enough from it on
        cuts.append((at, (wanted[t][label] - (above[at + 1] if at + 1 < len(n) else 0)) / max(1, n[at]) if at >= 0 else 1.0))

    def take(batches):
        for batch in batches:
            draw = batch.column("draw").to_numpy().view(_U) % _U(DRAWS)
            for k, b in bins(batch):
                at, share = cuts[k]
                some = np.flatnonzero((b >= 0) & ((b > at) | ((b == at) & (draw < share * DRAWS))))
                if len(some):
                    rows = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), *(rows.column(c) for c in ("id", "content", "meta"))], names=["k", "id", "content", "meta"])

    shape = T.StructType([T.StructField("k", T.LongType()), *(pool.schema[c] for c in ("id", "content", "meta"))])
    out: dict[tuple[int, int, int], list] = {}
    for r in pool.mapInArrow(take, shape).collect():
        out.setdefault(sides[r.k], []).append((r.id, r.content, r.meta))
    held.destroy()
    return out


_FEATURES = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("meta", T.BinaryType())])


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The features of each row (text, lang, source first) as bytes, with the columns to keep."""

    def run(batches):
        for batch in batches:
            lang, source = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out: list[list[bytes]] = [[], []]
            for c in tokens.chunks(batch.column(0)):
                rows = slice(c.first, c.first + c.n)
                for k, r in enumerate((content_rows(c), meta_rows(c, lang[rows], source[rows]))):
                    ids = r.ids.astype(np.uint16)
                    out[k] += [ids[a:b].tobytes() for a, b in zip(r.of.tolist(), r.of[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *(pa.array(x, type=pa.binary()) for x in out)], names=[*keep, "content", "meta"])

    source = docs.select("text", "lang", "source", *keep)
    return source.mapInArrow(run, T.StructType([*source.schema.fields[3:], *_FEATURES.fields]))


def _rows(column) -> Rows:
    parts = [np.frombuffer(x, dtype=np.uint16).astype(np.int64) for x in column]
    return Rows(np.concatenate([*parts, np.zeros(0, dtype=np.int64)]), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> dict[str, Classifier]:
    """A classifier for each target. ``docs``: id, draw, content, meta; ``labels``: doc_id and the targets.

    Driver data: features of at most ``labelled`` labelled documents and of those that are exchanged.
    """
    draw = F.xxhash64(F.col("id").cast("string"), F.lit("draw"))
    marked = labels.select(F.col("doc_id").alias("id"), *TARGETS).dropna().groupBy("id").agg(*(F.max(t).alias(t) for t in TARGETS))
    marked = marked.orderBy(draw, "id").limit(labelled)
    if labelled <= 100_000:
        marked = F.broadcast(marked)
    known = docs.join(marked, "id").orderBy("draw", "id", F.xxhash64("content", "meta")).limit(labelled).toArrow()
    pool = docs.join(marked.select("id"), "id", "left_anti")
    rows = [_rows(known[c].to_pylist()) for c in ("content", "meta")]
    aside = np.array([int(tokens.splitmix(np.array([hash_text(str(i))], dtype=_U))[0] % _U(5)) == 0 for i in known["id"].to_pylist()], dtype=bool)
    out, pairs = {}, {}
    for target in TARGETS:
        y = np.minimum(known[target].to_numpy().astype(float), 1.0)
        if len(y) < 20 or not 0 < y[~aside].mean() < 1:  # nothing to learn: all get the share of the labels
            p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
            out[target] = Classifier([(np.zeros(1 << b), 0.0) for b in (CONTENT_BITS, META_BITS)], np.array([0.0, 0.0, np.log(p / (1 - p))]))
        else:
            pairs[target] = Pair(rows, y, np.flatnonzero(~aside), [{}, {}])
    exchanged = min(exchanged, pool.count() // 4) if pairs else 0
    for _ in range(rounds if exchanged else 0):
        found = surest(pool, [pair.fitted() for pair in pairs.values()], [pair.wanted(exchanged) for pair in pairs.values()])
        for t, pair in enumerate(pairs.values()):
            for v in (0, 1):
                for label in (0, 1):
                    for i, *sides in found.get((t, v, label), []):
                        pair.given[1 - v].setdefault(i, (label, *sides))
    return out | {target: pair.classifier(aside) for target, pair in pairs.items()}


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", labelled: int = LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """(id, score, quality_score, toxic_score, content_logit, meta_logit, kept) for every row of ``docs``.

    quality_score and toxic_score are calibrated probabilities, score = quality_score x (1 - toxic_score); kept: quality of
    at least LEAST_QUALITY and toxicity below MOST_TOXIC. Labels that are null are passed over; a document labelled more than once has the
    largest. Null texts are empty; null languages and sources are values of their own. Repeated rows are scored alike. Without
    labels, or with one class only, all documents get the share of the labels (a half without any). An empty table gives an
    empty one. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    source = source.withColumn("draw", F.xxhash64(F.col("id").cast("string"), F.lit("draw")))
    kept_features = Scratch(spark, "cotrain").keep(features(source, ["id", "draw"]), "features")
    held = spark.sparkContext.broadcast(train(spark, kept_features, labels, labelled, rounds))
    names = ["score", "quality_score", "toxic_score", "content_logit", "meta_logit"]

    def run(batches):
        by = held.value
        for batch in batches:
            sides = [_rows(batch.column(c).to_pylist()) for c in (1, 2)]
            good, bad = (by[t].probability(sides) for t in TARGETS)
            x = np.column_stack((good * (1 - bad), good, bad, by["quality"].logits(sides)))
            kept = pa.array((x[:, 1] >= LEAST_QUALITY) & (x[:, 2] < MOST_TOXIC))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(5)), kept], names=["id", *names, "kept"])

    shape = T.StructType([source.schema["id"], *(T.StructField(k, T.DoubleType()) for k in names), T.StructField("kept", T.BooleanType())])
    return kept_features.select("id", "content", "meta").mapInArrow(run, shape)
