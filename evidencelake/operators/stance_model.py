"""A stance model learnt from a labelled table, and its blend with lexicon and discourse.

Texts become hashed words and word pairs; document frequencies are counted by Spark over the whole table. A margin classifier a
class (squared hinge, balanced weights, dual coordinate descent) learns from a bounded, documented sample, and a sigmoid a class
fitted on margins of folds that it did not see turns margins into probabilities. The weights, of a bounded size, score any table in
Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evidence import LEXICON, Lexicon

# Classes in order, weights of model, lexicon and discourse, and discourse markers.
STANCES = ("supporting", "contrasting", "extending", "methodology", "mentioning")
WEIGHTS, NEGATED_WEIGHTS, UNSURE_WEIGHTS, SURE = (0.5, 0.3, 0.2), (0.3, 0.6, 0.1), (0.3, 0.5, 0.2), 0.6
MARKERS = {
    "supporting": ("therefore", "thus", "hence", "furthermore", "moreover", "consequently", "accordingly"),
    "contrasting": ("however", "whereas", "although", "though", "nevertheless", "nonetheless", "conversely", "in contrast", "on the other hand", "despite", "in spite of", "unlike"),
    "methodology": ("we used", "we employed", "we applied", "we measured", "we performed", "following the", "according to the protocol"),
}
# End of fixed values.

BITS = 16
#: Labelled rows of a class that the classifier learns from, drawn by hash.
LEARN_ROWS = 4_000
FOLDS, EPOCHS, COST = 3, 25, 1.0
_WORD = re.compile(r"[^\W_][\w-]+")


def hashed(text: str | None) -> dict[int, float]:
    """Places of the words and word pairs of a text, with one plus the logarithm of how often each occurs."""
    words = _WORD.findall((text or "").lower())
    counts = Counter(zlib.crc32(t.encode()) & ((1 << BITS) - 1) for t in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))))
    return {k: 1.0 + float(np.log(n)) for k, n in counts.items()}


@dataclass
class StanceModel:
    """Weights (class, place and intercept), the places' inverse frequencies, and slope and offset of each class's sigmoid."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    sigmoid: np.ndarray
    learnt_from: int

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights at length one; the last place is the intercept's."""
        found = hashed(text)
        at = np.array(sorted(found), dtype=np.int64)
        x = np.array([found[k] for k in at.tolist()]) * self.idf[at]
        length = float(np.sqrt((x * x).sum()))
        return np.append(at, 1 << BITS), np.append(x / length if length else x, 1.0)

    def probabilities(self, text: str | None) -> np.ndarray:
        at, x = self.row(text)
        margin = self.weights[:, at] @ x
        p = 1 / (1 + np.exp(-(self.sigmoid[:, 0] * margin + self.sigmoid[:, 1])))
        return p / p.sum()


def margin_classifier(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the squared-hinge classifier of signs ``y``, classes balanced, by dual coordinate descent in a fixed random order."""
    w, alpha = np.zeros(width), np.zeros(len(rows))
    n = {s: max(1, int((y == s).sum())) for s in (1.0, -1.0)}
    inverse = np.array([1 / (2 * cost * len(rows) / (2 * n[s])) for s in y.tolist()])
    curve = np.array([float(x @ x) for _, x in rows]) + inverse
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            at, x = rows[k]
            step = max(0.0, alpha[k] - (y[k] * float(w[at] @ x) - 1 + inverse[k] * alpha[k]) / curve[k]) - alpha[k]
            if step:
                alpha[k] += step
                w[at] += step * y[k] * x
    return w


def fit_sigmoid(margin: np.ndarray, hit: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that make margins probabilities, by Newton steps on targets drawn in from 0 and 1."""
    up, down = int(hit.sum()), int((~hit).sum())
    target = np.where(hit, (up + 1) / (up + 2), 1 / (down + 2))
    x, b = np.stack((margin, np.ones(len(margin))), axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        move = np.linalg.solve((x * (p * (1 - p) + 1e-12)[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - target))
        b = b - np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def train(labelled: DataFrame, text_col: str, label_col: str, learn_rows: int = LEARN_ROWS) -> StanceModel:
    """A model of the labels of a table; rows without a label or text are left out.

    Document frequencies cover all rows. A class learns from ``learn_rows`` rows at most, those with the smallest hashes; what the
    driver gets is bounded by that, the number of labels, and the places of the hash. Needs two labels at least.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")

    def places(batches):
        for batch in batches:
            n = np.zeros(1 << BITS, dtype=np.int64)
            for t in batch.column(0).to_pylist():
                n[list(hashed(t))] += 1
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["place", "n"])

    frequency = np.zeros(1 << BITS)
    for r in rows.select("text").mapInArrow(places, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        frequency[r.place] = r.n
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        raise ValueError("a model needs rows of two labels at least")
    total, classes = sum(sizes.values()), [*(s for s in STANCES if s in sizes), *sorted(set(sizes) - set(STANCES))]
    idf = np.where(frequency > 0.95 * total, 0.0, np.log((1 + total) / (1 + frequency)) + 1)
    key = F.xxhash64("label", "text")
    some = reduce(lambda a, b: a.union(b), (rows.where(F.col("label") == c).withColumn("key", key).orderBy("key").limit(learn_rows) for c in classes)).toPandas().sort_values(["key", "label", "text"])
    model = StanceModel(classes, idf, np.zeros((len(classes), (1 << BITS) + 1)), np.ones((len(classes), 2)), len(some))
    x, labels = [model.row(t) for t in some["text"]], some["label"].to_numpy()
    fold = some["key"].to_numpy() % FOLDS  # copies of a sentence share a fold
    for c, name in enumerate(classes):
        y = np.where(labels == name, 1.0, -1.0)
        margin = np.zeros(len(x))
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w = margin_classifier([x[k] for k in inside], y[inside], (1 << BITS) + 1)
            margin[outside] = [float(w[x[k][0]] @ x[k][1]) for k in outside]
        model.sigmoid[c] = fit_sigmoid(margin, y > 0)
        model.weights[c] = margin_classifier(x, y, (1 << BITS) + 1)
    model.weights = model.weights.astype(np.float32)
    return model


def predict(texts: DataFrame, text_col: str, model: StanceModel, name: str = "model_scores") -> DataFrame:
    """Adds a map from class to probability. A null or empty text has the scores of the intercepts."""
    held = texts.sparkSession.sparkContext.broadcast(model)  # a class of 0.3 MB each

    @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
    def score(column: pd.Series) -> pd.Series:
        m = held.value
        return column.map(lambda t: dict(zip(m.classes, m.probabilities(t).tolist(), strict=True)), na_action=None)

    return texts.withColumn(name, score(F.col(text_col)))


def lexicon_stance(contexts: DataFrame, column: str, words: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``stance``, ``stance_confidence`` and ``negated`` (a word of support that a negation turns) by the lexicon."""
    lexicon = Lexicon(words or LEXICON)
    shape = T.StructType([T.StructField("stance", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("negated", T.BooleanType())])

    @F.pandas_udf(shape)
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*lexicon.judge(t or ""), lexicon.turned(t or "") > 0) for t in texts], columns=shape.names)

    return contexts.withColumn("__s", judge(column)).withColumns({"stance": F.col("__s.stance"), "stance_confidence": F.col("__s.confidence"), "negated": F.col("__s.negated")}).drop("__s")


def discourse_scores(text: Column) -> Column:
    """Map from stance to share: each kind of marker that a text has counts once."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    hit = {s: reduce(lambda a, b: a | b, (low.contains(m) for m in MARKERS[s])).cast("double") if s in MARKERS else F.lit(0.0) for s in STANCES}
    total = reduce(lambda a, b: a + b, hit.values())
    return F.map_from_arrays(F.array(*map(F.lit, STANCES)), F.array(*(F.coalesce(F.try_divide(h, total), F.lit(0.0)) for h in hit.values())))


def blended(model: Column, stance: Column, confidence: Column, negated: Column, discourse: Column) -> Column:
    """(stance, score) of the best class: 50 % model, 30 % lexicon, 20 % discourse; 30, 60 and 10 where a negation turned a word of
    support; 30, 50 and 20 where the model is unsure and the lexicon names a stance. Of equals the first class stands.

    ``model`` and ``discourse`` map classes to scores, missing ones 0; the lexicon gives its stance its confidence, 0.3 at least,
    the other classes 0.1, all in shares.
    """
    named = F.coalesce(stance.isin(*STANCES), F.lit(False))
    own = F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.3))
    total = F.when(named, own + 0.1 * (len(STANCES) - 1)).otherwise(0.1 * len(STANCES))
    sure = F.array_max(F.map_values(model))
    kinds = [F.when(F.coalesce(negated, F.lit(False)), b).when((F.coalesce(sure, F.lit(0.0)) < SURE) & named, c).otherwise(a) for a, b, c in zip(WEIGHTS, NEGATED_WEIGHTS, UNSURE_WEIGHTS, strict=True)]
    lexicon = lambda s: F.when(named & (stance == s), own).otherwise(0.1) / total
    value = lambda m, s: F.coalesce(F.try_element_at(m, F.lit(s)), F.lit(0.0))
    scores = [F.struct((kinds[0] * value(model, s) + kinds[1] * lexicon(s) + kinds[2] * value(discourse, s)).alias("score"), F.lit(-k).alias("o"), F.lit(s).alias("stance")) for k, s in enumerate(STANCES)]
    best = F.array_max(F.array(*scores))
    return F.struct(best["stance"].alias("stance"), best["score"].alias("score"))
