"""Scoring of whole texts by a gated recurrent language model in numpy, trained on the corpus itself.

Words are lower-cased (A-Z) runs of anything but ASCII white space, each text ends in one end token. Word counts of all
training documents are summed in Spark. The commonest words, TOP or the root of the number of different words if that is more,
have rows of their own in the network; its output softmax is factored: first a class, then the word within it. Top words stand
in classes by rank, of CLASS_WORDS or the root of their number if that is more, the end token in its own,
and all other words, the unseen too, in SURFACES classes by their last letter, punctuation and script, within which a word
counted c has probability (c + 1) / (sum of all c + 1, and 1 for the unseen).

Training is local: the training documents are dealt by a hash of id and text to shards of about SHARD_TOKENS tokens. In each
shard truncated backpropagation runs over its documents in the order of that hash, states carried from window to window, and the
parameters of a round's shards are averaged. So neither files nor partitions nor cores change what is learnt. Scoring carries the state through the whole of
each document. Counts of words under 1 in COMMON tokens are not sent to the tasks but joined by hash.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .quality import counted
from .scratch import Scratch

HIDDEN, TOP, CLASS_WORDS, SURFACES = 16, 1024, 32, 32
#: Words seen at least once in this many training tokens are sent to all tasks: 16 bytes each, so 16 MB at most.
COMMON = 1 << 20
#: A round trains on one of SHARES shares of the shards; there is a round for each, so that all are trained on.
SHARES, RATE, LANES, STEPS = 4, 0.03, 512, 16
SHARD_TOKENS = 1 << 20
ROUNDS = SHARES
#: A short stream has fewer lanes, so that it still is this many windows long.
LEAST_WINDOWS = 16
#: Bytes of text that are scored, or trained on, together.
GROUP_BYTES = 1 << 23
SCORE_LANES = 640
AVERAGERS = 64
_U = np.uint64
END = 0x5851F42D4C957F2D & ~(SURFACES - 1)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b".,;:!?\"')|*$%&#>")] = True


def word_keys(c: tokens.Chunk) -> tuple[tokens.Words, np.ndarray]:
    """The words of a chunk, lower-cased, and a key for each: 59 bits of hash and, in the low five, its surface class."""
    words = c.lowered().words()
    data, last = words.chunk.data, words.ends - 1
    mark = _PUNCTUATION[data[last]]
    last = np.where(mark & (last > words.starts), last - 1, last)
    letter = data[last]
    surface = ((letter >= 128).astype(np.int64) << 4) | (mark.astype(np.int64) << 3) | (letter.astype(np.int64) * 5 >> 1) % 8
    return words, (words.hashes() & ~_U(SURFACES - 1)) | surface.astype(_U)


@dataclass
class Vocabulary:
    """What tasks know of the counts."""

    keys: np.ndarray  # of common words, sorted
    counts: np.ndarray
    top: np.ndarray  # number among the top words of each, or -1
    surface_sum: np.ndarray  # of c + 1 over words that are not top, and 1, by surface
    top_counts: np.ndarray
    end_count: int
    total: int
    types: int

    @property
    def width(self) -> int:
        """Top words in a class."""
        return max(CLASS_WORDS, math.isqrt(len(self.top_counts)))

    @property
    def groups(self) -> int:
        return -(-max(1, len(self.top_counts)) // self.width)

    @property
    def classes(self) -> int:
        return self.groups + SURFACES + 1

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is among the common words, -1 where it is not. One bisection a word is most of what looking up costs."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def ids(self, keys: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The network's numbers: a top word, or past these its surface class; the end token is the last."""
        return np.where(number >= 0, number, len(self.top_counts) + (keys & _U(SURFACES - 1)).astype(np.int64))

    def top_only(self) -> Vocabulary:
        """The same for the network alone: a small table to search."""
        word = self.top >= 0
        return Vocabulary(self.keys[word], self.counts[word], self.top[word], self.surface_sum, self.top_counts, self.end_count, self.total, self.types)

    @property
    def end(self) -> int:
        return len(self.top_counts) + SURFACES


def top_words(types: int) -> int:
    """How many words have rows of their own."""
    return max(TOP, math.isqrt(types))


def training(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 7 != 2


def count_words(spark: SparkSession, docs: DataFrame, text_col: str, scratch: Scratch) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the training documents, and their (key, n) counts. Driver data: at most COMMON words."""

    def keys_of(c):
        words, keys = word_keys(c)
        return np.append(keys, np.full(c.n, END, dtype=_U))

    counts = counted(docs.select(F.col(text_col).alias("text")), keys_of, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "counts")
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, -(-total // COMMON))
    common = counts.where((F.col("n") >= least) | (F.col("key") == END)).toArrow()
    keys, n = common["key"].to_numpy().view(_U), common["n"].to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    word = keys != _U(END)
    rank = np.lexsort((keys[word], -n[word]))[: top_words(int(types))]
    top = np.full(len(keys), -1, dtype=np.int64)
    top[np.flatnonzero(word)[rank]] = np.arange(len(rank))
    surface = F.col("key").bitwiseAND(F.lit(SURFACES - 1))
    sums = np.ones(SURFACES)
    for r in counts.where(F.col("key") != END).groupBy(surface.alias("s")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
        sums[r.s] += r.n
    chosen = np.flatnonzero(word)[rank]
    np.subtract.at(sums, (keys[chosen] & _U(SURFACES - 1)).astype(np.int64), n[chosen] + 1)
    return Vocabulary(keys, n, top, sums, n[chosen], int(n[~word].sum()), int(total), int(types)), counts


def initial(v: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters that give every word its share of the training tokens, whatever stands before."""
    rng = np.random.default_rng(seed)
    n_in = len(v.top_counts) + SURFACES + 1
    weight = np.zeros(v.groups * v.width)
    weight[: len(v.top_counts)] = v.top_counts
    weight = weight.reshape(v.groups, v.width)
    share = np.concatenate((weight.sum(axis=1), v.surface_sum, [v.end_count])) + 1.0
    small = lambda *shape: rng.normal(0, 0.1, shape)
    out = {
        "E": small(n_in, 3 * HIDDEN), "U": small(HIDDEN, 3 * HIDDEN) * 2, "b": np.zeros(3 * HIDDEN),
        "C": small(HIDDEN, v.classes) * 0.1, "c": np.log(share / share.sum()),
        "W": small(v.groups, HIDDEN, v.width) * 0.1, "w": np.where(weight > 0, np.log(np.maximum(weight, 1)), -30.0),
    }
    return {k: x.astype(np.float32) for k, x in out.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    hu = h @ p["U"]
    gates = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
    return n + z * (h - n), z, r, n, hu[:, 2 * HIDDEN :]


def _exponentials(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of logits, a row an outcome and a column a token, so that sums run over whole rows at a time: their exponentials (in
    the place of ``x``), the sum of each column, and the log probability of each column's own outcome. An exponential is taken once."""
    x -= x.max(axis=0)
    logit = x[own, np.arange(len(own))]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return x, total, logit - np.log(total)


def _class_of(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    n_top = len(v.top_counts)
    return np.where(ids < n_top, ids // v.width, v.groups + ids - n_top)


def _by_group(v: Vocabulary, ids: np.ndarray):
    """Positions of the top words by class."""
    top = np.flatnonzero(ids < len(v.top_counts))
    group = ids[top] // v.width
    order = np.argsort(group, kind="stable")
    top, group = top[order], group[order]
    ends = np.searchsorted(group, np.arange(v.groups + 1))
    for g in range(v.groups):
        if ends[g] < ends[g + 1]:
            yield g, top[ends[g] : ends[g + 1]]


def log_probabilities(p: dict[str, np.ndarray], v: Vocabulary, hidden: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural logarithm of the class of each next token and, for top words, of the word within it."""
    out = _exponentials(p["C"].T @ hidden.T + p["c"][:, None], _class_of(v, ids))[2].astype(np.float64)
    for g, at in _by_group(v, ids):
        out[at] += _exponentials(p["W"][g].T @ hidden[at].T + p["w"][g][:, None], ids[at] % v.width)[2]
    return out


def gradients(p: dict[str, np.ndarray], v: Vocabulary, before: np.ndarray, after: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean loss over a window of steps x lanes, the last state and the summed loss.

    ``before`` are the input tokens, ``after`` those to predict, ``fresh`` flags the first token of a document.
    """
    steps, lanes = before.shape
    kept, hidden = [], np.empty((steps, lanes, HIDDEN), dtype=np.float32)
    for t in range(steps):
        h = h * ~fresh[t][:, None]
        new, z, r, n, hu = _step(p, p["E"][before[t]] + p["b"], h)
        kept.append((h, z, r, n, hu))
        hidden[t] = h = new
    flat, ids = hidden.reshape(-1, HIDDEN), after.ravel()
    scale = np.float32(1 / len(ids))
    g = {k: np.zeros_like(x) for k, x in p.items()}
    at = np.arange(len(ids))
    own = _class_of(v, ids)
    d, total, logp = _exponentials(p["C"].T @ flat.T + p["c"][:, None], own)
    loss = -float(logp.sum())
    d *= scale / total
    d[own, at] -= scale
    g["C"], g["c"] = (d @ flat).T, d.sum(axis=1)
    dh = d.T @ p["C"].T
    for group, where in _by_group(v, ids):
        sub, word = flat[where], ids[where] % v.width
        d, total, logp = _exponentials(p["W"][group].T @ sub.T + p["w"][group][:, None], word)
        loss -= float(logp.sum())
        d *= scale / total
        d[word, np.arange(len(where))] -= scale
        g["W"][group], g["w"][group] = (d @ sub).T, d.sum(axis=1)
        dh[where] += d.T @ p["W"][group].T
    dh = dh.reshape(steps, lanes, HIDDEN)
    carry = np.zeros((lanes, HIDDEN), dtype=np.float32)
    dx = np.empty((steps, lanes, 3 * HIDDEN), dtype=np.float32)
    for t in reversed(range(steps)):
        h0, z, r, n, hu = kept[t]
        d = dh[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h0 - n) * z * (1 - z)
        dr = dn * hu * r * (1 - r)
        dx[t, :, :HIDDEN], dx[t, :, HIDDEN : 2 * HIDDEN], dx[t, :, 2 * HIDDEN :] = dz, dr, dn
        du = np.concatenate((dz, dr, dn * r), axis=1)
        g["U"] += h0.T @ du
        carry = (d * z + du @ p["U"].T) * ~fresh[t][:, None]
    flat = dx.reshape(-1, 3 * HIDDEN)
    g["b"] = flat.sum(axis=0)
    order = np.argsort(before, axis=None, kind="stable")
    sorted_in = before.ravel()[order]
    first = np.flatnonzero(np.append(True, sorted_in[1:] != sorted_in[:-1]))
    g["E"][sorted_in[first]] = np.add.reduceat(flat[order], first, axis=0)
    return g, h, loss


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.turn = rate, 0
        self.m, self.s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def move(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.turn += 1
        long = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        shrink = np.float32(min(1.0, 1.0 / max(long, 1e-9)))
        for k, x in p.items():
            d = g[k] * shrink
            self.m[k] += 0.1 * (d - self.m[k])
            self.s[k] += 0.01 * (d * d - self.s[k])
            x -= np.float32(self.rate) * (self.m[k] / (1 - 0.9**self.turn)) / (np.sqrt(self.s[k] / (1 - 0.99**self.turn)) + np.float32(1e-6))


def token_stream(v: Vocabulary, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens of a column, the end of each document included; where documents begin; the keys of its words and
    their places in the vocabulary."""
    ids, lengths, keys, places = [], [], [], []
    top = np.append(v.top, -1)
    for c in tokens.chunks(column):
        words, k = word_keys(c)
        n = words.counts + 1
        at = v.places(k)
        out = np.full(n.sum(), v.end, dtype=np.int64)
        out[np.arange(len(k)) + np.repeat(np.arange(c.n), words.counts)] = v.ids(k, top[at])
        ids.append(out)
        lengths.append(n)
        keys.append(k)
        places.append(at)
    if not ids:
        none = np.zeros(0, dtype=np.int64)
        return none, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=_U), none
    return np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(lengths)))), np.concatenate(keys), np.concatenate(places)


def train_on(p: dict[str, np.ndarray], v: Vocabulary, adam: Adam, ids: np.ndarray, begin: np.ndarray) -> None:
    """Truncated backpropagation over a stream of documents, cut into lanes; the state is carried from window to window. The last
    lane is filled up from the beginning of the stream."""
    lanes = int(min(LANES, max(1, len(ids) // (STEPS * LEAST_WINDOWS))))
    length = -(-len(ids) // lanes)
    fresh = np.zeros(len(ids), dtype=bool)
    fresh[begin[:-1]] = True
    before = np.append(v.end, ids[:-1])
    before[begin[:-1]] = v.end
    lane = lambda x: np.resize(x, lanes * length).reshape(lanes, length).T
    before, after, fresh = lane(before), lane(ids), lane(fresh).copy()
    h = np.zeros((lanes, HIDDEN), dtype=np.float32)
    for t in range(0, length, STEPS):
        g, h, _ = gradients(p, v, before[t : t + STEPS], after[t : t + STEPS], fresh[t : t + STEPS], h)
        adam.move(p, g)


def _grouped(batches, place: int):
    """Slices of record batches of about GROUP_BYTES of text."""
    for batch in batches:
        size = batch.column(place).nbytes
        rows = max(1, batch.num_rows * GROUP_BYTES // max(1, size))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def learner(held: Broadcast):
    """From the rows (shard, k, text) of a shard to (shard, p, n): what training leaves of the held parameters, and tokens."""

    def learnt(table: pa.Table) -> pa.Table:
        p, v = held.value
        p = {k: x.copy() for k, x in p.items()}
        table = table.sort_by("k")
        ids, begin, _, _ = token_stream(v, table["text"])
        train_on(p, v, Adam(p, RATE), ids, begin)
        return pa.table({"shard": table["shard"].slice(0, 1), "p": pa.array([_pack(p).tobytes()]), "n": pa.array([float(len(ids))])})

    return learnt


def average(table: pa.Table) -> pa.Table:
    """The mean of the parameters (shard, p, n), weighted by tokens and added up in the order of shards."""
    total, n = 0.0, 0.0
    for row in table.sort_by("shard").to_pylist():
        total, n = total + row["n"] * np.frombuffer(row["p"], dtype=np.float32).astype(np.float64), n + row["n"]
    return pa.table({"shard": table["shard"].slice(0, 1), "p": pa.array([(total / n).astype(np.float32).tobytes()]), "n": pa.array([n])})


def train(docs: DataFrame, id_col: str, text_col: str, v: Vocabulary, rounds: int = ROUNDS, shares: int = SHARES) -> dict[str, np.ndarray]:
    """The parameters after ``rounds`` of training in all shards and averaging, weighted by tokens.

    Driver data are AVERAGERS sets of parameters, 0.3 MB each at TOP words; the averagers add up one set at a time.
    """
    p = initial(v)
    shards = shares * -(-max(1, v.total) // (shares * SHARD_TOKENS))
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), key.alias("k"), F.col(text_col).alias("text"))
    for turn in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast((p, v.top_only()))
        shape = "shard long, p binary, n double"
        found = rows.where(F.col("shard") % shares == turn % shares).groupBy("shard").applyInArrow(learner(held), shape)
        sums = found.groupBy((F.col("shard") % AVERAGERS).alias("averager")).applyInArrow(average, shape).collect()
        if sums:
            n = sum(r.n for r in sums)
            p = _unpack(sum(r.n / n * np.frombuffer(r.p, dtype=np.float32).astype(np.float64) for r in sorted(sums, key=lambda r: r.shard % AVERAGERS)), p)
        held.destroy()
    return p


def score_stream(p: dict[str, np.ndarray], v: Vocabulary, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log probability of the network's part of every document, its state carried from the first token to the last.

    Documents are dealt to lanes, the longest first, and follow each other there; a state starts anew with each.
    """
    n = np.diff(begin)
    lanes = int(min(SCORE_LANES, len(n)))
    load = [(0, k) for k in range(lanes)]
    lane_of, first = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    for d in np.argsort(-n, kind="stable").tolist():
        size, k = load[0]
        lane_of[d], first[d] = k, size
        heapq.heapreplace(load, (size + int(n[d]), k))
    length = max(size for size, _ in load)
    of = np.repeat(np.arange(len(n)), n)
    row = first[of] + np.arange(len(ids)) - begin[of]
    grid = np.full((length, lanes), -1, dtype=np.int64)
    grid[row, lane_of[of]] = np.arange(len(ids))
    before = np.append(v.end, ids[:-1])
    before[begin[:-1]] = v.end
    fresh = np.zeros(len(ids) + 1, dtype=bool)
    fresh[begin[:-1]] = True
    before, after = np.append(before, v.end), np.append(ids, v.end)
    out = np.zeros(len(n))
    h = np.zeros((lanes, HIDDEN), dtype=np.float32)
    inputs = p["E"] + p["b"]
    window = 64
    for t in range(0, length, window):
        part = grid[t : t + window]
        busy = np.flatnonzero((part >= 0).any(axis=0))
        part, state = part[:, busy], h[busy]
        hidden = np.empty((*part.shape, HIDDEN), dtype=np.float32)
        for s in range(len(part)):
            state = state * ~fresh[part[s]][:, None]
            hidden[s] = state = _step(p, inputs[before[part[s]]], state)[0]
        h[busy] = state
        real = part >= 0
        at = part[real]
        out += np.bincount(of[at], weights=log_probabilities(p, v, hidden[real], after[at]), minlength=len(n))
    return out


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, shares: int = SHARES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; scores are log10 of whole texts.

    Documents learn from those whose crc32 of the id as text modulo 7 is not 2 (a null id: held out). A null text is empty and
    has its end token alone. Repeated rows are each counted and scored. An empty table gives an empty one; without training
    documents all counts are 0. Other columns are not read.
    """
    scratch = Scratch(spark, "lm")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training(F.col(id_col)), F.lit(False)).alias("learns"))
    learn = source.where("learns")
    v, counts = count_words(spark, learn, "text", scratch)
    p = train(learn, "id", "text", v, rounds, shares)
    held = spark.sparkContext.broadcast((p, v))
    inner = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("net", T.DoubleType()), T.StructField("keys", T.ArrayType(T.LongType(), False)), T.StructField("times", T.ArrayType(T.LongType(), False))])
    names = [f.name for f in inner]

    def run(batches):
        p, v = held.value
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 36  # a row and its seldom words are written by one task, so it can number them
        log_sum = np.log10(v.surface_sum)
        end_known, end_log = int(v.end_count > 0), np.log10(v.end_count + 1)
        counts, not_top = np.append(v.counts, 0), np.append(v.top < 0, True)  # the last is for words that are not common
        count_logs = np.log10(counts + 1.0)
        for batch in _grouped(batches, 2):
            ids, begin, keys, place = token_stream(v, batch.column(2))
            n = np.diff(begin)
            number = pa.array(row + np.arange(len(n)))
            row += len(n)
            of = np.repeat(np.arange(len(n)), n - 1)
            net = score_stream(p, v, ids, begin) / np.log(10)
            c, logs, other = counts[place], count_logs[place], not_top[place]
            surface = (keys & _U(SURFACES - 1)).astype(np.int64)
            base = np.bincount(of, weights=logs, minlength=len(n)) + end_log
            net += np.bincount(of[other], weights=logs[other] - log_sum[surface[other]], minlength=len(n))
            known = np.bincount(of[c > 0], minlength=len(n)) + end_known
            rare = c == 0
            pair = np.stack((of[rare].astype(np.int64), keys[rare].view(np.int64)))
            pair = pair[:, np.lexsort((pair[1], pair[0]))]
            where = np.flatnonzero(np.append(True, (pair[:, 1:] != pair[:, :-1]).any(axis=0))) if pair.shape[1] else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(where, pair.shape[1]))
            ends = pa.array(np.searchsorted(pair[0][where], np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pair[1][where], times)]
            yield pa.RecordBatch.from_arrays([number, *batch.columns[:2], pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(net), *lists], names=["rid", "id", "learns", *names])

    keyed = source.select("id", "learns", "text")
    rows = scratch.keep(keyed.mapInArrow(run, T.StructType([T.StructField("rid", T.LongType()), *keyed.schema.fields[:2], *inner.fields])), "rows")
    least = max(1, -(-v.total // COMMON))
    rare = rows.select("rid", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("rid", F.col("w.keys").alias("key"), F.col("w.times").alias("n")).join(counts.where(F.col("n") < least).select("key", F.col("n").alias("c")), "key")
    more = rare.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("more_known"))
    whole = rows.select("rid", "id", "learns", "n_tokens", "known", "base", "net")
    joined = whole.join(more, "rid", "left").withColumns({"more": F.coalesce("more", F.lit(0.0)), "more_known": F.coalesce("more_known", F.lit(0))})
    return joined.select(
        "id", (~F.col("learns")).alias("held_out"), "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(float(np.log10(v.total + v.types + 1)))).alias("base_score"), (F.col("net") + F.col("more")).alias("score"),
    )
