"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link when at most ``tau`` bits differ. The bits are grouped into partitions, correlated ones
together; a fingerprint that probes partition p within t[p] bits for thresholds with sum(t[p] + 1) = tau + 1 (t[p] = -1: no
probe) meets all its links. The thresholds of each fingerprint are those of least estimated cost, found by dynamic programming
on counts of the values near its own in each partition: a common value is passed over and a rare one probed more widely.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .components import connected_components, forest
from .names import free_name
from .scratch import Scratch

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
#: Candidate rows that one bucket may hold before its remaining bits split it; splitting is exact.
BUCKET_ROWS = 2048
_U = np.uint64


def shingle_hashes(chunk: tokens.Chunk, size: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word shingle of a chunk, and how many each document has."""
    chunk = chunk.lowered()
    words = chunk.words()
    length = words.ends - words.starts + 1
    to = np.concatenate(([0], np.cumsum(length)))
    joined = np.full(to[-1], 32, dtype=np.uint8)
    letter = np.ones(to[-1], dtype=bool)
    letter[to[1:] - 1] = False
    joined[letter] = chunk.data[tokens.NOT_WHITE[chunk.data]]
    n = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    first = np.repeat(words.of[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(first + size, np.repeat(words.of[1:], n))
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    out = np.fromiter((digest(text[a:b], seed) for a, b in zip(to[first].tolist(), (to[last] - 1).tolist(), strict=True)), dtype=_U, count=len(first))
    return out, n


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document, the bits that over half of its hashes have; none: zero.

    Eight byte lanes of a word add up 255 hashes at a time for each bit position within a byte.
    """
    out = np.zeros(len(counts), dtype=_U)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    begin = np.cumsum(n) - n
    pieces = -(-n // 255)
    piece_of = np.cumsum(pieces) - pieces
    at = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(piece_of, pieces))
    for j in range(8):
        lanes = np.add.reduceat((hashes >> _U(j)) & _U(0x0101010101010101), at)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), piece_of, axis=0)
        for lane in range(8):
            out[some] |= (2 * ones[:, lane] > n).astype(_U) << _U(8 * lane + j)
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits for rows that agree in id and text, null ids and texts included."""
    cells = [F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col)]
    return F.struct(F.xxhash64(*cells).alias("lo"), F.xxhash64(F.lit(1), *cells).alias("hi"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp long) for every row; a null or wordless text has fingerprint zero."""

    def run(batches):
        for batch in batches:
            got = [majority_bits(*shingle_hashes(c, size)) for c in tokens.chunks(batch.column(1))]
            fp = np.concatenate(got) if got else np.zeros(0, dtype=_U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, T.StructType([source.schema["id"], T.StructField("fp", T.LongType())]))


def bit_groups(fps: DataFrame) -> list[list[int]]:
    """PARTS groups of WIDTH bits, the most correlated together, from counts over all fingerprints."""

    def run(batches):
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total[i, j], n))], names=["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    counts, n = np.zeros((BITS, BITS)), 1
    for r in rows:
        if r.i < 0:
            n = max(1, r.n)
        else:
            counts[r.i, r.j] = counts[r.j, r.i] = r.n
    return correlated(counts, n)


def correlated(counts: np.ndarray, n: float) -> list[list[int]]:
    """PARTS groups of WIDTH bits, the most correlated together, from the number of fingerprints that have each two of them."""
    p = counts.diagonal() / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    like = np.abs(counts / n - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    for _ in range(PARTS - 1):
        i, j = max(combinations(left, 2), key=lambda ij: (like[ij], -ij[0], -ij[1]))
        group = [i, j]
        while len(group) < WIDTH:
            group.append(max((b for b in left if b not in group), key=lambda b: (like[b, group].sum(), -b)))
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return [*groups, left]


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as a number."""
    out = np.zeros(len(fp), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> _U(b)) & _U(1)).astype(np.int64) << k
    return out


def near_counts(histogram: np.ndarray, tau: int) -> np.ndarray:
    """For each distance up to tau and each value: fingerprints whose value lies within it."""
    layers = [histogram.astype(np.int64)] + [np.zeros_like(histogram, dtype=np.int64) for _ in range(tau)]
    values = np.arange(len(histogram))
    for b in range(WIDTH):
        turned = values ^ (1 << b)
        for t in range(tau, 0, -1):
            layers[t] = layers[t] + layers[t - 1][turned]
    return np.cumsum(np.stack(layers), axis=0)


def allocate(costs: np.ndarray, levels: int | None = None) -> np.ndarray:
    """Thresholds t of least total cost with sum(t[p] + 1) = levels (else as many as there are thresholds); costs[p, t, q]: of
    probing partition p within t bits, for query q."""
    parts, most, n = costs.shape
    levels = most if levels is None else levels
    best = np.full((levels + 1, n), np.inf)
    best[0] = 0
    choice = np.zeros((parts, levels + 1, n), dtype=np.int8)
    for p in range(parts):
        new = np.full_like(best, np.inf)
        for total in range(levels + 1):
            for used in range(min(total, most) + 1):
                c = best[total - used] + (costs[p, used - 1] if used else 0)
                better = c < new[total]
                new[total][better] = c[better]
                choice[p, total][better] = used
        best = new
    out, total = np.zeros((parts, n), dtype=np.int8), np.full(n, levels)
    for p in reversed(range(parts)):
        used = choice[p, total, np.arange(n)]
        out[p] = used - 1
        total = total - used
    return out


def ball(t: int) -> np.ndarray:
    """Masks of WIDTH bits with at most t set."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(WIDTH), k)], dtype=np.int64)


_ROWS = "bucket long, fp long, probes boolean, stands boolean, known long"


def _rows(bucket, fp, probes, stands, known) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, fp, probes, stands, known)], names=["bucket", "fp", "probes", "stands", "known"])


def probe_rows(fps: DataFrame, groups: list[list[int]], near: np.ndarray, tau: int) -> DataFrame:
    """A row for each partition under the own value (stands; probes if the threshold allows) and for each wider probe."""
    balls, masks = [ball(t) for t in range(tau + 1)], [sum(1 << b for b in g) for g in groups]

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            values = [gather(fp, g) for g in groups]
            costs = np.stack([np.stack([near[p, t][values[p]] + len(balls[t]) for t in range(tau + 1)]) for p in range(PARTS)]).astype(float)
            t = allocate(costs)
            for p in range(PARTS):
                known = np.full(len(fp), np.array(masks[p], dtype=_U).view(np.int64))
                yield _rows(values[p] * PARTS + p, fp.view(np.int64), t[p] >= 0, np.ones(len(fp), dtype=bool), known)
                for level in range(1, tau + 1):
                    who = np.flatnonzero(t[p] == level)
                    for some in np.array_split(who, max(1, len(who) * len(balls[level]) // 200_000)):
                        key = (values[p][some, None] ^ balls[level][None, 1:]).ravel()
                        who_fp = np.repeat(fp[some], len(balls[level]) - 1)
                        found = near[p, 0][key] > 0
                        key, who_fp = key[found], who_fp[found]
                        yield _rows(key * PARTS + p, who_fp.view(np.int64), np.ones(len(key), dtype=bool), np.zeros(len(key), dtype=bool), np.full(len(key), known[0] if len(known) else 0))

    return fps.select("fp").mapInArrow(run, _ROWS)


def split_bucket(rows: DataFrame, tau: int) -> DataFrame:
    """Each row under tau + 1 pieces of the bits that its bucket leaves open; links agree in at least one of them."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, fp, known = (batch.column(i).to_numpy(zero_copy_only=False).view(_U) for i in (0, 1, 4))
            probes, stands = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for mask in np.unique(known):
                at = np.flatnonzero(known == mask)
                free = [b for b in range(BITS) if not int(mask) >> b & 1]
                for j in range(tau + 1):
                    piece = free[j :: tau + 1]
                    took = _U(sum(1 << b for b in piece))
                    key = tokens.splitmix(tokens.splitmix(bucket[at] + _U(j + 1)) ^ (fp[at] & took)) if piece else tokens.splitmix(bucket[at] + _U(j + 1))
                    yield _rows(key.view(np.int64), fp[at].view(np.int64), probes[at], stands[at], np.full(len(at), mask | took).view(np.int64))

    return rows.mapInArrow(run, _ROWS)


def verify(bucket: np.ndarray, fp: np.ndarray, probes: np.ndarray, stands: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between a probing and a standing row of the same bucket, as a spanning forest; rows come sorted by bucket."""
    us, vs, held = [], [], 0
    at = np.arange(len(bucket))
    step = 1
    while True:
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        if not len(at):
            break
        to = at + step
        x = (fp[at] ^ fp[to]).view(_U)
        hit = (np.bitwise_count(x) <= tau) & (x != 0) & ((probes[at] & stands[to]) | (probes[to] & stands[at]))
        us.append(fp[at[hit]])
        vs.append(fp[to[hit]])
        held += int(hit.sum())
        if held > 1_000_000:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
        step += 1
    if not us:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return forest(np.concatenate(us), np.concatenate(vs))


def linked_pairs(rows: DataFrame, tau: int) -> DataFrame:
    """(u, v) links of all buckets. A task walks its sorted rows and holds one batch and one bucket, which BUCKET_ROWS bounds."""

    def run(batches):
        left = None
        for batch in batches:
            table = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if left is not None:
                table = [np.concatenate(x) for x in zip(left, table, strict=True)]
            cut = int(np.searchsorted(table[0], table[0][-1])) if len(table[0]) else 0
            left = [x[cut:] for x in table]
            u, v = verify(*[x[:cut] for x in table], tau)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        if left is not None:
            u, v = verify(*left, tau)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.select("bucket", "fp", "probes", "stands").repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


def links(spark: SparkSession, fps: DataFrame, scratch: Scratch, tau: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): links that join what all pairs of distinct fingerprints with at most ``tau`` differing bits join.

    Driver data are the 64 x 64 bit counts and a histogram of PARTS x 2**WIDTH values, whatever the number of documents.
    """
    groups = bit_groups(fps)
    value = [F.lit(0).cast("long")] * PARTS
    for p, g in enumerate(groups):
        for k, b in enumerate(g):
            value[p] = value[p].bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")), k))
    counts = fps.select(F.explode(F.array(*[(v * PARTS + p) for p, v in enumerate(value)])).alias("bucket")).groupBy("bucket").count().toPandas()
    histogram = np.zeros(PARTS << WIDTH, dtype=np.int64)
    histogram[counts["bucket"].to_numpy()] = counts["count"].to_numpy()
    near = np.stack([near_counts(histogram[p::PARTS], tau) for p in range(PARTS)])
    rows = probe_rows(fps, groups, near, tau)
    if histogram.max() <= bucket_rows // 2:
        return linked_pairs(rows, tau)
    done, rows = [], scratch.keep(rows, "probes-0")
    for level in range(1, BITS):
        sizes = rows.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket")
        done.append(linked_pairs(rows.join(sizes, "bucket", "left_anti").select(*rows.columns), tau))
        finer = scratch.keep(split_bucket(rows.join(sizes, "bucket", "left_semi").select(*rows.columns), tau), f"probes-{level}")
        if finer.isEmpty():
            break
        rows = finer
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the least id reachable over links.

    Exact copies share a fingerprint and enter the search once. Null texts and texts without words have fingerprint zero and
    link like any other. A null id keeps its row but names no component; if a component has no other, it is null. Repeated
    rows stay repeated. An empty table gives an empty one. Other columns are not read.
    """
    scratch = Scratch(spark, "simhash")
    marked = scratch.keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = scratch.keep(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(spark, links(spark, fps, scratch, tau, bucket_rows), scratch)
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return marked.join(named.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents without near copies: of each component the row with the least id stays, with all its columns.

    Rows without an id come after all others of their component; of rows that share id and component the one with the least hash
    of id and text stays, and of rows that repeat both, one.
    """
    rid = row_key(id_col, text_col)
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), rid.alias("rid")).alias("key"), F.col(text_col).alias("text"))
    found = near_duplicates(spark, keyed, "key", "text", **params)
    name = free_name(docs, "rid")
    keep = found.select(F.col("component.rid").alias(name)).distinct()
    return docs.withColumn(name, rid).join(keep, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
