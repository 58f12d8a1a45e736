"""Density clusters against all pairs."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencelake.operators import density
from evidencelake.plans import catalog


def plain(rows: list[tuple], least: float, min_samples: int, min_size: int | None) -> list[tuple]:
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and not math.isnan(x) for x in v) and any(v)]
    x = np.array([np.array(rows[k][1], dtype=np.float64) / np.linalg.norm(rows[k][1]) for k in good])
    near = (x @ x.T >= least) if good else np.zeros((0, 0), dtype=bool)
    core = near.sum(axis=1) >= min_samples if good else np.zeros(0, dtype=bool)
    of: dict[int, int] = {}
    for s in np.flatnonzero(core):
        if s not in of:
            of[s], todo = s, [s]
            while todo:
                for t in np.flatnonzero(near[todo.pop()] & core):
                    if t not in of:
                        of[t] = s
                        todo.append(t)
    likeness = x @ x.T if good else near
    for k in np.flatnonzero(~core):
        to = np.flatnonzero(near[k] & core)
        if len(to):
            of[k] = of[to[np.argmax(likeness[k, to])]]
    members = defaultdict(list)
    for k, s in of.items():
        members[s].append(k)
    most = max(3, len(rows) // 10) if min_size is None else min_size
    out = {k: (None, "noise") for k in range(len(rows))}
    for ks in members.values():
        if len(ks) >= most:
            name = min((rows[good[k]][0] for k in ks if core[k] and rows[good[k]][0] is not None), default=None)
            for k in ks:
                out[good[k]] = (name, "core" if core[k] else "border")
    return [(rows[k][0], *v) for k, v in out.items()]


def vectors(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 8))
    rows = [(k, (centres[k % 7] + rng.normal(size=8) * 0.45 if k % 7 < 5 else rng.normal(size=8)).tolist()) for k in range(n)]
    rows += [(1000 + k, rows[3][1]) for k in range(9)] + [(None, rows[4][1]), (5, rows[5][1]), (2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, float("nan")] + [0.0] * 6), (2004, [None] + [1.0] * 7)]
    return rows


@pytest.mark.parametrize(("least", "min_samples", "min_size", "block"), [(0.9, 4, 3, 16), (0.8, 2, None, 16), (0.95, 6, 5, 512), (0.3, 3, 3, 40)])
def test_clusters(spark, least, min_samples, min_size, block):
    rows = vectors(3, 160)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, v array<double>, node string, cell int").repartition(4)
    got = density.density_clusters(spark, frame, "id", "v", least, min_samples, min_size, block)
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows, least, min_samples, min_size))


def test_blocks_are_bounded(spark):
    """A third of the rows around one pivot: every block has a bounded number of rows, whatever the cell has."""
    rows = [(k, v) for k, v in vectors(5, 600) if v and len(v) == 8]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    units = density.unit_vectors(frame, "v")
    cells = density.Cells(units, 32)
    sizes = [r["count"] for r in cells.blocks(units, units, 0.8).agg(F.count("*").alias("count")).collect()]
    assert len(sizes) > 50 and max(sizes) < 32 * 2 * 3  # hashing deals parts unevenly, within a small factor
    assert density.density_clusters(spark, frame.limit(0), "id", "v").count() == 0


def test_forest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        near = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.2
        edges = density.forest(near)
        assert len(edges) == len(set(edges)) and all(near[i, j] for i, j in edges)

        def groups(pairs, shape=near.shape):
            root = list(range(sum(shape)))

            def find(k):
                while root[k] != k:
                    k = root[k]
                return k

            for i, j in pairs:
                root[find(i)] = find(shape[0] + j)
            return {frozenset(k for k in range(sum(shape)) if find(k) == r) for r in map(find, range(sum(shape)))}

        assert groups(edges) == groups(np.argwhere(near).tolist())


def test_query(spark):
    got = {(r.vec_id, r.cluster, r.kind) for r in catalog.QUERIES["density_clusters"](spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert got == set(plain(rows, 0.3, 3, 3)) and len({c for _, c, _ in got}) > 1


def test_cells_are_dealt_in_small_batches():
    """A batch whose rows visit every cell is handed on in parts: its copies are never held at once."""
    x = np.random.default_rng(1).normal(size=(5000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    batch = pa.RecordBatch.from_pydict({"node": list(range(5000)), "vec": x.tolist()})
    out = list(density.dealt(iter([batch, batch.slice(0, 0)]), x[:30], ["node", "vec"], lambda batch, apart: np.nonzero(apart >= 0)))
    assert max(b.num_rows for b in out) <= density.DEALT and sum(b.num_rows for b in out) == 5000 * 30
    assert {(n, c) for b in out for n, c in zip(b["node"].to_pylist(), b["cell"].to_pylist(), strict=True)} == {(n, c) for n in range(5000) for c in range(30)}
