"""Random orders against sorting the whole list."""

from __future__ import annotations

import hashlib
import random

import pytest

from evidencelake.operators import screening


def plain(rows, draw, share=0.95):
    order = sorted(rows, key=lambda r: (not r[2], hashlib.md5(f"42:{draw}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), not r[1]))
    hits = sum(bool(r[1]) for r in order)
    seen, n_to = 0, len(order)
    for at, r in enumerate(order, 1):
        seen += bool(r[1])
        if hits and seen >= share * hits:
            n_to = at
            break
    early = sum(bool(r[1]) for r in order[: max(1, len(order) // 10)])
    return len(order), hits, n_to, 1 - n_to / len(order), early / hits if hits else None


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("kind", ["some", "none", "all", "one"])
def test_baseline(spark, kind, digits):
    r = random.Random(1)
    chance = {"some": 0.2, "none": 0.0, "all": 1.0, "one": 1.0}[kind]
    rows = [(k, r.random() < chance, r.random() < 0.1) for k in range(1 if kind == "one" else 700)]
    if kind == "some":
        rows += [(None, True, None), (None, False, None), (None, None, False), (5, True, rows[5][2])]
    frame = spark.createDataFrame(rows, "id long, rel boolean, seed boolean").repartition(3)
    got = {x.draw: tuple(x)[1:] for x in screening.random_baseline(frame, "id", "rel", "seed", draws=4, digits=digits).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for draw, x in got.items():
        want = plain(rows, draw)
        assert x[:3] == want[:3] and x[3:] == pytest.approx(want[3:]), (draw, x, want)
    assert screening.random_baseline(frame.limit(0), "id", "rel", "seed").count() == 0
