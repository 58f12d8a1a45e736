"""Slots of questions against a plain search for the longest name."""

from __future__ import annotations

import random
import re

from evidencelake.operators import intent

WORDS = ["quartz", "u-pb", "dating", "mars", "of", "mantle", "wedge", "fe3+", "spinel", "é", "the"]


def tokens(text: str | None) -> list[str]:
    return re.findall(r"[^\W_+-]+(?:[+-]|[^\W_])*|[+-]+(?:[+-]|[^\W_])*", (text or "").lower())


def plain(text: str | None, names: list[tuple]) -> dict:
    t, best = tokens(text), {}
    for slot, name, canonical, position in names:
        n = tokens(name)
        for at in range(len(t) - len(n) + 1) if n else []:
            if t[at : at + len(n)] == n:
                rank = (-len(n), -len(" ".join(n)), at, position, canonical, name)
                best[slot] = min(best.get(slot, rank), rank)
    return {slot: (b[4], b[5], b[2]) for slot, b in best.items()}


def test_slots(spark):
    r = random.Random(5)
    names = list({(r.choice(["material", "method", "place"]), " ".join(r.choice(WORDS) for _ in range(r.randint(1, 3))), r.choice("ABCD"), r.randint(0, 3)) for _ in range(60)}) + [("material", None, "A", 0), ("material", " ?! ", "A", 0), ("material", "QUARTZ", "upper", 9)]
    queries = [(k, " ".join(r.choice([*WORDS, "marsh", "What", "?"]) for _ in range(r.randint(0, 9)))) for k in range(150)] + [(900, None), (901, ""), (902, "Mars!"), (903, "quartz " * 20_000)]
    q = spark.createDataFrame(queries, "query_id long, query string").repartition(3)
    v = spark.createDataFrame(names, "slot string, name string, canonical string, position int")
    got: dict = {}
    for x in intent.slots(q, v).collect():
        got.setdefault(x.id, {})[x.slot] = (x.canonical, x.name, x.at)
    want = {k: found for k, t in queries if (found := plain(t, names))}
    assert got == want
    whole = {x.id: x for x in intent.intents(q, v).collect()}
    assert len(whole) == len(queries) and all(dict(whole[k].slots) == {s: b[0] for s, b in want.get(k, {}).items()} for k in whole)
    assert all(whole[k].understood == bool({"material", "method"} & set(want.get(k, {}))) for k in whole)
    assert intent.slots(q, v.limit(0)).count() == 0 and intent.expanded(q, v.limit(0)).count() == len(queries)


def test_goal_and_expansion(spark):
    q = spark.createDataFrame([(1, "Overview of Quartz dating"), (2, "Detect it, for example"), (3, "nothing"), (None, "quartz"), (4, None)], "query_id long, query string")
    v = spark.createDataFrame([("material", "quartz", "quartz", 1), ("material", "silica", "quartz", 2), ("material", "SiO2", "quartz", 3), ("method", "dating", "geochronology", 1), ("method", "Silica", "geochronology", 2)], "slot string, name string, canonical string, position int")
    assert {r.id: r.goal for r in intent.intents(q, v).collect()} == {1: "review", 2: "identification", 3: None, None: None, 4: None}
    got = {r.id: r.expanded for r in intent.expanded(q, v).collect()}
    assert got == {1: "Overview of Quartz dating quartz silica SiO2 dating", 2: "Detect it, for example", 3: "nothing", None: "quartz silica SiO2", 4: ""}
    assert {r.id: r.expanded for r in intent.expanded(q, v, most=1).collect()}[1] == "Overview of Quartz dating quartz dating"


def test_questions_are_never_sent_whole(spark, monkeypatch):
    """Runs of questions are many times what their table's size lets expect: only a small vocabulary goes to all tasks."""
    q = spark.createDataFrame([(1, "fine garnet and zircon"), (2, None)], "query_id long, query string")
    v = spark.createDataFrame([("material", f"name {k}", f"name {k}", k) for k in range(200)] + [("material", "zircon", "zircon", 1), ("material", "fine garnet", "garnet", 2)], "slot string, name string, canonical string, position int")
    got = []
    for most in (intent.NAMES, 0):
        monkeypatch.setattr(intent, "NAMES", most)
        found = intent.slots(q, v)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BuildLeft" not in plan and ("BuildRight" in plan) == (most > 0)
        got.append([tuple(r) for r in found.collect()])
    assert got == [[(1, "material", "garnet", "fine garnet", 0)]] * 2
