"""Statistics by field against plain Python."""

from __future__ import annotations

import math
import random
import statistics as st

import pytest

from evidencelake.operators import domains

COLUMNS = ["Age_Ma", "Strike", "Dip", "SiO2", "Na2O", "K2O", *(m for m, _, _ in domains.GRADES)]


def numbers(rows, name):
    return [r[name] for r in rows if r[name] is not None and not math.isnan(r[name])]


def rock(silica, alkali):
    if silica < 45:
        return "basanite" if alkali < 3 else "foidite / tephrite"
    for top, name in ((52, "basalt"), (57, "basaltic andesite"), (63, "andesite")):
        if silica < top:
            return name
    if silica >= 77:
        return "high-silica rhyolite"
    if alkali > 8:
        return "phonolite"
    if silica < 69:
        return "trachyandesite" if alkali > 5 and silica < 65 else "dacite"
    return "trachyte" if alkali > 5 else "rhyolite"


def plain(rows):
    ages = [x for x in numbers(rows, "Age_Ma") if x > 0]
    mean = st.mean(ages) if ages else None
    turns = [(r["Strike"], r["Dip"]) for r in rows if all(r[c] is not None and not math.isnan(r[c]) for c in ("Strike", "Dip"))]
    oxides = [numbers(rows, c) for c in ("SiO2", "Na2O", "K2O")]
    means = [st.mean(x) if x else None for x in oxides]
    grades = {}
    for metal, moderate, high in domains.GRADES:
        v = [x for x in numbers(rows, metal) if x > 0]
        if v:
            grades[metal] = (len(v), min(v), max(v), st.mean(v), "low grade" if st.mean(v) < moderate else "moderate grade" if st.mean(v) < high else "high grade")
    return {
        "age": (len(ages), min(ages, default=None), max(ages, default=None), mean, (st.stdev(ages) if len(ages) > 1 else 0.0) if ages else None, "Precambrian" if ages and mean > 541 else None, None if not ages or mean <= 541 else "Archean" if mean > 2500 else "Proterozoic"),
        "orientation": (len(turns), *(st.mean(x) if turns else None for x in (list(zip(*turns, strict=True)) or [(), ()]))),
        "rock": (len(oxides[0]), means[0], means[1] + means[2] if None not in means[1:] else None, rock(means[0], means[1] + means[2]) if None not in means else None),
        "grades": grades,
    }


def same(a, b):
    return len(a) == len(b) and all(x == y if x is None or y is None or isinstance(x, str) else x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b, strict=True))


def test_statistics(spark):
    r = random.Random(3)
    scale = {"Age_Ma": 4000, "Strike": 360, "Dip": 90, "SiO2": 90, "Na2O": 8, "K2O": 8, "Cu_pct": 2, "Au_ppm": 8, "Zn_pct": 15, "Pb_pct": 8, "Ni_pct": 2}
    rows = []
    for k in range(1500):
        g = None if k % 41 == 0 else f"g{min(k % 60, r.randint(0, 59))}"
        rows.append((g, *(r.choice([None, float("nan"), -1.0, 0.0]) if r.random() < 0.3 else r.random() * scale[c] for c in COLUMNS)))
    rows += [("lone", 2600.0, *[None] * 10), ("none", *[None] * 11), ("edge", 541.0, *[None] * 10)]
    frame = spark.createDataFrame(rows, "g string, " + ", ".join(f"`{c}` double" for c in COLUMNS)).repartition(5)
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[0], []).append(dict(zip(COLUMNS, row[1:], strict=True)))
    got = {x.g: x for x in domains.statistics(frame, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, x in got.items():
        want = plain(groups[g])
        assert all(same(tuple(x[c]), want[c]) for c in ("age", "orientation", "rock")), (g, x, want)
        assert {y.metal for y in x.grades} == set(want["grades"]) and all(same(tuple(y)[1:], want["grades"][y.metal]) for y in x.grades)
    assert got["lone"].age.sd == 0 and got["lone"].age.eon == "Archean" and got["edge"].age.era is None and got["none"].grades == []


def test_missing_and_clashing_columns(spark):
    some = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y")], "g string, Age_Ma int, __age_n string")
    row = domains.statistics(some, ["g"]).first()
    assert tuple(row.age)[:4] == (2, 1.0, 3.0, 2.0) and row.rock.name is None and row.grades == []
    assert domains.statistics(some.limit(0), ["g"]).count() == 0
    text = domains.statistics(some, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("silica", [44.9, 45, 51.9, 52, 57, 62.9, 63, 64.9, 65, 69, 76.9, 77, 90])
@pytest.mark.parametrize("alkali", [0, 2.9, 3, 5, 5.1, 8, 8.1, 12])
def test_rock_edges(spark, silica, alkali):
    from pyspark.sql import functions as F

    assert spark.range(1).select(domains.rock_class(F.lit(float(silica)), F.lit(float(alkali)))).first()[0] == rock(silica, alkali)
