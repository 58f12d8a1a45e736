"""Pooling against known values."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidencelake.functions import effects, special
from evidencelake.operators import effects as arms
from evidencelake.operators import meta, units

Y, V = np.array([0.2, 0.8, 0.5, 1.1, -0.1, 0.6]), np.array([0.08, 0.09, 0.07, 0.12, 0.10, 0.08])


def test_between_study_variance():
    assert meta.tau_squared(Y, V, "reml") == pytest.approx(0.0634693, abs=1e-5)
    assert meta.tau_squared(Y, V, "pm") == pytest.approx(0.0782891, abs=5e-5)
    assert meta.tau_squared(np.array([0.5, 0.52, 0.49, 0.51]), np.full(4, 0.05), "reml") == 0


def test_hartung_knapp_interval():
    y = np.array([1.0, 2, 3, 4])
    got = meta.pool_one(y, np.ones(4), "dl", True)
    w = 1 / (1 + got["tau_squared"])
    se = math.sqrt((w * (y - 2.5) ** 2).sum() / (3 * 4 * w))
    assert got["effect"] == pytest.approx(2.5) and got["se"] == pytest.approx(se)
    assert got["ci_upper"] - got["effect"] == pytest.approx(special.t_isf(0.025, 2) * se) and special.t_isf(0.025, 2) == pytest.approx(4.302653, abs=1e-5)


def test_trim_and_fill_of_a_symmetric_funnel():
    y = np.arange(0.35, 0.66, 0.05)
    assert meta.trim_and_fill(y, np.full(len(y), 0.05))["n_filled"] == 0
    lopsided = meta.trim_and_fill(np.array([0.1, 0.12, 0.15, 0.2, 0.8, 0.9, 1.0]), np.array([0.01, 0.01, 0.01, 0.02, 0.2, 0.2, 0.2]))
    assert lopsided["n_filled"] >= 1 and lopsided["shift"] < 0


def test_influence(spark):
    rows = [(1, e, 0.05) for e in (0.5, 0.52, 0.49, 0.51, 3.0)] + [(2, 1.0, 0.1)]
    got = meta.leave_one_out(spark.createDataFrame(rows, "g int, effect double, variance double"), ["g"]).collect()
    assert len(got) == 5 and max(got, key=lambda r: abs(r.shift)).omitted_effect == 3.0


def test_p_curve_and_selection():
    assert meta.p_curve(np.array([0.01, -0.01, 0]), np.full(3, 4.0))["k_significant"] == 0
    assert meta.selection_model(np.array([0.1, 0.2]), np.array([1.0, 1.0])) is None
    strong = meta.p_curve(np.full(6, 1.0), np.full(6, 0.05))
    assert strong["verdict"] == "right-skewed"


@settings(max_examples=40, deadline=None)
@given(st.floats(0.1, 60), st.integers(1, 40))
def test_tails(x, df):
    assert 0 <= special.chi2_sf(x, df) <= 1
    assert special.t_sf(special.t_isf(0.025, df), df) == pytest.approx(0.025, abs=1e-9)
    assert special.t_sf(-x, df) == pytest.approx(1 - special.t_sf(x, df))
    if df == 2:
        assert special.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2))


def test_known_tails():
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and special.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.norm_sf(1.959964) == pytest.approx(0.025, abs=1e-7) and special.norm_isf(0.025) == pytest.approx(1.959964, abs=1e-6)


def test_native_pooling_equals_one_pool_in_numpy(spark):
    s = spark.createDataFrame([("a", float(y), float(v)) for y, v in zip(Y, V, strict=True)] + [("b", 1.0, 0.5), ("c", 1.0, 0.0), ("c", 2.0, 0.0)], "p string, effect double, variance double")
    h = {r.p: r for r in meta.heterogeneity(s, ["p"]).collect()}
    assert h["a"].tau_squared == pytest.approx(meta.tau_dl(Y, V)) and h["b"].q == 0 and h["b"].h_squared == 1 and h["c"].q == 0
    pooled = {r.p: r for r in meta.pool_random(s, ["p"]).collect()}
    assert pooled["a"].effect == pytest.approx(meta.pool_one(Y, V)["effect"]) and "c" not in pooled
    advanced = meta.pool_advanced(s.where("p = 'a'"), ["p"]).first()
    assert advanced.tau_squared == pytest.approx(0.0634693, abs=1e-5) and advanced.k == 6


def test_effect_sizes(spark):
    c = [F.lit(float(x)) for x in (10, 2, 20, 8, 2, 20)]
    row = spark.range(1).select(
        effects.cohens_d(*c).alias("d"), effects.odds_ratio(*map(F.lit, (0, 5, 5, 0))).alias("o"), effects.risk_ratio(*map(F.lit, (0, 0, 1, 2))).alias("r"), effects.hedges_g(F.lit(1.0), F.lit(1), F.lit(2)).alias("g"),
        effects.number_needed_to_treat(F.lit(0.0)).alias("n"), effects.d_to_or(effects.or_to_d(F.lit(2.5))).alias("back"), effects.variance_d(F.lit(1), F.lit(2), F.lit(1.0)).alias("v"), effects.cohens_d(*[F.lit(0.0)] * 6).alias("zero"),
    ).first()
    assert row.d == 1 and row.o == pytest.approx(0.25 / 30.25) and row.r is None and row.g == 1 and row.n == math.inf and row.back == pytest.approx(2.5) and row.v == math.inf and row.zero == 0


def test_units(spark):
    rows = [("p1", 1.0, "GPa", "", 0.1, 4), ("p2", 100.0, "MPa", "pressure", None, None), ("p3", 5.0, "kbar", "", None, None), ("p4", 1000.0, "K", "", 10.0, 2), ("p5", 5.0, "‰", "", None, None), ("p6", 3.0, "furlong", "", None, None), ("p7", 1.0, None, "", None, None)]
    m = spark.createDataFrame(rows, "paper_id string, value double, unit string, measurement string, uncertainty double, n int")
    got = {r.paper_id: r for r in units.canonical(m).collect()}
    assert got["p1"].value == 10 and got["p1"].uncertainty == pytest.approx(1.0) and got["p2"].value == 1 and got["p4"].value == pytest.approx(726.85) and got["p4"].uncertainty == 10 and got["p5"].value == 0.5 and got["p6"].unit == "furlong"
    pool = units.pools(m).collect()
    assert {r.effect for r in pool} == {10.0, 1.0, 5.0} and {r.pool for r in pool} == {"pressure (kbar)"}


def test_arms(spark):
    rows = [("a", 10.0, 2.0, 20, 8.0, 2.0, 20, None, None), ("b", 10.0, None, None, 8.0, None, None, 1.0, 3.0), ("c", 10.0, None, 5, 8.0, None, 5, None, None), ("d", 1.0, None, None, 1.0, None, None, None, None)]
    got = {r.paper_id: r for r in arms.continuous(spark.createDataFrame(rows, "paper_id string, mean1 double, sd1 double, n1 int, mean2 double, sd2 double, n2 int, ci_lower double, ci_upper double")).collect()}
    assert got["a"].scale == "smd" and got["a"].effect == pytest.approx(1 - 3 / 151) and got["b"].variance == pytest.approx((2 / 3.92) ** 2) and got["c"].variance == pytest.approx(0.4) and "d" not in got


def test_selection_model_against_a_fine_search():
    """No effect and weight of a fine search over both fit better, and the best of it is near."""
    rng = np.random.default_rng(8)
    for k in (3, 4, 7, 15, 40):
        for _ in range(6):
            v = rng.uniform(0.01, 0.4, k)
            y = rng.normal(rng.choice([0.0, 0.3, 0.8]), 0.3, k)
            got = meta.selection_model(y, v)

            def cost(theta, delta, y=y, v=v, k=k):
                z = (y[:, None] - theta) / np.sqrt(v)[:, None]
                hits = (z > NORMAL_05).sum(axis=0)
                return 0.5 * (z * z).sum(axis=0)[:, None] - hits[:, None] * np.log(delta) + k * np.log(0.95 + 0.05 * delta)

            theta = np.linspace(got["naive_effect"] - 3, got["naive_effect"] + 3, 60_001)  # a step of 1e-4
            delta = np.exp(np.linspace(math.log(0.01), math.log(100), 301))
            fine = np.inf
            for part in np.array_split(theta, 60):
                fine = min(fine, cost(part, delta).min())
            at = got["adjusted_effect"] + np.array([-1e-9, 0.0, 1e-9])  # an optimum may lie right beside a cut
            mine = cost(at, np.array([got["selection_delta"]])).min()
            assert mine <= fine + 1e-6
            near = got["adjusted_effect"] + np.linspace(-2e-5, 2e-5, 41)
            assert cost(near, np.array([got["selection_delta"]])).min() >= mine - 1e-6


NORMAL_05 = 1.6448536269514722


def test_a_pool_without_each_study_is_that_pool_estimated_anew():
    r = np.random.default_rng(5)
    for v in (r.uniform(0.05, 1, 30), r.integers(1, 4, 30) / 10, np.full(30, 0.2)):
        y = r.normal(0, 1, 30)
        y[0] = 1e6  # far from all others: sums without it keep their digits
        for method in ("reml", "pm", "dl"):
            for hksj in (True, False):
                mean, half = meta.without_each(y, v, method, hksj)
                for i in range(30):
                    alone = meta.pool_one(np.delete(y, i), np.delete(v, i), method, hksj)
                    assert mean[i] == pytest.approx(alone["effect"], rel=1e-7, abs=1e-8) and half[i] == pytest.approx(alone["ci_upper"] - alone["effect"], rel=1e-6)


def test_leaving_each_study_of_a_large_pool_out_takes_seconds():
    r = np.random.default_rng(6)
    start = time.perf_counter()
    meta.without_each(r.normal(0, 1, 5_000), r.integers(1, 8, 5_000) / 10, "reml", True)
    assert time.perf_counter() - start < 20


def test_pools_are_summed_by_variance_before_a_group_is_made(spark):
    r = np.random.default_rng(7)
    rows = [(i % 2, float(y), float(v)) for i, (y, v) in enumerate(zip(r.normal(0, 1, 400), r.integers(1, 5, 400) / 10, strict=True))]
    frame = spark.createDataFrame(rows, "g int, effect double, variance double")
    for method, hksj in (("reml", True), ("pm", False)):
        pools = meta.pool_advanced(frame, ["g"], method=method, hksj=hksj)
        assert "var_pop" in pools._jdf.queryExecution().toString()
        for got in pools.collect():
            y, v = (np.array([x[c] for x in rows if x[0] == got.g]) for c in (1, 2))
            assert got.k == 200
            for name, value in meta.pool_one(y, v, method, hksj).items():
                assert got[name] == pytest.approx(value, rel=1e-8)


def test_pools_join_no_studies(spark):
    """Studies are summed by pool and variance before they meet anything of their pool; nulls and pools of one stay as they were."""
    rows = [(k % 3, k % 2, 0.1 * (k % 7), 0.01 * (1 + k % 4)) for k in range(60)] + [(7, 0, 1.0, 0.5), (None, 0, 1.0, 0.5), (8, 1, None, 0.2), (8, 1, 2.0, 0.1), (9, 0, 1.0, None)]
    t = spark.createDataFrame(rows, "p int, g int, effect double, variance double")
    got = {(r.p, r.g): r for r in meta.subgroups(t, ["p"], "g")[0].collect()}
    assert set(got) == {(p, g) for p in range(3) for g in range(2)} | {(7, 0), (8, 1)} and got[7, 0].model == "fixed" and got[8, 1].k == 2
    for (p, g), r in got.items():
        mine = [(e, v) for a, b, e, v in rows if (a, b) == (p, g)]
        full = [(e, v) for e, v in mine if e is not None]
        sw, centre = sum(1 / v for _, v in mine), sum(e for e, _ in full) / len(full)
        swx, swxx = sum((e - centre) / v for e, v in full), sum((e - centre) ** 2 / v for e, v in full)
        q, c = max(swxx - swx * swx / sw, 0), sw - sum(1 / v**2 for _, v in mine) / sw
        tau = max((q - len(mine) + 1) / c, 0) if len(mine) > 1 else 0
        assert r.effect == pytest.approx(sum(e / (v + tau) for e, v in full) / sum(1 / (v + tau) for _, v in mine), rel=1e-9)
    assert_summed_first(meta.pool_random(t, ["p"]))


def test_decades_are_chosen_after_pooling(spark):
    """Pools are chosen among their decades' results, not by a join of all studies."""
    rows = [("a", float(k % 2) * 9, 0.01, 1990 + k) for k in range(20)] + [("b", 1.0, 0.01, 1990 + k) for k in range(20)] + [("c", float(k % 2) * 9, 0.01, 1990 + k if k else None) for k in range(20)]
    found = meta.decade_pools(spark.createDataFrame(rows, "p string, effect double, variance double, year int"), ["p"])
    assert sorted((r.p, r.decade, r.k) for r in found.collect()) == [("a", 1990, 10), ("a", 2000, 10)]
    assert_summed_first(found)


def assert_summed_first(frame):
    """In the plan a sum stands above each reading of the studies before any join does."""
    lines = frame._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for k, line in enumerate(lines):
        if "LogicalRDD" in line:
            above, at = [], depth[k]
            for j in range(k - 1, -1, -1):
                if depth[j] < at:
                    above, at = [*above, lines[j].lstrip(" :+-").split(" ")[0]], depth[j]
            assert next(x for x in above if x in ("Aggregate", "Join")) == "Aggregate"
