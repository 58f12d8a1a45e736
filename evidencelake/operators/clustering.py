"""Order-dependent grouping of findings over pair scores, and greedy packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def pair_scores(items: DataFrame, id_col: str, tokens: str, by: list[str] | None = None, least: float = 0.15) -> DataFrame:
    """(by, a, b, score): pairs of items of a group with token likeness of at least ``least``; they meet on tokens."""
    by = by or []
    flat = items.select(*by, F.col(id_col).alias("id"), F.col(tokens).alias("set"), F.explode(tokens).alias("t"))
    a, b = flat.select(*by, "t", F.col("id").alias("a"), F.size("set").alias("na")), flat.select(*by, "t", F.col("id").alias("b"), F.size("set").alias("nb"))
    shared = a.join(b, [*by, "t"]).where("a < b").groupBy(*by, "a", "b", "na", "nb").agg(F.count("*").alias("s"))
    return shared.select(*by, "a", "b", (F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("score")).where(F.col("score") >= least)


def contained(texts: DataFrame, claims: DataFrame, least: float) -> DataFrame:
    """(text_id, claim_id, score): texts (text_id, tokens) that have at least ``least`` of a claim's (claim_id, tokens) distinct
    tokens, ``least`` above 0. They meet on tokens; a text's rows lie together, so counts shrink before the shuffle."""
    c = claims.select("claim_id", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    t = texts.select("text_id", F.explode("tokens").alias("t"))
    shared = t.join(c, "t").groupBy("text_id", "claim_id", "n").agg(F.count("*").alias("s"))
    return shared.select("text_id", "claim_id", (F.col("s") / F.col("n")).alias("score")).where(F.col("score") >= least)


def vector_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, score): pairs of documents by the inner product of sparse vectors (id, term, weight) of length one."""
    a, b = vectors.select("term", F.col("id").alias("a"), F.col("weight").alias("x")), vectors.select("term", F.col("id").alias("b"), F.col("weight").alias("y"))
    return a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("score")).where(F.col("score") >= least)


def _assign(ids: list, near: dict, most: int | None) -> dict:
    leader: dict = {}
    size: dict = {}
    place = {i: k for k, i in enumerate(ids)}
    for i in ids:
        fits = [(s, j) for j, s in near.get(i, {}).items() if leader.get(j) == j and (most is None or size[j] < most)]
        best = max(fits, key=lambda x: (x[0], -place[x[1]]))[1] if fits else i
        leader[i] = best
        size[best] = size.get(best, 0) + 1
    return leader


def leaders(items: DataFrame, pairs: DataFrame, id_col: str, by: str, most: int | None = None) -> DataFrame:
    """(id, leader): in order of id each item joins the most alike leader it has a pair with, else leads; a leader takes
    ``most`` members. ``pairs``: by, a, b, score. A group is the findings of one theme or brief."""
    nodes = items.select(F.col(by).alias("g"), F.col(id_col).alias("a"), F.lit(None).cast(items.schema[id_col].dataType).alias("b"), F.lit(0.0).alias("score"))
    links = pairs.select(F.col(by).alias("g"), "a", "b", "score")
    kind = items.schema[id_col].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for r in rows[rows["b"].notna()].itertuples():
            near.setdefault(r.b, {})[r.a] = r.score
            near.setdefault(r.a, {})[r.b] = r.score
        ids = sorted(rows[rows["b"].isna()]["a"])
        got = _assign(ids, near, most)
        return pd.DataFrame({"id": list(got), "leader": list(got.values())})

    return nodes.unionByName(links).groupBy("g").applyInPandas(run, f"id {kind}, leader {kind}")


def agreement_groups(items: DataFrame, pairs: DataFrame, id_col: str, by: str) -> DataFrame:
    """(leader, n, mean gap, contrast): groups of alike findings; they contrast when their values lie over a fifth apart."""
    got = leaders(items, pairs, id_col, by)
    values = items.select(F.col(id_col).alias("id"), F.col("value"))
    out = got.join(values, "id").groupBy("leader").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
    gap = F.coalesce(F.try_divide(F.col("hi") - F.col("lo"), F.abs("mean")), F.lit(0.0))
    return out.select("leader", "n", gap.alias("gap"), (gap > 0.2).alias("contrast"))


def themes(papers: DataFrame, vocabulary: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """(id, theme) by weighted words, ``other`` without any."""
    from .extraction import weighted_class

    return weighted_class(papers, id_col, X.record_text(F.col("title"), F.col("abstract")), vocabulary, "other").select(F.col("id").alias(id_col), F.col("label").alias("theme"))


def distinctive_terms(docs: DataFrame, by: str, tokens: str, most: int = 3) -> DataFrame:
    """(by, term, score): terms of a group by their share there times the log of how few groups have them."""
    from pyspark.sql import Window as W

    counts = docs.select(by, F.explode(tokens).alias("term")).groupBy(by, "term").agg(F.count("*").alias("tf"))
    n = docs.select(by).distinct().agg(F.count("*").alias("n"))
    held = counts.groupBy("term").agg(F.count("*").alias("df"))
    size = counts.groupBy(by).agg(F.sum("tf").alias("all"))
    scored = counts.join(held, "term").join(size, by).crossJoin(F.broadcast(n)).withColumn("score", F.col("tf") / F.col("all") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return scored.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "term"))).where(F.col("r") <= most).select(by, "term", "score")


def pack(items: DataFrame, by: str, priority: str, size: str, budget: int, id_col: str) -> DataFrame:
    """(id) of the items that fit a budget of characters, taken by priority; one that does not fit is passed over."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for r in rows.sort_values(["p", "id"], ascending=[False, True]).itertuples():
            if r.s <= left:
                left -= r.s
                out.append(r.id)
        return pd.DataFrame({"id": out})

    return items.select(F.col(by).alias("g"), F.col(id_col).alias("id"), F.col(priority).alias("p"), F.col(size).alias("s")).groupBy("g").applyInPandas(run, f"id {kind}")
