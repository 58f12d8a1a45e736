"""Citation graphs as edge tables: components, coupling, co-citation, PageRank, snowballing, communities.

Iterations are joins in a bounded driver loop; every few rounds the state is written to the shared folder, so that a lost
executor costs a re-read and no lineage. The driver sees a few numbers a round. Only ``small_graph_metrics`` gathers a graph,
after checking its size.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..sources.layout import dealt

#: Edges and nodes up to which a graph may be gathered for betweenness and communities.
SMALL_EDGES = 200_000
#: Pairs that count as one row where tasks are made for them: most are counted away when they arrive.
PAIRS_A_ROW = 4


def components(spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node that each node reaches, by contraction in an order drawn anew each round.

    A node goes up to the first of itself and its neighbours, and edges to where their ends went: what was connected stays so, as
    an edge to that neighbour turns into one between both nodes' choices. Each round leaves a share of the nodes, whatever the
    graph, so that all rounds together move a small multiple of its edges. Nulls are ignored.
    """
    scratch = Scratch(spark, "components")
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    left, levels = scratch.keep(pairs, "edges-0"), []
    for turn in range(1, 1000):
        drawn = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        near = left.union(left.select("v", "u")).groupBy("u").agg(F.min_by("v", drawn("v")).alias("near"))
        level = scratch.keep(near.select(F.col("u").alias("node"), F.when(drawn("near") < drawn("u"), F.col("near")).otherwise(F.col("u")).alias("up")), f"up-{turn}")
        levels.append(level)
        one = left.join(level, left["u"] == level["node"]).select("v", F.col("up").alias("a"))
        both = one.join(level, one["v"] == level["node"]).where("a <> up").select(F.least("a", "up").alias("u"), F.greatest("a", "up").alias("v"))
        fewer = scratch.keep(both.distinct(), f"edges-{turn}")
        scratch.drop(left)
        left = fewer
        if left.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = levels[-1]
    for level in reversed(levels[:-1]):
        above = roots.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        roots = level.join(above, level["up"] == above["mid"], "left").select("node", F.coalesce("top", "up").alias("up"))
    roots = scratch.keep(roots, "roots")
    least = roots.groupBy("up").agg(F.min("node").alias("component"))
    out = scratch.keep(roots.join(least, "up").select("node", "component"), "components")
    for frame in (*levels, roots, left):
        scratch.drop(frame)
    return out


def coupling_pairs(papers: DataFrame, id_col: str, refs_col: str, least: int = 2, chunk: int = 512) -> DataFrame:
    """(a, b, shared): pairs of papers with at least ``least`` references in common, a < b.

    Meets on references; a reference of most papers makes many pairs, as coupling asks for every pair. The papers of a reference
    travel to each of them as lists of up to ``chunk``, and are counted where all references of a paper arrive. References and
    pairs are counted first, so that more of them make more tasks and not larger ones.
    """
    scratch = Scratch(papers.sparkSession, "coupling")
    refs = scratch.keep(papers.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(refs_col)).alias("ref")).where("id IS NOT NULL AND ref IS NOT NULL"), "refs")
    n_refs = refs.count()
    place = F.floor((F.row_number().over(Window.partitionBy("ref").orderBy("id")) - 1) / chunk)
    lists = scratch.keep(dealt(refs, n_refs, "ref").withColumn("chunk", place).groupBy("ref", "chunk").agg(F.collect_list("id").alias("ids")), "lists")
    held = lists.groupBy("ref").agg(F.sum(F.size("ids")).alias("n"))
    pairs = held.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    met = dealt(lists, n_refs, "ref")
    x, y = met.select("ref", F.col("chunk").alias("k"), F.col("ids").alias("some")), met.select("ref", F.col("chunk").alias("l"), F.col("ids").alias("others"))
    met = x.join(y, "ref").where("k <= l").select(F.explode("some").alias("a"), "others").select("a", F.filter("others", lambda b: b > F.col("a")).alias("others"))
    told = dealt(met.where(F.size("others") > 0), int(pairs) // PAIRS_A_ROW, "a").select("a", F.explode("others").alias("b"))
    return told.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def coupling_scores(papers: DataFrame, id_col: str, refs_col: str) -> DataFrame:
    """(id, coupling): references shared with all others, and half the logarithm of one's own, over the maximum.

    The shared references need no pairs: a reference that n papers have gives each of them n - 1.
    """
    refs = papers.select(F.col(id_col).alias("id"), F.explode_outer(F.array_distinct(refs_col)).alias("ref"))
    held = refs.where("ref IS NOT NULL").groupBy("ref").agg((F.count("*") - 1).alias("others"))
    raw = refs.join(held, "ref", "left").groupBy("id").agg((F.coalesce(F.sum("others"), F.lit(0)) + 0.5 * F.log1p(F.count("ref"))).alias("raw"))
    return max_scaled(raw, "raw", "coupling")


def max_scaled(frame: DataFrame, raw: str, name: str) -> DataFrame:
    """``raw`` over its maximum as ``name``; 0 where the maximum is not above 0. The maximum is one row of an aggregate."""
    top = frame.agg(F.max(raw).alias("__top"))
    out = frame.crossJoin(F.broadcast(top))
    return out.withColumn(name, F.when(F.col("__top") > 0, F.col(raw) / F.col("__top")).otherwise(0.0)).drop("__top", *([raw] if raw != name else []))


def cocitation_scores(papers: DataFrame, id_col: str, refs_col: str) -> DataFrame:
    """(id, cocitation): how often others of the corpus cite a paper together with one more of it, over the maximum.

    A paper that cites n of the corpus counts n - 1 for each of them (and each occurrence in its list).
    """
    ids = papers.select(F.col(id_col).alias("id")).distinct()
    cites = Scratch(papers.sparkSession, "cocitation").keep(papers.select(F.col(id_col).alias("by"), F.explode(refs_col).alias("id")).where("by <> id"), "cites")
    n = cites.count()
    counts = dealt(dealt(cites, n, "id").join(ids, "id", "left_semi"), n, "by").groupBy("by", "id").agg(F.count("*").alias("times"))
    counts = counts.withColumn("total", F.sum("times").over(Window.partitionBy("by")))
    raw = counts.groupBy("id").agg(F.sum(F.col("times") * (F.col("total") - F.col("times")) + F.col("times") * (F.col("times") - 1)).cast("double").alias("raw"))
    return max_scaled(ids.join(raw, "id", "left").fillna(0.0, ["raw"]), "raw", "cocitation")


def corpus_edges(papers: DataFrame, id_col: str, refs_col: str) -> DataFrame:
    """(src, dst): distinct references between papers of the corpus, dealt out by ``src``."""
    cites = Scratch(papers.sparkSession, "corpus").keep(papers.select(F.col(id_col).alias("src"), F.explode(refs_col).alias("dst")).where("src <> dst"), "cites")
    n = cites.count()
    inside = dealt(cites, n, "dst").join(papers.select(F.col(id_col).alias("dst")).distinct(), "dst", "left_semi")
    return dealt(inside.select("src", "dst"), n, "src").distinct()


def pagerank(spark: SparkSession, nodes: DataFrame, edges: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6, write_every: int = 5, chunk: int = 4096) -> DataFrame:
    """(id, rank): PageRank over distinct edges (src, dst) of ``nodes`` (id); the rank of nodes without edges out is dealt to
    all alike. Stops when ranks move by under ``tolerance`` in sum. Ranks sum to one. Edges are kept as lists of up to ``chunk``, so
    that a round sorts nodes and not edges."""
    scratch = Scratch(spark, "pagerank")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    place = F.floor((F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1) / chunk)
    ends = edges.select("src", "dst", (1.0 / F.count("*").over(Window.partitionBy("src"))).alias("share"), place.alias("chunk"))
    shares = scratch.keep(ends.groupBy("src", "share", "chunk").agg(F.collect_list("dst").alias("dsts")).drop("chunk"), "shares")
    out = shares.select("src").distinct()
    ranks = scratch.keep(nodes.join(out.select(F.col("src").alias("id"), F.lit(True).alias("cites")), "id", "left").select("id", F.coalesce("cites", F.lit(False)).alias("cites"), F.lit(1.0 / n).alias("rank")), "ranks-0")
    kept = ranks
    for turn in range(1, most + 1):
        idle = ranks.where("NOT cites").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("idle"))
        gained = shares.join(ranks.select(F.col("id").alias("src"), "rank"), "src").select(F.explode("dsts").alias("dst"), (F.col("rank") * F.col("share")).alias("part")).groupBy("dst").agg(F.sum("part").alias("gained"))
        new = ranks.join(gained, ranks["id"] == gained["dst"], "left").crossJoin(F.broadcast(idle))
        new = new.select("id", "cites", (damping * (F.coalesce("gained", F.lit(0.0)) + F.col("idle") / n) + (1 - damping) / n).alias("rank"), F.col("rank").alias("before"))
        if turn % write_every == 0 or turn == most:
            new = scratch.keep(new, f"ranks-{turn}")
            moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
            scratch.drop(kept)
            ranks = kept = new.drop("before")
            scratch.paths[id(kept)] = scratch.paths.pop(id(new))
            if moved < tolerance:
                break
        else:
            ranks = new.drop("before")
    return ranks.select("id", "rank")


def centrality(spark: SparkSession, papers: DataFrame, id_col: str = "paper_id", refs_col: str = "referenced_works") -> DataFrame:
    """(id, coupling, cocitation, pagerank, network): three scaled signals and their scaled mean."""
    papers = Scratch(spark, "centrality").keep(papers.select(id_col, refs_col), "papers")
    nodes = papers.select(F.col(id_col).alias("id")).distinct()
    rank = max_scaled(pagerank(spark, nodes, corpus_edges(papers, id_col, refs_col)), "rank", "pagerank")
    joined = coupling_scores(papers, id_col, refs_col).join(cocitation_scores(papers, id_col, refs_col), "id").join(rank, "id")
    mean = joined.withColumn("__mean", (F.col("coupling") + F.col("cocitation") + F.col("pagerank")) / 3)
    return max_scaled(mean, "__mean", "network")


def coauthor_edges(papers: DataFrame, id_col: str, names_col: str, most: int = 8) -> DataFrame:
    """(a, b, weight): pairs among the first ``most`` distinct names of each paper."""
    names = papers.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.slice(names_col, 1, most))).alias("name"))
    a, b = names.select("id", F.col("name").alias("a")), names.select("id", F.col("name").alias("b"))
    return a.join(b, "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def snowball(spark: SparkSession, seeds: DataFrame, edges: DataFrame, depth: int = 1, direction: str = "backward", least_new: int = 0, least_ratio: float = 0.0) -> tuple[DataFrame, list[dict]]:
    """Papers (id, depth) found from ``seeds`` (id) over (src, dst) citations, and a log row a step.

    Backward follows references, forward the citing papers. Stops early at saturation: when a step finds under ``least_new``
    papers and these are under ``least_ratio`` of all so far.
    """
    scratch = Scratch(spark, "snowball")
    way = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if direction == "backward" else edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    seen = scratch.keep(seeds.select("id").distinct().select("id", F.lit(0).alias("depth")), "depth-0")
    frontier, total, log = seen, seen.count(), []
    for step in range(1, depth + 1):
        reached = way.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = scratch.keep(reached.join(seen, "id", "left_anti").select("id", F.lit(step).alias("depth")), f"depth-{step}")
        new = frontier.count()
        seen = seen.union(frontier)
        total += new
        ratio = new / total if total else 0.0
        log.append({"depth": step, "new": new, "total": total, "ratio": ratio})
        if not new or (new < least_new and ratio < least_ratio):
            break
    return seen, log


def small_graph_metrics(nodes: DataFrame, edges: DataFrame, sources: int = 50) -> pd.DataFrame | None:
    """Betweenness from at most ``sources`` nodes, and communities by greedy modularity, of a graph that fits the driver.

    None under 3 nodes or 5 edges. Raises above SMALL_EDGES edges or nodes. Edges are (src, dst, weight); direction is dropped.
    """
    if max(edges.limit(SMALL_EDGES + 1).count(), nodes.limit(SMALL_EDGES + 1).count()) > SMALL_EDGES:
        raise ValueError("the graph is too large to gather")
    names = sorted(r.id for r in nodes.select("id").distinct().collect())
    links = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w")).where("a <> b").orderBy("a", "b").collect()
    if len(names) < 3 or len(links) < 5:
        return None
    number = {x: k for k, x in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    for r in links:
        a, b = number[r.a], number[r.b]
        near[a][b] = near[b][a] = float(r.w)
    return pd.DataFrame({"id": names, "betweenness": betweenness(near, sources), "community": communities(near)})


def betweenness(near: list[dict[int, float]], sources: int) -> np.ndarray:
    """Share of shortest paths through each node, from evenly spaced source nodes."""
    n = len(near)
    chosen = range(n) if n <= sources else [i * n // sources for i in range(sources)]
    total = np.zeros(n)
    for s in chosen:
        far, paths, order = {s: 0}, np.zeros(n), []
        paths[s] = 1
        queue = deque([s])
        while queue:
            a = queue.popleft()
            order.append(a)
            for b in near[a]:
                if b not in far:
                    far[b] = far[a] + 1
                    queue.append(b)
                if far[b] == far[a] + 1:
                    paths[b] += paths[a]
        share = np.zeros(n)
        for b in reversed(order):
            for a in near[b]:
                if far.get(a, n + 1) == far[b] - 1:
                    share[a] += paths[a] / paths[b] * (1 + share[b])
            if b != s:
                total[b] += share[b]
    return total / max(1, (n - 1) * (n - 2)) * (n / max(1, len(list(chosen))))


def communities(near: list[dict[int, float]]) -> np.ndarray:
    """Merge the pair of groups that raises modularity most, until none does; groups are numbered by size."""
    n = len(near)
    weight = sum(sum(x.values()) for x in near) or 1.0
    degree = [sum(x.values()) / weight for x in near]
    between: dict[int, dict[int, float]] = {a: {b: w / weight for b, w in x.items()} for a, x in enumerate(near)}
    group = list(range(n))
    while True:
        gain, a, b = max(((2 * (w - degree[a] * degree[b]), -a, -b) for a, x in between.items() for b, w in x.items() if a < b), default=(0.0, 0, 0))
        if gain <= 1e-12:
            break
        a, b = -a, -b
        for c, w in between.pop(b).items():
            between[c].pop(b, None)
            if c != a:
                between[a][c] = between[c][a] = between[a].get(c, 0.0) + w
        between[a].pop(b, None)
        degree[a] += degree[b]
        group = [a if g == b else g for g in group]
    sizes = {g: group.count(g) for g in set(group)}
    rank = {g: k for k, g in enumerate(sorted(sizes, key=lambda g: (-sizes[g], g)))}
    return np.array([rank[g] for g in group])


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, density) of a directed graph."""
    n, e = nodes.agg(F.count_distinct("id").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    return n.crossJoin(e).withColumn("density", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0))
