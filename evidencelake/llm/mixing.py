"""Mixing sources to target weights as a min-cost flow.

Documents that belong to the same set of sources form a pattern. A pattern's tokens can be used up to ``max_epochs`` times; its
e-th use costs e a token, so that repetition is put off and spread (the costs are convex). The flow sends pattern capacity to
source quotas at least cost. A pattern whose flow is b whole uses and a rest takes every document b times and seeded documents
once more until the rest is met. Driver data are totals a pattern; documents are counted and selected in Spark.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import free_name
from .scratch import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Hash bins a pattern's documents are counted in before the one in which its rest runs out is looked into.
BINS = 1 << 16
#: Documents before and after the place where a rest runs out, of which the best sum is sought.
FILL = 48
#: Steps in which sums are told apart in that search.
SUM_STEPS = 1 << 21


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    runs = F.regexp_replace(text, "[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")
    return F.when(F.coalesce(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == "", 0).otherwise(F.length(runs)).cast("long")


def quotas(sizes: list[int], weights: list[float], max_epochs: int = MAX_EPOCHS, total: float | None = None) -> list[float]:
    """Shares of the total (default: of all sizes) by weight, none above ``max_epochs`` times its size; the excess is shared again
    by weight until none is."""
    total = float(sum(sizes)) if total is None else float(total)
    capped = [False] * len(sizes)
    while True:
        free = [i for i, c in enumerate(capped) if not c]
        rest = total - sum(max_epochs * sizes[i] for i, c in enumerate(capped) if c)
        weight = sum(weights[i] for i in free)
        out = [float(max_epochs * s) if capped[i] else (rest * weights[i] / weight if weight else 0.0) for i, s in enumerate(sizes)]
        over = [i for i in free if out[i] > max_epochs * sizes[i]]
        if not over:
            return out
        for i in over:
            capped[i] = True


def min_cost_flow(capacity: list[int], members: list[list[int]], need: list[int], max_epochs: int = MAX_EPOCHS) -> list[dict[int, int]]:
    """Tokens from each pattern to each of its sources: as much of the needs as can be met, at least total cost.

    Successive shortest paths with potentials over start -> pattern (an arc of cost e for the e-th use) -> source -> end.
    """
    n_p, n_s = len(capacity), len(need)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[list[int]]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, size in enumerate(capacity):
        for epoch in range(max_epochs):
            arc(start, p, size, epoch)
        for s in members[p]:
            arc(p, n_p + s, max_epochs * size, 0)
    for s, tokens in enumerate(need):
        arc(n_p + s, end, tokens, 0)
    potential = [0] * (end + 1)
    while True:
        far, via = [float("inf")] * (end + 1), [(-1, -1)] * (end + 1)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                step = d + cost + potential[a] - potential[b]
                if room > 0 and step < far[b]:
                    far[b], via[b] = step, (a, k)
                    heapq.heappush(heap, (step, b))
        if far[end] == float("inf"):
            break
        potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
        path, b = [], end
        while b != start:
            a, k = via[b]
            path.append((a, k))
            b = a
        push = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            edge = graph[a][k]
            edge[1] -= push
            graph[edge[0]][edge[3]][1] += push
    out: list[dict[int, int]] = []
    for p in range(n_p):
        got: dict[int, int] = {}
        for b, _, _, back in graph[p]:
            if n_p <= b < start and (used := graph[b][back][1]):
                got[b - n_p] = got.get(b - n_p, 0) + used
        out.append(got)
    return out


def best_sum(sizes: list[int], wanted: int) -> list[bool]:
    """Which sizes to take for the sum nearest to ``wanted``, earlier ones rather than later ones.

    Sums that can be reached are the bits of a number, which each size shifts; walking back, a size is left out where the sum can
    be reached without it.
    """
    step = max(1, sum(sizes) // SUM_STEPS)
    scaled, goal = [-(-s // step) for s in sizes], max(0, wanted // step)
    reach = [1]
    for s in scaled:
        reach.append(reach[-1] | reach[-1] << s)
    last = reach[-1]
    below = (last & ((1 << goal + 1) - 1)).bit_length() - 1
    above = last >> goal
    up = goal + (above & -above).bit_length() - 1 if above else below
    total = up if up - goal < goal - below else below
    taken = [False] * len(sizes)
    for k in range(len(sizes) - 1, -1, -1):
        if not reach[k] >> total & 1:
            taken[k] = True
            total -= scaled[k]
    return taken


def fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one pattern's documents near the end of its rest, in seeded order: those well before it, and of the FILL on either side
    those whose sum comes nearest."""
    rows = rows.sort_values(["draw", "id", "size"], kind="stable", na_position="last").reset_index(drop=True)
    left, sizes = int(rows["rest"].iloc[0]), [int(s) for s in rows["size"]]
    upto, place = 0, 0
    while place < len(sizes) and upto + sizes[place] <= left:
        upto, place = upto + sizes[place], place + 1
    first, last = max(0, place - FILL), min(len(sizes), place + FILL)
    extra = [True] * first + best_sum(sizes[first:last], left - sum(sizes[:first])) + [False] * (len(sizes) - last)
    return rows.assign(extra=extra)[["rid", "extra"]]


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, weights: dict[str | None, float] | None = None, cycle: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7, total: int | None = None) -> DataFrame:
    """(id, rid, pattern, size, source_size, target, copies, taken) for every row: size in words, taken = copies x size, target
    and source_size of the first source of the pattern; rid is the hash of seed, id and text that draws the row.

    ``sources`` is an array column; a document counts towards any one of its sources for each use. Default: the column source.
    A null source is a source, last in order; weights not given go round ``cycle`` in order of code point. An empty array is
    the null source. Targets share ``total`` words (default: all). Null and wordless texts have size 0 and are never taken.
    Rows that repeat an id are drawn one by one; rows equal in id and text are drawn alike, so each counts. An empty table
    stays empty. Reruns agree. Other columns are not read.

    The driver holds one row a pattern and source, which are settings of a corpus and no documents. Seeded selection: words
    are summed in BINS hash bins a pattern, a running sum finds the bin in which the rest runs out, and only that bin's
    documents and those FILL before and after are put in order, so that no source is gathered in one task.
    """
    scratch = Scratch(spark, "mix")
    named = F.array(F.col("source")) if sources is None else F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))
    sized = docs.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.coalesce(named, F.array(F.lit(None).cast("string"))))).alias("pattern"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("rid"), word_count(F.col(text_col)).alias("size"))
    sized = scratch.keep(sized.withColumn("draw", F.shiftrightunsigned("rid", 1)).withColumn("bin", F.shiftrightunsigned("rid", 48).cast("int")), "sizes")
    totals = [(r.pattern, int(r.size)) for r in sized.groupBy("pattern").agg(F.sum("size").alias("size")).collect()]
    totals.sort(key=lambda x: [(s is None, (s or "").encode("utf-32-be")) for s in x[0]])
    order = sorted({s for p, _ in totals for s in p}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    at = {s: k for k, s in enumerate(order)}
    share = [(weights or {}).get(s, cycle[k % len(cycle)]) for k, s in enumerate(order)]
    sizes = [sum(n for p, n in totals if s in p) for s in order]
    target = quotas(sizes, share, max_epochs, sum(n for _, n in totals) if total is None else total)
    flows = min_cost_flow([n for _, n in totals], [[at[s] for s in p] for p, _ in totals], [round(t) for t in target], max_epochs)
    plan = []
    for (pattern, size), flow in zip(totals, flows, strict=True):
        used = sum(flow.values())
        base = min(used // size, max_epochs) if size else 0
        first = at[pattern[0]]
        plan.append((pattern, base, used - base * size, sizes[first], target[first]))
    shape = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("base", T.LongType()), T.StructField("rest", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    planned = sized.join(spark.createDataFrame(plan, shape), "pattern")
    bins = planned.where("rest > 0").groupBy("pattern", "rest", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    ordered = "PARTITION BY pattern ORDER BY bin"
    bins = bins.select("*", F.expr(f"sum(words) OVER ({ordered})").alias("run"), F.expr(f"sum(n) OVER ({ordered})").alias("seen"))
    cut = bins.where("run > rest").groupBy("pattern").agg(F.min(F.struct("bin", F.expr("seen - n").alias("before"), F.col("seen").alias("seen"))).alias("cut"))
    near = bins.join(cut, "pattern").where(f"seen > cut.before - {FILL} AND seen - n < cut.seen + {FILL}")
    end = near.groupBy("pattern").agg(F.min("bin").alias("from_bin"), F.min(F.expr("struct(bin, rest - (run - words) AS left)")).alias("first"), F.max("bin").alias("to_bin"))
    end = end.select("pattern", "from_bin", "first.left", "to_bin")
    placed = planned.join(F.broadcast(end) if len(plan) <= 100_000 else end, "pattern", "left")
    placed = placed.withColumn("more", F.expr("CASE WHEN rest = 0 OR size = 0 THEN 0 WHEN from_bin IS NULL OR bin < from_bin THEN 1 WHEN bin <= to_bin THEN 2 ELSE 0 END"))
    tail = placed.where("more = 2").select("pattern", "id", "rid", "draw", "size", F.col("left").alias("rest"))
    drawn = tail.groupBy("pattern").applyInPandas(fill, "rid long, extra boolean").groupBy("rid").agg(F.count_if("extra").alias("extra"), F.count("*").alias("rows"))
    drawn = scratch.keep(drawn, "drawn")
    copies = placed.join(F.broadcast(drawn) if drawn.count() <= 1_000_000 else drawn, "rid", "left")
    rank = F.expr("row_number() OVER (PARTITION BY rid ORDER BY rid)")
    whole = copies.where("more <> 2").withColumn("copies", F.col("base") + F.col("more"))
    edge = copies.where("more = 2").withColumn("copies", F.col("base") + (rank <= F.col("extra")).cast("long"))
    return whole.unionByName(edge).select("id", "rid", "pattern", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, **params) -> DataFrame:
    """The documents that the mix takes, with columns ``copies`` and ``taken`` added (in place of any of these names); rows equal in
    id and text become one."""
    docs = docs.drop("copies", "taken") if id_col not in ("copies", "taken") else docs
    rid, own = free_name(docs, "rid"), free_name(docs, "own")
    got = mix(spark, docs, id_col, text_col, seed=seed, **params).where("copies > 0").groupBy(F.col("rid").alias(rid), F.col("id").alias(own)).agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    marked = docs.withColumns({rid: F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)), own: F.struct(id_col)})
    return marked.join(got.withColumn(own, F.struct(F.col(own).alias(id_col))), [rid, own]).dropDuplicates([rid, own]).drop(rid, own)
