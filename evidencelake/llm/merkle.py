"""Merkle manifest of a dataset: a tree of digests a source, trees over the sources' roots, and a proof for every row.

A row's place in its source comes from histograms of its id's digits: ids are counted by their upper bits, those counts by fewer
bits, and so on up; the rows before a bucket are the sum, over the levels, of those in smaller buckets of the same parent. No table
is sorted as a whole. The place in base ``FANOUT`` is a row's key in a trie whose nodes are the digests: rows that share all but the
last ``LEVELS`` digits meet in one group, become one digest there, and the digests go on in the same way. Siblings are passed down
again from the root, as far as a row's own proof.

All of it is DataFrame functions; a group holds at most FANOUT ** LEVELS rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

FANOUT, LEVELS = 3, 6
#: Bits of an id that a level of the histogram takes: a bucket of the finest holds at most 2**DIGIT_BITS different ids.
DIGIT_BITS = 12
ROW = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(cells: list[Column]) -> Column:
    """SHA-256 of the cells, each a minus sign if null, else its UTF-8 byte count, a colon and its value."""
    framed = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (x.cast("string") for x in cells)]
    return F.sha2(F.concat(*framed), 256)


def group_key(source: Column) -> Column:
    """A string that is never null and orders as the source does in UTF-8, null first."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def offsets(counts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(g, number, before): rows of the group with a smaller number, from (g, number, n) with each number of a group once.

    Numbers are 64-bit integers, null comes first.
    """
    bucket = lambda level: F.shiftright("number", DIGIT_BITS * level)
    ends = counts.agg(F.min("number").alias("low"), F.max("number").alias("high")).first()
    levels = [counts.groupBy("g", bucket(1).alias("b")).agg(F.sum("n").alias("n"))]
    while ends.low is not None and ends.low >> (DIGIT_BITS * len(levels)) != ends.high >> (DIGIT_BITS * len(levels)) and len(levels) * DIGIT_BITS < 64:
        levels.append(levels[-1].groupBy("g", F.shiftright("b", DIGIT_BITS).alias("b")).agg(F.sum("n").alias("n")))
    earlier = lambda key, parent: F.coalesce(F.sum("n").over(Window.partitionBy("g", *parent).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the few buckets of the coarsest level have no parent but the group
    before = levels[-1].select("g", "b", earlier("b", []).alias("before"))
    for level in reversed(levels[:-1]):
        inner = level.select("g", "b", F.shiftright("b", DIGIT_BITS).alias("up"), "n").withColumn("inner", earlier("b", ["up"]))
        above = before.select(F.col("g").alias("ag"), F.col("b").alias("ab"), F.col("before").alias("outer"))
        before = inner.join(above, (inner["g"] == above["ag"]) & inner["up"].eqNullSafe(above["ab"])).select("g", "b", (F.col("inner") + F.col("outer")).alias("before"))
    before = scratch.keep(before, f"{name}-buckets")
    fine = counts.select("g", "number", bucket(1).alias("b"), "n").withColumn("inner", earlier("number", ["b"]))
    above = before.select(F.col("g").alias("ag"), F.col("b").alias("ab"), F.col("before").alias("outer"))
    return fine.join(above, (fine["g"] == above["ag"]) & fine["b"].eqNullSafe(above["ab"])).select("g", "number", (F.col("inner") + F.col("outer")).alias("before"))


def ranked(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, number, leaf, tampered, i): leaves (g, number, leaf, tampered) with their places by number, then by leaf, in their group.

    Rows that repeat a number are told apart by the digits of their digests in the same way; equal rows are counted once, and
    take as many places as they are.
    """
    ids = leaves.groupBy("g", "number").agg(F.count("*").alias("n"))
    places = scratch.keep(offsets(ids, scratch, "ids").join(ids.withColumnsRenamed({"g": "ig", "number": "inumber"}), (F.col("g") == F.col("ig")) & F.col("number").eqNullSafe(F.col("inumber"))).select("g", "number", "before", "n"), "ids")
    at = places.select(F.col("g").alias("pg"), F.col("number").alias("pnumber"), "before", "n")
    placed = leaves.join(at, (leaves["g"] == at["pg"]) & leaves["number"].eqNullSafe(at["pnumber"])).select("g", "number", "leaf", "tampered", "before", "n")
    single = placed.where("n = 1").select("g", "number", "leaf", "tampered", F.col("before").alias("i"))
    if not places.where("n > 1").limit(1).count():
        return single
    equal = placed.where("n > 1").groupBy("g", "number", "leaf", "tampered", "before").agg(F.count("*").alias("times"))
    equal = scratch.keep(equal.withColumn("digits", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")), "repeated")
    inside = equal.select(F.to_json(F.struct("g", "number")).alias("g"), F.col("digits").alias("number"), F.col("times").alias("n")).groupBy("g", "number").agg(F.sum("n").alias("n"))
    inner = offsets(inside, scratch, "digests").select(F.col("g").alias("ig"), F.col("number").alias("idigits"), F.col("before").alias("inner"))
    split = equal.join(inner, (F.to_json(F.struct("g", "number")) == F.col("ig")) & (F.col("digits") == F.col("idigits")))
    tie = F.coalesce(F.sum("times").over(Window.partitionBy("ig", "digits").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = split.withColumn("first", F.col("before") + F.col("inner") + tie)
    return single.union(first.select("g", "number", "leaf", "tampered", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1)).alias("i")))


def _above(level: Column) -> Column:
    """Digests of the next level: of each run of FANOUT the digest of their texts."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(level, j * FANOUT + 1, FANOUT), ""), 256))


def _siblings(level: Column, at: Column) -> Column:
    """The other digests of the run of the node at place ``at``, before and after it."""
    start = at - at % FANOUT
    return F.struct(F.array_join(F.slice(level, start + 1, at % FANOUT), "").alias("left"), F.array_join(F.slice(level, at + 2, FANOUT - 1 - at % FANOUT), "").alias("right"))


def climb(nodes: DataFrame, scratch: Scratch, levels: int, name: str) -> list[DataFrame]:
    """Tables (g, block, nodes, all, depth, digest), the next of each one's digests until every group is a single block; from nodes
    (g, i, digest, payload), i from 0 on without gaps in every group.

    ``all`` has the digests of every level of the block. A group in one block has its last node at ``depth``; the first block of
    any other group is full, so a block knows its depth by itself.
    """
    width, tables = FANOUT**levels, []
    count = F.size("nodes")
    depth = reduce(lambda d, k: d + F.when((F.col("block") > 0) | (count > FANOUT**k), 1).otherwise(0), range(levels), F.lit(0))
    while not tables or tables[-1].where("block > 0").limit(1).count():
        block = nodes.groupBy("g", F.floor(F.col("i") / width).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "digest", "payload"))).alias("nodes"))
        block = block.withColumns({"depth": depth, "level0": F.col("nodes.digest")})
        for k in range(levels):
            block = block.withColumn(f"level{k + 1}", _above(F.col(f"level{k}")))
        block = block.withColumn("all", F.array(*(F.col(f"level{k}") for k in range(levels + 1))))
        tables.append(scratch.keep(block.select("g", "block", "nodes", "depth", "all", F.get(F.get("all", F.col("depth")), F.lit(0)).alias("digest")), f"{name}-{len(tables)}", "zstd"))
        nodes = tables[-1].select("g", F.col("block").alias("i"), "digest", F.lit(None).cast("boolean").alias("payload"))
    return tables


def descend(tables: list[DataFrame], over: DataFrame, levels: int) -> DataFrame:
    """(g, i, digest, payload, path, ...): the nodes of the first table with their siblings (left, right) of all levels, those of
    ``over`` (g, path, ...) behind their group's own; its further columns stay."""
    power = F.array(*(F.lit(FANOUT**k) for k in range(levels)))
    runs = F.when(F.col("depth") > 0, F.sequence(F.lit(0), F.col("depth") - 1)).otherwise(F.array().cast("array<int>"))
    own = lambda at: F.transform(runs, lambda k: _siblings(F.get(F.col("all"), k), F.floor(at / F.get(power, k)).cast("int")))
    local = F.transform("nodes", lambda x, at: F.struct(x["i"].alias("i"), x["digest"].alias("digest"), x["payload"].alias("payload"), own(at).alias("own")))
    kept = [c for c in over.columns if c not in ("g", "path")]
    paths = over.withColumn("i", F.lit(0).cast("long"))
    for table in reversed(tables):
        above = paths.select("g", F.col("i").alias("block"), F.col("path").alias("upper"), *kept)
        rows = table.join(above, ["g", "block"]).select("g", "upper", *kept, F.inline(local))
        paths = rows.select("g", "i", "digest", "payload", F.concat("own", "upper").alias("path"), *kept)
    return paths


def source_places(subroots: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, subroot, i): the sources' own order from 0 on. Each source is one row, so ranges of them can be sorted apart."""
    parts = scratch.keep(subroots.repartitionByRange(int(subroots.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g").withColumn("part", F.spark_partition_id()), "sources")
    ahead = {r.part: r.n for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = [], 0
    for part in sorted(ahead):
        before, total = [*before, F.lit(part), F.lit(total)], total + ahead[part]
    start = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    return parts.select("g", "subroot", (F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1 + start).cast("long").alias("i"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(spark: SparkSession, docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ROW, text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """(id, source, leaf, tampered, path, subroot, root) for every row of ``docs``; ``path`` lists the siblings (left, right) from
    the leaf's run to the root's.

    The leaves of a group ascend by id, which is a whole number, null first; rows of one id go by their leaves, and equal rows have
    neighbouring places. While more than one node remains, every FANOUT of them (the last run: the rest) become the digest of their
    hex texts; the groups' last nodes, ordered by group with null first, likewise. ``tampered`` is an expression for changed text:
    the column of that name is the leaf of the row with that text, null where nothing changes. Null cells are part of the digest.
    An empty table gives an empty one; columns not named are not read, and any names may be among them.
    """
    scratch = Scratch(spark, "merkle")
    leaf = leaf_digest([F.col(c) for c in columns])
    changed = F.lit(None).cast("string") if tampered is None else leaf_digest([tampered if c == text_col else F.col(c) for c in columns])
    source = docs.select(group_key(F.col(group_col)).alias("g"), F.col(id_col).cast("long").alias("number"), leaf.alias("leaf"), changed.alias("tampered"))
    leaves = scratch.keep(source.withColumn("tampered", F.when(F.col("tampered") != F.col("leaf"), F.col("tampered"))), "leaves")
    rows = ranked(leaves, scratch).select("g", "i", F.col("leaf").alias("digest"), F.struct("number", "tampered").alias("payload"))
    low = climb(rows, scratch, levels, "rows")
    places = source_places(low[-1].select("g", F.col("digest").alias("subroot")), scratch)
    high = climb(places.select(F.lit("").alias("g"), "i", F.col("subroot").alias("digest"), F.col("g").alias("payload")), scratch, levels, "sources")
    none = F.array().cast("array<struct<left: string, right: string>>")
    roots = descend(high, high[-1].select("g", none.alias("path"), F.col("digest").alias("root")), levels)
    found = descend(low, roots.select(F.col("payload").alias("g"), "path", F.col("digest").alias("subroot"), "root"), levels)
    name = F.when(F.col("g") != "", F.substring("g", 2, 2**31 - 1))
    return found.select(F.col("payload.number").alias("id"), name.alias("source"), F.col("digest").alias("leaf"), "payload.tampered", "path", "subroot", "root")
