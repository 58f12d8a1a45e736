"""Nearest neighbours of vectors by cosine, exactly, and the expansion of terms by them.

Rows are indexed in cells around pivots. A query first looks into the cells nearest to it; the distance of its k-th neighbour there
bounds where nearer ones can be, by the triangle inequality, and only those cells are looked into again. Cells are split into
blocks of a bounded size, of which each returns k rows a query at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .density import BLOCK, Cells, _sides

#: Cells that a query looks into first.
PROBES = 2


def _named_units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    raw = F.transform(vector_col, lambda x: x.cast("double"))
    square = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.select(F.col(id_col).cast("long").alias("node"), raw.alias("raw"), F.sqrt(square).alias("length")).where("node IS NOT NULL AND length > 0 AND length < double('infinity')")
    return rows.select("node", F.transform("raw", lambda x: x / F.col("length")).alias("vec"))


def _best(k: int):
    def run(table: pa.Table) -> pa.Table:
        home, visitors, likeness = _sides(table)
        a, b, s = [], [], []
        if home.num_rows and visitors.num_rows:
            names, asked = home["node"].to_numpy(), visitors["node"].to_numpy()
            for j, query in enumerate(asked.tolist()):
                score = np.where(names == query, -np.inf, likeness[:, j])
                top = np.lexsort((names, -score))[:k]
                top = top[np.isfinite(score[top])]
                a, b, s = [*a, *[query] * len(top)], [*b, *names[top].tolist()], [*s, *score[top].tolist()]
        return pa.table({"query": pa.array(a, pa.int64()), "neighbour": pa.array(b, pa.int64()), "cosine": pa.array(s, pa.float64())})

    return run


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """(query, neighbour, rank, cosine): the ``k`` rows of ``vectors`` nearest to each row of ``queries``, itself (the same id) left
    out; of equals those with the smaller id; with ``least`` only those of that cosine or more.

    Ids are whole numbers; rows without one, and rows whose vector is null, empty or zero or holds a null or NaN, have no neighbours
    and are none. Rows that repeat an id are neighbours once each; queries that repeat one are one, of the same vector. An empty table
    gives none.
    """
    scratch = Scratch(spark, "nearest")
    rows = scratch.keep(_named_units(vectors, id_col, vector_col), "rows")
    asked = scratch.keep(_named_units(queries, id_col, vector_col).dropDuplicates(["node"]), "queries")
    cells = Cells(rows, block)
    shape, order = "query long, neighbour long, cosine double", Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = ranked(cells.blocks(rows, cells.nearest(asked, PROBES), None).applyInArrow(_best(k), shape))
    bound = first.groupBy("query").agg(F.min("cosine").alias("worst"), F.count("*").alias("n"))
    reach = F.when(F.col("n") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")))).otherwise(F.lit(2.0))
    if least is not None:
        reach = F.least(reach, F.lit(float(np.sqrt(max(0.0, 2 - 2 * least)))))
    again = asked.join(bound, F.col("node") == F.col("query"), "left").select("node", "vec", F.coalesce(reach, F.lit(2.0 if least is None else float(np.sqrt(max(0.0, 2 - 2 * least))))).alias("reach"))
    again = scratch.keep(again, "again")
    out = ranked(cells.blocks(rows, again, "reach").applyInArrow(_best(k), shape))
    return (out if least is None else out.where(F.col("cosine") >= least)).select("query", "neighbour", "rank", "cosine")


def expand_terms(spark: SparkSession, terms: DataFrame, asked: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """(term, added, rank, cosine): for the terms of ``asked`` (term) the terms of a table (term_id, term, vector) nearest to them.

    A term that the table does not know, or knows without a vector, has none; a null term neither; of a term's rows the one with the
    smallest id is asked for.
    """
    known = asked.select("term").distinct().join(terms, "term").groupBy("term").agg(F.min(F.struct("term_id", "vector")).alias("t")).select("term", "t.*")
    found = nearest(spark, terms, known, "term_id", "vector", k, least)
    names = terms.select(F.col("term_id").alias("neighbour"), F.col("term").alias("added"))
    return found.join(known.select(F.col("term_id").alias("query"), "term"), "query").join(names, "neighbour").where("added <> term").select("term", "added", "rank", "cosine")
