"""Line deduplication against levelled sorted runs of line hashes, with DataFrame operations alone.

A run is a table (h1, h2, owner), bucketed and sorted by the 96-bit key hash, of lines and the first document that holds them.
A batch of documents is merged against all runs: lines that a run knows, or that a smaller document of the batch holds, are
dropped; lines that are new make the batch's own run at level 0. When a level has ``fanout`` runs they are compacted into one
of the next level. Batches must come in order of their ids for the owner to be the smallest id overall.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import free_name, moved
from .scratch import Scratch

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows without an id count as one document that comes after all others.
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(doc, rid, line, h1, h2) for each line whose key has at least ``least_chars`` code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("rid"), F.posexplode(F.split(text, "\n", -1)).alias("line", "raw"))
    keyed = rows.select("doc", "rid", "line", line_key(F.col("raw")).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select("doc", "rid", "line", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


class LineRuns:
    """The runs of a corpus, as bucketed tables below a shared folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 4, buckets: int | None = None):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.scratch.path(name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        self.scratch.delete(self.scratch.path(name))

    def close(self) -> None:
        for name in [n for level in self.levels for n in level]:
            self._drop(name)
        self.levels = []

    def add(self, lines: DataFrame, number: int) -> DataFrame:
        """The (doc, rid, line) rows of a batch that go; its new lines become a run."""
        found = lines.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).withColumn("owner", F.lit(None).cast("long"))
        for i, name in enumerate(n for level in self.levels for n in level):
            run = self.spark.table(name).where("fresh").select("h1", "h2", F.col("owner").alias(f"owner{i}"))
            found = found.join(run, ["h1", "h2"], "left").withColumn("owner", F.coalesce("owner", f"owner{i}")).drop(f"owner{i}")
        state = found.select("h1", "h2", F.coalesce("owner", "least").alias("owner"), F.col("owner").isNull().alias("fresh"), (F.col("owner").isNotNull() | (F.col("least") < F.col("most"))).alias("shared"))
        name = self._write(state)
        shared = self.spark.table(name).where("shared").select("h1", "h2", "owner")
        gone = self.scratch.keep(lines.join(shared, ["h1", "h2"]).where("doc <> owner").select("doc", "rid", "line"), f"gone-{number}")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        self._compact()
        return gone

    def _compact(self) -> None:
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) < self.fanout:
                continue
            runs = self.levels[depth]
            merged = self.spark.table(runs[0]).where("fresh")
            for name in runs[1:]:
                merged = merged.union(self.spark.table(name).where("fresh"))
            new = self._write(merged.repartition(self.buckets, "h1", "h2"))
            for name in runs:
                self._drop(name)
            self.levels[depth] = []
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(new)


def kept_lines(lines: Column, gone: Column) -> Column:
    """The lines without those whose numbers the sorted array ``gone`` lists, in time linear in both."""
    begin = F.concat(F.array(F.lit(0)), F.transform(gone, lambda i: i + 1))
    end = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(begin, end, lambda b, e: F.slice(lines, b + 1, e - b)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, batches: int = 3, fanout: int = 2) -> DataFrame:
    """``docs`` with two more columns: ``__n_dropped`` and ``__kept``, the text without its repeated lines.

    A line's key is the line stripped of ASCII white space and lower-cased (A-Z). Keys of ``least_chars`` code points or more
    found in two documents go everywhere but in the smallest id that holds them, where all their lines stay. Null and empty
    texts are one empty line; lines with shorter keys stay. Rows without an id are one document after all others; rows that
    repeat an id are the same document, so their common lines stay in both. An empty table stays empty. Extra columns stay; those
    of the new names with further underscores before them. Ids are whole numbers of 64 bits; the greatest is taken for none.

    The corpus is fed to the runs in ``batches`` ranges of ids. Texts are read twice and shuffled once; the runs hold hashes.
    """
    scratch = Scratch(spark, "lines")
    lines = scratch.keep(line_hashes(docs, id_col, text_col, least_chars), "hashes")
    cuts = (batches > 1 and lines.where(F.col("doc") < LAST).agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000)).first()[0]) or []
    runs, gone, low = LineRuns(spark, scratch, fanout), [], None
    for k, high in enumerate([*sorted({int(c) for c in cuts}), None]):
        batch = lines if low is None else lines.where(F.col("doc") > low)
        gone.append(runs.add(batch if high is None else batch.where(F.col("doc") <= high), k))
        low = high
    runs.close()
    dropped = gone[0]
    for more in gone[1:]:
        dropped = dropped.union(more)
    scratch.drop(lines)
    docs = moved(docs, "__kept", "__n_dropped")
    doc, rid, numbers = (free_name(docs, name) for name in ("doc", "rid", "gone"))
    per_row = dropped.groupBy(F.col("doc").alias(doc), F.col("rid").alias(rid)).agg(F.array_sort(F.collect_set("line")).alias(numbers))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), rid: F.xxhash64(text)})
    joined = keyed.join(per_row.hint("shuffle_hash"), [doc, rid], "left").drop(doc, rid)
    kept = F.when(F.col(numbers).isNull(), text).otherwise(F.array_join(kept_lines(F.split(text, "\n", -1), F.col(numbers)), "\n"))
    return joined.withColumns({"__kept": kept, "__n_dropped": F.when(F.col(numbers).isNull(), 0).otherwise(F.size(numbers))}).drop(numbers)
