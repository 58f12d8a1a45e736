"""Reference formats as text columns, artifacts, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _names() -> Column:
    return F.filter(F.transform(F.coalesce("authors", F.array()), lambda a: a["name"]), lambda n: F.coalesce(n != "", F.lit(False)))


def bibtex_key(number: Column) -> Column:
    """Letters of the first author's last name, the year, and the number of two digits."""
    name = F.regexp_replace(F.element_at(F.split(F.coalesce(F.get(_names(), F.lit(0)), F.lit("Anon")), "\\s+"), -1), "[^A-Za-z]", "")
    return F.concat(F.when(name == "", "Anon").otherwise(name), F.coalesce(F.col("year").cast("string"), F.lit("ND")), F.lpad(number.cast("string"), 2, "0"))


def bibtex(papers: DataFrame, number: str = "number") -> DataFrame:
    """(number, entry); without a venue, or from arXiv with its number, an entry is no article."""
    plain = lambda c: F.regexp_replace(X.text_or_empty(c), "[{}]", "")
    loose = (plain(F.col("venue")) == "") | (X.truthy(F.col("arxiv_id")).isNotNull() & (F.col("source") == "arxiv"))
    field = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    lines = F.array_compact(F.array(
        field("title", F.coalesce(X.truthy(plain(F.col("title"))), F.lit("Untitled"))), field("author", F.coalesce(X.truthy(F.array_join(F.slice(_names(), 1, 10), " and ")), F.lit("Anonymous"))), field("year", F.coalesce(F.col("year").cast("string"), F.lit("n.d."))),
        F.when(~loose, field("journal", plain(F.col("venue")))), field("doi", F.col("doi")), field("eprint", F.col("arxiv_id")), F.when(X.truthy(F.col("arxiv_id")).isNotNull(), F.lit("  archivePrefix = {arXiv}")),
    ))
    entry = F.concat(F.lit("@"), F.when(loose, "misc").otherwise("article"), F.lit("{"), bibtex_key(F.col(number)), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
    return papers.select(number, entry.alias("entry"))


def ris(papers: DataFrame, number: str = "number") -> DataFrame:
    line = lambda tag, c: F.concat(F.lit(f"{tag}  - "), c)
    lines = F.concat(
        F.array(F.lit("TY  - JOUR"), line("T1", F.coalesce(X.truthy(F.col("title")), F.lit("Untitled")))), F.transform(_names(), lambda n: line("AU", n)), F.array(line("PY", F.coalesce(F.col("year").cast("string"), F.lit(""))), line("JO", X.text_or_empty(F.col("venue")))),
        F.array_compact(F.array(line("DO", X.truthy(F.col("doi"))), line("AN", F.concat(F.lit("arXiv:"), X.truthy(F.col("arxiv_id")))))), F.array(line("AB", X.text_or_empty(F.col("abstract"))), F.lit("ER  -")),
    )
    return papers.select(number, F.array_join(lines, "\n").alias("entry"))


def apa(papers: DataFrame, number: str = "number") -> DataFrame:
    n = _names()
    people = F.concat(F.array_join(F.slice(n, 1, 6), ", "), F.when(F.size(n) > 6, F.concat(F.lit(", ... "), F.element_at(n, -1))).otherwise(""))
    doi = F.coalesce(F.concat(F.lit(" https://doi.org/"), X.truthy(F.col("doi"))), F.lit(""))
    return papers.select(number, F.concat(people, F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("). *"), F.coalesce(X.truthy(F.col("title")), F.lit("Untitled")), F.lit("*. "), X.text_or_empty(F.col("venue")), F.lit("."), doi).alias("entry"))


def csl_json(papers: DataFrame, number: str = "number") -> DataFrame:
    parts = lambda n: F.split(n, " ")
    author = F.transform(_names(), lambda n: F.struct(F.element_at(parts(n), -1).alias("family"), F.array_join(F.slice(parts(n), F.lit(1), F.size(parts(n)) - 1), " ").alias("given")))
    item = F.struct(
        F.coalesce(X.truthy(F.col("doi")), X.truthy(F.col("arxiv_id")), F.col("paper_id").cast("string")).alias("id"), F.lit("article-journal").alias("type"), X.text_or_empty(F.col("title")).alias("title"), author.alias("author"),
        F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year")).alias("date-parts"))).alias("issued"), X.text_or_empty(F.col("venue")).alias("container-title"), F.col("doi").alias("DOI"), X.truthy(F.col("arxiv_id")).alias("number"),
    )
    return papers.select(number, F.to_json(item).alias("entry"))


FORMATS = {"bibtex": bibtex, "ris": ris, "apa": apa, "csl-json": csl_json}


def write_text(entries: DataFrame, path: str, number: str = "number") -> None:
    """Entries as text files in order of number; files are ranges, so that no task writes all."""
    entries.repartitionByRange(number).sortWithinPartitions(number).select("entry").write.mode("overwrite").text(path)


def write_artifact(table: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """A table and its properties; a job's files appear when it commits."""
    table.write.mode("overwrite").parquet(f"{path}/rows")
    if meta:
        table.sparkSession.createDataFrame(sorted(meta.items()), "key string, value string").write.mode("overwrite").parquet(f"{path}/meta")


def require(table: DataFrame, columns: list[str], what: str) -> DataFrame:
    """The table if it has the columns and a row; else an error that names what lacks."""
    lacking = [c for c in columns if c not in table.columns]
    if lacking:
        raise ValueError(f"{what}: no column {', '.join(lacking)}")
    if table.isEmpty():
        raise ValueError(f"{what}: empty")
    return table


def provenance(spark, stage: str, path: str, params: dict[str, str]) -> DataFrame:
    """(stage, path, sha256, bytes, params) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.lit(stage).alias("stage"), "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.lit(str(sorted(params.items()))).alias("params"))
