"""Paper records: quality gates, blocking, duplicate resolution, merging, enrichment."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..scratch import Scratch
from .graph import components

#: Thresholds of title likeness: within a block, within a first author of any year, and where a block is incomplete.
BLOCK, SURNAME, LOOSE = 0.85, 0.95, 0.92
_S, _A = T.StringType(), T.ArrayType(T.StringType())
AUTHOR = T.StructType([T.StructField("name", _S), T.StructField("orcid", _S), T.StructField("openalex_id", _S), T.StructField("affiliation", _A), T.StructField("countries", _A)])
PAPER = T.StructType(
    [T.StructField(n, _S) for n in ("paper_id", "doi", "arxiv_id", "openalex_id", "s2_paper_id", "pmid", "title", "abstract", "full_text")]
    + [T.StructField("authors", T.ArrayType(AUTHOR)), T.StructField("year", T.IntegerType())]
    + [T.StructField(n, _S) for n in ("venue", "publication_date", "type", "type_crossref", "language")]
    + [T.StructField("citation_count", T.IntegerType()), T.StructField("influential_citation_count", T.IntegerType()), T.StructField("is_retracted", T.BooleanType()), T.StructField("is_open_access", T.BooleanType()), T.StructField("oa_pdf_url", _S)]
    + [T.StructField(n, _A) for n in ("concepts", "fields_of_study", "keywords", "mesh", "awards", "referenced_works")]
    + [T.StructField("funders", T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("doi", _S)])))]
    + [T.StructField("source", _S), T.StructField("sources_seen", _A), T.StructField("verification_status", _S), T.StructField("discovery_provenance", _S), T.StructField("ingest_pos", T.LongType())]
)


def primary_id() -> Column:
    """The first identifier that a record has, or a hash of its title."""
    named = [F.concat(F.lit(f"{k}:"), X.truthy(F.lower(c) if k == "doi" else F.col(c))) for k, c in (("doi", "doi"), ("arxiv", "arxiv_id"), ("pmid", "pmid"), ("openalex", "openalex_id"), ("s2", "s2_paper_id"))]
    return F.coalesce(*named, F.concat(F.lit("title:"), F.substring(F.sha2(F.lower(X.text_or_empty(F.col("title"))), 256), 1, 16)))


def surname_key(authors: Column) -> Column:
    """The first four letters of the first author's whole name."""
    return F.substring(F.regexp_replace(F.lower(X.text_or_empty(F.get(authors, F.lit(0))["name"])), "[^a-z]", ""), 1, 4)


def is_supplement(doi: Column) -> Column:
    d = F.lower(X.text_or_empty(doi))
    return d.rlike("\\.s\\d{3}\\b|10\\.1130/(geol|geos)\\.s\\.") | d.contains(".supp") | d.contains("_si") | d.contains("supplement") | d.contains("supporting")


def is_junk() -> Column:
    """Records that are no papers: supplements, empty titles, file names, page headers."""
    title, doi = F.trim(X.text_or_empty(F.col("title"))), X.text_or_empty(F.col("doi"))
    no_authors = F.coalesce(F.size("authors") == 0, F.lit(True))
    no_year = F.coalesce(F.col("year") == 0, F.lit(True))
    stem = (doi == "") & no_authors & no_year & (F.size(F.regexp_extract_all(title, F.lit("(\\w+)"), F.lit(1))) < 3)
    header = F.lower(title).rlike("^(vol\\.|volume\\b|pages?\\b|no\\.\\s*\\d)") & no_authors & (doi == "")
    return is_supplement(F.col("doi")) | (title == "") | F.lower(title).startswith("supplemental material") | stem | header


def _keyed(papers: DataFrame) -> DataFrame:
    norm = X.norm_title(F.col("title"))
    return papers.select(
        "ingest_pos", norm.alias("norm"), F.lower(X.truthy(F.col("doi"))).alias("doi"), X.truthy(F.col("arxiv_id")).alias("arxiv"), surname_key(F.col("authors")).alias("surname"),
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), F.regexp_replace(norm, "[^a-z0-9]+", "").alias("exact"), F.array_join(F.slice(F.split(norm, " "), 1, 12), " ").alias("prefix"),
        F.size(F.split(norm, " ")).alias("n_words"), primary_id().alias("pid"),
    )


def candidate_edges(keyed: DataFrame) -> DataFrame:
    """(src, dst) of records that the resolution could bring together: a superset, by equal keys and by shared rare tokens.

    Equal keys make stars around the first record, not pairs. Titles meet once for each distinct title, on the tokens among
    which two titles of likeness BLOCK must share one (the rarest, as many as the threshold leaves open).
    """
    keys = F.array(
        F.concat(F.lit("d:"), F.col("doi")), F.concat(F.lit("a:"), F.col("arxiv")), F.concat(F.lit("t:"), X.truthy(F.col("norm"))), F.concat(F.lit("i:"), F.col("pid")),
        F.when((F.length("exact") >= 40) & (F.col("n_words") >= 6), F.concat(F.lit("x:"), F.col("exact"))), F.when(F.length("prefix") >= 40, F.concat(F.lit("p:"), F.col("prefix"))),
    )
    held = keyed.select("ingest_pos", F.explode(F.array_compact(keys)).alias("key"))
    first = held.groupBy("key").agg(F.min("ingest_pos").alias("src"))
    equal = held.join(first, "key").where("src <> ingest_pos").select("src", F.col("ingest_pos").alias("dst"))
    titles = keyed.where("norm <> ''").groupBy("norm", "surname").agg(F.min("ingest_pos").alias("at"), F.max(F.col("year") == "").alias("open"))
    tokens = titles.select("norm", "surname", "at", "open", X.token_set(F.col("norm")).alias("set"))
    seen = tokens.select(F.explode("set").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ranked = tokens.select("norm", "surname", "at", "open", "set", F.explode("set").alias("t")).join(seen, "t").groupBy("norm", "surname", "at", "open", "set").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("order"))
    least = F.ceil(F.size("set") * F.lit(BLOCK)).cast("int")
    rare = ranked.select("surname", "at", "open", "set", F.explode(F.slice("order", F.lit(1), F.size("set") - least + 1)).alias("o")).select("surname", "at", "open", "set", F.col("o.t").alias("t"))
    a, b = rare.alias("a"), rare.alias("b")
    free = (F.col("a.surname") == F.col("b.surname")) | F.col("a.open") | F.col("b.open") | (F.col("a.surname") == "") | (F.col("b.surname") == "")
    size = (F.size("a.set") * BLOCK <= F.size("b.set")) & (F.size("b.set") * BLOCK <= F.size("a.set"))
    like = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.at") < F.col("b.at")) & size & free).where(X.jaccard(F.col("a.set"), F.col("b.set")) >= BLOCK).select(F.col("a.at").alias("src"), F.col("b.at").alias("dst"))
    return equal.union(like).distinct()


class Resolver:
    """Greedy resolution in order of arrival. A record joins the first cluster that a rule gives, else it founds one; only
    founders are compared with."""

    def __init__(self) -> None:
        self.keys: dict[str, str] = {}
        self.founders: list[tuple[str, frozenset[str], str, str]] = []
        self.clusters: set[str] = set()

    def like(self, tokens: frozenset[str], least: float, fits) -> str | None:
        for name, other, surname, year in self.founders:
            if fits(surname, year) and tokens and other and len(tokens & other) / len(tokens | other) >= least:
                return name
        return None

    def by_title(self, r) -> str | None:
        tokens = frozenset(r.norm.split())
        if r.surname and r.year:
            same = self.like(tokens, BLOCK, lambda s, y: s == r.surname and y == r.year)
            return same or self.like(tokens, SURNAME, lambda s, y: s == r.surname and y)
        return self.like(tokens, LOOSE, lambda _, y: not r.year or not y or y == r.year)

    def place(self, r) -> str:
        long = len(r.exact) >= 40 and r.n_words >= 6
        if r.norm:
            found = (self.keys.get(f"x:{r.exact}") if long else None) or (self.keys.get(f"p:{r.prefix}") if len(r.prefix) >= 40 else None) or self.by_title(r)
            if found:
                return found
        name = f"doi:{r.doi}" if r.doi else f"arxiv:{r.arxiv}" if r.arxiv else None
        if name in self.clusters:
            return name
        if name is None:
            name = r.pid
            if name in self.clusters:
                name = f"{name}#{sum(c.startswith(r.pid) for c in self.clusters)}"
        self.clusters.add(name)
        if r.norm:
            self.founders.append((name, frozenset(r.norm.split()), r.surname, r.year))
            if long:
                self.keys.setdefault(f"x:{r.exact}", name)
                if len(r.prefix) >= 40:
                    self.keys.setdefault(f"p:{r.prefix}", name)
        return name


def resolve(spark: SparkSession, papers: DataFrame) -> DataFrame:
    """(ingest_pos, cluster) of all records that are no junk.

    Records that no rule could bring together never meet: candidates form components, and the greedy order is replayed within
    each. A component is one task's group; it holds what could be copies of one work.
    """
    keyed = _keyed(papers.where(~is_junk()))
    edges = candidate_edges(keyed)
    part = components(spark, edges)
    grouped = keyed.join(part, keyed["ingest_pos"] == part["node"], "left").withColumn("component", F.coalesce("component", "ingest_pos"))

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ingest_pos").where(rows.notna(), None)
        resolver = Resolver()
        return pd.DataFrame({"ingest_pos": rows["ingest_pos"].astype("int64"), "cluster": [resolver.place(r) for r in rows.itertuples()]})

    alone = grouped.where("node IS NULL").select("ingest_pos", F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), "doi")).when(F.col("arxiv").isNotNull(), F.concat(F.lit("arxiv:"), "arxiv")).otherwise(F.col("pid")).alias("cluster"))
    return alone.union(grouped.where("node IS NOT NULL").groupBy("component").applyInPandas(replay, "ingest_pos long, cluster string"))


def author_key(a: Column) -> Column:
    """Last word of the name and first letter; the identifier or all of it where there is no name."""
    name = F.trim(F.regexp_replace(F.lower(X.text_or_empty(a["name"])), "\\.", " "))
    parts = F.split(name, "\\s+")
    return F.when(name == "", F.coalesce(a["orcid"], a["openalex_id"], F.lit("")))\
        .when(F.size(parts) > 1, F.concat_ws("|", F.element_at(parts, -1), F.substring(parts[0], 1, 1))).otherwise(name)


def merge_clusters(papers: DataFrame, assigned: DataFrame) -> DataFrame:
    """One record a cluster. Scalars: the first that is not missing; lists: union in order; authors: the longest name of each
    key; ``sources_seen`` sorted; ``source`` is ``merged`` where there were several."""
    rows = papers.join(assigned, "ingest_pos")
    plain = [f for f in papers.schema if f.name not in ("ingest_pos", "authors", "sources_seen", "source")]
    aggs = []
    for f in plain:
        c = F.col(f.name)
        kind = "array" if isinstance(f.dataType, T.ArrayType) else "string" if isinstance(f.dataType, T.StringType) else "bool" if isinstance(f.dataType, T.BooleanType) else "number"
        if kind == "array":
            lists = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("ingest_pos", c.alias("v")))))
            aggs.append(F.array_distinct(F.flatten(F.transform(lists, lambda s: s["v"]))).alias(f.name))
        else:
            aggs.append(F.min_by(c, F.when(X.truthy(c, kind).isNotNull(), F.col("ingest_pos"))).alias(f.name))
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sources_seen", F.array().cast("array<string>"))))))
    merged = rows.groupBy("cluster").agg(F.count("*").alias("n_records"), F.min("ingest_pos").alias("ingest_pos"), *aggs, seen.alias("sources_seen"), F.min_by("source", "ingest_pos").alias("source"))
    people = rows.select("cluster", "ingest_pos", F.posexplode("authors").alias("at", "author")).withColumn("key", author_key(F.col("author")))
    best = people.groupBy("cluster", "key").agg(F.min(F.struct("ingest_pos", "at")).alias("first"), F.max_by("author", F.struct(F.length("author.name"), -F.col("ingest_pos"), -F.col("at"))).alias("author"))
    authors = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "author"))), lambda s: s["author"]).alias("authors"))
    out = merged.join(authors, "cluster", "left")
    return out.withColumn("source", F.when(F.col("n_records") > 1, "merged").otherwise(F.col("source")))


def deduplicate(spark: SparkSession, papers: DataFrame) -> DataFrame:
    """The corpus without duplicates: gates, resolution, merging. Needs ``ingest_pos``, the order of arrival."""
    return merge_clusters(papers, resolve(spark, papers))


def backfill(papers: DataFrame, found: DataFrame, least: int = 80) -> DataFrame:
    """Abstracts from another provider by DOI, where a record has none and the found one is long enough; the provider joins
    ``sources_seen``."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(X.text_or_empty(F.col("abstract")), "<[^>]+>", " "), "\\s+", " "))
    more = found.select(F.lower("doi").alias("__doi"), clean.alias("__abstract"), F.col("source").alias("__source")).where(F.length("__abstract") > least).dropDuplicates(["__doi"])
    joined = papers.join(more, F.lower("doi") == F.col("__doi"), "left")
    take = X.truthy(F.col("abstract")).isNull() & F.col("__abstract").isNotNull()
    return joined.withColumns({"abstract": F.when(take, F.col("__abstract")).otherwise(F.col("abstract")), "sources_seen": F.when(take, F.array_union(F.coalesce("sources_seen", F.array().cast("array<string>")), F.array("__source"))).otherwise(F.col("sources_seen"))}).drop("__doi", "__abstract", "__source")


def with_knowledge(fresh: DataFrame, base: DataFrame) -> DataFrame:
    """Fresh records and those of the knowledge base that they lack, by DOI."""
    return fresh.unionByName(base.join(fresh.select(F.lower("doi").alias("__doi")).where("__doi IS NOT NULL"), F.lower(base["doi"]) == F.col("__doi"), "left_anti"), allowMissingColumns=True)


def new_against(fresh: DataFrame, baseline: DataFrame, key: str = "paper_id") -> DataFrame:
    """Records whose key the baseline lacks."""
    return fresh.join(baseline.select(key).distinct(), key, "left_anti")


def novel_reflections(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Records new by DOI and by the first 80 characters of the title; a blank DOI counts as a DOI that others may share."""
    doi, head = F.lower(X.text_or_empty(F.col("doi"))), F.substring(F.lower(X.text_or_empty(F.col("title"))), 1, 80)
    keyed = found.withColumns({"__doi": doi, "__head": head})
    known = corpus.select(doi.alias("__doi"), head.alias("__head"))
    return keyed.join(known.select("__doi").distinct(), "__doi", "left_anti").join(known.select("__head").distinct(), "__head", "left_anti").drop("__doi", "__head")


def by_identifier(verified: DataFrame, extracted: DataFrame, fields: list[str]) -> DataFrame:
    """Verified records that are not unresolved with the fields of their extraction: looked up by paper_id, else by DOI, else by
    ``doi:`` and the DOI."""
    out = verified.where("verification_status <> 'unresolved'")
    keys = (F.col("paper_id"), F.lower("doi"), F.concat(F.lit("doi:"), F.lower("doi")))
    for k, key in enumerate(keys):
        side = extracted.select(F.col("paper_id").alias(f"__k{k}"), F.struct(*fields).alias(f"__v{k}")).dropDuplicates([f"__k{k}"])
        out = out.withColumn(f"__j{k}", key).join(side, F.col(f"__j{k}") == F.col(f"__k{k}"), "left").drop(f"__j{k}", f"__k{k}")
    got = F.coalesce("__v0", "__v1", "__v2")
    return out.withColumns({f: got[f] for f in fields}).drop("__v0", "__v1", "__v2")


def _rare(sets: DataFrame, name: str, seen: DataFrame, least: float) -> DataFrame:
    """Sets with each of the tokens (t) among which one must lie in any set of a Jaccard index of ``least`` with them: the
    rarest by ``seen`` (t, df)."""
    keep = [F.col(c) for c in sets.columns]
    ranked = sets.select(*keep, F.explode(name).alias("t")).join(seen, "t").groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("__order"))
    open_ = F.size(name) - F.ceil(F.size(name) * F.lit(least) - 1e-9).cast("int") + 1
    return ranked.select(*keep, F.explode(F.slice("__order", F.lit(1), open_)).alias("__o")).select(*keep, F.col("__o.t").alias("t"))


#: Likeness from which titles meet first: only those that nothing is so alike to go on to the next, and to the caller's least.
STEPS = (0.8, 0.65)


def local_match(papers: DataFrame, files: DataFrame, least: float = 0.5) -> DataFrame:
    """(paper_id, file_id, score) of local full texts: equal DOIs, else the most alike title of at least ``least``, the first of
    equals. Each distinct title is looked up once; titles meet on their rarest tokens, as many as the threshold leaves open. High
    thresholds leave few, and a best match over one is the best of all, so titles meet in steps from high to ``least``."""
    exact = papers.select("paper_id", F.lower("doi").alias("doi")).join(files.select("file_id", F.lower("doi").alias("doi")), "doi").groupBy("paper_id").agg(F.min("file_id").alias("file_id")).withColumn("score", F.lit(1.0))
    scratch = Scratch(papers.sparkSession, "matches")
    left = scratch.keep(papers.join(exact, "paper_id", "left_anti").select("paper_id", X.token_set(X.norm_title(F.col("title"))).alias("a")), "left")
    held = scratch.keep(files.select("file_id", X.token_set(X.norm_title(F.col("title"))).alias("b")).groupBy("b").agg(F.min("file_id").alias("file_id")), "held")
    asked = left.select("a").where(F.size("a") > 0).distinct()
    seen = scratch.keep(asked.select(F.explode("a").alias("t")).unionAll(held.select(F.explode("b").alias("t"))).groupBy("t").agg(F.count("*").alias("df")), "seen")
    tops = []
    for step in (*(x for x in STEPS if x > least), least):
        asked = scratch.keep(asked.join(tops[-1], "a", "left_anti") if tops else asked, f"asked-{step}")
        if asked.isEmpty():
            break
        rare_a, rare_b = _rare(asked, "a", seen, step), _rare(held, "b", seen, step)
        size = (F.size("a") * step <= F.size("b") + 1e-9) & (F.size("b") * step <= F.size("a") + 1e-9)
        near = rare_a.join(rare_b, "t").where(size).withColumn("score", X.jaccard(F.col("a"), F.col("b"))).where(F.col("score") >= step)
        tops.append(scratch.keep(near.groupBy("a").agg(F.max(F.struct("score", (-F.col("file_id")).alias("o"))).alias("m")), f"top-{step}"))
    if not tops:
        return exact.select("paper_id", "file_id", "score")
    best = left.join(reduce(DataFrame.unionAll, tops), "a").select("paper_id", (-F.col("m.o")).alias("file_id"), F.col("m.score").alias("score"))
    return exact.select("paper_id", "file_id", "score").unionByName(best)
