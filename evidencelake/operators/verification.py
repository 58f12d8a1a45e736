"""Verification of records: retractions, agreement of resolvers, evidence levels, risk-of-bias routing, assessment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Evidence level by what a type contains, the first that fits. Fixed values.
LEVELS = (("systematic-review", "I"), ("meta-analysis", "I"), ("randomized", "II"), ("clinical-trial", "II"), ("cohort", "III"), ("case-control", "III"), ("journal-article", "IV"), ("proceedings-article", "IV"), ("posted-content", "V"), ("preprint", "V"), ("book", "V"), ("report", "V"))
#: Risk-of-bias tool by what the design says. Fixed values.
TOOLS = (("RoB 2", "rct|randomized|randomised"), ("ROBINS-I", "cohort|non-randomized|observational"), ("QUADAS-2", "diagnostic|sensitivity|specificity"), ("Newcastle-Ottawa Scale", "case-control|case control"))
#: Domains of each tool. Fixed values.
DOMAINS = {
    "RoB 2": ["randomization process", "deviations from intended interventions", "missing outcome data", "measurement of the outcome", "selection of the reported result"],
    "ROBINS-I": ["confounding", "selection of participants", "classification of interventions", "deviations from intended interventions", "missing data", "measurement of outcomes", "selection of the reported result"],
    "QUADAS-2": ["patient selection", "index test", "reference standard", "flow and timing"], "Newcastle-Ottawa Scale": ["selection", "comparability", "outcome or exposure"],
}


def clean_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(doi)), "^https?://(dx\\.)?doi\\.org/", "")


def retraction(is_retracted: Column, type_crossref: Column, has_notice: Column) -> Column:
    return F.when(is_retracted, "retracted").when(F.lower(X.text_or_empty(type_crossref)).contains("retraction"), "retracted").when(has_notice, "concern").otherwise("clean")


def retraction_dois(rows: DataFrame) -> DataFrame:
    """Distinct DOIs of every column of a list whose name has ``doi``; none without such a column."""
    columns = [c for c in rows.columns if "doi" in c.lower()]
    if not columns:
        return rows.sparkSession.createDataFrame([], "doi string")
    return rows.select(F.explode(F.array(*columns)).alias("doi")).select(clean_doi(F.col("doi")).alias("doi")).where("doi IS NOT NULL AND doi <> ''").distinct()


def cross_check(records: DataFrame, listed: DataFrame, status: str = "retraction_status") -> DataFrame:
    """Clean records whose DOI is listed become a concern, never retracted."""
    marks = listed.select(F.col("doi").alias("__doi"), F.lit(True).alias("__hit"))
    out = records.join(marks, clean_doi(records["doi"]) == F.col("__doi"), "left")
    return out.withColumn(status, F.when((F.col(status) == "clean") & F.col("__hit"), "concern").otherwise(F.col(status))).drop("__doi", "__hit")


def agreement(records: DataFrame, by: str = "paper_id") -> DataFrame:
    """(id, consistency): whether several resolvers agree on title (two spellings at most) and year (one apart)."""
    c = records.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(F.lower(F.trim("title"))).alias("t"), (F.max("year") - F.min("year")).alias("y"))
    return c.select(by, F.when(F.col("n") < 2, "single-source").when((F.col("t") <= 2) & (F.coalesce("y", F.lit(0)) <= 1), "consistent").otherwise("discrepancy").alias("consistency"))


def resolvers(papers: DataFrame, found: dict[str, DataFrame], fields: list[str], by: str = "paper_id") -> DataFrame:
    """Papers with each field from the first resolver that has it, the resolvers that answered and those that did not."""
    out = papers
    for name, table in found.items():
        out = out.join(table.select(by, F.struct(*fields).alias(f"__{name}")), by, "left")
    names = list(found)
    out = out.withColumns({f: F.coalesce(*(F.col(f"__{n}")[f] for n in names), *([F.col(f)] if f in papers.columns else [])) for f in fields})
    out = out.withColumns({"used": F.array_compact(F.array(*(F.when(F.col(f"__{n}").isNotNull(), n) for n in names))), "failed": F.array_compact(F.array(*(F.when(F.col(f"__{n}").isNull(), n) for n in names)))})
    return out.withColumn("verification_status", F.when(F.size("used") > 0, "resolved").otherwise("unresolved")).drop(*(f"__{n}" for n in names))


def evidence_level(kind: Column, fallback: Column | None = None, systematic: Column | None = None) -> Column:
    t = F.lower(F.trim(X.text_or_empty(kind)))
    if fallback is not None:
        t = F.when(t == "", F.lower(F.trim(X.text_or_empty(fallback)))).otherwise(t)
    out = F.when(systematic, "I") if systematic is not None else F.when(F.lit(False), "I")
    for part, level in LEVELS:
        out = out.when(t.contains(part), level)
    return out.otherwise("V")


def bias_tools(design: Column, kind: Column) -> Column:
    low = F.lower(X.text_or_empty(design))
    tools = F.array_compact(F.array(*(F.when(low.rlike(p), name) for name, p in TOOLS)))
    return F.when((F.size(tools) == 0) & F.lower(X.text_or_empty(kind)).contains("journal-article"), F.array(F.lit("JBI / CASP checklist"))).otherwise(tools)


def assessments(papers: DataFrame, reviewed: DataFrame | None = None, id_col: str = "paper_id", tools: str = "tools") -> DataFrame:
    """(id, tool, domain, judgement): each domain of each tool, unknown unless a reviewer judged it."""
    domains = F.create_map(*(x for k, v in DOMAINS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = papers.select(F.col(id_col).alias("id"), F.explode(tools).alias("tool")).select("id", "tool", F.explode(F.coalesce(domains[F.col("tool")], F.array(F.lit("overall")))).alias("domain"))
    if reviewed is None:
        return rows.withColumn("judgement", F.lit("unknown"))
    return rows.join(reviewed.select("id", "tool", "domain", F.col("judgement").alias("__j")), ["id", "tool", "domain"], "left").withColumn("judgement", F.coalesce("__j", F.lit("unknown"))).drop("__j")


def report(verified: DataFrame) -> DataFrame:
    """(status, level, n) with totals, by grouping sets."""
    return verified.groupingSets([["verification_status", "level"], ["verification_status"], []], "verification_status", "level").agg(F.count("*").alias("n"))


def lookup(records: DataFrame, table: DataFrame, key: str, fields: list[str], prefix: str = "") -> DataFrame:
    """Fields of a dimension table (journal directory, open-access index, venue index) by a lower-cased key."""
    side = table.select(F.lower(key).alias("__k"), *(F.col(f).alias(prefix + f) for f in fields)).dropDuplicates(["__k"])
    return records.join(side, F.lower(records[key]) == F.col("__k"), "left").drop("__k")
