"""Claims, contradictions, stance, timelines and citation contexts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Relative gap that contradicts, and the least absolute one, by metric. Fixed values.
GAPS = {"temperature": (0.15, 50.0), "pressure": (0.20, 1.0), "age": (0.25, 5.0)}
ANY_GAP = (0.25, 0.0)
#: A small stance lexicon; a larger one is a parameter.
LEXICON = {
    "support": "confirm confirms confirmed support supports supported agree agrees agreed consistent corroborate corroborates corroborated validate validates validated replicate replicated similar extend extends extended".split(),
    "contrast": "contradict contradicts contradicted however contrary conflict conflicts disagree disagrees differ differs refute refutes refuted challenge challenges inconsistent unlike whereas".split(),
    "method": "use uses used using method methods dataset datasets technique approach protocol".split(), "mention": "report reports reported describe describes described present presented previous earlier".split(),
    "negation": "not no never neither nor without hardly barely cannot fail failed fails".split(), "hedge": "may might could possibly perhaps suggest suggests appears likely".split(), "bad": "flawed biased insufficient inadequate incomplete outdated questionable spurious misleading".split(),
}


def contradictions(claims: DataFrame, least_ratio: float = 5.0, least_papers: int = 2) -> DataFrame:
    """(quantity, unit, n_papers, spread, ratio, values): quantities whose values from several papers lie apart by a factor;
    those with a value of zero or below have no ratio. Values are listed by size."""
    groups = claims.groupBy("quantity", "unit").agg(F.count_distinct("paper_key").alias("n_papers"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    hit = groups.where((F.col("n_papers") >= least_papers) & (F.col("lo") > 0)).withColumn("ratio", F.col("hi") / F.col("lo")).where(F.col("ratio") >= least_ratio)
    listed = claims.join(hit.select("quantity", "unit"), ["quantity", "unit"], "left_semi").groupBy("quantity", "unit").agg(F.array_sort(F.collect_list(F.struct("value", "paper_key"))).alias("values"))
    return hit.join(listed, ["quantity", "unit"]).select("quantity", "unit", "n_papers", (F.col("hi") - F.col("lo")).alias("spread"), F.round("ratio", 2).alias("ratio"), "values")


def numeric_claims(measured: DataFrame) -> DataFrame:
    """One claim for each value of a quantity in a paper: that of the abstract before that of the full text."""
    order = F.struct((F.col("source") != "abstract").alias("later"), "seq")
    return measured.groupBy("paper_key", "quantity", "unit", "value").agg(F.min_by(F.struct("sentence", "source"), order).alias("s")).select("paper_key", "quantity", "unit", "value", "s.sentence", "s.source")


def adjacent_gaps(values: DataFrame, by: list[str], metric: str = "metric", value: str = "value", ref: str = "ref") -> DataFrame:
    """Neighbouring values of a metric whose relative gap contradicts, with the references that hold them."""
    w = W.partitionBy(*by, metric).orderBy(value, ref)
    pairs = values.withColumns({"value2": F.lead(value).over(w), "ref2": F.lead(ref).over(w)}).where("value2 IS NOT NULL")
    limit, least = F.lit(ANY_GAP[0]), F.lit(ANY_GAP[1])
    for name, (gap, delta) in GAPS.items():
        limit, least = F.when(F.col(metric) == name, gap).otherwise(limit), F.when(F.col(metric) == name, delta).otherwise(least)
    out = pairs.withColumns({"delta": F.col("value2") - F.col(value), "__mean": F.abs((F.col("value2") + F.col(value)) / 2), "__limit": limit, "__least": least})
    out = out.withColumn("relative", F.try_divide("delta", "__mean")).where("delta >= __least AND __mean <> 0 AND relative > __limit")
    return out.withColumn("severity", F.when(F.col("relative") > 2 * F.col("__limit"), "severe").otherwise("moderate")).drop("__mean", "__limit", "__least")


def consensus(n_refs: Column, contested: Column) -> Column:
    return F.when(contested, "contested").when(n_refs >= 5, "strong").when(n_refs >= 3, "moderate").otherwise("uncertain")


def evidence_grade(n_papers: Column, agreement: Column, experimental: Column, measured: Column, contradicted: Column) -> Column:
    """(grade, score): points for volume, agreement and kind of evidence, less those for contradiction."""
    volume = F.when(n_papers >= 10, 0.35).when(n_papers >= 5, 0.25).when(n_papers >= 3, 0.15).when(n_papers >= 1, 0.05).otherwise(0.0)
    agreed = F.when(agreement == "strong", 0.30).when(agreement == "moderate", 0.20).when(agreement == "uncertain", 0.10).otherwise(0.05)
    kind = F.when(experimental, 0.20).when(measured, 0.12).otherwise(0.03)
    score = F.round(F.least(F.greatest(volume + agreed + kind - F.when(contradicted, 0.15).otherwise(0.0), F.lit(0.0)), F.lit(1.0)), 2)
    return F.struct(F.when(score >= 0.8, "A").when(score >= 0.6, "B").when(score >= 0.4, "C").otherwise("D").alias("grade"), score.alias("score"))


def claim_table(items: DataFrame, by: str = "cluster") -> DataFrame:
    """One claim a cluster of findings (cluster, ref, finding, metric, value): its longest finding, references, gaps, grade."""
    found = items.groupBy(by).agg(F.max_by("finding", F.length("finding")).alias("statement"), F.array_sort(F.collect_set("ref")).alias("refs"), F.max(F.lower("finding").contains("experimental")).alias("experimental"), (F.count("value") > 0).alias("measured"))
    gaps = adjacent_gaps(items.where("value IS NOT NULL"), [by]).groupBy(by).agg(F.count("*").alias("n_gaps"), F.array_sort(F.collect_set("ref2")).alias("conflicting"))
    out = found.join(gaps, by, "left").withColumn("contradicted", F.coalesce(F.col("n_gaps") > 0, F.lit(False)))
    agreed = consensus(F.size("refs"), F.col("contradicted"))
    return out.withColumn("consensus", agreed).withColumn("g", evidence_grade(F.size("refs"), F.col("consensus"), F.col("experimental"), F.col("measured"), F.col("contradicted"))).select(
        by, "statement", "refs", F.array_except("refs", F.coalesce("conflicting", F.array().cast(items.schema["ref"].dataType.simpleString().join(("array<", ">"))))).alias("supporting"), "conflicting", "consensus", F.col("g.grade").alias("grade"), F.col("g.score").alias("score"),
    )


def claim_matrix(papers: DataFrame, claims: list[str], id_col: str = "paper_id", least: float = 0.10) -> DataFrame:
    """(claim, id, relevance, addresses, finding): each of a few claims against each paper, by the share of its stems."""
    asked = F.explode(F.array(*map(F.lit, claims)))
    cells = papers.select(F.col(id_col).alias("id"), X.text_or_empty(F.col("abstract")).alias("abstract"), X.stems(F.col("abstract")).alias("stems"), asked.alias("claim"))
    score = X.containment(X.stems(F.col("claim")), F.col("stems"))
    out = cells.withColumn("relevance", F.round(score, 3)).withColumn("addresses", score >= least)
    return out.select("claim", "id", "relevance", "addresses", F.when(F.col("addresses"), X.best_sentence(F.col("abstract"), F.col("claim"))).otherwise("").alias("finding"))


def timeline(papers: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """(id, year, citations, milestone) of papers; milestones have the upper quartile of non-zero citations, by its index.

    The quartile is looked up among counts of equal citation numbers, so no task orders the papers.
    """
    n = F.coalesce("citation_count", F.lit(0))
    rows = papers.select(F.col(id_col).alias("id"), F.col("year"), n.alias("citations"))
    counts = rows.where("citations > 0").groupBy("citations").agg(F.count("*").alias("c"))
    run = counts.withColumns({"upto": F.sum("c").over(W.orderBy("citations")), "total": F.sum("c").over(W.partitionBy())})
    bar = run.where("upto > total * 3 div 4").agg(F.min("citations").alias("bar"))
    return rows.crossJoin(F.broadcast(bar)).select("id", F.coalesce("year", F.lit(0)).alias("year"), "citations", F.coalesce((F.col("citations") >= F.col("bar")) & (F.col("citations") > 0), F.lit(False)).alias("milestone"))


def reference_numbers(papers: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """(id, number) in order of year, unknown last, and title: ranges of years are numbered apart and shifted by those before."""
    keyed = papers.select(F.col(id_col).alias("id"), F.coalesce("year", F.lit(9999)).alias("y"), F.lower(X.text_or_empty(F.col("title"))).alias("t"))
    sizes = keyed.groupBy("y").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("y").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = keyed.withColumn("r", F.row_number().over(W.partitionBy("y").orderBy("t", "id")))
    return inside.join(before.select("y", "before"), "y").select("id", (F.col("before") + F.col("r")).alias("number"))


def paragraph_breaks(items: DataFrame, by: str, order: list[str], year_gap: int = 8, overlap: float = 0.15, every: int = 5) -> DataFrame:
    """Adds ``breaks``: where years jump, words change, or every fifth item of a group."""
    w = W.partitionBy(by).orderBy(*order)
    out = items.withColumns({"__y": F.lag("year").over(w), "__t": F.lag("tokens").over(w), "__n": F.row_number().over(w)})
    new = (F.abs(F.col("year") - F.col("__y")) > year_gap) | (X.jaccard(F.col("tokens"), F.col("__t")) < overlap) | ((F.col("__n") - 1) % every == 0)
    return out.withColumn("breaks", F.coalesce(new, F.lit(True))).drop("__y", "__t", "__n")


class Lexicon:
    """Counts of stance words, those of support that a negation precedes within 40 characters as contrast."""

    def __init__(self, words: dict[str, list[str]]):
        self.patterns = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(v, key=len, reverse=True))) + r")\b", re.IGNORECASE) for k, v in words.items() if v}

    def turned(self, text: str) -> int:
        """Words of support that a negation turns."""
        return sum(bool(self.patterns["negation"].search(text[max(0, m.start() - 40) : m.start()])) for m in self.patterns["support"].finditer(text))

    def judge(self, text: str) -> tuple[str, float]:
        if not text.strip():
            return "mentioning", 0.0
        n = {k: len(p.findall(text)) for k, p in self.patterns.items()}
        turned = self.turned(text)
        against, behind, less = n["contrast"] + n["bad"] + turned, n["support"] - turned, 0.1 * n["hedge"]
        if against and against >= behind:
            return "contrasting", max(0.3, min(1.0, 0.55 + 0.12 * against - less))
        if behind > 0:
            return "supporting", max(0.3, min(1.0, 0.55 + 0.12 * behind - less))
        if n["method"]:
            return "methodology", max(0.3, 0.6 - less)
        return "mentioning", min(0.85, max(0.3, 0.5 + 0.05 * n["mention"] - less))


def stance(contexts: DataFrame, column: str, words: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``stance`` and ``stance_confidence`` by the lexicon."""
    lexicon = Lexicon(words or LEXICON)

    @F.pandas_udf(T.StructType([T.StructField("stance", T.StringType()), T.StructField("confidence", T.DoubleType())]))
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lexicon.judge(t or "") for t in texts], columns=["stance", "confidence"])

    return contexts.withColumn("__s", judge(column)).withColumns({"stance": F.col("__s.stance"), "stance_confidence": F.col("__s.confidence")}).drop("__s")


def combined_stance(lexicon: Column, confidence: Column, discourse: Column, model: Column, negated: Column) -> Column:
    """Score of a stance from -1 to 1 as a weighted mean of lexicon, discourse and model; a negation trusts discourse more, an
    unsure lexicon the model."""
    sign = F.when(lexicon == "supporting", confidence).when(lexicon == "contrasting", -confidence).otherwise(0.0)
    return F.when(negated, 0.30 * sign + 0.60 * discourse + 0.10 * model).when(confidence < 0.5, 0.30 * sign + 0.50 * discourse + 0.20 * model).otherwise(0.50 * sign + 0.30 * discourse + 0.20 * model)


def context_summary(judged: DataFrame, by: str = "paper_id", sure: float = 0.6) -> DataFrame:
    """Per cited paper: counts of sure stances, up to three quotes of either, and a signal."""
    yes, no = (F.col("stance") == "supporting") & (F.col("stance_confidence") >= sure), (F.col("stance") == "contrasting") & (F.col("stance_confidence") >= sure)
    quote = lambda c: F.transform(F.slice(F.array_sort(F.collect_list(F.when(c, F.struct("seq", F.substring("context", 1, 200).alias("q"))))), 1, 3), lambda s: s["q"])
    out = judged.groupBy(by).agg(F.count("*").alias("n"), F.count_if(yes).alias("supporting"), F.count_if(no).alias("contrasting"), quote(yes).alias("for"), quote(no).alias("against"))
    signal = F.when((F.col("supporting") > 3) & (F.col("contrasting") == 0), "consensus").when(F.col("contrasting") > 0, "contested").when(F.col("supporting") + F.col("contrasting") < 3, "emerging").otherwise("consensus")
    return out.withColumns({"mentioning": F.expr("n - supporting - contrasting"), "signal": signal})


def verdict(supporting: Column, contrasting: Column, addressed: Column) -> Column:
    """What the stances on a claim add up to."""
    return (
        F.when(addressed < 2, "Insufficient").when((supporting > 0) & (contrasting == 0), "Supported").when((contrasting > 0) & (supporting == 0), "Contradicted")
        .when(supporting >= 2 * contrasting, "Mostly supported").when(contrasting >= 2 * supporting, "Mostly contradicted").otherwise("Contested")
    )


def entity_comparison(papers: DataFrame, a: str, b: str) -> DataFrame:
    """(only_a, only_b, both, either): papers that mention either of two entities."""
    text = X.record_text(F.col("title"), F.col("abstract"))
    x, y = text.contains(a.lower()), text.contains(b.lower())
    return papers.agg(F.count_if(x & ~y).alias("only_a"), F.count_if(y & ~x).alias("only_b"), F.count_if(x & y).alias("both"), F.count_if(x | y).alias("either"))
