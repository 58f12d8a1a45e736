"""Constraints of the evidence contracts, as queries for violations (rule, key, detail) that must return no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed vocabularies. Fixed values.
VOCABULARY = {
    "execution_status": ["succeeded", "empty", "failed", "timed_out"], "review_status": ["unreviewed", "model_suggested", "human_reviewed"], "stage": ["title_abstract", "full_text"],
    "decision": ["include", "exclude", "uncertain"], "origin": ["human", "model", "rule"], "adjudication_status": ["consensus", "adjudicated", "unresolved"],
    "protocol_status": ["draft", "approved", "registered", "amended", "completed"],
}
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
#: What makes two effects comparable. Fixed values.
COMPARABLE = ("effect_measure", "outcome_id", "population_id", "timepoint", "study_design_family", "unit", "intervention_id", "comparator_id")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def check(table: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, all rules in one pass; a rule is true, or null, where it is broken."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items())))
    return table.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key", F.lit("").alias("detail"))


def unique(table: DataFrame, columns: list[str], rule: str) -> DataFrame:
    n = table.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return n.select(F.lit(rule).alias("rule"), F.concat_ws("|", *columns).alias("key"), F.concat(F.lit("n="), "n").alias("detail"))


def missing(child: DataFrame, column: str, parent: DataFrame, parent_column: str, rule: str, key: str) -> DataFrame:
    """Children whose parent does not exist."""
    gone = child.join(parent.select(F.col(parent_column).alias("__p")).distinct(), child[column] == F.col("__p"), "left_anti")
    return gone.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(column).cast("string").alias("detail"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def texts(c: Column, least: int = 0) -> Column:
    """Whether an array has ``least`` items, none of them null or blank and none twice once trimmed; a null array has none."""
    return F.when(c.isNull(), F.lit(least == 0)).otherwise((F.size(c) >= least) & ~F.exists(c, blank) & (F.size(F.array_distinct(F.transform(c, lambda x: F.trim(x)))) == F.size(c)))


def protocols(t: DataFrame) -> DataFrame:
    """A protocol states its question, when it was made, at least one inclusion criterion and one planned source, in lists without
    blanks or repeats; exclusion criteria may be none. Its status is one of the vocabulary; a registration, if any, is not blank."""
    return together(
        unique(t, ["protocol_id"], "protocol id repeats"),
        check(t, "protocol_id", {
            "no protocol id": blank(F.col("protocol_id").cast("string")), "no question": blank(F.col("research_question")), "time without offset": ~F.col("created_at_utc").rlike(TIMESTAMP),
            "no inclusion criterion": ~texts(F.col("inclusion_criteria"), 1), "bad exclusion criteria": ~texts(F.col("exclusion_criteria")), "no planned source": ~texts(F.col("planned_sources"), 1),
            "unknown protocol status": ~F.col("status").isin(VOCABULARY["protocol_status"]), "blank registration": F.col("preregistration_uri").isNotNull() & blank(F.col("preregistration_uri")),
        }),
    )


def executions(t: DataFrame) -> DataFrame:
    failed = F.col("status").isin("failed", "timed_out")
    return together(
        unique(t, ["execution_id"], "execution id repeats"),
        check(t, "execution_id", {
            "no query": blank(F.col("exact_query")), "no provider": blank(F.col("provider")), "unknown status": ~F.col("status").isin(VOCABULARY["execution_status"]), "negative count": F.col("result_count") < 0,
            "succeeded without results": (F.col("status") == "succeeded") & (F.col("result_count") == 0), "empty with results": (F.col("status") == "empty") & (F.col("result_count") != 0), "failed with results": failed & (F.col("result_count") != 0),
            "failed without error": failed & blank(F.col("error_type")), "error without failure": ~failed & F.col("error_type").isNotNull(), "time without offset": ~F.col("executed_at_utc").rlike(TIMESTAMP),
            "ends before it starts": F.coalesce(F.try_to_timestamp("finished_at_utc") < F.try_to_timestamp("started_at_utc"), F.lit(False)),
        }),
    )


def sources(t: DataFrame) -> DataFrame:
    return together(
        unique(t, ["source_id"], "source id repeats"),
        check(t, "source_id", {"no title": blank(F.col("title")), "no locator": blank(F.col("provider_record_id")) & blank(F.col("doi")) & blank(F.col("url")), "year out of range": F.coalesce(~F.col("publication_year").between(1450, 9999), F.lit(False)), "bad digest": F.coalesce(~F.lower("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))}),
    )


def spans(t: DataFrame, source: DataFrame) -> DataFrame:
    joined = t.join(source.select(F.col("source_id").alias("__s"), F.col("content_sha256").alias("__h")), t["source_id"] == F.col("__s"))
    unlike = joined.where(~F.col("__h").eqNullSafe(F.col("source_sha256"))).select(F.lit("other content version").alias("rule"), F.col("evidence_id").cast("string").alias("key"), F.coalesce("__h", F.lit("none")).alias("detail"))
    return together(
        unique(t, ["evidence_id"], "evidence id repeats"), missing(t, "source_id", source, "source_id", "span without source", "evidence_id"), unlike,
        check(t, "evidence_id", {
            "no quote": blank(F.col("quote")), "no locator": blank(F.col("locator")) & blank(F.col("section")) & F.col("page_number").isNull(), "half an offset": F.col("char_start").isNull() != F.col("char_end").isNull(),
            "offsets do not fit": F.coalesce((F.col("char_start") < 0) | (F.col("char_end") - F.col("char_start") != F.length("quote")), F.lit(False)),
        }),
    )


def links(t: DataFrame, claims: DataFrame, span: DataFrame) -> DataFrame:
    return together(
        missing(t, "claim_id", claims, "claim_id", "link without claim", "claim_id"), missing(t, "evidence_id", span, "evidence_id", "link without span", "evidence_id"), unique(t, ["claim_id", "evidence_id", "relation"], "link repeats"),
        check(t, "claim_id", {"no rationale": blank(F.col("rationale")), "reviewed by nobody": (F.col("review_status") == "human_reviewed") & blank(F.col("reviewer_id")), "reviewer of an unreviewed link": (F.col("review_status") == "unreviewed") & ~blank(F.col("reviewer_id"))}),
    )


def unlinked(claims: DataFrame, t: DataFrame, key: str = "claim_id") -> DataFrame:
    return claims.join(t.select(key).distinct(), key, "left_anti").select(key)


def decisions(t: DataFrame) -> DataFrame:
    model = ~blank(F.col("model_name")) | ~blank(F.col("model_version")) | ~blank(F.col("prompt_sha256"))
    whole = ~blank(F.col("model_name")) & ~blank(F.col("model_version")) & ~blank(F.col("prompt_sha256"))
    rule = ~blank(F.col("rule_id"))
    return together(
        unique(t, ["decision_id"], "decision id repeats"),
        check(t, "decision_id", {
            "unknown decision": ~F.col("decision").isin(VOCABULARY["decision"]), "exclusion without reason": (F.col("decision") == "exclude") & blank(F.col("reason_code")), "full text without digest": (F.col("stage") == "full_text") & blank(F.col("source_sha256")),
            "human with machine data": (F.col("origin") == "human") & (model | rule), "model without its data": (F.col("origin") == "model") & (~whole | rule), "rule without its id": (F.col("origin") == "rule") & (~rule | model), "time without offset": ~F.col("decided_at_utc").rlike(TIMESTAMP),
        }),
    )


def adjudications(t: DataFrame, made: DataFrame) -> DataFrame:
    """Each over two decisions or more of different people on one source and stage, with an outcome that fits its status."""
    rows = t.select("adjudication_id", "source_id", "stage", "status", "final_decision", "adjudicator_id", F.explode("decision_ids").alias("decision_id"))
    d = made.select("decision_id", F.col("source_id").alias("ds"), F.col("stage").alias("dt"), F.col("origin").alias("do"), F.col("actor_id").alias("da"), F.col("decision").alias("dd"))
    joined = rows.join(d, "decision_id", "left")
    group = joined.groupBy("adjudication_id", "status", "final_decision", "adjudicator_id").agg(
        F.count("*").alias("n"), F.count("ds").alias("known"), F.count_if((F.col("ds") == F.col("source_id")) & (F.col("dt") == F.col("stage"))).alias("own"), F.count_if(F.col("do") == "human").alias("human"), F.collect_set("dd").alias("said"), F.collect_set("da").alias("by")
    ).withColumns({"people": F.size("by"), "outcomes": F.size("said")})
    decided, judge = ~blank(F.col("final_decision")), ~blank(F.col("adjudicator_id"))
    s = F.col("status")
    return together(
        unique(t, ["adjudication_id"], "adjudication id repeats"), unique(t, ["source_id", "stage"], "two adjudications of one stage"),
        check(group, "adjudication_id", {
            "under two decisions": F.col("n") < 2, "unknown decision": F.col("known") < F.col("n"), "other source or stage": F.col("own") < F.col("known"), "decision not by a person": F.col("human") < F.col("known"), "one person": F.col("people") < 2,
            "consensus does not fit": (s == "consensus") & (~decided | judge | (F.col("outcomes") > 1) | ~F.coalesce(F.array_contains("said", F.col("final_decision")), F.lit(False))),
            "adjudication does not fit": (s == "adjudicated") & (~decided | ~judge | (F.col("outcomes") < 2) | F.coalesce(F.array_contains("by", F.col("adjudicator_id")), F.lit(False))), "unresolved does not fit": (s == "unresolved") & (decided | judge | (F.col("outcomes") < 2)),
        }),
    )


def plans(t: DataFrame) -> DataFrame:
    md, fz, random = F.col("effect_measure") == "mean_difference", F.col("effect_measure") == "fisher_z_correlation", F.col("pooling_model") == "random_effects"
    arms = ~blank(F.col("intervention_id")) & ~blank(F.col("comparator_id"))
    return check(t, "analysis_id", {
        "under two studies": F.col("minimum_studies") < 2, "difference without unit": md & blank(F.col("unit")), "unit without difference": ~md & ~blank(F.col("unit")), "arms missing": ~fz & ~arms, "arms alike": ~fz & arms & (F.col("intervention_id") == F.col("comparator_id")),
        "arms of a correlation": fz & (~blank(F.col("intervention_id")) | ~blank(F.col("comparator_id"))), "random without estimator": random & blank(F.col("tau_squared_estimator")), "fixed with estimator": ~random & ~blank(F.col("tau_squared_estimator")), "interval needs random effects": (F.col("confidence_interval_method") == "knapp_hartung") & ~random,
    })


def estimates(t: DataFrame) -> DataFrame:
    half = F.col("ci_lower").isNull() != F.col("ci_upper").isNull()
    outside = F.coalesce((F.col("ci_lower") >= F.col("ci_upper")) | ~F.col("estimate").between(F.col("ci_lower"), F.col("ci_upper")), F.lit(False))
    return check(t, "effect_id", {"no error": F.coalesce(~(F.col("standard_error") > 0), F.lit(True)), "half an interval": half, "interval does not hold the estimate": outside, "half the sizes": F.col("n_intervention").isNull() != F.col("n_comparator").isNull()})


def dataset(plan: DataFrame, t: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """Estimates of a plan: enough studies, none twice, all comparable with it, their spans of their own source."""
    few = plan.join(t.groupBy("analysis_id").agg(F.count("*").alias("n")), "analysis_id", "left").where(F.coalesce("n", F.lit(0)) < F.col("minimum_studies")).select(F.lit("too few studies").alias("rule"), F.col("analysis_id").cast("string").alias("key"), F.concat(F.lit("n="), F.coalesce("n", F.lit(0))).alias("detail"))
    p = plan.select(F.col("analysis_id").alias("__a"), *(F.col(c).alias(f"__{c}") for c in COMPARABLE))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in COMPARABLE))
    unlike = t.join(p, t["analysis_id"] == F.col("__a")).where(~same).select(F.lit("not comparable with the plan").alias("rule"), F.col("effect_id").cast("string").alias("key"), F.lit("").alias("detail"))
    out = [few, unlike, unique(t, ["analysis_id", "effect_id"], "effect repeats"), unique(t, ["analysis_id", "study_id"], "study counts twice")]
    if span is not None:
        cited = t.select("effect_id", "source_id", F.explode("evidence_ids").alias("evidence_id")).join(span.select("evidence_id", F.col("source_id").alias("__s")), "evidence_id", "left")
        out.append(cited.where(~F.col("__s").eqNullSafe(F.col("source_id"))).select(F.lit("span of another source").alias("rule"), F.col("effect_id").cast("string").alias("key"), F.col("evidence_id").cast("string").alias("detail")))
    return together(*out)


def locate(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, page_number, start, end, status): where each quote stands word for word, if it does so exactly once; overlapping
    places count. ``pages``: source_id, page_number, text; ``quotes``: quote_id, source_id, quote, page_number or null."""
    q = quotes.select("quote_id", F.col("source_id").alias("__s"), "quote", F.col("page_number").alias("__p"))
    joined = q.join(pages, (F.col("__s") == pages["source_id"]) & (F.col("__p").isNull() | (F.col("__p") == pages["page_number"])), "left")
    first, empty = F.position(F.col("quote"), F.col("text")), F.col("quote") == ""
    again = F.when(empty, F.length("text") > 0).otherwise(F.position(F.col("quote"), F.col("text"), F.col("first") + 1) > 0)
    places = joined.select("quote_id", "quote", "page_number", "text", F.coalesce(first, F.lit(0)).alias("first")).select("quote_id", "quote", "page_number", "first", F.when(F.col("first") == 0, 0).when(again, 2).otherwise(1).alias("n"))  # 2 for more
    found = places.groupBy("quote_id", "quote").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.struct("page_number", (F.col("first") - 1).alias("start")))).alias("at"))
    once = F.col("n") == 1
    return found.select("quote_id", F.when(once, F.col("at.page_number")).alias("page_number"), F.when(once, F.col("at.start")).alias("start"), F.when(once, F.col("at.start") + F.length("quote")).alias("end"), F.when(once, "found").when(F.col("n") == 0, "not found").otherwise("ambiguous").alias("status"))
