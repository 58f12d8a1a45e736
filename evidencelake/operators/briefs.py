"""The tables behind a written brief: citations, finding gates, interpretation bands, query repair, model output.

Prose is left to whoever renders; every operator here gives rows.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .summaries import at_index, classify_measurement

#: Interpretation of temperature, pressure and their ratio: [low, high) and a name. Fixed values.
TEMPERATURE_BANDS = (
    (0, 150, "diagenetic/burial conditions"), (150, 250, "prehnite-pumpellyite facies (sub-greenschist)"), (250, 350, "lower greenschist facies (chlorite zone)"), (350, 450, "upper greenschist facies (biotite-garnet zone)"), (450, 550, "lower amphibolite facies (garnet-staurolite zone)"),
    (550, 650, "middle amphibolite facies (staurolite-kyanite zone)"), (650, 700, "upper amphibolite facies (sillimanite zone)"), (700, 850, "granulite facies"), (850, 1000, "ultra-high temperature (UHT) granulite facies"), (1000, 1300, "crustal anatexis / melting"), (1300, 1800, "mantle melting conditions"),
)
PRESSURE_BANDS = (
    (0, 2, "very low pressure (contact/volcanic)"), (2, 5, "low pressure (Buchan / andalusite)"), (5, 8, "medium pressure (Barrovian / kyanite)"), (8, 12, "medium-high pressure (kyanite-sillimanite)"), (12, 20, "high pressure (eclogite facies)"), (20, 40, "ultra-high pressure (coesite/diamond)"), (40, 60, "deep subduction / mantle"),
)
GRADIENT_BANDS = ((0, 5, "cold subduction zone"), (5, 15, "subduction / accretionary wedge"), (15, 25, "normal continental crust"), (25, 40, "Barrovian regional metamorphism"), (40, 60, "Buchan / contact metamorphism"), (60, 150, "contact aureole / rift"), (150, 99999, "volcanic / geothermal field"))
#: Pairs of methods whose values are known to differ, by the words that name both. Fixed values.
OFFSETS = (("garnet-biotite calibrations", ("ferry", "holdaway")), ("trace element methods", ("laiu", "lai-icp")), ("uranium-lead methods", ("mass-spec", "thermal ionization")), ("garnet thermometers", ("grt-bt", "grt-cpx")))
#: Words of a limitation, and of support, contrast and extension between findings.
LIMITATION = "limitation|uncertain|assumption|sensitiv|depend\\w*\\s+on|affected\\s+by|may\\s+not|could\\s+be\\s+biased|require|challeng|problematic|caveat|warn|caution|large\\s+error|poorly\\s+constrain"
RELATIONS = {"contrast": ("however", "contrast", "contrary", "differ", "unlike", "whereas", "disagree"), "support": ("confirm", "consistent", "agree", "support", "similar"), "extend": ("extend", "further", "build", "refine", "improve")}


def short_author(names: Column) -> Column:
    """Last names of one or two authors, the first of more; those in capitals as names are written."""
    last = F.transform(names, lambda n: F.element_at(F.split(F.trim(n), "\\s+"), -1))
    last = F.transform(last, lambda n: F.when((F.upper(n) == n) & (F.length(n) > 1), F.initcap(n)).otherwise(n))
    return F.when(F.coalesce(F.size(last), F.lit(0)) == 0, "Anonymous").when(F.size(last) <= 2, F.array_join(last, " & ")).otherwise(F.concat(last[0], F.lit(" et al.")))


def reference_list(papers: DataFrame, number: str = "number") -> DataFrame:
    """(number, line) of a numbered reference list."""
    doi = F.coalesce(F.concat(F.lit(" DOI:["), X.truthy(F.col("doi")), F.lit("](https://doi.org/"), F.col("doi"), F.lit(")")), F.lit(""))
    line = F.concat(F.lit("["), F.col(number).cast("string"), F.lit("] "), short_author(F.col("names")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("). "), F.coalesce(X.truthy(F.col("title")), F.lit("Untitled")), F.lit("."), doi)
    return papers.select(number, line.alias("line"))


def provenance_route(papers: DataFrame) -> DataFrame:
    """Adds ``route``: how a paper was found, else the source that served it."""
    return papers.withColumn("route", F.coalesce(X.truthy(F.col("discovery_provenance")), F.concat(F.lit("source:"), F.coalesce(X.truthy(F.col("source")), F.lit("?")))))


#: Marks of a damaged or borrowed sentence, in any case, as they are searched for anywhere: none begins with a run, which would be
#: tried again from each of its places. Fixed values.
GARBLED = (
    "KEY WORDS", "Keywords?", "Abstract unavailable", "You do not have", "<", "&lt;", "Integrating these results with new", "After exclusion of samples", r"\d\s*Ma\)", "propagating uncertainty", "depending on the temperature", "modeling the fractionation",
    "analytical methods", "supplemental (?:material|figures|data)", "supplementary (?:material|data|information)", r"(?:c?ontact|corresponding author)[:\s]", r"@\w+\.\w{2,3}", r"\]\s*(?:,\s*)?which\s+(?:features|show)", r"\d\s*,\s*\d+\s*\(\d+\)",
    r"(?:editor'?s|reviewer'?s)\s+(?:careful|kind)\s+(?:attention|comments?)", "rensen", "(?:damarlar|olumular|ierisinde|ncelme|alanndaki|barit-galenit)", "(?:self-gravitating|gravitational fugac)", r"chapter\s+(?:also\s+)?(?:outlines?|discusses?)\s+key",
)
#: Letters that the marks cannot do without, in lower case; a finding that has none of them is not searched for marks.
GARBLED_PARTS = (
    "key words", "keyword", "abstract unavailable", "you do not have", "<", "&lt;", "integrating these results with new", "after exclusion of samples", "ma)", "propagating uncertainty", "depending on the temperature", "modeling the fractionation",
    "analytical methods", "supplemental ", "supplementary ", "ontact", "corresponding author", "@", "]", "(", "editor", "reviewer", "rensen", "damarlar", "olumular", "ierisinde", "ncelme", "alanndaki", "barit-galenit", "self-gravitating", "gravitational fugac", "chapter",
)


def is_garbled(finding: Column) -> Column:
    """Whether a mark stands in it. Four letters beyond ASCII are, in any case, letters of the marks."""
    low = F.lower(F.when(F.octet_length(finding) > F.length(finding), F.translate(finding, "\u017f\u0131\u212a\u0130", "siki")).otherwise(finding))
    return reduce(lambda a, b: a | b, (low.contains(x) for x in GARBLED_PARTS)) & finding.rlike("(?iU)" + "|".join(GARBLED))


def good_finding(finding: Column) -> Column:
    """Findings worth telling: 40 characters, in English, without marks of damage, not cut off in a letter, at most half of the
    words with digits."""
    words = F.filter(F.split(F.trim(finding), "\\s+"), lambda w: w != "")
    digits = F.size(F.filter(words, lambda w: w.rlike("[0-9]"))) / F.greatest(F.size(words), F.lit(1))
    cut = finding.rlike("\\b\\w\\.$") & ~finding.rlike("\\b[A-Z]\\.$")
    return F.coalesce((F.length(F.trim(finding)) >= 40) & ~X.is_foreign(finding) & ~cut & (digits <= 0.5) & ~is_garbled(finding), F.lit(False))


def good_title(title: Column) -> Column:
    """Titles of papers, not keys, volumes or damaged text."""
    t = X.text_or_empty(title)
    cased = F.lower(t) != F.upper(t)
    plain = cased & ((F.lower(t) == t) | ((F.upper(t) == t) & ~F.substring(t, 2, 1 << 30).rlike("\\p{Lu}")))
    junk = t.rlike("^(VOL\\.|VOLUME|PAGES|CHAPTER|American Mineralogist|Journal of|Volume |pages |NO\\. |PAGES )")
    return (F.length(t) >= 10) & ~plain & ~(~t.contains(" ") & (F.length(t) < 30)) & ~junk & ~t.rlike("[½•↓→]")


def limitations(papers: DataFrame, text: str, id_col: str = "paper_id") -> DataFrame:
    """(id, limitation): the first sentence of each paper, over 20 characters, that states one."""
    parts = F.transform(F.split(text, "\\."), lambda s: F.trim(s))
    hit = F.filter(parts, lambda s: F.lower(s).rlike(f"\\b(?:{LIMITATION})") & (F.length(s) > 20))
    return papers.select(F.col(id_col).alias("id"), F.substring(F.get(hit, F.lit(0)), 1, 300).alias("limitation")).where("limitation IS NOT NULL")


def relation(items: DataFrame, by: str, order: list[str], finding: str = "finding") -> DataFrame:
    """Adds ``relation`` of each finding to the one before it: contrast, support, extend, or null if they share few words."""
    w = W.partitionBy(by).orderBy(*order)
    tokens = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.lower(X.text_or_empty(c)), "\\s+"), lambda t: F.regexp_replace(t, "^[.,;:!?\"'()\\[\\]{}]+|[.,;:!?\"'()\\[\\]{}]+$", "")), lambda t: F.length(t) > 3))
    out = items.withColumn("__t", tokens(F.col(finding))).withColumn("__before", F.lag("__t").over(w))
    like = X.jaccard(F.col("__t"), F.col("__before"))
    n = {k: reduce(lambda a, b: a + b, (F.lower(finding).contains(x).cast("int") for x in words)) for k, words in RELATIONS.items()}
    kind = F.when((n["contrast"] > n["support"]) & (n["contrast"] > 0), "contrast").when((n["support"] > 0) & (n["support"] >= n["extend"]), "support").when(n["extend"] > 0, "extend").when(like >= 0.25, "extend")
    return out.withColumn("relation", F.when(F.col("__before").isNotNull() & (like >= 0.12), kind)).drop("__t", "__before")


#: Units, what they measure, factor and shift to °C, kbar and Ma; and what is possible. Ages under 5 are errors of ages.
SCALES = (
    ("°c", "temperature", 1.0, 0.0), ("c", "temperature", 1.0, 0.0), ("k", "temperature", 1.0, -273.15), ("kelvin", "temperature", 1.0, -273.15), ("kbar", "pressure", 1.0, 0.0), ("gpa", "pressure", 10.0, 0.0), ("mpa", "pressure", 0.01, 0.0), ("kpa", "pressure", 1e-5, 0.0),
    ("bar", "pressure", 1e-3, 0.0), ("pa", "pressure", 1e-8, 0.0), ("ma", "age", 1.0, 0.0), ("ga", "age", 1000.0, 0.0), ("ka", "age", 0.001, 0.0),
)
POSSIBLE = (("temperature", "°C", -50.0, 2500.0), ("pressure", "kbar", 0.0, 400.0), ("age", "Ma", 5.0, 5000.0))


def normalised_measurements(values: DataFrame) -> DataFrame:
    """Values with ``kind``, in the unit of their kind and within what is possible; others go. A unit that says nothing leaves
    the kind to the label, else the size."""
    spark = values.sparkSession
    scales = spark.createDataFrame(list(SCALES), "__u string, __kind string, __factor double, __shift double")
    possible = spark.createDataFrame(list(POSSIBLE), "kind string, __unit string, __low double, __high double")
    joined = values.join(F.broadcast(scales), F.lower(F.trim(X.text_or_empty(F.col("unit")))) == F.col("__u"), "left")
    kind = F.coalesce("__kind", classify_measurement(F.col("measurement"), F.lit(None).cast("string"), F.col("value")))
    scaled = F.col("value") * F.coalesce("__factor", F.lit(1.0)) + F.coalesce("__shift", F.lit(0.0))
    out = joined.withColumns({"kind": kind, "value": scaled}).join(F.broadcast(possible), "kind").where("value BETWEEN __low AND __high")
    return out.withColumn("unit", F.col("__unit")).drop("__u", "__kind", "__factor", "__shift", "__unit", "__low", "__high")


def band(value: Column, bands: tuple[tuple[float, float, str], ...]) -> Column:
    """The name of the band [low, high) that a value is in, or null."""
    out = F.when((value >= bands[0][0]) & (value < bands[0][1]), bands[0][2])
    for low, high, name in bands[1:]:
        out = out.when((value >= low) & (value < high), name)
    return out


def interpret(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, upper medians of temperature and pressure, their bands, gradient and its band) of values by measurement."""
    mid = at_index(values.where(F.col("measurement").isin("temperature", "pressure")), [*by, "measurement"], "value", {"mid": (1, 2)})
    wide = mid.groupBy(*by).agg(*(F.max(F.when(F.col("measurement") == m, F.col("mid"))).alias(m) for m in ("temperature", "pressure")))
    gradient = F.when(F.col("pressure") > 0, F.col("temperature") / F.col("pressure"))
    return wide.select(*by, "temperature", "pressure", band(F.col("temperature"), TEMPERATURE_BANDS).alias("temperature_band"), band(F.col("pressure"), PRESSURE_BANDS).alias("pressure_band"), gradient.alias("gradient"), band(gradient, GRADIENT_BANDS).alias("gradient_band"))


def known_offsets(text: Column) -> Column:
    """Names of the known offsets of which a text has all words."""
    low = F.lower(X.text_or_empty(text))
    return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a & b, (low.contains(w) for w in words)), F.lit(name)) for name, words in OFFSETS)))


def entity_kind(description: Column) -> Column:
    d = F.lower(X.text_or_empty(description))
    return (
        F.when(d.rlike("\\b(?:city|town|village|district|region|province|state|country|river|basin|mountain|island)\\b"), "locality").when(d.rlike("\\b(?:mineral|rock|ore|chemical compound|element)\\b"), "material")
        .when(d.rlike("\\b(?:method|technique|algorithm|procedure|process|therapy|medication|drug|software)\\b"), "method").when(d.rlike("\\b(?:species|genus|family of|plant|bacteria|virus)\\b"), "organism").otherwise("concept")
    )


def sections(query: str, n_measurements: int, n_themes: int, mentions: dict[str, int]) -> list[str]:
    """The parts that a brief can have: by coordinated entities with support, measurements and kinds of study."""
    out = []
    for a, b in re.findall(r"\b([a-z][a-z-]+)\s+(?:and|vs\.?|versus|compared\s+(?:to|with))\s+([a-z][a-z-]+)\b", query.lower())[:2]:
        out += [f"Evidence: {x}" for x in (a, b) if mentions.get(x)] + [f"Comparison: {a} vs {b}"] * bool(mentions.get(a) and mentions.get(b)) + ["Comparative synthesis"]
    out += ["Quantitative synthesis"] * (n_measurements >= 3) + ["Methodological landscape"] * (n_themes >= 2)
    return list(dict.fromkeys([*out, "Findings", "Limitations", "Research gaps and future directions"]))


def related_values(values: DataFrame, tags: DataFrame, likeness: str = "likeness", least: float = 0.25) -> DataFrame:
    """Values without a tag, and those whose tag is like enough to the question (tag, likeness)."""
    out = values.join(tags, "tag", "left")
    return out.where((X.text_or_empty(F.col("tag")) == "") | (F.coalesce(likeness, F.lit(0.0)) >= least)).drop(likeness)


def extend_aliases(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term, aliases): each term with the other names that a table (term, alias) gives it."""
    named = aliases.groupBy(F.lower("term").alias("term")).agg(F.array_sort(F.collect_set(F.lower("alias"))).alias("aliases"))
    return terms.select(F.lower("term").alias("term")).join(named, "term", "left").select("term", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def boosted(papers: DataFrame, templates: DataFrame, text: Column) -> DataFrame:
    """Papers that no excluded word of a template drops, with ``boost``, the product of the factors whose word they have.

    ``templates``: word, factor; a factor of 0 excludes. Templates are few, papers are read once.
    """
    rules = templates.agg(F.collect_list(F.struct(F.lower("word").alias("w"), F.col("factor").alias("f"))).alias("__rules"))
    low = F.lower(text)
    out = papers.crossJoin(F.broadcast(rules)).withColumn("boost", F.aggregate("__rules", F.lit(1.0), lambda a, r: a * F.when(low.contains(r["w"]), r["f"]).otherwise(1.0)))
    return out.where("boost > 0").drop("__rules")


def expand_tokens(tokens: DataFrame, dictionary: DataFrame, token: str = "token") -> DataFrame:
    """Tokens with ``fixed``: the dictionary's word (known misspellings, abbreviations) or the token itself."""
    d = dictionary.select(F.lower("from").alias("__from"), F.col("to").alias("__to"))
    return tokens.join(d, F.lower(token) == F.col("__from"), "left").withColumn("fixed", F.coalesce("__to", token)).drop("__from", "__to")


def ambiguous(tokens: DataFrame, senses: DataFrame, token: str = "token") -> DataFrame:
    """(token, senses) of the tokens with several."""
    return tokens.select(F.lower(token).alias("token")).distinct().join(senses.groupBy(F.lower("term").alias("token")).agg(F.array_sort(F.collect_set("sense")).alias("senses")), "token").where(F.size("senses") > 1)


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over all letters."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def repairs(tokens: DataFrame, vocabulary: DataFrame, least: float = 0.82, token: str = "token", word: str = "word") -> DataFrame:
    """(token, word): for tokens of over four letters outside a vocabulary the word within two edits of the best ratio.

    Candidates meet on what is left when up to two letters are taken out of either.
    """

    def without_one(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))

    def cuts(c: Column) -> Column:
        return F.array_distinct(F.concat(F.array(c), without_one(c), F.flatten(F.transform(without_one(c), without_one))))

    odd = tokens.select(F.col(token).alias("token")).where(F.length(token) > 4).distinct().join(vocabulary.select(F.col(word).alias("token")), "token", "left_anti")
    pairs = odd.select("token", F.explode(cuts(F.col("token"))).alias("cut")).join(vocabulary.select(F.col(word).alias("word")).distinct().select("word", F.explode(cuts(F.col("word"))).alias("cut")), "cut").select("token", "word").distinct()
    near = pairs.where(F.levenshtein("token", "word") <= 2).withColumn("ratio", match_ratio("token", "word")).where(F.col("ratio") >= least)
    return near.groupBy("token").agg(F.max_by("word", F.struct("ratio", "word")).alias("word"))


def json_of(text: Column, schema: str) -> Column:
    """The first object or array in a model's answer, whatever stands around it, commas before closing brackets dropped; null if
    there is none."""
    opening = "[" if schema.strip().lower().startswith("array") else "{"
    closing = "]" if opening == "[" else "}"
    body = F.regexp_extract(text, f"(?s)(\\{opening}.*\\{closing})", 1)
    return F.from_json(F.regexp_replace(body, ",\\s*([}\\]])", "$1"), schema, {"mode": "PERMISSIVE"})


def prefer_model(extracted: DataFrame, fields: list[str], prefix: str = "model_") -> DataFrame:
    """Each field from the model where it gave one, else from the patterns."""
    take = {f: F.coalesce(F.when(F.size(prefix + f) > 0, F.col(prefix + f)) if isinstance(extracted.schema[f].dataType, T.ArrayType) else X.truthy(F.col(prefix + f)), F.col(f)) for f in fields}
    return extracted.withColumns(take).drop(*(prefix + f for f in fields))


def alumina_saturation(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, ratio, name): mean of Al2O3 / (CaO + Na2O + K2O) of samples with all four above zero."""
    whole = reduce(lambda a, b: a & b, (F.col(c) > 0 for c in ("Al2O3", "CaO", "Na2O", "K2O")))
    out = samples.where(whole).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("Al2O3") / (F.col("CaO") + F.col("Na2O") + F.col("K2O"))).alias("ratio"))
    return out.withColumn("name", F.when(F.col("ratio") > 1.0, "peraluminous").when(F.col("ratio") > 0.9, "metaluminous").otherwise("subaluminous"))


def discourse_score(text: Column) -> Column:
    """From -1 to 1: markers of agreement less markers of contrast, over both."""
    low = F.lower(X.text_or_empty(text))
    n = {k: reduce(lambda a, b: a + b, (X.count_of(low, w) for w in RELATIONS[k])) for k in ("support", "contrast")}
    return F.coalesce(F.try_divide((n["support"] - n["contrast"]).cast("double"), n["support"] + n["contrast"]), F.lit(0.0))


def compact(papers: DataFrame, most: int = 50, chars: int = 300, order: str = "paper_id") -> DataFrame:
    """The first papers with their texts cut at a word."""
    return papers.orderBy(order).limit(most).withColumn("abstract", X.clip_words(X.text_or_empty(F.col("abstract")), chars))


def decade_spread(pools: DataFrame, by: list[str], effect: str = "effect") -> DataFrame:
    """(by, decades, spread) of pooled effects by decade."""
    return pools.groupBy(*by).agg(F.count("*").alias("decades"), F.round(F.max(effect) - F.min(effect), 3).alias("spread"))
