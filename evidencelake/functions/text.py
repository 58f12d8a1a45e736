"""Text functions as Column expressions: normalising, tokens, set similarity, sentences, cleaning.

Missing follows the records' rule: null, empty and white space are the same (``truthy``), which ``coalesce`` alone is not.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no content, for claims and sentences. Fixed values.
STOP_WORDS = (
    "the a an and or but of in to for with on at by from as is was were be been this that these those we our their it its "
    "study studies show showed found find result results"
).split()
#: Dropped from queries. Fixed values.
QUERY_STOP_WORDS = (
    "and or the a an of in on at to for with from by its their his her is are was were be been about into along across between among "
    "within through throughout toward towards via per over under this that these those what which"
).split()
#: Broad concepts that a query need not have. Fixed values.
BROAD_TERMS = (
    "research study analysis review overview characterization investigation understanding origin evolution formation genesis comparison "
    "comparative correlation contrast difference similarity connection link association between among versus vs relative"
).split()


def truthy(c: Column, kind: str = "string") -> Column:
    """The value, or null where the records' rule calls it missing."""
    if kind == "string":
        return F.when(F.trim(c) != "", c)
    if kind == "number":
        return F.when(c != 0, c)
    if kind == "array":
        return F.when(F.size(c) > 0, c)
    return F.when(c, c)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def record_text(title: Column, abstract: Column) -> Column:
    return F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(abstract)))


def norm_title(title: Column) -> Column:
    """Lower case, letters, digits and single spaces."""
    kept = F.regexp_replace(F.lower(text_or_empty(title)), "[^a-z0-9\\s]", "")
    return F.trim(F.regexp_replace(kept, "\\s+", " "))


def words(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(f"({pattern})"), F.lit(1))


def token_set(normalised: Column) -> Column:
    """Distinct tokens of a normalised title; an empty one has none."""
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays of distinct values; 0 where either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def containment(claim: Column, text: Column) -> Column:
    """Share of the claim's distinct tokens that the text has; 0 for an empty claim."""
    return F.when(F.size(claim) == 0, 0.0).otherwise(F.size(F.array_intersect(claim, text)) / F.size(claim))


def stems(c: Column) -> Column:
    """Distinct content words cut to six letters."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    kept = F.filter(words(c, "[a-z]+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, 6)))


def content_words(c: Column) -> Column:
    """Distinct content words, whole."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(words(c, "[a-z]+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def sentences(c: Column) -> Column:
    """Trimmed sentences: cut after ``. ! ?`` before white space and a capital."""
    return F.transform(F.split(text_or_empty(c), "(?<=[.!?])\\s+(?=[A-Z])"), lambda s: F.trim(s))


def best_sentence(text: Column, claim: Column, most: int = 500) -> Column:
    """The sentence of over 30 characters most like the claim, the first of equals; with no likeness the first sentence, with no
    sentence the text."""
    long = F.filter(sentences(text), lambda s: F.length(s) > 30)
    tokens = content_words(claim)
    scored = F.transform(long, lambda s, i: F.struct(jaccard(tokens, content_words(s)).alias("score"), (-i).alias("order"), s.alias("s")))
    best = F.array_max(scored)
    pick = F.when(F.size(long) == 0, text_or_empty(text)).when(best["score"] > 0, best["s"]).otherwise(long[0])
    return F.substring(pick, 1, most)


def count_of(text: Column, part: str) -> Column:
    """How often a string stands in another, side by side."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def within_one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, replacement or swap of neighbours, or none."""
    distance = F.levenshtein(a, b, 2)
    # two replacements that are one swap: without the common ends two letters are left, each the other's mirror
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return F.when(F.levenshtein(a, b, 1) >= 0, True).otherwise((F.length(a) == F.length(b)) & (distance == 2) & swap)


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Compatibility form without case or marks; dashes, quotes, brackets and spaces of any script become ASCII ones."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
        out = []
        for ch in plain:
            kind = unicodedata.category(ch)
            if kind.startswith("M") and unicodedata.combining(ch):
                continue
            if kind == "Pd":
                ch = "-"
            elif kind in ("Pi", "Pf", "Ps", "Pe"):
                ch = "'"
            elif kind == "Zs" or (kind[0] in "PS" and ch > "\x7f"):
                ch = " "
            out.append(ch)
        return "".join(out)

    return s.map(one)


def strip_markup(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), "<[^>]+>", ""))


def sanitise(c: Column) -> Column:
    """Text of a page or abstract: entities decoded, tags and paywall notices dropped, white space single."""
    out = F.regexp_replace(text_or_empty(c), "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = F.regexp_replace(out, "(?i)(access provided by|get access|this is a preview of subscription content)[^.]*\\.?", " ")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def clean_doi(raw: Column) -> Column:
    """A harvested DOI without closing punctuation or a bracket that nothing opens."""
    out = F.rtrim(F.lower(raw), F.lit(".,;:)\\]}\"'"))
    opened = F.length(F.regexp_replace(out, "[^(]", "")) > F.length(F.regexp_replace(out, "[^)]", ""))
    return F.when(opened, F.regexp_replace(out, "\\([^()]*$", "")).otherwise(out)


def harvest_dois(text: Column) -> Column:
    found = F.regexp_extract_all(text_or_empty(text), F.lit("(10\\.[0-9]{4,9}/[^\\s<>\"]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, clean_doi))


def with_runs(frame: DataFrame, ordered: str, part: str | None = None) -> DataFrame:
    """Adds ``runs``: (at, size) of each run of equal values (of a part of the structs, if named) in a sorted array column, places
    counted from 0. A row is worked on where it lies; null has none."""
    value = lambda i: F.get(F.col(ordered), i)[part] if part else F.get(F.col(ordered), i)
    places = F.transform(F.array_repeat(F.lit(0), F.coalesce(F.size(ordered), F.lit(0))), lambda _, i: i)
    starts = F.filter(places, lambda i: (i == 0) | ~value(i).eqNullSafe(value(i - 1)))
    ends = F.concat(F.slice("__starts", 2, F.greatest(F.size("__starts"), F.lit(1))), F.array(F.size(ordered)))
    sizes = F.zip_with("__starts", F.slice("__ends", 1, F.size("__starts")), lambda a, b: F.struct(a.alias("at"), (b - a).alias("size")))
    return frame.withColumn("__starts", starts).withColumn("__ends", ends).withColumn("runs", sizes).drop("__starts", "__ends")


def inverted_abstract(index: Column) -> Column:
    """Text of a map from word to its places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " ")


def is_foreign(c: Column) -> Column:
    """From 20 characters on: three tenths of the letters or more are not ASCII."""
    letters = F.length(F.regexp_replace(c, "\\P{L}+", ""))
    other = F.length(F.regexp_replace(c, "[\\x00-\\x7F\\P{L}]+", ""))
    return (F.length(c) >= 20) & (F.octet_length(c) > F.length(c)) & (F.coalesce(F.try_divide(other, letters), F.lit(0.0)) >= 0.3)


def phrases(c: Column, stop: list[str], longest: int = 4) -> Column:
    """Runs of one to ``longest`` words between stop words, of which words under two letters count as one."""
    plain = F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9\\s-]", " ")
    tokens = F.filter(F.split(plain, "\\s+"), lambda t: t != "")
    held = F.array(*map(F.lit, stop))
    marked = F.array_join(F.transform(tokens, lambda t: F.when(F.array_contains(held, t) | (F.length(t) < 2), "|").otherwise(t)), " ")
    runs = F.transform(F.split(marked, "\\|"), lambda s: F.trim(s))
    return F.filter(runs, lambda r: (r != "") & (F.size(F.split(r, " ")) <= longest))


def clip_words(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space before."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(head, "\\s+\\S*$", ""), F.lit("…")))


def slug(c: Column, most: int = 60) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def number_range(c: Column) -> Column:
    """A value or range in text: (value, low, high, unit); the value of a range is its middle."""
    n = "([+-]?[0-9]+(?:\\.[0-9]+)?)"
    high = F.regexp_extract(c, f"{n}\\s*(?:-|–|to)\\s*{n}", 2)
    first = F.regexp_extract(c, n, 1)
    low = F.when(high != "", F.regexp_extract(c, f"{n}\\s*(?:-|–|to)\\s*{n}", 1).try_cast("double"))
    top = F.when(high != "", high.try_cast("double"))
    unit = F.regexp_extract(c, "[0-9]\\s*([A-Za-zµ°%‰][A-Za-z%]*)\\s*$", 1)
    value = F.when(high != "", (low + top) / 2).otherwise(F.when(first != "", first.try_cast("double")))
    return F.struct(value.alias("value"), low.alias("low"), top.alias("high"), truthy(unit).alias("unit"))


def island_ranges(numbers: Column) -> Column:
    """Sorted distinct integers as text, runs of three or more as ``a–b``. Each number is looked at beside its neighbours alone."""

    def text(order: Column) -> Column:
        first = F.filter(order, lambda x, i: (i == 0) | (F.get(order, i - 1) != x - 1))
        last = F.filter(order, lambda x, i: (i == F.size(order) - 1) | (F.get(order, i + 1) != x + 1))
        return F.array_join(F.zip_with(first, last, one), ", ")

    def one(a: Column, b: Column) -> Column:
        return F.when(a == b, a.cast("string")).when(b == a + 1, F.concat_ws(", ", a.cast("string"), b.cast("string"))).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string")))

    order = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))
    return F.transform(F.array(order), text)[0]  # sorted once for all lambdas


def key_terms(query: str) -> list[str]:
    """A query's terms in order of weight: proper nouns, then content words. Capitals say nothing when most words have one."""
    raw = [w for w in re.split(r"[\s\-]+", query.strip()) if w]
    letters = [w for w in raw if w[0].isalpha()]
    titled = bool(letters) and sum(w[0].isupper() for w in letters) / len(letters) > 0.6
    names, plain = [], []
    for w in (w.strip(".,;:!?()[]\"'") for w in raw):
        low = w.lower()
        if len(w) < 3 or low in QUERY_STOP_WORDS or low in BROAD_TERMS:
            continue
        if not titled and w[0].isupper():
            names += [w] * (w not in names)
        else:
            plain += [low] * (low not in plain)
    return names + plain


def and_query(query: str, most: int = 4) -> str:
    terms = key_terms(query)[:most]
    return " AND ".join(terms) if len(terms) > 1 else query


def boolean_query(groups: list[list[str]], stemmed: bool = True) -> str:
    """Groups of alternatives joined by AND; words over six letters are cut and starred."""
    word = lambda w: f"{w[:5]}*" if stemmed and len(w) > 5 and " " not in w else (f'"{w}"' if " " in w else w)
    return " AND ".join("(" + " OR ".join(dict.fromkeys(word(w) for w in g)) + ")" for g in groups if g)


def surface_forms(term: str) -> list[str]:
    """A term with its plural or singular and the stems that plain English endings leave."""
    t = term.lower()
    endings = (("ies", 5, (("y", 3), ("", 1))), ("ical", 6, (("", 2),)), ("ing", 6, (("", 3),)), ("ed", 5, (("", 2),)), ("ic", 4, (("", 2), ("", 1))))
    out = [t] + [t[: len(t) - cut] + tail for end, least, cuts in endings if t.endswith(end) and len(t) > least for tail, cut in cuts]
    if t.endswith("s") and not t.endswith("ies") and len(t) > 4:
        out.append(t[:-1])
    elif not t.endswith("s"):
        out.append(t + "s")
    return list(dict.fromkeys(out))
