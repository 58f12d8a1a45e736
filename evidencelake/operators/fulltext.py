"""Full texts parted into sections by their headings, with column functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings by section; a number may stand before. Fixed values.
HEADINGS = {
    "introduction": r"introduction|background|previous\s+work|literature\s+review",
    "methods": r"materials?\s+and\s+methods?|methods?|methodology|analytical\s+(?:methods?|procedures?)|experimental(?:\s+(?:methods?|section|procedures?))?|sample\s+preparation|geological\s+setting|study\s+area",
    "results": r"results?|findings?|data\s+analysis|analytical\s+results?|geochemical\s+(?:results?|data)",
    "discussion": r"discussion|interpretation|implications?|comparison\s+with",
    "conclusions": r"conclusions?|summary|outlook|closing\s+remarks?",
    "references": r"references?|bibliography|literature\s+cited",
    "acknowledgments": r"acknowledg(?:e)?ments?|funding",
}
#: Sections that are left out. Fixed values.
DROPPED = ("references", "acknowledgments")
#: Characters that a text and a section have at least. Fixed values.
LEAST_TEXT, LEAST_SECTION = 200, 51
WHITE = " \t\n\x0b\x0c\r"
_LEAD = r"(?idm)^[ \t]*(?:\d{1,4}\.?[ \t]*)?"


def sections(text: Column) -> Column:
    """Map from section to its text, heading included, in order of HEADINGS.

    A line that begins with a heading opens a section, which runs to the next such line; parts of one section are joined by an
    empty line. References and acknowledgments go, and parts of up to 50 characters. A text with fewer than two headings is one
    section, ``body``; a null one, or one of fewer than 200 characters, has none. What stands before the first heading is left out.
    """
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit("\u0001"), F.lit(" "))
    parts = F.split(F.regexp_replace(clean, f"{_LEAD}(?:{'|'.join(HEADINGS.values())})\\b", "\u0001$0"), "\u0001", -1)
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    part = lambda words: F.filter(F.transform(F.filter(parts, lambda p: p.rlike(f"{_LEAD.replace('^', chr(92) + 'A')}(?:{words})\\b")), lambda p: F.btrim(p, F.lit(WHITE))), lambda p: F.char_length(p) >= LEAST_SECTION)
    found = [F.struct(F.lit(name).alias("key"), F.array_join(part(words), "\n\n").alias("value")) for name, words in HEADINGS.items() if name not in DROPPED]
    named = F.map_from_entries(F.filter(F.array(*found), lambda s: s["value"] != ""))
    none = F.map_from_entries(F.array().cast("array<struct<key: string, value: string>>"))
    return F.when(F.char_length(clean) < LEAST_TEXT, none).when(F.size(parts) < 2, F.create_map(F.lit("body"), text)).otherwise(named)
