"""Abbreviations and what they stand for, read from texts.

A short form in brackets is aligned backwards with the words before it: each of its letters takes the last place in front of the
next one's, and its first letter has to begin a word. Other ways of saying it are tried for short forms that no bracket explains.
Windows are bounded and initials are looked up in a table, so time is linear in the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words between a long form and its short form, and between a short form and its long form. Fixed values.
NAMED_AS = ("hereafter", "referred to as", "also known as", "abbreviated as", "denoted as")
STANDS_FOR = ("stands for", "is defined as", "is short for")

_BRACKET = re.compile(r"\(([^()\n]{2,120})\)")
_SENTENCE_END = re.compile(r"[.!?]\s")
_SPACES = {w: re.escape(w).replace(r"\ ", r"\s{1,3}") for w in (*NAMED_AS, *STANDS_FOR)}
_NAMED = re.compile(rf"([^,.\n]{{5,60}}),\s{{1,3}}(?:{'|'.join(_SPACES[w] for w in NAMED_AS)})\s{{1,3}}([A-Z][A-Z0-9-]{{1,9}})\b")
_STANDS = re.compile(rf"\b([A-Z][A-Z0-9-]{{1,9}})\s{{1,3}}(?:{'|'.join(_SPACES[w] for w in STANDS_FOR)})\s{{1,3}}([^.,;\n]{{5,80}})")
_AFTER = re.compile(r"\(([A-Z][A-Za-z0-9-]{1,9})\)\s{1,3}([a-z][^.,;()\n]{10,80})")
_UPPER, _CAPITALISED = re.compile(r"\b[A-Z]{2,6}\b"), re.compile(r"\b[A-Z][a-z]+\b")


def is_short(candidate: str) -> bool:
    """Two to ten characters in at most two words, a letter or digit first, and a letter somewhere."""
    return 2 <= len(candidate) <= 10 and len(candidate.split()) <= 2 and candidate[0].isalnum() and any(c.isalpha() for c in candidate)


def align(short: str, before: str) -> str | None:
    """The end of ``before`` that the short form stands for, from the start of a word on; words whose initials it has come first."""
    low, place = before.lower(), len(before)
    letters = [c for c in short.lower() if c.isalnum()]
    last = low.split()[-len(letters) :]
    if len(letters) > 1 and [w[0] for w in last] == letters:
        return " ".join(last) if short.lower() not in last and len(" ".join(last)) > len(short) else None
    for k in range(len(letters) - 1, -1, -1):
        place = low.rfind(letters[k], 0, place)
        while k == 0 and place > 0 and low[place - 1].isalnum():
            place = low.rfind(letters[k], 0, place)
        if place < 0:
            return None
    long = before[low.rfind(" ", 0, place) + 1 :].strip()
    words = long.lower().split()
    good = len(long) > len(short) and short.lower() not in words and long.count("(") == long.count(")")
    return long.lower() if good else None


def window(text: str, end: int, short: str) -> str:
    """The words of the sentence before ``end`` that a short form may stand for: its length and five more, or twice its length."""
    most = min(len(short) + 5, 2 * len(short))
    before = text[max(0, end - 40 * most) : end]
    cut = [m.end() for m in _SENTENCE_END.finditer(before)]
    return " ".join(before[cut[-1] if cut else 0 :].split()[-most:])


def abbreviations_of(text: str | None) -> dict[str, str]:
    """Short forms with their long forms in lower case. Of several in brackets the last stands; other ways fill in the rest."""
    text = text or ""
    out: dict[str, str] = {}
    for m in _BRACKET.finditer(text):
        inside = re.split(r"[;,]", m.group(1))[0].strip()
        if is_short(inside):
            if long := align(inside, window(text, m.start(), inside)):
                out[inside] = long
        else:  # the long form may be the one in brackets
            short = text[max(0, m.start() - 12) : m.start()].rstrip().rsplit(None, 1)
            if short and short[-1].isupper() and is_short(short[-1]) and (long := align(short[-1], inside)) and long == " ".join(inside.lower().split()):
                out.setdefault(short[-1], long)
    found = [(m.group(2), align(m.group(2), " ".join(m.group(1).split())) or m.group(1).strip().lower()) for m in _NAMED.finditer(text)]
    found += [(m.group(1), " ".join(m.group(2).split()).lower()) for m in _STANDS.finditer(text)]
    found += [(m.group(1), long) for m in _AFTER.finditer(text) if (long := led(m.group(1), m.group(2)))]
    for short, long in found:
        if is_short(short) and len(long) > len(short):
            out.setdefault(short, long)
    return out | {k: v for k, v in initials(text).items() if k not in out}


def led(short: str, after: str) -> str | None:
    """The words behind a short form whose initials it has."""
    words = after.lower().split()[: len(short)]
    return " ".join(words) if "".join(w[0] for w in words) == short.lower() else None


def initials(text: str) -> dict[str, str]:
    """Upper-case words that are the initials of capitalised words in a row, the first such row."""
    words = [m.group() for m in _CAPITALISED.finditer(text)]
    row = "".join(w[0] for w in words)
    first: dict[str, int] = {}
    for n in range(2, 7):
        for k in range(len(row) - n + 1):
            first.setdefault(row[k : k + n], k)
    return {a: " ".join(words[first[a] : first[a] + len(a)]).lower() for a in dict.fromkeys(_UPPER.findall(text)) if a in first}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def abbreviations(texts: pd.Series) -> pd.Series:
    """Map from short form to long form; empty for a null or empty text."""
    return texts.map(abbreviations_of)
