"""Abbreviations against a plain alignment, and sections against what was planted."""

from __future__ import annotations

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidencelake.operators import abbreviations as A
from evidencelake.operators import fulltext

CASES = [
    ("Patients with chronic kidney disease (CKD) were seen.", {"CKD": "chronic kidney disease"}), ("heat shock transcription factor (HSF)", {"HSF": "heat shock transcription factor"}), ("The Comprehensive Cancer Center (CCC) opened.", {"CCC": "comprehensive cancer center"}),
    ("by X-ray fluorescence (XRF) and loss on ignition (LOI; Table 2)", {"XRF": "x-ray fluorescence", "LOI": "loss on ignition"}), ("mid-ocean ridge basalt (MORB)", {"MORB": "mid-ocean ridge basalt"}), ("It ended. Another matter (AM) began", {"AM": "another matter"}), ("Ended with AM. Nothing here (AM)", {}),
    ("CKD (chronic kidney disease) is common", {"CKD": "chronic kidney disease"}), ("see (Figure 3) and (2015) and (a)", {}), ("of the electron microprobe, hereafter EMP, we", {"EMP": "electron microprobe"}), ("MORB stands for mid-ocean ridge basalt, as", {"MORB": "mid-ocean ridge basalt"}), ("REE is short for rare earth elements.", {"REE": "rare earth elements"}),
    ("(SEM) scanning electron microscope images", {"SEM": "scanning electron microscope"}), ("The World Health Organization met. WHO said", {"WHO": "world health organization"}), ("nothing", {}), ("", {}), (None, {}), ("((AB)) unbalanced ( (CD", {}), ("the laser (laser) light", {}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_abbreviations(text, want):
    assert A.abbreviations_of(text) == want


def plain(short: str, before: str) -> str | None:
    """Words whose initials they are; else the last word start from which the letters of the short form stand in order, the first of them there."""
    letters = [c for c in short.lower() if c.isalnum()]
    low = before.lower()
    last = low.split()[-len(letters) :]
    if len(letters) > 1 and [w[0] for w in last] == letters:
        return " ".join(last) if short.lower() not in last and len(" ".join(last)) > len(short) else None
    for p in range(len(low) - 1, -1, -1):
        if low[p] == letters[0] and (p == 0 or not low[p - 1].isalnum()):
            rest = iter(low[p + 1 :])
            if all(c in rest for c in letters[1:]):
                long = low[low.rfind(" ", 0, p) + 1 :].strip()
                return long if len(long) > len(short) and short.lower() not in long.split() and long.count("(") == long.count(")") else None
    return None


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab-1", min_size=2, max_size=4).filter(A.is_short), st.text(alphabet="abc -1", max_size=25))
def test_alignment(short, before):
    assert A.align(short, before) == plain(short, before)


def test_documents(spark):
    """The whole texts of a table, short forms in brackets alone, against the plain alignment."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    r = random.Random(4)
    planted = []
    for t in texts:
        words = re.findall(r"[A-Za-z]+", t or "")
        if len(words) > 20:
            k = r.randrange(len(words) - 4)
            planted.append(f"{t} and {' '.join(words[k : k + 3])} ({''.join(w[0] for w in words[k : k + 3]).upper()}) end")
    got = spark.createDataFrame([(k, t) for k, t in enumerate(planted)], "k int, t string").select("k", A.abbreviations("t").alias("a")).collect()
    assert len(got) > 50
    for row in got:
        want = {}
        for m in re.finditer(r"\(([^()\n]{2,120})\)", planted[row.k]):
            short = re.split(r"[;,]", m.group(1))[0].strip()
            if A.is_short(short) and (long := plain(short, A.window(planted[row.k], m.start(), short))):
                want[short] = long
        assert {k: v for k, v in row.a.items() if k in want} == want


def test_long_text_in_linear_time():
    for piece in ("(A", "a ", "AB ", "word, ", "(AB) ", "Ab Cd (AC) "):
        start = time.perf_counter()
        A.abbreviations_of(piece * (300_000 // len(piece)))
        assert time.perf_counter() - start < 20, piece


def body(name: str, r: random.Random) -> str:
    return name + "\n" + " ".join(r.choice(["stone", "of\n", "the", "river", "7.2", "é"]) for _ in range(r.randint(3, 60)))


def test_sections(spark):
    r, rows, want = random.Random(7), [], []
    headings = {"introduction": ["Introduction", "1. BACKGROUND", "  2 Literature review"], "methods": ["Methods", "Materials and methods", "3.  Study area"], "results": ["RESULTS", "4 Findings:"], "discussion": ["Discussion", "Interpretation of data"], "conclusions": ["Conclusions", "Summary"], "references": ["References", "Literature cited"], "acknowledgments": ["Funding", "Acknowledgements"]}
    for k in range(60):
        parts = [(n, body(r.choice(headings[n]), r)) for n in r.choices(list(headings), k=r.randint(2, 9))]
        text = "A title that is no heading\n" + "\n".join(p for _, p in parts)
        rows.append((k, text))
        found: dict = {}
        for n, p in parts:
            if n not in fulltext.DROPPED and len(p.strip()) > 50:
                found[n] = found[n] + "\n\n" + p.strip() if n in found else p.strip()
        want.append(found if len(text) >= 200 else {})
    rows += [(60, None), (61, ""), (62, "Methods\nshort"), (63, "x" * 300), (64, "Results\n" + "one heading only " * 20), (65, "results that run on, not " * 20 + "\nMethods of it\n" + "long enough to be kept as a section of its own, surely\n" + "Resultsandmore\n"), (66, "Methods\n" + "\n" * 100_000 + "Results\n" + "far down " * 50_000)]
    got = {x.k: x.s for x in spark.createDataFrame(rows, "k int, t string").select("k", fulltext.sections(F.col("t")).alias("s")).collect()}
    assert [got[k] for k in range(60)] == want
    assert got[60] == got[61] == got[62] == {} and got[63] == {"body": "x" * 300} and list(got[64]) == ["body"]
    assert set(got[65]) == {"results", "methods"} and got[65]["methods"].endswith("Resultsandmore")
    assert got[66] == {"results": rows[66][1].split("\n" * 100_000)[1].strip()}
