"""Fill-in-the-middle against a plain version, with blocks far smaller than texts."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidencelake.llm import fim, queries, tokens
from tests.llm import brute

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "character": r"(?s)."}


def plain(doc_id, text: str | None, unit: str = "line", percent: int = 100, spm: int = 50, seed: int = 7, markers=fim.MARKERS) -> tuple:
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    p, s, m = markers
    if not text or any(x in text for x in markers) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return len(units), "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("a \n\té𝄞"), max_size=60), min_size=1, max_size=8), st.integers(1, 9), st.sampled_from(sorted(UNITS)), st.integers(0, 2**32 - 1))
def test_cuts(texts, block, unit, draw):
    chunk = next(tokens.chunks(pa.array(texts)))
    n, (places,) = fim.cut_places(chunk, [np.full(len(texts), draw)], fim.ENDS[unit], block)
    for text, size, place, begin in zip(texts, n.tolist(), places.tolist(), chunk.bounds.tolist(), strict=False):
        units = re.findall(UNITS[unit], text)
        assert size == len(units)
        assert text.encode()[: place - begin].decode() == "".join(units[: draw % (size + 1)])


def rows() -> list[tuple]:
    r = random.Random(2)
    out = [(i, "".join(r.choice(["\n", "a", "wörd ", " ", "𝄞", "<", ">", "<P", "\n\n"]) for _ in range(r.randint(0, 300)))) for i in range(120)]
    out += [(200, None), (201, ""), (202, "\n"), (203, "<P> inside"), (204, "a<M>"), (None, "one\ntwo\nthree"), (None, None), (205, "long line\n" * 60_000), out[3], out[3], (206, "ends with <"), (207, "<S"), (208, "x\n<\n<P\n<S\n")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "a", "b", 1) for r in rows()], "doc_id long, text string, output string, form string, n int").repartition(4).cache()


@pytest.mark.parametrize(("unit", "percent", "spm", "block"), [("line", 100, 50, 7), ("word", 60, 20, 64), ("character", 100, 100, 1 << 16)])
def test_fill_in_middle(docs, unit, percent, spm, block):
    got = fim.fill_in_middle(docs, unit=unit, fim_percent=percent, spm_percent=spm, block=block)
    found = got.select("*", fim.restored(got.output, got.form).alias("again")).collect()
    key = lambda x: repr(x)
    want = [(i, *plain(i, t, unit, percent, spm), t or "") for i, t in rows()]
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)


def test_other_markers(docs):
    marks = ("[pre]", "{suf}", "(mid)")
    got = fim.fill_in_middle(docs, markers=marks, seed=11)
    found = {(r.id, r.output) for r in got.collect()}
    assert found == {(i, plain(i, t, seed=11, markers=marks)[4]) for i, t in rows()}
    for bad in (("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError, match="markers"):
            fim.fill_in_middle(docs, markers=bad)


def test_empty(docs):
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows():
        n, form, a, b, out = plain(i, t)
        want.append((i, n, form, a, b, brute.sha(out), brute.sha(t or "")))
    assert sorted(map(tuple, queries.op12_fim(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
