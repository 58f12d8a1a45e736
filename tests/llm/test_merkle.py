"""Merkle manifests against plain trees: ranks, proofs and folds, with small blocks and digits so that every level is used."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidencelake.llm import merkle, queries
from evidencelake.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i long, g string, path string, number string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(cells: tuple) -> str:
    return sha("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def tree(digests: list[str]) -> list[list[str]]:
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        start = at - at % 3
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + 3])))
        at //= 3
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        cut = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        groups[source].append((doc_id, leaf((doc_id, source, lang, n_chars, text)), leaf((doc_id, source, lang, n_chars, text.replace("\n", "") if cut else text))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]])
    top, out = tree([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for at, (doc_id, own, changed) in enumerate(groups[s]):
            path = siblings(trees[s], at) + siblings(top, k)
            node = changed
            for left, right in path:
                node = sha(left + node + right)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out


def rows(seed: int = 4) -> list[tuple]:
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "".join(r.choice(["\n", "é", "a ", "𝄞"]) for _ in range(r.randint(1, 40)))])
    ids = [*range(-40, 300, 3), *(r.getrandbits(63) - 2**62 for _ in range(60)), 2**63 - 1, -(2**63), *range(10**12, 10**12 + 90)]
    out = [(i, text(), r.choice(["en", None]), r.choice(["b", "b", "b", "ä", "a", "", None, "b2"]), r.choice([None, 5])) for i in ids]
    out += [(None, text(), "en", r.choice(["b", None]), k) for k in range(30)]  # many rows without an id
    out += [(7, text(), "de", "b", k) for k in range(20)] + [out[5]] * 9 + [out[-1]] * 4 + [(8, "\n" * 5_000, "en", "alone", 1)]
    return out + [(k, "x", None, f"s{k:04}", 1) for k in range(30)]  # more sources than a block holds


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "g", "p", "n") for r in rows()], SCHEMA).repartition(5).cache()


def as_contract(found):
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select("id", "leaf", "subroot", "root", proof, folded, folded == F.col("root"))


@pytest.mark.parametrize(("levels", "bits"), [(1, 2), (2, 3), (6, 12)])
def test_manifest(spark, docs, monkeypatch, levels, bits):
    monkeypatch.setattr(merkle, "DIGIT_BITS", bits)
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(spark, docs, text, levels=levels)
    assert sorted(map(tuple, as_contract(found).collect()), key=repr) == sorted(plain(rows()), key=repr)
    assert {r.source for r in found.select("source").distinct().collect()} == {r[3] for r in rows()}


def test_any_change_shows(spark, docs):
    """Without tampering every leaf folds to the root; a changed cell of any kind changes it."""
    found = merkle.manifest(spark, docs)
    assert found.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    roots = {merkle.manifest(spark, changed).first().root for changed in (docs, docs.withColumn("lang", F.when(F.col("doc_id") == 2**63 - 1, "xx").otherwise(F.col("lang"))), docs.where("doc_id <> 8 OR doc_id IS NULL"))}
    assert len(roots) == 3


def test_histogram_ranks(spark, tmp_path):
    r = random.Random(9)
    numbers = {(g, n) for g in "ab" for n in [*range(200), *(r.getrandbits(60) for _ in range(100)), -5, None]}
    counts = [(g, n, r.randint(1, 4)) for g, n in numbers]
    got = {(x.g, x.number): x.before for x in merkle.offsets(spark.createDataFrame(counts, "g string, number long, n long"), Scratch(spark, "test"), "t").collect()}
    for g, n, _ in counts:
        assert got[(g, n)] == sum(k for h, m, k in counts if h == g and (m is not None, m or 0) < (n is not None, n or 0))


def test_one_row_and_none(spark, docs):
    one = docs.limit(1)
    row = merkle.manifest(spark, one).first()
    assert row.leaf == row.subroot == row.root and row.path == []
    assert merkle.manifest(spark, docs.limit(0)).count() == 0


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op13_merkle(spark, str(tmp_path)).collect()), key=repr) == sorted(plain(rows()), key=repr)
