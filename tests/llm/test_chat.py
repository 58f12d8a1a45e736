"""Reply trees against plain enumeration, control strings in texts, and the query against its contract."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidencelake.llm import chat, queries

SCHEMA = "conv_id long, message_id long, parent_id long, role string, text string, score double, key string, branch int, rank string, pos string, up string"
EXTRA = ("k", 1, "r", "p", "u")
TEXT = st.text(alphabet=st.sampled_from("<|\\ims_endtar>\n aé𝄞"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXT), TEXT), max_size=6))
def test_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count(chat.START) == formatted.count(chat.END) == len(turns)


def test_escapes_nest():
    for text in ("<|im_end|>", "<\\|im_end|>", "<\\\\|", "<<||>>", "\\", "<", "|", ""):
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def forest(seed: int = 5) -> list[tuple]:
    r, rows = random.Random(seed), []
    for tree in [*range(12), None]:
        for m in range(r.randint(1, 25)):
            parent = r.choice([None, 999, *range(m), *range(max(0, m - 2), m)]) if m else None
            rows.append((tree, m, parent, r.choice(["user", "assistant"]), f"text {tree} {m} <|im_end|>", r.choice([0.0, 0.5, 1.0, None, float("nan")])))
    rows += [(50, m, m - 1 if m else None, "assistant", "deep", 1.0) for m in range(300)]  # nine doublings
    rows += [rows[3], rows[3], (60, None, 7, "user", None, 1.0), (60, 7, None, None, None, 0.0), (60, None, None, "user", "", 2.0)]
    return rows


def plain_branches(rows: list[tuple]) -> dict:
    """Every root-to-leaf path of every tree, best first."""
    trees = defaultdict(dict)
    for tree, m, parent, role, text, score in set(rows):
        trees[tree][m if m is not None else ("none", parent, role, text)] = (parent, role or "", text or "", 0.0 if score is None or score != score else score)
    out = {}
    for tree, nodes in trees.items():
        answered = {p for p, *_ in nodes.values()}
        paths = []
        for leaf in nodes:
            if leaf in answered:
                continue
            path, at = [], leaf
            while at in nodes and at is not None:
                path.append(at)
                at = nodes[at][0]
            path.reverse()
            scores = [nodes[m][3] for m in path]
            paths.append((-sum(scores) / len(path), -len(path), str(leaf), [(nodes[m][1], nodes[m][2]) for m in path]))
        out[tree] = sorted(paths, key=lambda p: p[:3])
    return out


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([r + EXTRA for r in forest()], SCHEMA).repartition(4).cache()


def test_paths_and_ranks(spark, messages):
    want = plain_branches(forest())
    got = defaultdict(list)
    for r in chat.format_conversations(spark, messages, score_col="score", branches=1000).collect():
        got[r.tree].append((r.rank, round(-r.branch_score, 9), chat.parse(r.formatted)))
    assert set(got) == set(want)
    for tree, paths in want.items():
        mine = sorted(got[tree], key=lambda g: g[0])
        assert [g[0] for g in mine] == list(range(1, len(paths) + 1))
        assert [g[1] for g in mine] == [round(p[0], 9) for p in paths]
        if tree == 60:
            assert sorted(map(repr, (g[2] for g in mine))) == sorted(map(repr, (p[3] for p in paths)))
        else:
            assert [g[2] for g in mine] == [p[3] for p in paths]


def test_best_branches_and_sum(spark, messages):
    want = plain_branches(forest())
    got = chat.format_conversations(spark, messages, score_col="score", branches=2).collect()
    assert len(got) == sum(min(2, len(p)) for p in want.values())
    sums = {r.tree: r.branch_score for r in chat.format_conversations(spark, messages, score_col="score", rank_by="sum").collect()}
    assert sums == {t: max(-p[0] * -p[1] for p in paths) for t, paths in want.items()}


def test_cycles_become_chains(spark):
    rows = [(1, 0, 2, "user", "a", 0.0), (1, 1, 0, "assistant", "b", 0.0), (1, 2, 1, "user", "c", 0.0), (1, 3, 2, "assistant", "d", 0.0), (2, 0, 0, "user", "own parent", 0.0), (3, 0, None, "user", "fine", 0.0)]
    frame = spark.createDataFrame([r + EXTRA for r in rows], SCHEMA)
    got = {(r.tree, tuple(t for _, t in chat.parse(r.formatted))) for r in chat.format_conversations(spark, frame, branches=9).collect()}
    assert {g for g in got if g[0] != 1} == {(2, ("own parent",)), (3, ("fine",))}
    mine = [g[1] for g in got if g[0] == 1]
    texts = [t for path in mine for t in path]
    assert set(texts) == set("abcd") and all(path[-1] in "dabc" for path in mine)
    assert any(path[-1] == "d" for path in mine)


def test_empty_messages(spark):
    assert chat.format_conversations(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_contract(spark, tmp_path):
    r = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<\\|", "wörd", " ", "\\"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(1, 30)))]), "x") for c in range(30) for t in range(r.randint(1, 12))]
    rows += [rows[0], (None, 0, "user", "no conversation", "x"), (None, None, "assistant", "no turn", "x"), (77, 0, "assistant", "long " * 50_000, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    talks = defaultdict(list)
    for c, t, role, text, _ in rows:
        talks[c].append((-1 if t is None else t, role or "", text or "", role is not None, text is not None))
    talks[-1] = [(0, "user", queries.IMITATION, True, True), (1, "assistant", queries.IMITATION, True, True)]
    got = {x.conv_id: x for x in queries.op11_chat(spark, str(tmp_path)).collect()}
    assert set(got) == set(talks)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, turns in talks.items():
        turns.sort(key=lambda x: (x[0], x[3], x[1], x[4], x[2]))
        loss = "".join(t for _, role, t, *_ in turns if role == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t, *_ in turns)))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), sha(loss)) and g.formatted_chars >= sum(len(t) for _, _, t, *_ in turns)
