"""Operators against brute force, on documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidencelake.llm import components, cotrain, decontamination, linededup, lm, mixing, pii, quality, simhash, simwide, substrings, tokens, urlfilter
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, id string, rid long, doc string, size int, kept string, copies int, key string, fp long"
EXTRA = ("x", 1, "y", 2, "z", 3, "k", 4)


@pytest.fixture(scope="module")
def rows():
    return brute.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With further columns whose names the operators use inside."""
    return spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(spark, docs, rows):
    want = brute.component_ids(rows)
    text_of = {(i, t) for i, t, *_ in rows}
    for limit in (simhash.BUCKET_ROWS, 8):  # the second splits almost every bucket
        got = simhash.near_duplicates(spark, docs, bucket_rows=limit).collect()
        assert len(got) == len(rows)
        assert Counter((r.id, f"{r.fp & (2**64 - 1):016x}", r.component) for r in got) == Counter((i, *want[(i, t)]) for i, t, *_ in rows)
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) >= {c for _, c in want.values() if c is not None}
    assert text_of


def test_simhash_dense_group(spark):
    """Many fingerprints a few bits apart, which no bucket may pair in full."""
    rng = np.random.default_rng(0)
    base = int(rng.integers(1 << 62))
    bits = rng.choice(64, 14, replace=False)
    fps = {base ^ sum(1 << int(b) for b in bits if rng.random() < 0.25) for _ in range(600)} | {int(x) for x in rng.integers(1 << 62, size=400)}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    frame = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, least long")
    scratch = simhash.Scratch(spark, "test")
    near = {}
    for limit in (simhash.BUCKET_ROWS, 64):
        found = components.connected_components(spark, simhash.links(spark, frame, scratch, bucket_rows=limit), scratch).collect()
        near[limit] = {r.node: r.root for r in found}
    a, nodes = np.array(signed), {f: f for f in signed}

    def find(f):
        while nodes[f] != f:
            f = nodes[f]
        return f

    for k in range(len(a)):
        for b in a[k + 1 :][np.bitwise_count((a[k + 1 :] ^ a[k]).view(np.uint64)) <= 3].tolist():
            x, y = find(int(a[k])), find(b)
            nodes[max(x, y)] = min(x, y)
    want = {f: find(f) for f in signed if find(f) != f}
    assert near[64] == want and near[simhash.BUCKET_ROWS] == want


def test_thresholds_meet_all_links():
    rng = np.random.default_rng(1)
    costs = np.cumsum(rng.random((4, 4, 50)) * 10, axis=1)
    t = simhash.allocate(costs)
    assert ((t + 1).sum(axis=0) == 4).all()
    choices = [c for c in np.ndindex(5, 5, 5, 5) if sum(c) == 4]
    price = lambda c, q: sum(costs[p, c[p] - 1, q] if c[p] else 0 for p in range(4))
    for q in range(50):
        assert math.isclose(price(t[:, q] + 1, q), min(price(c, q) for c in choices))


def test_components_of_a_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (None, 3)], "u long, v long").where("u IS NOT NULL")
    got = components.connected_components(spark, edges, simhash.Scratch(spark, "test")).collect()
    assert {r.node: r.root for r in got} == dict.fromkeys(range(1, n + 1), 0)


def test_line_dedup(spark, docs, rows):
    want = brute.line_dedup(rows)
    for batches, fanout in ((3, 2), (1, 4), (5, 2)):
        got = linededup.drop_repeated_lines(spark, docs, batches=batches, fanout=fanout)
        assert got.columns == [*docs.columns, "__kept", "__n_dropped"]
        assert Counter((r.doc_id, r.text, r["__n_dropped"], r["__kept"]) for r in got.collect()) == Counter((i, t, want[(i, t)][1], want[(i, t)][2]) for i, t, *_ in rows)


def test_passages(spark, docs, rows):
    want = brute.passages(rows)
    got = substrings.drop_repeated_passages(spark, docs).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept) for r in got) == Counter((i, *want[(i, t)]) for i, t, *_ in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=30, max_size=80), st.integers(0, 40), st.integers(0, 30))
def test_equal_windows_have_equal_anchors(words, shift, pad):
    """Whatever stands around a window."""
    rng = np.random.default_rng(pad)
    names = tokens.splitmix(np.arange(1, 10, dtype=np.uint64))
    text = names[np.array(words)]
    window = min(len(text), 30)
    a = np.concatenate((names[rng.integers(0, 4, pad)], text, names[rng.integers(0, 4, shift)]))
    b = np.concatenate((names[rng.integers(0, 4, shift)], text, names[rng.integers(4, 9, pad)]))
    found = [substrings.anchors(x, np.zeros(len(x), dtype=np.int64), np.array([at]), window) for x, at in ((a, pad), (b, shift))]
    assert found[0][0] == found[1][0] and found[0][1] - pad == found[1][1] - shift


ITEMS = [(1, "an item of the benchmark with more than ten words in it, all told"), (2, "short one"), (3, None), (4, "..."), (None, "anonymous item"), (2, "an item of the benchmark with more than ten words in it again")]


@pytest.mark.parametrize("bound", [1000, 0])
def test_decontamination(spark, rows, bound):
    planted = [(2000, "before an ITEM of the-benchmark with more than ten words in it, all told after", "en", "a"), (2001, "a short one", "en", "a"), (2002, "anonymous item here", "en", "a"), (2000, "short", "en", "a")]
    some = rows + planted
    docs = spark.createDataFrame([r + EXTRA for r in some], SCHEMA).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute.benchmark_hits(some, ITEMS)
    got = decontamination.benchmark_hits(spark, docs, items, broadcast_windows=bound).collect()
    assert Counter((r.id, r.n_words, sum(s.end - s.begin for s in r.spans), tuple(r["items"])) for r in got) == Counter((i, n, h, tuple(x)) for i, t, *_ in some for n, h, x in [want[(i, t)]])
    kept = decontamination.clean_documents(spark, docs, items, broadcast_windows=bound).collect()  # rows that share an id are judged apart
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((i, t) for i, t, *_ in some if not want[(i, t)][1])


def test_winnowing_guarantee():
    """Documents that share SPAN words share a fingerprint."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    word = lambda k: " ".join("w%d" % x for x in rng.integers(0, 1000, k))
    for _ in range(50):
        shared = word(decontamination.SPAN)
        fps = [set(decontamination.winnow(w, w.hashes())[0].tolist()) for c in tokens.chunks(pa.array([f"{word(9)} {shared} {word(7)}", f"{word(3)} {shared}"]), 1) for w in [c.words(tokens.ALNUM)]]
        assert fps[0] & fps[1]


def test_mixing(spark, rows):
    rows = [r for r in rows if r[0] != 906]  # of its source the others are a tenth, so no choice comes near
    docs = spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(5)
    got = mixing.mix(spark, docs).collect()
    again = mixing.mix(spark, docs.repartition(7)).collect()
    key = lambda r: (str(r.id), r.rid, r.taken)
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    size = {(i, t): len(brute.WORD.findall(t or "")) for i, t, *_ in rows}
    assert Counter((r.id, r["size"]) for r in got) == Counter((i, size[(i, t)]) for i, t, *_ in rows)
    total, by = sum(size[(i, t)] for i, t, *_ in rows), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        s = by.setdefault(r.pattern[0], [0, 0, r.target, r.source_size])
        s[0], s[1] = s[0] + r["size"], s[1] + r.taken
    assert math.isclose(sum(s[2] for s in by.values()), total)
    for n, taken, target, source in by.values():
        assert n == source and target <= 3 * n + 1e-6 and abs(taken - target) <= 3


def test_best_sum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = rng.integers(0, 60, rng.integers(0, 9)).tolist()
        wanted = int(rng.integers(0, 250))
        took = sum(s for s, t in zip(sizes, mixing.best_sum(sizes, wanted), strict=True) if t)
        every = [sum(s for k, s in enumerate(sizes) if m >> k & 1) for m in range(1 << len(sizes))]
        assert abs(took - wanted) == min(abs(e - wanted) for e in every)


def test_quotas_and_flow():
    assert mixing.quotas([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.quotas([10, 500, 490], [5, 2, 1])
    assert got[0] == 30 and math.isclose(sum(got), 1000) and math.isclose(got[1], 2 * got[2])
    assert mixing.quotas([0, 0], [5, 2]) == [0.0, 0.0]
    # a pattern of both sources goes where its tokens are wanted; repeats come last
    flows = mixing.min_cost_flow([10, 10, 10], [[0], [1], [0, 1]], [5, 25])
    assert flows[0] == {0: 5} and flows[1] == {1: 10 + flows[1][1] - 10} and sum(f.get(1, 0) for f in flows) == 25
    assert flows[1].get(1, 0) + flows[2].get(1, 0) == 25 and max(flows[1][1], flows[2][1]) <= 15


def test_mixing_overlapping_sources(spark, docs):
    from pyspark.sql import functions as F

    both = mixing.mix(spark, docs.where("doc_id IS NULL OR doc_id <> 906"), sources=F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))).collect()
    assert {tuple(r.pattern) for r in both} == {("a", "b"), ("b",)}
    total = sum(r["size"] for r in both)
    assert abs(sum(r.taken for r in both) - total) <= 0.02 * total


def test_quality_counts_and_bands(spark, docs, rows):
    got = quality.judge(spark, docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.id, *(r[n] for n in names)) for r in got) == Counter((i, *brute.text_counts(t)) for i, t, *_ in rows)
    assert all(not r.kept or not r.base_failed for r in got) and any(r.kept for r in got)
    kept = quality.keep_good(spark, docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_kneser_ney_sums_to_one_and_rejects_noise(spark):
    import random

    r = random.Random(4)
    words = ["w%d" % k for k in range(40)]
    clean = [(k, " ".join(r.choice(words[: 10 + 10 * (k % 3)]) for _ in range(120)), "en") for k in range(200)]
    noise = [(1000 + k, " ".join("".join(r.choice("xyzq") for _ in range(9)) for _ in range(120)), "en") for k in range(5)]
    copies = [(2000 + k, clean[0][1], "en") for k in range(60)]
    docs = spark.createDataFrame(clean + noise + copies, "doc_id long, text string, lang string")
    numbers, tables = quality.train(spark, docs, "text", quality.Scratch(spark, "test"))
    model = quality.arrays(numbers, tables)
    types = sorted({w for _, t, _ in clean + noise for w in t.split()})
    ids = numbers.of(next(tokens.chunks(pa.array([" ".join(types)]))).words().hashes())
    assert len(set(ids)) == len(types) and tables.trigrams.count() > 0 and tables.pairs.count() > 0
    c = np.append(ids, quality.EDGE)
    stored = [(r.y, r.x >> 32) for r in tables.trigrams.collect()[:3]]
    for a, b in [*stored, (quality.EDGE, quality.EDGE), (quality.FIRST, quality.FIRST + 3), (int(ids[-1]), int(ids[0]))]:
        assert math.isclose(model.probabilities(np.full(len(c), a), np.full(len(c), b), c).sum(), 1, rel_tol=1e-5)
    kept = {r.id: r.kept for r in quality.judge(spark, docs).collect()}
    assert not any(kept[i] for i, *_ in noise) and all(kept[i] for i, *_ in clean + copies)


def brute_trigrams(texts):
    """Log probabilities of documents under the stored model, n-gram by n-gram, with the words before counted exactly."""
    seqs = [["<", "<", *(t or "").split(), ">"] for t in texts]
    grams, left, pairs, ends = Counter(), {}, {}, {}
    for s in seqs:
        for k in range(2, len(s)):
            a, b, c = s[k - 2 : k + 1]
            b, c, a = (x.replace(">", "<") if x == ">" else x for x in (b, c, a))
            grams[a, b, c] += 1
            left.setdefault((a, b, c), set()).add(s[k - 3] if k > 2 else "<")
            pairs.setdefault((b, c), set()).add(a)
            ends.setdefault(c, set()).add(b)
    seen = Counter()
    for (_, b, c), n in grams.items():
        seen[b, c] += n
    discount = lambda counts: quality.discounts([sum(x == k for x in counts) for k in (1, 2, 3, 4)])
    d1, d2, d3 = discount(list(map(len, ends.values()))), discount(list(map(len, pairs.values()))), discount(list(grams.values()))
    need = lambda n: max(quality.LEAST_DIVERSE, min(quality.DIVERSE, n / quality.SHARE))
    total, after = sum(map(len, ends.values())), Counter()
    for (b, _), x in pairs.items():
        after[b] += len(x)
    p1 = {c: (len(x) - d1[min(3, len(x))]) / total for c, x in ends.items() if len(x) >= quality.LEAST_DIVERSE}
    spare = (1 - sum(p1.values())) / len(ends)
    one = lambda c: p1.get(c, 0) + spare
    a2 = {k: (len(x) - d2[min(3, len(x))]) / after[k[0]] for k, x in pairs.items() if len(x) >= need(seen[k])}
    a3 = {k: (n - d3[min(3, n)]) / seen[k[:2]] for k, n in grams.items() if len(left[k]) >= need(n) and len(pairs.get(k[:2], ())) >= quality.LEAST_DIVERSE}
    gone2, gone3 = Counter(), Counter()
    for k, v in a2.items():
        gone2[k[0]] += v
    for k, v in a3.items():
        gone3[k[:2]] += v
    out = []
    for s in seqs:
        s = [x.replace(">", "<") if x == ">" else x for x in s]
        p2 = lambda b, c: a2.get((b, c), 0) + (1 - gone2[b]) * one(c)
        out.append(sum(math.log(a3.get((s[k - 2], s[k - 1], s[k]), 0) + (1 - gone3[s[k - 2], s[k - 1]]) * p2(s[k - 1], s[k])) for k in range(2, len(s))))
    return out


def test_bitmaps_count_words():
    rng = np.random.default_rng(1)
    for many, off in ((1, 0.1), (4, 0.5), (16, 0.25), (64, 0.25), (1000, 0.3)):
        found = np.array([quality.different(np.bitwise_or.reduce(quality.bit_of(rng.integers(1 << 40, size=many)))[None])[0] for _ in range(60)])
        assert abs(np.median(found) - many) <= off * many, (many, np.median(found))


@pytest.mark.parametrize("bound", [quality.BOUND, 0])
def test_trigram_model_against_brute_force(spark, bound):
    """Both as arrays and by joins."""
    import random

    r = random.Random(9)
    words = ["w%d" % min(k, int(r.expovariate(0.06))) for k in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 150))) for _ in range(150)] + [None, "", "once only"]
    texts += [texts[0]] * 12
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    want = brute_trigrams(texts)
    got = {x.id: x for x in quality.judge(spark, docs, bound=bound).collect()}
    diff = [abs(got[k].log_perplexity + w / (got[k].n_words + 1)) for k, w in enumerate(want) if got[k].n_words]
    assert max(diff) < 0.25 and float(np.median(diff)) < 0.05  # bitmaps of 64 bits: a few trigrams are stored or not
    assert got[150].log_perplexity is None and not got[150].kept


def test_quality_is_the_same_whether_tasks_hold_the_model_or_not(spark):
    import random

    r = random.Random(10)
    words = ["w%d" % min(k, int(r.expovariate(0.05))) for k in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 200))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame([(k, t, "en" if k % 3 else None, k) for k, t in enumerate(texts * 2)], "doc_id long, text string, lang string, score int").repartition(3)
    held, joined = ({x.id: (x.log_perplexity, x.base_failed, x.low, x.high, x.kept) for x in quality.judge(spark, docs, bound=b).collect()} for b in (quality.BOUND, 0))
    assert held == joined and any(x[4] for x in held.values())
    for b in (quality.BOUND, 0):
        kept = quality.keep_good(spark, docs, bound=b)
        assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(k for k, x in held.items() if x[4])
        assert b == 0 or "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()  # texts stay where they lie


def test_bands_reject_menus_and_scrambled_words_but_not_copies(spark):
    """Over-predictable boilerplate lies below the band, noise above it; copies, near copies and clean texts stay."""
    import random

    r = random.Random(14)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(1500)]
    weight = [1 / (k + 3) for k in range(len(words))]
    prose = lambda n: " ".join(r.choices(words, weight, k=n))
    clean = [(k, prose(r.randint(250, 400)), "en") for k in range(300)]
    base = clean[3][1].split()
    near = [(1000 + k, " ".join(r.choice(words) if r.random() < 0.03 else w for w in base), "en") for k in range(40)]
    copies = [(2000 + k, clean[5][1], "en") for k in range(60)]
    menu = [(3000 + k, " ".join(f"{w} | -" for w in r.choices(words, k=60)), "en") for k in range(30)]
    noise = [(4000 + k, " ".join(w + "###" for w in prose(100).split()), "en") for k in range(10)]
    docs = spark.createDataFrame(clean + near + copies + menu + noise, "doc_id long, text string, lang string").repartition(4)
    got = {x.id: x for x in quality.judge(spark, docs).collect()}
    kept = {i: x.kept for i, x in got.items()}
    assert all(got[i].log_perplexity < got[i].low for i, *_ in menu), [got[i].log_perplexity for i, *_ in menu]
    assert all(got[i].log_perplexity > got[i].high for i, *_ in noise)
    assert sum(kept[i] for i, *_ in clean) >= 0.98 * len(clean) and all(kept[i] for i, *_ in copies + near)


def test_language_model(spark, docs, rows):
    got = lm.score(spark, docs).collect()
    split = {(i, t): brute.lowered(t or "").encode().split() + [None] for i, t, *_ in rows}
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    c = Counter(w for i, t, *_ in rows if learns(i) for w in split[(i, t)])
    n, v = sum(c.values()), len(c)
    want = Counter((i, not learns(i), len(s), sum(c[w] > 0 for w in s), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s), 6)) for i, t, *_ in rows for s in [split[(i, t)]])
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_network_beats_single_words(spark):
    """Texts of two vocabularies that share no word."""
    import random

    r = random.Random(8)
    rows = [(k, " ".join(r.choice(["ab", "cd"][k % 2]) + str(r.randint(0, 30)) for _ in range(100)), "h") for k in range(400)]
    out = lm.score(spark, spark.createDataFrame(rows, "doc_id long, text string, held_out string"), rounds=6, shares=1).where("held_out").collect()
    n = sum(r.n_tokens for r in out)
    assert (sum(r.score for r in out) - sum(r.base_score for r in out)) / n > 0.15


def test_counts_below_the_common_ones_are_joined(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 5)
    whole = {(r.id, r.n_tokens): r for r in lm.score(spark, docs, rounds=0).collect()}
    monkeypatch.setattr(lm, "COMMON", 60)
    for r in lm.score(spark, docs, rounds=0).collect():
        w = whole[(r.id, r.n_tokens)]
        assert r.n_known == w.n_known and math.isclose(r.base_score, w.base_score, rel_tol=1e-9) and math.isclose(r.score, w.score, rel_tol=1e-6)


def test_language_model_gradients():
    rng = np.random.default_rng(0)
    n = 40
    v = lm.Vocabulary(np.arange(n).astype(np.uint64), np.full(n, 5), np.arange(n), np.full(32, 10.0), np.arange(n, 0, -1) * 3, 5, 1000, n)
    p = {k: x.astype(np.float64) * 2 for k, x in lm.initial(v).items()}
    before, after = rng.integers(0, n + 33, (2, 5, 4))
    fresh = np.zeros((5, 4), dtype=bool)
    fresh[0] = fresh[3, 1] = True
    loss = lambda: lm.gradients(p, v, before, after, fresh, np.zeros((4, lm.HIDDEN)))
    g = loss()[0]
    for k in p:
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            p[k][i] += 1e-3
            up = loss()[2]
            p[k][i] -= 2e-3
            down = loss()[2]
            p[k][i] += 1e-3
            assert abs((up - down) / 2e-3 / 20 - g[k][i]) < 2e-3


def test_url_rules(spark):
    urls = ["http://a.example.com/en/x?y", "https://WWW.example.com/en/", "http://net/es/1", "x.net/es/", None, "", "http://notnet/es/", "http://b.net/fr/#a", "ftp://example.org/spam/1", "http://com", "http://a.com/", "http://a.com?b/", "http://example.com/EN/", "http://u@example.com/en/", "a://b://net/es/"]
    pages = spark.createDataFrame([(k, u, "h", "h", 1) for k, u in enumerate(urls + urls[:2])], "page_id long, url string, rule string, best string, token int")
    rules = urlfilter.rule_table(spark, [urlfilter.site_rule(*r) for r in urlfilter.SITE_RULES] + [urlfilter.token_rule("spam", "block")])
    got = {r.page_id: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in urlfilter.judge_urls(pages, rules).collect()}
    assert len(got) == len(urls) + 2

    def plain(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        tail = url.split("://", 1)[1]
        cut = min([tail.find(c) for c in "/?#" if c in tail] or [len(tail)])
        host, rest = brute.lowered(tail[:cut]), tail[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [(len(r), r, v) for r, v in urlfilter.SITE_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        if fits:
            return host, path, *max(fits)[1:]
        return host, path, *(("*spam*", "block") if "spam" in (host + path).replace("/", " ").split() else (None, "allow"))

    for k, u in enumerate(urls + urls[:2]):
        assert got[k] == plain(u), u
    assert "Python" not in urlfilter.judge_urls(pages, rules)._jdf.queryExecution().toString()
    assert urlfilter.judge_urls(pages, rules.limit(0)).where("__verdict <> 'allow'").count() == 0


def test_personal_data(spark):
    texts = ["mail a.b+c@d-e.example.com now", "ip 1.2.3.4 and 1.2.3.256 and 1.2.3.4.5", "card 4111 1111 1111 1111, not 4111 1111 1111 1112", "call +1 (555) 010-9999 or +12", None, "", "no data at all", "ñandú 10.0.0.1", "Version 2.0.", "9" * 5000]
    got = {r.id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    show = lambda k: [(s.kind, texts[k][s.start : s.end]) for s in got[k].base]
    assert show(0) == [("email", "a.b+c@d-e.example.com")] and show(1) == [("ip", "1.2.3.4"), ("ip", "1.2.3.4")]
    assert show(2) == [("card", "4111 1111 1111 1111")] and show(3) == [("phone", "+1 (555) 010-9999")] and show(7) == [("ip", "10.0.0.1")]
    assert all(not got[k].spans for k in (4, 5, 6, 8, 9))
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got.values())


def test_field_on_held_out_sentences():
    field = pii.train(pii.labelled_table(300), passes=8)
    test = pii.labelled_table(150, seed=77)
    right = wrong = lost = 0
    for (_, gold), found in zip(test, pii.field_spans(field, [t for t, _ in test]), strict=True):
        right, wrong, lost = right + len(set(gold) & set(found)), wrong + len(set(found) - set(gold)), lost + len(set(gold) - set(found))
    assert right / (right + wrong) > 0.9 and right / (right + lost) > 0.9


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@%-+ 9(é", max_size=30))
def test_base_matches_the_plain_patterns(text):
    import re

    found = pii.base_spans(text)
    assert [s[1:] for s in found if s[0] == "email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [s[1:] for s in found if s[0] == "ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]


def test_long_runs_take_linear_time():
    import time

    field = pii.default_field()
    for text in ("1" * 10**6, "a1" * 500_000, "a" * 10**6 + "@", "a@" * 500_000, "1." * 500_000, "a" * 10**6 + "@b.c"):
        start = time.perf_counter()
        pii.base_spans(text)
        pii.field_spans(field, [text])
        assert time.perf_counter() - start < 3


def test_field_adds_what_patterns_miss(spark):
    """Planted in prose: secrets and addresses without any digit, in all texts; and nothing in prose alone."""
    import random

    r = random.Random(21)
    word = lambda: "".join(r.choice(("er", "on", "tha", "ing", "es", "and")) for _ in range(r.randint(1, 3)))
    prose = lambda n: " ".join(word() + r.choice(("", "", "", ".", ",", " at")) for _ in range(n))
    hexed = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    plant = (lambda: ("secret", f'token = "{hexed()}"'), lambda: ("email", f"{word()}.{word()} at example dot org"), lambda: ("email", f"{word()} [AT] example [dot] com"), lambda: ("email", f"{word()} (at) {word()}.net"))
    rows, want = [], {}
    for k in range(120):
        kind, text = r.choice(plant)()
        rows.append((k, f"{prose(30)} {text} {prose(30)}"))
        want[k] = kind
    rows += [(1000 + k, prose(80)) for k in range(60)]
    got = {x.id: x for x in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not got[k].base for k in want)
    assert sum(want[k] in {s.kind for s in got[k].spans} for k in want) >= 0.9 * len(want)
    assert sum(bool(x.spans) for k, x in got.items() if k >= 1000) <= 2


def test_viterbi_is_best_path():
    from itertools import product

    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    field = pii.Field({}, np.zeros((0, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    scores = [rng.normal(size=(n, k)) for n in (3, 1, 2)]
    for s, path in zip(scores, pii.viterbi(field, scores), strict=True):
        value = lambda p: field.begin[p[0]] + sum(s[t, x] for t, x in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert math.isclose(value(path), max(value(p) for p in product(range(k), repeat=len(s))))


def test_cotraining(spark):
    import random

    r = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    rows, labels = [], []
    for i in range(900):
        good, toxic = r.random() < 0.8, r.random() < 0.15
        body = [r.choice(words) + ("" if good else r.choice(["***", "$$$"])) for _ in range(r.randint(20, 60))] + ["idiot"] * toxic
        r.shuffle(body)
        rows.append((i, " ".join(body), r.choice(["en", None]), r.choice(["a", None])))
        if i % 2:
            labels.append((i, int(good) if i % 50 else None, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None, None, None), (5001, "", "en", "a")], "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in cotrain.classify(spark, docs, spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 902 and all(0 <= x.score <= 1 for x in got.values())
    held = [(i, "***" not in t and "$$$" not in t, "idiot" in t) for i, t, *_ in rows if not i % 2]
    assert sum(got[i].kept == (g and not t) for i, g, t in held) / len(held) > 0.95
    none = cotrain.classify(spark, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 902


def test_surest_are_those_of_all_documents(spark):
    """Chosen over the whole pool, whatever its partitions: brute force over all logits."""
    rng = np.random.default_rng(2)
    ids = [rng.choice(400, rng.integers(1, 30), replace=False).astype(np.uint16) for _ in range(3000)]
    rows = [(k, int(rng.integers(-(1 << 62), 1 << 62)), x.tobytes(), x[:3].tobytes()) for k, x in enumerate(ids)]
    pool = spark.createDataFrame(rows, "id long, draw long, content binary, meta binary").repartition(7)
    views = [[(rng.normal(size=1 << cotrain.CONTENT_BITS), 0.1), (rng.normal(size=1 << cotrain.META_BITS), -0.1)]]
    got = cotrain.surest(pool, views, [{1: 50, 0: 80}])
    assert set(got) == {(0, v, label) for v in (0, 1) for label in (0, 1)}
    for (_, v, label), chosen in got.items():
        w, bias = views[0][v]
        logit = np.array([w[x if v == 0 else x[:3]].sum() + bias for x in ids]) * (1 if label else -1)
        wanted = {1: 50, 0: 80}[label]
        assert abs(len(chosen) - wanted) <= 12
        cut = np.sort(logit)[-wanted]
        found = {i for i, *_ in chosen}
        assert {k for k in range(3000) if logit[k] > max(2, cut) + 0.02} <= found and min(logit[k] for k in found) > max(2 - 1e-9, cut - 0.03)
        assert all(np.array_equal(np.frombuffer(c, dtype=np.uint16), ids[i]) for i, c, _ in chosen)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(spark, empty).count() == 0 and simhash.keep_one(spark, empty).count() == 0
    assert linededup.drop_repeated_lines(spark, empty).count() == 0 and substrings.drop_repeated_passages(spark, empty).count() == 0
    assert mixing.mix(spark, empty).count() == 0 and mixing.mixed_documents(spark, empty).count() == 0
    assert quality.judge(spark, empty).count() == 0 and lm.score(spark, empty).count() == 0
    assert decontamination.benchmark_hits(spark, empty, items).count() == 0 and pii.personal_data(empty).count() == 0
    assert cotrain.classify(spark, empty, labels).count() == 0
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string"), urlfilter.rule_table(spark, [urlfilter.site_rule("com/", "allow")])).count() == 0


def test_no_items_and_no_words(spark, docs, rows):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.benchmark_hits(spark, docs, items).where("size(spans) > 0").count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a"), (2, "", "en", None), (3, " ", None, "a")], "doc_id long, text string, lang string, source string")
    assert {r.component for r in simhash.near_duplicates(spark, blank).collect()} == {1}
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(spark, blank).collect())
    assert not any(r.kept for r in quality.judge(spark, blank).collect())
    assert all(r.n_tokens == 1 for r in lm.score(spark, blank).collect())
    assert {r.kept for r in substrings.drop_repeated_passages(spark, blank).collect()} == {""}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n\x0b\x1c\x85日.", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    import pyarrow as pa

    seen: dict[bytes, int] = {}
    found: list[list[str]] = []
    for c in tokens.chunks(pa.array(texts, type=pa.string()), limit):
        words = c.words()
        body, h = c.data.tobytes(), words.hashes()
        for d in range(c.n):
            found.append([body[words.starts[k] : words.ends[k]].decode() for k in range(words.of[d], words.of[d + 1])])
        for k in range(len(h)):
            w = body[words.starts[k] : words.ends[k]]
            assert seen.setdefault(w, int(h[k])) == h[k]
    assert found == [brute.WORD.findall(t or "") for t in texts] and len(set(seen.values())) == len(seen)


NAMES = ("__gone", "__doc", "__rid", "__kept", "__n_dropped", "__best", "__host", "__path", "__rule", "__weight", "__verdict", "__got", "__own", "rid", "own", "doc", "gone", "best", "copy", "key")


def test_columns_of_any_name_stay(spark):
    """Columns with the names that operators use keep their values; those of new columns' names get underscores."""
    texts = ["one line of some words\nsecond line that is long", "one line of some words\nthird line that is long", None, ""]
    docs = spark.createDataFrame([(k, t, "en", "a", "http://a.example.com/en/", *(f"{n}{k}" for n in NAMES)) for k, t in enumerate(texts)], ", ".join(["doc_id long", "text string", "lang string", "source string", "url string", *(f"{n} string" for n in NAMES)]))
    frames = {
        "lines": linededup.drop_repeated_lines(spark, docs), "urls": urlfilter.judge_urls(docs, urlfilter.rule_table(spark, [urlfilter.site_rule(*r) for r in urlfilter.SITE_RULES])), "mix": mixing.mixed_documents(spark, docs),
        "sim": simhash.keep_one(spark, docs), "wide": simwide.keep_one(spark, docs), "clean": decontamination.clean_documents(spark, docs, spark.createDataFrame([(1, "not in it")], "item_id long, text string")),
    }
    for name, frame in frames.items():
        rows = frame.collect()
        assert rows, name
        for row in rows:
            values = {v for v in row.asDict().values() if isinstance(v, str)}
            assert {f"{n}{row.doc_id}" for n in NAMES} <= values, (name, {f"{n}{row.doc_id}" for n in NAMES} - values)
    assert {r.doc_id: r["__n_dropped"] for r in frames["lines"].collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    assert {r["__verdict"] for r in frames["urls"].collect()} == {"block"}
    assert quality.judge(spark, docs).count() == 4 and quality.keep_good(spark, docs).columns == docs.columns


def test_words_of_any_length_and_addresses_of_any_depth():
    """Words over 512 characters and addresses of many spelled dots hold spans like any other; parts decode like one stretch."""
    field = pii.default_field()
    show = lambda t: [(k, t[a:b]) for k, a, b in pii.field_spans(field, [t])[0]]
    token = "9fA3kQ7zLm2Xw8Rt5Vb1Nc6YdP0sHj4G"
    assert show("a;" * 400 + f'token="{token}"' + ";b" * 300) == [("secret", token)]
    assert show("mail joe.12 at mail dot cs dot uni dot north dot example dot com now") == [("email", "joe.12 at mail dot cs dot uni dot north dot example dot com")]
    text = " ".join(("12", "at", "dot", "abc", "212-555-0173", "@", "4111 1111")[k * k % 11 % 7] for k in range(4000))
    _, (which,), features = pii.surroundings([(text, 0, len(text))])
    scores = field.scores(features)[which]
    assert len(scores) > 2 * pii.CHUNK and np.array_equal(pii.viterbi(field, [scores])[0], pii.viterbi(field, [scores], whole=True)[0])
    k, rng = len(pii.LABELS), np.random.default_rng(5)
    apart = pii.Field({}, np.zeros((0, k)), np.eye(k) * 1e6, rng.normal(size=k))
    scores = rng.normal(size=(3 * pii.CHUNK, k))
    assert np.array_equal(pii.viterbi(apart, [scores])[0], pii.viterbi(apart, [scores], whole=True)[0])
