"""Plain versions of the training-data contracts, and documents with planted cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def documents(seed: int = 1, n: int = 80) -> list[tuple]:
    """(doc_id, text, lang, source): prose, exact and near copies, shared lines and passages, nulls, empty and long texts, repeated
    rows, and a row without id."""
    r = random.Random(seed)
    vocabulary = [r.choice("abcdefgh") + r.choice(["an", "el", "ió", "ßt", "ou"]) + r.choice(["", "ra", "Ti", "s."]) for _ in range(60)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    line, passage = "a line that many Documents share", prose(70)
    out: list[tuple] = []
    for i in range(n):
        text = prose(r.randint(1, 160))
        kind = i % 10
        if kind == 1 and out:
            text = out[r.randrange(len(out))][1] or ""
        elif kind == 2:
            text = f"{prose(20)}\n{line}\n{prose(5)}\n  {line.upper()} \n\n{line}"
        elif kind == 3:
            text = f"{prose(9)} {passage} {prose(30)}"
        elif kind == 4 and i > 10:
            words = (out[i - 1][1] or "").split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        out.append((i * 3 % 1000, text, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])))
    out += [(901, None, "en", "a"), (902, "", None, None), (903, " \t\n ", "en", "b"), (904, "one", "en", "c"), (905, "one two", "de", "c"), (906, prose(20_000), "en", "a"), (907, "same " * 400, "en", "a")]
    out += [out[5], out[5], (None, out[6][1], "en", "b"), (None, "nobody's text " + prose(60), "en", None)]
    return out


def component_ids(rows: list[tuple]) -> dict[int, tuple[str, int]]:
    """For rows with ids of their own: fingerprint and least id reachable, by id; quadratic."""
    fps = {}
    for i, text in {(i, t) for i, t, *_ in rows}:
        words = lowered(text or "").encode().split()
        parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        fps[(i, text)] = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    nodes = sorted(set(fps.values()))
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if (a ^ b).bit_count() <= 3 and find(a) != find(b):
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {key: (f"{f:016x}", least.get(find(f))) for key, f in fps.items()}


def line_dedup(rows: list[tuple], last: int = 2**63 - 1) -> dict:
    owner: dict[str, set] = defaultdict(set)
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)].add(last if i is None else i)
    out = {}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(owner[key(x)]) == (last if i is None else i)]
        out[(i, text)] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def passages(rows: list[tuple], window: int = 50, last: int = 2**63 - 1) -> dict:
    first: dict[tuple, int] = {}
    split = {(i, t): (t or "").encode().split() for i, t, *_ in rows}
    for (i, _), w in split.items():
        for k in range(len(w) - window + 1):
            seen = tuple(w[k : k + window])
            first[seen] = min(last if i is None else i, first.get(seen, last))
    out = {}
    for (i, t), w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (last if i is None else i):
                gone.update(range(k, k + window))
        out[(i, t)] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def benchmark_hits(rows: list[tuple], items: list[tuple]) -> dict:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    index = defaultdict(set)
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            index[tuple(w[k : k + n])].add(i)
    out = {}
    for i, text, *_ in rows:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in index}:
            for k in range(len(w) - n + 1):
                if found := index.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= {str(x) for x in found if x is not None}
        out[(i, text)] = (len(w), len(hit), sorted(names))
    return out


def text_counts(text: str | None) -> tuple:
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
