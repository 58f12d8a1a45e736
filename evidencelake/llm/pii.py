"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The patterns find e-mail and IP addresses, card and international telephone numbers in their plain forms. The field is trained
by gradient ascent on a small labelled table (below: sentences about invented people, with the same data as it stands in prose
and written otherwise, secrets such as access tokens, and look-alikes that are none). It reads a text as tokens (digit runs,
letter runs, long runs of both, single other characters) whose features are their shapes and those of their neighbours, and
decodes by Viterbi in numpy, many stretches at a time. A stretch is all words within REACH of one that has a digit, an at sign
or ``at`` for a word: what the field marks has one of these, else ``plausible`` rejects it. A dot that stands alone or is spelled
carries a stretch on, so addresses may have any number of them. Words of any length are read. Equal
surroundings are scored once; stretches over twice CHUNK tokens are decoded in parts side by side, each from WARM tokens before
it, and as one where the parts do not meet in the same scores. All work is linear in the length of a text.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The last has no pattern: the field alone finds it.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Fixed patterns of the base, as the contract gives them; an address is put together from its two sides.
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
REACH, CHUNK, WARM = 6, 2048, 128
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in ("B", "I")))
BEGINS, INSIDE = ([k for k, label in enumerate(LABELS) if label[0] == x] for x in "BI")
#: Shapes that the look-alike check below accepts as the digits of a kind.
DIGITS = {"card": (13, 19), "phone": (9, 15)}
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; those that fail their check are dropped and not tried shorter."""
    out: list[Span] = []
    floor = at = 0
    while (at := text.find("@", at)) >= 0:
        lo = at
        while lo > floor and text[lo - 1] in LOCAL:
            lo -= 1
        host = HOST.match(text, at + 1) if lo < at else None
        if host:
            out.append(("email", lo, host.end()))
            floor = host.end()
        at = max(at + 1, floor)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


#: Tokens, and in the last place the blanks between them, so that nothing of a text is left out.
TOKEN = re.compile(r"[A-Za-z0-9]{20,}|[0-9]+|[^\W\d_]+|[^\s]|\n|[^\S\n]+", re.UNICODE)
#: Words that stand in addresses and before numbers; other words have only their shape.
CUES = ("at", "dot", "com", "net", "org", "example", "mail", "phone", "tel", "call", "fax", "mobile", "card", "visa", "ip", "host", "version", "section", "page", "order", "token", "key", "secret", "password", "api")


def token_shape(t: str) -> str:
    if t.isdigit():
        return f"d{min(len(t), 6)}" + ("-byte" if len(t) <= 3 and t.isascii() and int(t) <= 255 else "") + ("-card" if 13 <= len(t) <= 19 and t.isascii() and luhn(t) else "")
    if len(t) >= 20 and t.isalnum() and not t.isalpha():
        return "x" + ("-hex" if not set(t) - set("0123456789abcdefABCDEF") else "")
    if t.isalpha():
        return "w:" + t.lower() if t.lower() in CUES else ("W" if t[0].isupper() else "w") + str(min(len(t), 4))
    return t if t.isascii() else "?"


def surroundings(parts: list[tuple[str, int, int]]) -> tuple[list[np.ndarray], list[np.ndarray], list[list[str]]]:
    """For parts (text, lo, hi) of texts: bounds of the tokens, numbers of their surroundings, and the features of each number.

    Surroundings are the shapes of three tokens on either side and whether the token touches its neighbours. There are under 128
    shapes, so that a number of 64 bits holds them.
    """
    number = {"|": 0}  # beyond the ends

    class Numbers(dict):
        def __missing__(self, t: str) -> int:
            return self.setdefault(t, -1 if t != "\n" and t.isspace() else number.setdefault(token_shape(t), len(number)))

    seen = Numbers()
    none, gap = np.full((3, 2), (-1, -2)), np.zeros(3, dtype=np.int64)
    edges, shape, sizes = [none], [gap], []
    for text, lo, hi in parts:
        found = TOKEN.findall(text, lo, hi)
        kind = np.fromiter(map(seen.__getitem__, found), dtype=np.int64, count=len(found))
        ends = lo + np.fromiter(map(len, found), dtype=np.int64, count=len(found)).cumsum()
        token = kind >= 0
        edges += [np.stack([np.append(lo, ends[:-1]), ends], axis=1)[token] if found else none[:0], none]
        shape += [kind[token], gap]
        sizes.append(int(token.sum()))
    edges, shape = np.concatenate(edges), np.concatenate(shape)
    real = edges[:, 0] >= 0
    touch = np.zeros(len(shape) + 1, dtype=np.int64)
    touch[1:-1] = (edges[:-1, 1] == edges[1:, 0]) & real[:-1] & real[1:]
    at = np.flatnonzero(real)
    code = touch[at] * 2 + touch[at + 1]
    for d in range(-3, 4):
        code = code * len(number) + shape[at + d]
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    names, features = list(number), []
    for k in at[first].tolist():
        a, b, c, s, d, e, f = (names[i] for i in shape[k - 3 : k + 4])
        before, after = int(touch[k]), int(touch[k + 1])
        join = f"g{before}{after}"
        features.append([f"0{s}", f"0{s}{join}", join, f"-3{a}", f"-2{b}", f"-1{c}", f"1{d}", f"2{e}", f"3{f}", f"p-1{c}{s}{before}", f"n{s}1{d}{after}", f"c-1{c}{s}1{d}"])
    cuts = np.cumsum(sizes)[:-1]
    return np.split(edges[at], cuts), np.split(which, cuts), features


@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""

    names: dict[str, int]
    emit: np.ndarray  # feature x label
    move: np.ndarray  # label x label
    begin: np.ndarray

    def scores(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), len(LABELS)))
        for k, fs in enumerate(features):
            out[k] = self.emit[[i for i in map(self.names.get, fs) if i is not None]].sum(axis=0)
        return out


def viterbi(field: Field, scores: list[np.ndarray], whole: bool = False) -> list[np.ndarray]:
    """Best labels of many stretches, one step of all that are long enough at a time.

    Long ones are decoded in parts, unless ``whole``: each part begins WARM tokens early from scores that say nothing; once all
    paths into it are one, its scores are those of the part before but for a constant, which is checked. A stretch whose parts
    differ there is decoded as one.
    """
    parts = []  # (stretch, first token read, first of its own, end)
    for k, s in enumerate(scores):
        step = len(s) if whole or len(s) <= 2 * CHUNK else CHUNK
        parts += [(k, max(0, a - WARM), a, min(len(s), a + step)) for a in range(0, len(s), step)]
    parts.sort(key=lambda p: p[1] - p[3])
    length = np.array([end - lo for _, lo, _, end in parts])
    offset = np.cumsum(length) - length
    known: dict[tuple[bool, bytes], int] = {}  # equal parts share a row of the first pass
    row = np.array([known.setdefault((a > 0, hashlib.blake2b(scores[k][lo:end].tobytes(), digest_size=16).digest()), len(known)) for k, lo, a, end in parts])
    firsts = np.unique(row, return_index=True)[1]
    span = length[firsts]
    flat, begin = np.concatenate([scores[parts[i][0]][parts[i][1] : parts[i][3]] for i in firsts]), np.cumsum(span) - span
    best = np.stack([np.zeros(len(LABELS)) if parts[i][2] else field.begin for i in firsts]) + flat[begin]
    back = [np.zeros((0, len(LABELS)), dtype=np.int8)]
    warm, final = np.zeros_like(best), np.zeros_like(best)
    for t in range(1, int(span[0]) + 1):
        if t == WARM:
            warm[: len(best)] = best
        n = int(np.searchsorted(-span, -t, side="left"))  # those longer than t
        final[n : len(best)] = best[n:]
        best = best[:n]
        if not n:
            break
        through = best[:, :, None] + field.move[None]
        origin = through.argmax(axis=1)
        back.append(origin.astype(np.int8))
        best = np.take_along_axis(through, origin[:, None, :], axis=1)[:, 0] + flat[begin[:n] + t]
    labels, apart = final.argmax(axis=1)[row], set()
    later = sorted((i for i in range(len(parts)) if parts[i][2]), key=lambda i: parts[i], reverse=True)
    if later:
        entry = np.tile(np.arange(len(LABELS)), (len(firsts), 1))  # label before a part's own tokens, by its last label
        for t in range(len(back) - 1, WARM - 1, -1):
            entry[: len(back[t])] = np.take_along_axis(back[t], entry[: len(back[t])], axis=1)
        ending = {(k, end): i for i, (k, _, _, end) in enumerate(parts)}
        level = lambda x: x - x.max()
        for i in later:
            k, _, a, _ = parts[i]
            before = ending[k, a]
            labels[before] = entry[row[i], labels[i]]
            if not np.allclose(level(warm[row[i]]), level(final[row[before]]), rtol=0, atol=1e-7):
                apart.add(k)
    path = np.zeros(int(length.sum()), dtype=np.int64)
    path[offset + length - 1] = labels
    for t in range(len(back) - 1, 0, -1):
        n = int(np.searchsorted(-length, -t, side="left"))
        labels[:n] = back[t][row[:n], labels[:n]]
        path[offset[:n] + t - 1] = labels[:n]
    out = [np.zeros(len(s), dtype=np.int64) for s in scores]
    for i, (k, lo, a, end) in enumerate(parts):
        out[k][a:end] = path[offset[i] + a - lo : offset[i] + end - lo]
    if apart:
        for k, found in zip(sorted(apart), viterbi(field, [scores[k] for k in sorted(apart)], whole=True), strict=True):
            out[k] = found
    return out


def _forward_backward(field: Field, s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partition, label marginals and summed pair marginals of one stretch."""
    n = len(s)
    a, b = np.zeros_like(s), np.zeros_like(s)
    a[0] = field.begin + s[0]
    for t in range(1, n):
        x = a[t - 1][:, None] + field.move
        m = x.max(axis=0)
        a[t] = m + np.log(np.exp(x - m).sum(axis=0)) + s[t]
    for t in range(n - 2, -1, -1):
        x = field.move + s[t + 1] + b[t + 1]
        m = x.max(axis=1)
        b[t] = m + np.log(np.exp(x - m[:, None]).sum(axis=1))
    m = a[-1].max()
    z = m + np.log(np.exp(a[-1] - m).sum())
    pairs = np.zeros_like(field.move)
    for t in range(1, n):
        pairs += np.exp(a[t - 1][:, None] + field.move + s[t] + b[t] - z)
    return z, np.exp(a + b - z), pairs


def labelled_table(n: int = 900, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Sentences and their spans, drawn from a seed: data in forms that the patterns miss, and look-alikes without any."""
    r = random.Random(seed)
    syllables = ("ha", "ti", "on", "er", "the", "es", "ka", "lo", "mi", "ren", "st", "ou", "ein", "ción", "eau", "ver")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    end = lambda: r.choice(("com", "net", "org"))
    host = lambda sep: sep.join(r.choice((("mail" + digits(1), "example", end()), ("example", end()), (word(), end()))))
    some = lambda letters, low, high: "".join(r.choice(letters) for _ in range(r.randint(low, high)))
    at, dot = (lambda: r.choice((" at ", " AT ", " [at] ", " (at) ", " [AT] ", " [ at ] ")), lambda: r.choice((" dot ", " DOT ", " [dot] ", " (dot) ")))
    kinds = (lambda: f"{word()}.{word()}", lambda: word() + digits(2), lambda: f"{word()}.{digits(2)}", word, lambda: f"{word()} {word()}")
    hexed, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card(sep: str) -> str:
        body = digits(15)
        full = next(body + str(k) for k in range(10) if luhn(body + str(k)))
        return sep.join(full[k : k + 4] for k in range(0, 16, 4))

    def item() -> tuple[str, str | None]:
        return r.choice((
            lambda: (f"{r.choice(kinds[:4])()}{at()}{host(dot())}", "email"), lambda: (f"{r.choice(kinds[:4])()}{at()}{host('.')}", "email"), lambda: (f"{r.choice(kinds[:4])()}{at()}{host(' . ')}", "email"), lambda: (f"{word()}.{digits(2)}@{host('.')}", "email"),
            lambda: (".".join(str(r.randint(0, 255)) for _ in range(4)), "ip"), lambda: (card(r.choice(("", " ", "-"))), "card"), lambda: (f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", "phone"),
            lambda: (some(hexed, 32, 40), "secret-token"), lambda: (some(mixed, 20, 48), "secret-key"), lambda: (some(mixed, 20, 40), "secret-password"), lambda: ("sk_" + some(mixed, 24, 32), "secret-api_key"),
            lambda: (some(hexed, 40, 40), None), lambda: (f"{word()} at {word()}. {word()}", None), lambda: (f"{word()} at {word()}", None), lambda: (f"{word()} at {word()}. {word().capitalize()}, {word()}", None), lambda: (f"{word()}, at {word()} {word()}.", None),
            lambda: (f"{word()}.{digits(2)} at {host(' dot ')}", "email"), lambda: (f"{word()}{digits(2)} [at] {host('.')}", "email"), lambda: (f"{word()}.{word()} (at) {host(' dot ')}", "email"), lambda: (f"{word()} @ {host('.')}", "email"),
            lambda: ("[.]".join(str(r.randint(0, 255)) for _ in range(4)), "ip"), lambda: (" . ".join(str(r.randint(0, 255)) for _ in range(4)), "ip"),
            lambda: (card(r.choice((".", "/", "_"))), "card"), lambda: (f"({digits(3)}) {digits(3)}-{digits(4)}", "phone"), lambda: (f"{digits(3)}-{digits(3)}-{digits(4)}", "phone"), lambda: (f"{digits(3)}.{digits(3)}.{digits(4)}", "phone"), lambda: (f"00{digits(2)} {digits(3)} {digits(4)} {digits(3)}", "phone"),
            lambda: (digits(16), None), lambda: (f"Version {digits(1)}.{digits(1)}", None), lambda: (f"{r.randint(1900, 2030)}", None), lambda: (f"{digits(1)}.{digits(2)}.{digits(1)}", None), lambda: (f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}", None), lambda: (f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", None),
            lambda: (f"page {digits(2)} at {word()}", None), lambda: (f"{digits(3)} {digits(2)}", None), lambda: (f"{word()} at {word()} dot", None), lambda: (f"{digits(2)},{digits(3)}.{digits(2)}", None), lambda: (f"{digits(2)}:{digits(2)}", None), lambda: (f"{digits(4)}-{digits(4)}", None), lambda: (" ".join(digits(r.randint(1, 4)) for _ in range(4)), None), lambda: (f"{digits(1)}{word()}@{word()}", None), lambda: ("| " + " | ".join(digits(3) for _ in range(3)), None), lambda: (f"{digits(40)}", None),
        ))()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(0, 5))) + r.choice((" ", ", ", ".\n", " | ", " "))
            got, kind = item()
            close = ""
            if kind and kind.startswith("secret-"):
                kind, _, name = kind.partition("-")
                lead, close = r.choice((('{} = "', '"'), ("{}: ", ""), ("{}=", ""), ("{} = '", "'"), ('"{}": "', '"')))
                text += lead.format(name.upper() if r.random() < 0.2 else name)
            if kind:
                spans.append((kind, len(text), len(text) + len(got)))
            text += got + close + r.choice((" ", ". ", ", ", " | ", "\n"))
        out.append((text, spans))
    return out


def train(table: list[tuple[str, list[Span]]], passes: int = 12, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> Field:
    """Stochastic gradient ascent on the log likelihood, over the given sentences and no others."""
    data, names = [], {}
    for text, spans in table:
        (bounds,), (which,), features = surroundings([(text, 0, len(text))])
        if not len(bounds):
            continue
        gold = np.zeros(len(bounds), dtype=np.int64)
        for kind, a, b in spans:
            inside = [k for k, (x, y) in enumerate(bounds) if x >= a and y <= b]
            gold[inside] = LABELS.index(f"I-{kind}")
            gold[inside[:1]] = LABELS.index(f"B-{kind}")
        data.append(([[names.setdefault(f, len(names)) for f in features[i]] for i in which], gold))
    n = len(LABELS)
    field = Field(names, np.zeros((len(names), n)), np.zeros((n, n)), np.zeros(n))
    for to, label in enumerate(LABELS):
        if label[0] == "I":  # a span goes on only where it began
            for origin in range(n):
                if LABELS[origin][2:] != label[2:]:
                    field.move[origin, to] = -50.0
            field.begin[to] = -50.0
    free = field.move > -50
    rng = np.random.default_rng(seed)
    for turn in range(passes):
        step = rate / (1 + turn)
        for k in rng.permutation(len(data)):
            features, gold = data[k]
            s = np.stack([field.emit[fs].sum(axis=0) for fs in features])
            _, marginal, pairs = _forward_backward(field, s)
            d = -marginal
            d[np.arange(len(gold)), gold] += 1
            for fs, x in zip(features, d, strict=True):
                field.emit[fs] += step * x
            np.add.at(pairs := -pairs, (gold[:-1], gold[1:]), 1)
            field.move += np.where(free, step * pairs, 0)
        field.emit *= 1 - decay
    return field


@functools.cache
def default_field() -> Field:
    """The field of the labelled table as it is; trained once a driver."""
    return train(labelled_table())


MARK = re.compile(r"[0-9@]|(?<![^\W_])[Aa][Tt](?![^\W_])")
WORD = re.compile(r"\S+")


DOT = re.compile(r"(?i)[\[(]*(\.|dot)[\])]*")


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text that the field decodes: words within REACH of a marked one, or of a dot that goes on from it."""
    words = [m.span() for m in WORD.finditer(text)]
    out: list[tuple[int, int]] = []
    lo = hi = -1
    for k, (a, b) in enumerate(words):
        if MARK.search(text, a, b):
            if lo >= 0 and k - REACH > hi + 1:
                out.append((words[lo][0], words[hi][1]))
                lo = -1
            lo = max(0, k - REACH) if lo < 0 else lo
        elif lo < 0 or k > hi or not DOT.fullmatch(text, a, b):
            continue
        hi = min(len(words) - 1, k + REACH)
    if lo >= 0:
        out.append((words[lo][0], words[hi][1]))
    return out


#: An address as it may be spelled: dots stand close or with a blank on either side, not as at the end of a sentence.
#: A match from within a run of its letters is one from the run's start too, so only starts of runs are tried.
SPELLED = re.compile(r"(?i)(?<![\w.%+-])[\w.%+-]*\w\s?(@|[\[(]\s?at\s?[\])]|(?<=\s)at(?=\s))\s?[\w-]+((\.|\s\.\s|[\s\[(]+dot[\s\])]+)[\w-]+)+")


def trimmed(kind: str, found: str) -> tuple[int, int]:
    """The part of what the field marks that can be of its kind: an address without words of prose around it."""
    inner = SPELLED.search(found) if kind == "email" else None
    return inner.span() if inner else (0, len(found))


def plausible(kind: str, found: str) -> bool:
    """The checks of the base, on what the field marks."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(map(_byte, parts))
    if kind == "email":
        return bool(SPELLED.fullmatch(found))
    if kind == "secret":
        return len(found) >= 16 and bool(digits) and not re.search(r"\s", found)
    low, high = DIGITS[kind]
    return low <= len(digits) <= high and (kind != "card" or luhn(digits))


def field_spans(field: Field, texts: list[str]) -> list[list[Span]]:
    """What the field marks in each text."""
    places = [(k, lo, hi) for k, text in enumerate(texts) for lo, hi in stretches(text)]
    bounds, which, features = surroundings([(texts[k], lo, hi) for k, lo, hi in places])
    out: list[list[Span]] = [[] for _ in texts]
    if not features:
        return out
    table = field.scores(features)
    held = [i for i, x in enumerate(which) if len(x)]
    for i, path in zip(held, viterbi(field, [table[which[i]] for i in held]), strict=True):
        k, edges = places[i][0], bounds[i]
        goes_on = np.append(np.isin(path[1:], INSIDE) & (path[1:] == np.where(np.isin(path[:-1], INSIDE), path[:-1], path[:-1] + 1)), False)
        ends = np.flatnonzero(~goes_on)
        for at in np.flatnonzero(np.isin(path, BEGINS)).tolist():
            kind = LABELS[path[at]][2:]
            lo, hi = int(edges[at, 0]), int(edges[ends[np.searchsorted(ends, at)], 1])
            a, b = trimmed(kind, texts[k][lo:hi])
            if plausible(kind, texts[k][lo + a : lo + b]):
                out[k].append((kind, lo + a, lo + b))
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(id, base, spans) for every row: the spans of the patterns, and all spans; in code points, by kind and place.

    Spans of the field that overlap one of the patterns are left out. Null and empty texts have none. Repeated rows are handled
    one by one; an empty table gives an empty one; other columns are not read. A text without a digit, an at sign or the letters
    ``at`` is passed over.
    """
    held = docs.sparkSession.sparkContext.broadcast(field or default_field())
    def key(s: Span) -> tuple[int, int, int]:
        return KINDS.index(s[0]), s[1], s[2]

    def run(batches):
        field = held.value
        for batch in batches:
            text = batch.column(1)
            some = np.flatnonzero(pc.fill_null(pc.match_substring_regex(text, "[0-9@]|[Aa][Tt]"), False).to_numpy(zero_copy_only=False)).tolist()
            texts = [text[k].as_py() for k in some]
            base, whole = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for k, found, more in zip(some, map(base_spans, texts), field_spans(field, texts), strict=True):
                more = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in found)]
                base[k], whole[k] = sorted(found, key=key), sorted(found + more, key=key)
            columns = [pa.array([[{"kind": s[0], "start": s[1], "end": s[2]} for s in x] for x in spans], type=_SPAN) for spans in (base, whole)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "base", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, T.StructType([source.schema["id"], T.StructField("base", _SPAN_TYPE), T.StructField("spans", _SPAN_TYPE)]))
