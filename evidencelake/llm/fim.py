"""Fill-in-the-middle: whole texts cut at unit boundaries into prefix, middle and suffix, and reordered between markers.

A text is taken apart into blocks of bytes that overlap by one character. A predicate on adjacent characters counts the units that
end in each block, for all blocks of a batch; sums of the counts before each block route both cut ranks to the blocks that own
them, and only those are looked at again for the place of the cut. Nothing is shuffled: a text is one cell, so it is cut where
it is read, and documents spread over the tasks of the scan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

BLOCK_BYTES = 1 << 16
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7

#: Whether a unit ends between two adjacent bytes. Classes are of ASCII, so a cut never falls inside a code point.
ENDS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda left, right: left == 10,
    "word": lambda left, right: ~tokens.NOT_WHITE[left] & tokens.NOT_WHITE[right],
    "character": lambda left, right: (right & 0xC0) != 0x80,
}


def unit_ends(data: np.ndarray, lo: int, hi: int, end: int, ends: Callable) -> np.ndarray:
    """Flags of the bytes lo..hi of a document that are the last of a unit; the document's last byte always is."""
    flags = np.empty(hi - lo, dtype=bool)
    last = min(hi, end - 1)  # the byte after the block is looked at too, unless the document ends
    flags[: last - lo] = ends(data[lo:last], data[lo + 1 : last + 1])
    flags[last - lo :] = True
    return flags


def block_counts(chunk: tokens.Chunk, ends: Callable, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of every block, units that end before it in the chunk, and the number of the first block of each document."""
    size = np.diff(chunk.bounds)
    blocks = -(-size // block)
    first = np.concatenate(([0], np.cumsum(blocks)))
    doc = np.repeat(np.arange(chunk.n), blocks)
    begin = chunk.bounds[doc] + block * (np.arange(first[-1]) - first[doc])
    counts = [np.count_nonzero(unit_ends(chunk.data, b, min(b + block, e), e, ends)) for b, e in zip(begin.tolist(), chunk.bounds[doc + 1].tolist(), strict=True)]
    return begin, np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), first


def cut_places(chunk: tokens.Chunk, draws: list[np.ndarray], ends: Callable, block: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Units of every document, and the bytes of the chunk at which the unit of rank ``draw % (units + 1)`` ends, a draw each."""
    begin, before, first = block_counts(chunk, ends, block)
    n = before[first[1:]] - before[first[:-1]]
    places = []
    for draw in draws:
        rank = draw % (n + 1)
        place = chunk.bounds[:-1].copy()
        some = np.flatnonzero(rank)
        owner = np.searchsorted(before, before[first[some]] + rank[some]) - 1
        for d, k in zip(some.tolist(), owner.tolist(), strict=True):
            end = int(chunk.bounds[d + 1])
            flags = unit_ends(chunk.data, int(begin[k]), min(int(begin[k]) + block, end), end, ends)
            place[d] = begin[k] + np.flatnonzero(flags)[before[first[d]] + rank[d] - before[k] - 1] + 1
        places.append(place)
    return n, places


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2**32 from the SHA-256 of seed and id; a null id is the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def check_markers(markers: tuple[str, str, str]) -> None:
    """Texts without a marker must not form one where they meet markers: each has its first character in first place alone."""
    heads = {m[:1] for m in markers}
    if len(set(markers)) != 3 or "" in heads or any(h in m[1:] for h in heads for m in markers) or any(a != b and a.startswith(b) for a in markers for b in markers):
        raise ValueError("markers must be different, none the beginning of another, and hold their first characters in first place only")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", fim_percent: int = 100, spm_percent: int = 50, seed: int = SEED, markers: tuple[str, str, str] = MARKERS, block: int = BLOCK_BYTES) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row.

    n is the number of units (``line``: up to and with a newline; ``word``: with the white space after it, and any that the
    text begins with as one more; ``character``: a code point); what follows the last
    boundary is a unit too. Two draws by seed and id say after how many units prefix and
    middle end. Form is ``psm`` (markers[0] prefix markers[1] suffix markers[2] middle), ``spm`` (markers[1] suffix markers[0]
    prefix markers[2] middle), or ``plain``: the text as it is, for empty and null texts (taken as empty), texts that hold a
    marker, and the share of ids beyond ``fim_percent``; its chars are null. Rows that repeat an id have the same draws, a null
    id those of the empty string. An empty table gives an empty one; other columns are not read.
    """
    check_markers(markers)
    text, (h1, h2, h3, h4) = F.coalesce(F.col(text_col), F.lit("")), draws(F.col(id_col), seed)
    plain = (text == "") | (h3 % 100 >= fim_percent)
    for m in markers:
        plain = plain | F.contains(text, F.lit(m))
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    source = docs.select(F.col(id_col).alias("id"), form.alias("form"), h1.alias("h1"), h2.alias("h2"), text.alias("text"))
    ends, (p, s, m) = ENDS[unit], (x.encode() for x in markers)

    def run(batches):
        for batch in batches:
            for c in tokens.chunks(batch.column(4)):
                part = batch.slice(c.first, c.n)
                h = [part.column(k).to_numpy() for k in (2, 3)]
                n, places = cut_places(c, h, ends, block)
                low, high = np.minimum(*places).tolist(), np.maximum(*places).tolist()
                lead = lambda a, b: int(np.count_nonzero((c.data[a:b] & 0xC0) != 0x80))  # noqa: E731, B023
                sizes, output, bounds = [], [], c.bounds.tolist()
                for d, form in enumerate(part.column(1).to_pylist()):
                    a, x, y, b = bounds[d], low[d], high[d], bounds[d + 1]
                    prefix, middle, suffix = c.data[a:x].tobytes(), c.data[x:y].tobytes(), c.data[y:b].tobytes()
                    output.append({"plain": (prefix, middle, suffix), "psm": (p, prefix, s, suffix, m, middle), "spm": (s, suffix, p, prefix, m, middle)}[form])
                    sizes.append((None, None) if form == "plain" else (lead(a, x), lead(x, y)))
                cells = [pa.array(n.astype(np.int64)), part.column(1), pa.array([z[0] for z in sizes], pa.int64()), pa.array([z[1] for z in sizes], pa.int64()), pa.array([b"".join(o) for o in output], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cells], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    longs = [T.StructField(x, T.LongType()) for x in ("prefix_chars", "middle_chars")]
    return source.mapInArrow(run, T.StructType([source.schema["id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), *longs, T.StructField("output", T.StringType())]))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text again, from output and form alone."""
    check_markers(markers)
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in markers), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
