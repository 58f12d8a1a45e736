"""Byte-level words and hashes of whole Arrow text columns, without a Python loop over words.

A batch is handled in chunks of whole documents. Words are runs of bytes of a class given as a table of 256 flags, so
UTF-8 letters above ASCII need no decoding. Hashes are polynomial over the bytes (or words) modulo 2**64, read off prefix
sums, then mixed; two unequal strings share one with a chance near 2**-64.

Null texts are taken as empty; empty texts have no words; a document longer than a chunk makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64 bits so that each input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=_U)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def byte_class(drop: bytes) -> np.ndarray:
    """Flags of the bytes that words may hold: all but those given."""
    flags = np.ones(256, dtype=bool)
    flags[list(drop)] = False
    return flags


WHITE = bytes([0x20, *range(0x09, 0x0E)])
NOT_WHITE = byte_class(WHITE)
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))  # after lower-casing A-Z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_KEY = splitmix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2**64, and those of its inverse."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size + 1, b, dtype=_U)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers[base] = (out[0], out[1])
    return _powers[base]


def span_hashes(items: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of items[lo:hi] for every pair of bounds, equal for equal sequences wherever they stand."""
    power, inverse = _power_table(_BASES[seed % 2], len(items) + 1)
    with np.errstate(over="ignore"):
        prefix = np.empty(len(items) + 1, dtype=_U)
        prefix[0] = 0
        np.cumsum(items * power[: len(items)], out=prefix[1:])
        raw = (prefix[hi] - prefix[lo]) * inverse[lo]
        return splitmix(raw + (hi - lo).astype(_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


@dataclass
class Chunk:
    """Some whole documents of a batch: rows first..first+n, their bytes, and the bounds of each."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def lowered(self) -> Chunk:
        return Chunk(self.first, LOWER[self.data], self.bounds)

    def words(self, keep: np.ndarray = NOT_WHITE) -> Words:
        mask = keep[self.data]
        size = len(mask)
        edge = np.zeros(size + 1, dtype=bool)
        edge[self.bounds] = True
        starts = np.flatnonzero(mask & (edge[:size] | ~np.concatenate(([False], mask[:-1]))))
        ends = np.flatnonzero(mask & (edge[1:] | ~np.concatenate((mask[1:], [False])))) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.bounds))


@dataclass
class Words:
    """Word bounds in the bytes of a chunk; those of document d are of[d]:of[d+1]."""

    chunk: Chunk
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.n), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(_BYTE_KEY[self.chunk.data], self.starts, self.ends, seed)

    def window_starts(self, n: int) -> np.ndarray:
        """Word numbers at which n consecutive words of one document begin."""
        last = np.repeat(self.of[1:], self.counts)
        at = np.arange(len(self.starts))
        return at[at + n <= last]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column in runs of whole documents of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    if not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    _, where, body = column.buffers()  # the bytes are not copied
    width = np.int32 if pa.types.is_string(column.type) else np.int64
    offsets = np.frombuffer(where, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield Chunk(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
