"""Vectorised text kernels shared by the operators: words, word hashes, Rabin-Karp hashes of word sequences.

All kernels work on one Arrow block of whole texts at a time; blocks are cut by bytes so that a
worker's memory doesn't depend on the size of a batch (only on its longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

#: Byte classes: white space only, and everything that is no letter, digit or non-ASCII byte.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_WORD = np.ones(256, bool)
NON_WORD[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NON_WORD[_a:_b] = False
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i in 0..n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size + 1, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    p, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * p[: len(values)], dtype=U64, out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The Rabin-Karp hash of each span, independent of where it stands; the length is mixed in."""
    _, inverse = powers(base, len(sums))
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0x9FB21C651E98DF25))


@dataclass
class Words:
    """The words of a block of texts, in order."""

    buf: np.ndarray  # bytes of the texts, end to end
    offsets: np.ndarray  # byte offset of each text, and the end
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return spans_hash(prefix_sums(self.buf.astype(U64) + U64(1), _BYTE_BASE), self.starts, self.ends, _BYTE_BASE)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string array; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at - at[0]


def words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> Words:
    inside = ~separators[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside
    cut = offsets[offsets < len(buf)]
    fresh = inside & ~before[:-1]
    fresh[cut] = inside[cut]
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = inside
    last = inside & ~after[1:]
    ends_at = offsets[offsets > 0] - 1
    last[ends_at] = inside[ends_at]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))


class Grams:
    """Rabin-Karp hashes of word sequences; `which` picks one of two independent bases."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        self.base = _WORD_BASES[which]
        self.sums = prefix_sums(hashes, self.base)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return spans_hash(self.sums, starts, ends, self.base)


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words at which a sequence of k words of one text starts."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + shift


def blocks(texts: pa.Array, limit: int = 1 << 19, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text, and of `rows` rows at most."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    if not len(sizes):
        return
    group = (np.cumsum(sizes + 16) // limit).astype(np.int64)
    edges = np.flatnonzero((np.diff(group) != 0) | (np.arange(1, len(sizes)) % rows == 0)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)
