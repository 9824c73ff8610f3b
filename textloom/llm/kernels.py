"""Vectorised text kernels shared by the training-data operators.

Everything here works on one Arrow batch at a time: the texts are laid out as one
array of code points, words are found with boolean masks, and every word gets a
64-bit hash from prefix sums, so no Python loop runs over characters or words.
Sums are taken modulo 2**64 and modulo the prime 2**31 - 1: the first alone has texts of equal
hash that can be written down (Thue-Morse words), both together have none that are known.

A *word* is a maximal run of alphanumeric code points; its hash is taken over the
simple lower-case form. Null texts count as empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points laid out at once; one longer document is laid out alone.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_PRIME, _BASE_P = (1 << 31) - 1, 0x4B1D_36E7


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the basic plane: is a word character, lower-case form, random 64-bit value of that form."""
    chars = [chr(i) for i in range(0x10000)]
    word = np.fromiter((c.isalnum() for c in chars), bool, len(chars))
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, len(chars))
    return word, lower, _value(np.arange(0x10000))[lower]


def _value(cp: np.ndarray) -> np.ndarray:
    return mix(cp.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _sized(n: int) -> int:
    size = STEP
    while size < n:
        size *= 2
    return size


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_sized(n))


@functools.lru_cache(maxsize=2)
def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the other base and of its inverse, modulo the prime."""
    out = []
    for b in (_BASE_P, pow(_BASE_P, -1, _PRIME)):
        p = np.ones(n + 1, np.uint64)
        k = 1
        while k <= n:
            part = p[k : 2 * k]
            part[:] = p[: len(part)] * np.uint64(pow(b, k, _PRIME)) % np.uint64(_PRIME)
            k *= 2
        out.append(p)
    return out[0], out[1]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and the len+1 offsets of the texts in it."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = np.zeros(len(texts) + 1, np.int64)
    if len(texts):
        np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=at[1:])
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint32), at
    off = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2])[int(off[0]) : int(off[-1])]
    return np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32), at


def slices(texts: pa.Array, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of about step bytes of text each; a longer text is a range of its own."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right"))
        b = max(b, a + 1)
        yield a, b
        a = b


def is_word(cp: np.ndarray) -> np.ndarray:
    word = _tables()[0]
    if not len(cp) or cp.max() < 0x10000:
        return word[cp]
    out = word[np.minimum(cp, 0xFFFF)]
    far = np.flatnonzero(cp >= 0x10000)
    kinds, inverse = np.unique(cp[far], return_inverse=True)
    out[far] = np.fromiter((chr(k).isalnum() for k in kinds.tolist()), bool, len(kinds))[inverse]
    return out


def lowered(cp: np.ndarray) -> np.ndarray:
    """Simple lower-case form of each code point."""
    lower = _tables()[1]
    if not len(cp) or cp.max() < 0x10000:
        return lower[cp]
    out = lower[np.minimum(cp, 0xFFFF)]
    far = np.flatnonzero(cp >= 0x10000)
    kinds, inverse = np.unique(cp[far], return_inverse=True)
    out[far] = np.fromiter((ord(x) if len(x := chr(k).lower()) == 1 else k for k in kinds.tolist()), np.uint32, len(kinds))[inverse]
    return out


def values(cp: np.ndarray, fold: bool = True) -> np.ndarray:
    """Random 64-bit value of each code point, of its lower-case form if fold."""
    if not fold:
        return _value(cp)
    if not len(cp) or cp.max() < 0x10000:
        return _tables()[2][cp]
    return _value(lowered(cp))


class Prefix(NamedTuple):
    """Prefix sums from which the hash of any stretch is taken."""

    wide: np.ndarray  # modulo 2**64
    prime: np.ndarray  # sums of terms modulo the prime


def prefix(vals: np.ndarray) -> Prefix:
    n = len(vals)
    h, g = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(vals * powers(n)[0][:n], out=h[1:])
    term = (vals >> np.uint64(33)) * _prime_powers(_sized(n))[0][:n]
    # below 2**32 each, so that the sum of 2**32 of them fits
    np.cumsum((term & np.uint64(_PRIME)) + (term >> np.uint64(31)), out=g[1:])
    return Prefix(h, g)


def span_check(h: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """31 bits of the values in [start, end), independent of the sums modulo 2**64."""
    p = np.uint64(_PRIME)
    return ((h.prime[end] - h.prime[start]) % p * _prime_powers(_sized(len(h.prime)))[1][start] % p).astype(np.uint32)


def span_hash(h: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end); equal stretches have equal hashes wherever they stand."""
    return mix((h.wide[end] - h.wide[start]) * powers(len(h.wide))[1][start] + span_check(h, start, end).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


class Words(NamedTuple):
    """Words of a run of texts; places are in code points from the first text's start."""

    cp: np.ndarray  # all code points
    at: np.ndarray  # where each text starts, and the end
    row: np.ndarray  # each word's text
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray  # words of text r are offsets[r]:offsets[r + 1]


def words(texts: pa.Array) -> Words:
    cp, at = code_points(texts)
    w = is_word(cp)
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(cp))]
    first[inner] |= w[inner]
    last[inner - 1] |= w[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hash(prefix(values(cp)), s, e)
    offsets = np.searchsorted(s, at)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    return Words(cp, at, row, s, e, hashes, offsets)


def grams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, offsets by row) of all runs of n words; a row with 1 to n-1 words has one gram of all of them."""
    counts = np.diff(offsets)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    many = np.maximum(np.where(counts > 0, 1, 0), counts - n + 1)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(many, out=out[1:])
    row = np.repeat(np.arange(len(counts)), many)
    start = offsets[:-1][row] + (np.arange(out[-1]) - out[:-1][row])
    g = np.zeros(len(start), np.uint64)
    for k in range(n):
        at = start + k
        inside = at < offsets[1:][row]
        g = np.where(inside, mix(g * np.uint64(31) + hashes[np.minimum(at, len(hashes) - 1)] + np.uint64(k + 1)), g)
    return g, out


class Lines(NamedTuple):
    """Lines of a run of texts, newlines left out; places are in code points from the first text's start. A text's last line may be missing if it is empty."""

    row: np.ndarray
    number: np.ndarray  # in the text, from 0
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of what is left when white space at the ends is dropped
    last: np.ndarray


@functools.cache
def _spaces() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x10000)), bool, 0x10000)


def lines(cp: np.ndarray, at: np.ndarray) -> Lines:
    newline = np.flatnonzero(cp == 10)
    start = np.union1d(at[:-1], newline + 1)
    start = start[start < len(cp)].astype(np.int64)
    row = np.searchsorted(at, start, "right") - 1
    ends = np.append(newline, len(cp))
    end = np.minimum(ends[np.searchsorted(newline, start)], at[1:][row])
    number = np.arange(len(start)) - np.searchsorted(start, at[:-1])[row]
    solid = np.flatnonzero(~_spaces()[np.minimum(cp, 0xFFFF)])
    if not len(solid):
        return Lines(row, number, start, end, start, start)
    first = solid[np.minimum(np.searchsorted(solid, start), len(solid) - 1)]
    last = solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] + 1
    blank = (first >= end) | (first < start) | (last <= start)
    return Lines(row, number, start, end, np.where(blank, start, first), np.where(blank, start, last))
