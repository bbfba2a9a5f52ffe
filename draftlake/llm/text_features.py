"""Hashed tokens of whole texts, a slice of a batch at a time, in numpy.

A token is a run of letters (and of any non-ASCII bytes), of digits, or of other signs. Its hash is a
polynomial in its lower-cased bytes modulo 2**64, finished with a multiply-shift.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACE, LETTER, DIGIT, SIGN = range(4)
CHUNK = 1 << 20  # bytes that are hashed at once
BASE, MIX, STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))

_KIND = np.full(256, SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = LETTER
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(1 << 12, BASE, np.uint64))


@dataclass
class Tokens:
    doc: np.ndarray  # place of the text, ascending
    hash: np.ndarray
    kind: np.ndarray
    heads: list[np.ndarray]  # hashes of the first bytes of longer tokens, else 0, for each length asked for
    shape: np.ndarray  # of letters: 0 lower, 1 first upper, 2 all upper, 3 else, +4 if equal to the token before; of signs and digits: 8 up


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, bytes), long texts cut at a blank."""
    for i, t in enumerate(texts):
        while len(t) > CHUNK:
            cut = t.rfind(b" ", 0, CHUNK)
            cut = cut + 1 if cut > 0 else CHUNK
            yield i, t[:cut]
            t = t[cut:]
        yield i, t


def _hash(chunks: list[tuple[int, bytes]], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"\n".join(c for _, c in chunks) + b"\n", np.uint8)
    kind = _KIND[data]
    new = kind != SPACE
    new[1:] &= kind[1:] != kind[:-1]
    starts = np.flatnonzero(new)
    if not len(starts):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), *(np.zeros(0, np.uint64) for _ in prefixes))
    at = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(data)]])))
    value = (_LOWER[data] + np.uint64(1)) * _POWERS[at & 4095]
    value[kind == SPACE] = 0
    hashes = mix(np.add.reduceat(value, starts))
    upper = (data >= 65) & (data < 91)
    ups = np.add.reduceat(upper.astype(np.int32), starts)
    length = np.add.reduceat((kind != SPACE).astype(np.int32), starts)
    case = np.where(ups == 0, 0, np.where((ups == length) & (length > 1), 2, np.where((ups == 1) & upper[starts], 1, 3)))
    ends = np.cumsum([len(c) + 1 for _, c in chunks])
    doc = np.array([i for i, _ in chunks], np.int64)[np.searchsorted(ends, starts, "right")]
    # 0: the token is no longer than the prefix
    heads = [np.where(length > n, mix(np.add.reduceat(np.where(at < n, value, 0), starts) + np.uint64(n)), 0) for n in prefixes]
    return doc, hashes, kind[starts], case.astype(np.uint8), *heads


def tokens(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> Tokens:
    out, part, size = [], [], 0
    for i, c in _chunks(texts):
        part.append((i, c))
        size += len(c)
        if size >= CHUNK:
            out.append(_hash(part, prefixes))
            part, size = [], 0
    if part or not out:
        out.append(_hash(part or [(0, b"")], prefixes))
    doc, hashes, kind, case, *heads = (np.concatenate(x) for x in zip(*out, strict=True))
    again = np.zeros(len(doc), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    shape = np.where(kind == LETTER, case + 4 * again, np.where(kind == DIGIT, 8, 9 + (hashes & np.uint64(1023)).astype(np.int64)))
    return Tokens(doc, hashes, kind, heads, shape)


def ngrams(doc: np.ndarray, units: np.ndarray, n: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the runs of n units within a text."""
    if len(units) < n:
        return doc[:0], units[:0].astype(np.uint64)
    x = np.full(len(units) - n + 1, np.uint64(tag * 2 + 1))
    for i in range(n):
        x = x * STEP + units[i : len(units) - n + 1 + i].astype(np.uint64)
    inside = doc[: len(doc) - n + 1] == doc[n - 1 :]
    return doc[n - 1 :][inside], mix(x[inside] * BASE)


def slices(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Bounds of slices with about so many bytes."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
