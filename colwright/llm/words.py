"""Words of many texts at once as 64-bit digests, inside a task.

A word is a run of bytes other than space and 0x09-0x0D. Each byte value has a random 64-bit
number; a word's digest is a polynomial of them, taken from one running sum over the whole chunk,
then mixed. Upper and lower case ASCII letters share a number where case is folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit digests (an invertible mixer), differently for each salt."""
    with np.errstate(over="ignore"):
        x = x + _STEP * _U(2 * salt + 1)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


END_WORD = int(mix(np.array([0], _U), 7)[0])  # stands for the end of a text


@lru_cache(maxsize=4)
def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(256, dtype=_U), 11)
    if fold:
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, b, _U)]))
                     for b in (base, inverse))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


class Chunk(NamedTuple):
    """Texts first..last-1 of a batch: words[bounds[i]:bounds[i+1]] are those of text first+i."""

    first: int
    last: int
    bounds: np.ndarray
    words: np.ndarray
    tails: np.ndarray | None = None  # the last three bytes of each word, as a number


def chunks(texts: pa.Array, fold: bool = True, size: int = CHUNK_BYTES,
           tails: bool = False) -> Iterator[Chunk]:
    """Word digests chunk by chunk; nulls count as empty texts. Memory is bounded by the chunk
    size, or by the longest single text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        b, starts_of = data[at[i]:at[j]], at[i:j + 1] - at[i]
        yield Chunk(i, j, *_digests(b, starts_of, fold, tails))
        i = j


def _digests(b: np.ndarray, at: np.ndarray, fold: bool, tails: bool):
    if not len(b):
        return np.zeros(len(at), np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    word = _IS_WORD[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[at] = True  # texts never share a word
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    powers, inverse = _powers(1 << max(20, int(len(b) - 1).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(_byte_values(fold)[b] * powers[:len(b)], out=total[1:])
        words = mix((total[end] - total[start]) * inverse[start], 3)
    last = None
    if tails:
        last = np.zeros(len(start), np.int64)
        for back in (1, 2, 3):
            place = end - back
            byte = b[np.maximum(place, 0)].astype(np.int64)
            byte += 32 * ((byte >= 65) & (byte <= 90) & fold)
            last += np.where(place >= start, byte << (8 * (back - 1)), 0)
    return np.searchsorted(start, at), words, last


def shingles(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all runs of k words, and the bounds of each text's runs. A text of fewer words
    has one run, its whole sequence; a text without words has none."""
    words, bounds = chunk.words, chunk.bounds
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    if len(words) >= k:
        span = len(words) - k + 1
        run = words[:span].copy()
        with np.errstate(over="ignore"):
            for step in range(1, k):
                run = mix(run * _U(0xFF51AFD7ED558CCD) + words[step:step + span], 1)
    else:
        run = np.zeros(0, _U)
    text = np.repeat(np.arange(len(counts)), n)
    place = bounds[text] + np.arange(int(out_bounds[-1])) - out_bounds[text]
    out = run[np.minimum(place, max(len(run) - 1, 0))] if len(run) else np.zeros(len(place), _U)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        whole = words[bounds[i]:bounds[i] + 1].copy()
        with np.errstate(over="ignore"):
            for w in words[bounds[i] + 1:bounds[i + 1]]:
                whole = mix(whole * _U(0xFF51AFD7ED558CCD) + w, 1)
        out[out_bounds[i]] = mix(whole, 20 + int(counts[i]))[0]
    return out, out_bounds


def distinct_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and their bounds."""
    if not len(values):
        return values, np.zeros(len(bounds), np.int64)
    values = values.copy()
    for a, b in zip(bounds[:-1], bounds[1:]):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
