"""Sets of word shingles of whole texts, as numbers, computed over whole batches.

A word's hash is a polynomial of its bytes, so prefix sums over the bytes of
many texts give all words at once. Two different shingles of a corpus share a
64-bit hash with a chance of about one in 10**19 a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK = 1 << 18  # bytes hashed at once
_GAP = re.compile(rb"[\x20\x09-\x0D]")
P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(P), -1, 1 << 64))
_powers = {False: np.ones(1, np.uint64), True: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_values() -> np.ndarray:
    """A number for each byte; capitals have that of their small letter."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * P)
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def power(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of the multiplier, or of its inverse."""
    if len(_powers[inverse]) < n:
        base = np.full(n, _INVERSE if inverse else P)
        base[0] = 1
        _powers[inverse] = np.cumprod(base)
    return _powers[inverse]


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the place of the first word of each text."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers = power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers[: len(data)], out=sums[1:])
    # Taking the power of the first byte out makes equal words equal anywhere.
    hashes = mix((sums[last] - sums[first]) * power(len(data) + 1, True)[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, bounds)


def _sets(hashes: np.ndarray, places: np.ndarray) -> Iterator[np.ndarray]:
    """The set of each text, whose words stand between two places."""
    n = max(0, len(hashes) - SHINGLE + 1)
    total = np.full(n, SHINGLE, np.uint64)
    for k in range(SHINGLE):
        total = mix(total * P + hashes[k : k + n])
    for a, b in zip(places[:-1], places[1:], strict=True):
        if b - a >= SHINGLE:
            found = np.sort(total[a : b - SHINGLE + 1])
            keep = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                whole = mix(whole * P + h)
            yield whole
        else:
            yield np.empty(0, np.uint64)


def _long_words(text: bytes) -> np.ndarray:
    """Word hashes of one long text, cut at white space."""
    found, at = [], 0
    while at < len(text):
        space = _GAP.search(text, at + CHUNK)
        end = space.start() if space else len(text)
        part = np.frombuffer(text, np.uint8, end - at, at)
        found.append(_words(part, np.array([0, len(part)]))[0])
        at = end
    return np.concatenate(found)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as ascending 64-bit hashes.

    A-Z count as a-z. A text of fewer words is one shingle, all its words; a
    null or a text without words has none.
    """
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        bounds = np.cumsum([0, *map(len, held)])
        data = np.frombuffer(b"".join(held), np.uint8)
        return _sets(*_words(data, bounds)) if len(data) else iter([np.empty(0, np.uint64)] * len(held))

    for value in texts.cast(pa.binary()):
        text = value.as_py() or b""
        if size + len(text) > CHUNK and held:
            yield from flush()
            held, size = [], 0
        if len(text) > CHUNK:
            hashes = _long_words(text)
            yield from _sets(hashes, np.array([0, len(hashes)]))
        else:
            held.append(text)
            size += len(text)
    if held:
        yield from flush()
