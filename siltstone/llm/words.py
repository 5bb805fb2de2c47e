"""Words of many texts as 64-bit numbers, computed over the bytes of all texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SEED = 20240611
_RANDOM = np.random.default_rng(_SEED)
_OF_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Words of the contamination check: digits, letters and whatever is not ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[48:58] = PLAIN[97:123] = PLAIN[128:] = True
# Words of the n-gram join: whatever is not ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False


def mixed(values: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for each 64-bit number (the finalizer of splitmix64)."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.multiply.accumulate(np.full(64, _STEP, np.uint64))


def _powers(count: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < count:
        _POWERS = np.multiply.accumulate(np.full(2 * count, _STEP, np.uint64))
    return _POWERS


@dataclass
class Words:
    """``hashes`` of all words in order; text ``i`` has the words ``bounds[i]`` to ``bounds[i + 1]``."""

    hashes: np.ndarray
    bounds: np.ndarray


def hashed_words(texts: pa.Array, kind: np.ndarray) -> Words:
    """Words of each text after lower-casing A to Z; a null text has none."""
    count = len(texts)
    data = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()]
    sizes = np.fromiter((len(x) + 1 for x in data), np.int64, count)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    # A byte that is no word of either kind stands between two texts.
    flat = _LOWER[np.frombuffer(b" ".join(data) + b" ", np.uint8)]
    inside = kind[flat]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(count + 1, np.int64))
    at = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(at)) - np.repeat(first, lengths)
    parts = _OF_BYTE[flat[at]] * _powers(int(lengths.max()))[within]
    sums = np.add.reduceat(parts, first)
    return Words(mixed(sums + lengths.astype(np.uint64) * _OF_BYTE[0]), np.searchsorted(starts, offsets))


def spelled_words(text: str | None, kind: np.ndarray) -> list[str]:
    """The words themselves, for small texts and tests."""
    raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    kept = np.where(kind[raw], raw, 32).astype(np.uint8).tobytes()
    return [x.decode("utf-8", "surrogatepass") for x in kept.split()]
