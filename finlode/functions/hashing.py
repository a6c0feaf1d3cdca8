"""Scrambling and place weights for 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WEIGHTS = mix(np.arange(1, (1 << 14) + 1, dtype=np.uint64) * _MULTIPLIER)


def weights(place: np.ndarray) -> np.ndarray:
    """A fixed random 64-bit number for each place in a word.

    A hash sums codes times these. Numbers without a rule between them leave no two words with equal hashes by
    construction, as powers of one number would.
    """
    if not len(place) or place.max() < len(_WEIGHTS):
        return _WEIGHTS[place]
    return mix((place.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER)
