"""Reading vector columns in Spark tasks, and fast Hadamard rotations."""

from __future__ import annotations

import numpy as np


def usable(v) -> np.ndarray | None:
    """The vector in double precision, or None if it is null, empty, zero or holds a null or non-finite component."""
    if v is None:
        return None
    x = np.asarray(v, dtype=np.float64)
    return x if x.size and np.isfinite(x).all() and x.any() else None


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the row length is a power of two.  n log n additions."""
    x = x.copy()
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(x: np.ndarray, count: int, seed: int):
    """``count`` pseudo-random rotations of the rows, padded to a power of two: three rounds of signs and Hadamard transform each."""
    size = 1 << max(1, int(np.ceil(np.log2(x.shape[1]))))
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, size])
    for _ in range(count):
        signs = rng.choice([-1.0, 1.0], (3, size))
        y = padded
        for s in signs:
            y = hadamard(y * s)
        yield y
