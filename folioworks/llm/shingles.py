"""Word shingles of whole batches of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE, INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x.astype(U) + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


VALUE = mix(np.arange(256), 11)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, dtype=U), "down": np.ones(1, dtype=U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            for k, b in (("up", BASE), ("down", INVERSE)):
                x = np.full(size, U(b), dtype=U)
                x[0] = 1
                _POWERS[k] = np.cumprod(x, dtype=U)
    return _POWERS["up"], _POWERS["down"]


def _hashed_words(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of lower-cased bytes that end with white space."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, dtype=U), np.cumsum(VALUE[data] * up[: len(data)], dtype=U)])
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start = np.nonzero(edge == -1)[0]
    end = np.nonzero(np.concatenate([edge[1:], [0]]) == 1)[0] + 1 if len(start) else start
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U)), start


def word_hashes(texts: list[str], step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased) and, for each text, where its words begin (one more at the end).

    A word's hash depends on its bytes only, so about ``step`` bytes are hashed at a
    time, up to white space: running sums take eight times the memory of their bytes.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    space = SPACES[data]
    words, starts, a = [], [], 0
    while a < len(data):
        b = min(a + step, len(data))
        if b < len(data):
            b += int(np.argmax(space[b - 1 :]))
        w, s = _hashed_words(data[a:b], space[a:b])
        words.append(w)
        starts.append(s + a)
        a = b
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    return np.concatenate(words), np.searchsorted(np.concatenate(starts), bounds)


def shingle_sets(texts: list[str], size: int = 5, chunk: int = 1 << 21):
    """For each text in order, the sorted distinct hashes of its shingles.

    A text of fewer than ``size`` words is one shingle of all of them; a text
    without words has none.
    """
    k = 0
    while k < len(texts):
        e, n = k, 0
        while e < len(texts) and (e == k or n + len(texts[e]) < chunk):
            n += len(texts[e])
            e += 1
        words, first = word_hashes(texts[k:e])
        with np.errstate(over="ignore"):
            if len(words) >= size:
                acc = np.zeros(len(words) - size + 1, dtype=U)
                for j in range(size):
                    acc = acc * U(STEP) + words[j : len(acc) + j]
                acc = mix(acc, size)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= size:
                    own = np.sort(acc[a : b - size + 1])
                    yield own[np.concatenate([[True], own[1:] != own[:-1]])]
                elif b > a:
                    h = U(0)
                    for w in words[a:b]:
                        h = h * U(STEP) + w
                    yield mix(np.array([h], dtype=U), 100 + b - a)
                else:
                    yield np.zeros(0, dtype=U)
        k = e
