"""The most similar string of a project by the ratio of ``SequenceMatcher``, without comparing every pair.

The ratio is no more than twice the longest common subsequence over all characters, and
that no more than the letters two strings share.  Strings that one deletion on either side
makes equal are found by hashes.  What they leave open is compared by letters, one matrix
product for all classes of strings of equal letters, from the highest bound down: pairs
that may still win get their common subsequence (64 pairs of characters a step, in numpy),
and only the best of those the ratio itself.  Nothing is left out: a pair goes unread only
where a bound says that it cannot win.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: letters are told apart by their codes modulo this, and up to so many of each; both only raise the bounds
BUCKETS, REPEATS = 128, 16
#: strings up to this length have their common subsequence in one word of 64 bits
SHORT = 64
CELLS = 1 << 22


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


class _Strings:
    """Strings as arrays: lengths, codes of the short ones, counts of letters."""

    def __init__(self, words: list[str]):
        self.words, self.n = words, np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(words)), self.n)
        self.counts = np.bincount(row * BUCKETS + flat % BUCKETS, minlength=len(words) * BUCKETS).reshape(-1, BUCKETS).astype(np.int32)
        self.short = self.n <= SHORT
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        here = self.short[row]
        self.width = int(self.n[self.short].max(initial=0))
        self.codes = np.full((len(words), self.width), -1, np.int64)
        self.codes[row[here], at[here]] = flat[here]

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every short string and of all it gives by one deletion."""
        base = 0x9E3779B97F4A7C15
        powers = np.array([pow(base, k, 1 << 64) for k in range(self.width)], np.uint64)
        sums = np.zeros((len(self.words), self.width + 1), np.uint64)
        np.cumsum((self.codes + 1).astype(np.uint64) * powers, axis=1, out=sums[:, 1:])
        whole = sums[:, -1:]
        without = sums[:, :-1] + (whole - sums[:, 1:]) * np.uint64(pow(base, -1, 1 << 64))
        row, _ = np.nonzero(self.codes >= 0)
        own = np.flatnonzero(self.short)
        return np.concatenate([without[self.codes >= 0], whole[own, 0]]), np.concatenate([row, own])


def _cuts(counts: np.ndarray, most: int):
    """Ranges of rows with about ``most`` pairs each."""
    sums, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


class _Search:
    """The best strings of ``b`` for each of ``a``; of equal ratios those of the highest ``order`` (all, where that is equal too)."""

    def __init__(self, a: list[str], b: list[str], order: np.ndarray, least: float):
        self.a, self.b, self.order, self.least = _Strings(a), _Strings(b), order, least
        self.best, self.best_order, self.found = [0.0] * len(a), [-np.inf] * len(a), [[] for _ in a]
        masks = np.zeros((len(a), BUCKETS + 1), np.uint64)  # where each letter stands in a string; the last one stands nowhere
        for k in range(self.a.width):
            rows = np.flatnonzero(self.a.codes[:, k] >= 0)
            masks[rows, self.a.codes[rows, k] % BUCKETS] |= np.uint64(1 << k)
        self.masks = masks.reshape(-1)
        self.letters = np.where(self.b.codes >= 0, self.b.codes % BUCKETS, BUCKETS).astype(np.int16)

    def bounds(self, i: np.ndarray, j: np.ndarray, known: np.ndarray | float = 1.0) -> np.ndarray:
        """The ratio's bound by the longest common subsequence; ``known`` for pairs with a long string."""
        out = np.broadcast_to(np.asarray(known, float), i.shape).copy()
        both = self.a.short[i] & self.b.short[j]
        x, y = i[both], j[both]
        if len(x):
            v, at, letters = np.full(len(x), ~np.uint64(0)), x * (BUCKETS + 1), self.letters[y, : self.b.n[y].max()]
            for k in range(letters.shape[1]):
                u = v & self.masks[at + letters[:, k]]
                v = (v + u) | (v - u)
            out[both] = 2.0 * np.bitwise_count(~v) / (self.a.n[x] + self.b.n[y])
        return out

    def floors(self) -> np.ndarray:
        return np.maximum(np.array(self.best), self.least)

    def verify(self, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> None:
        at = np.lexsort((-self.order[j], -bound, i))
        best, best_order, found = self.best, self.best_order, self.found
        for x, y, u, o in zip(i[at].tolist(), j[at].tolist(), bound[at].tolist(), self.order[j[at]].tolist(), strict=True):
            if u < best[x] or (u == best[x] and o < best_order[x]):
                continue
            s = ratio(self.a.words[x], self.b.words[y])
            if s < self.least or (s, o) < (best[x], best_order[x]):
                continue
            if (s, o) > (best[x], best_order[x]):
                best[x], best_order[x], found[x] = s, o, []
            found[x].append(y)

    def by_deletions(self) -> np.ndarray:
        """Pairs up to two letters apart; returns the rows for which other pairs may be as good."""
        key, row = self.b.deletions()
        at = np.argsort(key)
        key, row = key[at], row[at]
        asked, i = self.a.deletions()
        at = np.argsort(i, kind="stable")
        asked, i = asked[at], i[at]
        first = np.searchsorted(key, asked, "left")
        counts = np.searchsorted(key, asked, "right") - first
        # where a row is cut in two, its pairs of both parts are verified all the same
        for s, e in _cuts(counts, CELLS):
            n = counts[s:e]
            j = row[np.repeat(first[s:e], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            pairs = np.unique(np.repeat(i[s:e], n) * len(self.b.words) + j)
            x, y = np.divmod(pairs, len(self.b.words))
            u = self.bounds(x, y)
            keep = u >= self.floors()[x]
            self.verify(x[keep], y[keep], u[keep])
        lengths = np.unique(self.b.n)
        left = np.zeros(len(self.a.words), bool)
        for n in np.unique(self.a.n):
            apart = np.abs(lengths - n)
            fewest = np.where((n <= SHORT) & (lengths <= SHORT), np.where(apart > 1, apart, 4 - apart), apart)
            other = np.max((lengths + n - fewest) / (lengths + n))
            if other >= self.least:
                rows = np.flatnonzero(self.a.n == n)
                left[rows] = np.array(self.best)[rows] <= other
        return np.flatnonzero(left)

    def by_letters(self, rows: np.ndarray) -> None:
        """All other pairs of ``rows``, from the highest bound down."""
        steps = [x for x in np.arange(0.97, self.least, -0.03) if x > self.least] + [self.least]
        used = np.flatnonzero(self.a.counts.any(axis=0) & self.b.counts.any(axis=0))
        ca, of_a = np.unique(self.a.counts[rows][:, used], axis=0, return_inverse=True)
        # letters that only one side has count for the length alone, so lengths are part of a class
        ka, of_a = np.unique(np.stack([of_a.reshape(-1), self.a.n[rows]], 1), axis=0, return_inverse=True)
        cb, of_b = np.unique(self.b.counts[:, used], axis=0, return_inverse=True)
        kb, of_b = np.unique(np.stack([of_b.reshape(-1), self.b.n], 1), axis=0, return_inverse=True)
        of_a, of_b = of_a.reshape(-1), of_b.reshape(-1)
        ca, na, cb, nb = ca[ka[:, 0]], ka[:, 1], cb[kb[:, 0]], kb[:, 1]
        top = np.minimum(np.minimum(ca.max(axis=0, initial=0), cb.max(axis=0, initial=0)), REPEATS)
        unary = lambda c: np.concatenate([c[:, [k]] > np.arange(top[k]) for k in range(len(used))] or [np.zeros((len(c), 0), bool)], axis=1).astype(np.float32)
        ua, ub = unary(ca), unary(cb).T
        more_a, more_b = np.maximum(ca - REPEATS, 0).sum(axis=1), np.maximum(cb - REPEATS, 0).sum(axis=1)
        in_a, in_b = rows[np.argsort(of_a, kind="stable")], np.argsort(of_b, kind="stable")
        size_a, size_b = np.bincount(of_a, minlength=len(na)), np.bincount(of_b, minlength=len(nb))
        from_a, from_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        block = max(1, CELLS // max(1, len(nb)))
        for s in range(0, len(na), block):
            e = min(len(na), s + block)
            shared = (ua[s:e] @ ub).astype(float)
            if more_a[s:e].any() and more_b.any():
                shared += np.minimum.outer(more_a[s:e], more_b)
            bound = 2.0 * shared / (na[s:e, None] + nb[None, :])
            floor = np.minimum.reduceat(self.floors()[in_a], from_a)[s:e]
            x, y = np.nonzero(bound >= floor[:, None])
            bound = bound[x, y]
            x += s
            wait = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for high, low in zip([np.inf, *steps], steps):
                here = np.flatnonzero((bound >= low) & (bound < high))
                sums = np.cumsum(size_a[x[here]] * size_b[y[here]])
                parts, held = [wait], len(wait[0])
                for at in range(0, int(sums[-1]) if len(sums) else 0, CELLS // 4):
                    flat = np.arange(at, min(int(sums[-1]), at + CELLS // 4))
                    t = np.searchsorted(sums, flat, "right")
                    p = here[t]
                    inside = flat - (sums[t] - size_a[x[p]] * size_b[y[p]])
                    i, j = in_a[from_a[x[p]] + inside // size_b[y[p]]], in_b[from_b[y[p]] + inside % size_b[y[p]]]
                    floors = self.floors()
                    keep = bound[p] >= floors[i]
                    i, j, known = i[keep], j[keep], bound[p][keep]
                    u = self.bounds(i, j, known)
                    keep = u >= floors[i]
                    parts.append([i[keep], j[keep], u[keep]])
                    held += int(keep.sum())
                    if held > CELLS:  # what waits stays bounded: it is read now
                        self.verify(*[np.concatenate(c) for c in zip(*parts)])
                        parts, held = [], 0
                wait = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                now = wait[2] >= low
                self.verify(*[c[now] for c in wait])
                later = ~now & (wait[2] >= self.floors()[wait[0]])
                wait = [c[later] for c in wait]


def best_of(a: list[str], b: list[str], order: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(i, j, ratio): the most similar ones of ``b`` for each of ``a``, of ``least`` or more and of the highest order; empty strings meet nothing."""
    if len(a) * len(b) <= 64:
        out = []
        for i, x in enumerate(a):
            scored = [(ratio(x, y), o, j) for j, (y, o) in enumerate(zip(b, order.tolist(), strict=True)) if x and y and 2.0 * min(len(x), len(y)) / (len(x) + len(y)) >= least]
            top = max(((s, o) for s, o, _ in scored if s >= least), default=None)
            out += [(i, j, s) for s, o, j in scored if (s, o) == top]
        return out
    own, other = [i for i, x in enumerate(a) if x], [j for j, y in enumerate(b) if y]
    if not own or not other:
        return []
    search = _Search([a[i] for i in own], [b[j] for j in other], order[other], least)
    rows = search.by_deletions()
    if len(rows):
        search.by_letters(rows)
    return [(own[i], other[j], search.best[i]) for i, js in enumerate(search.found) for j in set(js)]


def most_similar(left: DataFrame, right: DataFrame, least: float, most_left: int = 32_768, most_right: int = 32_768) -> DataFrame:
    """(project_id, a, b, score): for each ``a`` of ``left`` the most similar ``b`` of its project in ``right``, ``least`` or more.

    ``left`` is (project_id, a), ``right`` (project_id, b, o), each string once in a project.  A
    project's strings are dealt out by their letters into parts of about ``most_left`` and
    ``most_right``; every part meets every other one and gives its best, so that ``a`` may come
    more than once: the highest score, then the highest ``o``, counts.  Projects smaller than
    that share groups.
    """
    kind = left.schema["project_id"].dataType.simpleString()
    n_a = left.groupBy("project_id").agg(F.count("*").alias("n_a"))
    n_b = right.groupBy("project_id").agg(F.count("*").alias("n_b"))
    both = n_a.join(n_b, "project_id").withColumn("one", F.lit(1))
    small = (F.col("n_a") <= most_left // 8) & (F.col("n_b") <= most_right // 8)
    # one row: how many groups the small projects need
    slots = both.where(small).groupBy("one").agg((F.ceil(F.sum("n_a") / (most_left // 8)) + F.ceil(F.sum("n_b") / (most_right // 8))).alias("slots"))
    hashed = F.xxhash64("project_id")
    slot = F.when(small, F.pmod(hashed, F.coalesce("slots", F.lit(1)))).otherwise(hashed)
    sizes = both.join(F.broadcast(slots), "one", "left").select("project_id", slot.alias("slot"), F.ceil(F.col("n_a") / most_left).alias("parts_a"), F.ceil(F.col("n_b") / most_right).alias("parts_b"))
    letters = lambda c: F.xxhash64(F.array_join(F.array_sort(F.split(c, "")), ""))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    at_a = left.join(sizes, "project_id").withColumn("part_a", F.pmod(letters("a"), F.col("parts_a"))).withColumn("part_b", every("parts_b")).select("project_id", "slot", "part_a", "part_b", "a")
    at_b = right.join(sizes, "project_id").withColumn("part_b", F.pmod(letters("b"), F.col("parts_b"))).withColumn("part_a", every("parts_a")).select("project_id", "slot", "part_a", "part_b", "b", F.col("o").cast("double").alias("o"))
    at_b = at_b.select(*[F.col(c).alias(c) for c in at_b.columns])  # columns of its own, where both sides come from one table

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        mine: dict = {}
        for p, a in zip(one.project_id, one.a, strict=True):
            mine.setdefault(p, []).append(a)
        theirs: dict = {}
        for p, b, o in zip(two.project_id, two.b, two.o.fillna(-np.inf), strict=True):
            theirs.setdefault(p, []).append((b, o))
        rows = []
        for p in mine.keys() & theirs.keys():
            a, b = mine[p], [b for b, _ in theirs[p]]
            rows += [(p, a[i], b[j], s) for i, j, s in best_of(a, b, np.array([o for _, o in theirs[p]], float), least)]
        return pd.DataFrame(rows, columns=["project_id", "a", "b", "score"])

    keys = ("slot", "part_a", "part_b")
    return at_a.groupBy(*keys).cogroup(at_b.groupBy(*keys)).applyInPandas(meet, f"project_id {kind}, a string, b string, score double")
