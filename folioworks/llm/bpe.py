"""Byte-level BPE: a minimal perfect hash over the vocabulary, merges by a heap over linked bytes.

Both are small helpers inside Spark tasks.  :class:`TwoTierEncoder` encodes one
pre-token; :class:`UnitEncoder` splits whole texts and remembers the result of
units that return often.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
import unicodedata
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Unicode White_Space, which is what \s means to the reference library (fixed values).
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def other_numbers() -> str:
    """Numbers that are no decimal digits, as ranges of a character class."""
    out, start, last = [], None, None
    for cp in range(sys.maxunicode + 1):
        if unicodedata.category(chr(cp)) in ("Nl", "No"):
            if last is not None and cp == last + 1:
                last = cp
                continue
            if start is not None:
                out.append((start, last))
            start = last = cp
    out.append((start, last))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def pretokenizer() -> re.Pattern:
    r"""The split pattern in terms of the standard library's classes.

    Letters are \w without digits, other numbers and the underscore; numbers are
    digits and other numbers; the rest is neither of those nor white space.
    """
    n = other_numbers()
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_{n}]+| ?[\d{n}]+| ?(?:[^\w{SPACE}]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MinimalPerfectHash:
    """Maps n distinct keys to 0..n-1 without gaps: hash and displace.

    Keys fall into buckets by a first hash; the largest buckets are placed first,
    each with the smallest displacement that puts its keys on free slots.  One
    64-bit hash of the key gives the bucket and two values that the displacement
    combines.  A key that is not of the set maps to some slot, so callers compare
    the key that is stored there.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.n = n = max(1, len(keys))
        self.m = m = max(1, n // per_bucket)
        self.shift = np.zeros(m, dtype=np.int64).tolist()
        buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(m)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            buckets[h % m].append(((h >> 20) % n, 1 + (h >> 42) % (n - 1 or 1), i))
        taken, self.slots = bytearray(n), [0] * n
        for b in sorted(range(m), key=lambda x: -len(buckets[x])):
            own = buckets[b]
            if not own:
                continue
            if len(own) == 1:  # the many single keys come last: they name a free slot, as -1 - slot
                p = taken.index(0)
                self.shift[b] = -1 - p
                taken[p], self.slots[p] = 1, own[0][2]
                continue
            d = 0
            while True:
                places = [(f + d * g + d * d) % n for f, g, _ in own]
                if not any(taken[p] for p in places) and len(set(places)) == len(places):
                    break
                d += 1
            self.shift[b] = d
            for p, (_, _, i) in zip(places, own, strict=True):
                taken[p], self.slots[p] = 1, i

    def slot(self, key: bytes) -> int:
        h, n = xxhash.xxh3_64_intdigest(key), self.n
        d = self.shift[h % self.m]
        return -1 - d if d < 0 else ((h >> 20) % n + d * (1 + (h >> 42) % (n - 1 or 1)) + d * d) % n


class TwoTierEncoder:
    """ids of one pre-token: the whole token by the perfect hash, or else merges of its bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.hash = MinimalPerfectHash(keys)
        self.key_at = [keys[i] for i in self.hash.slots]
        self.id_at = [ranks[k] for k in self.key_at]
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        #: id of the left part << 17 | id of the right part -> id of the token they make
        self.pairs = {}
        for k, v in ranks.items():
            for c in range(1, len(k)):
                if (x := ranks.get(k[:c])) is not None and (y := ranks.get(k[c:])) is not None:
                    self.pairs[x << 17 | y] = v
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k

    def lookup(self, piece: bytes) -> int | None:
        s = self.hash.slot(piece)
        return self.id_at[s] if self.key_at[s] == piece else None

    def encode(self, piece: bytes) -> list[int]:
        found = self.lookup(piece)
        return [found] if found is not None else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of least rank, leftmost first, until none is left; O(n log n).

        Places are linked by their next and previous ones.  The heap holds
        rank << 32 | place; an entry counts only while the pair at its place still has that rank.
        """
        n, get, pop, push = len(piece), self.pairs.get, heapq.heappop, heapq.heappush
        ids = [self.byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := get(ids[i] << 17 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            j = after[i]
            if j >= n or ids[i] < 0 or get(ids[i] << 17 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := get(r << 17 | ids[k])) is not None:
                    push(heap, q << 32 | i)
            h = before[i]
            if h >= 0 and (q := get(ids[h] << 17 | r)) is not None:
                push(heap, q << 32 | h)
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class UnitEncoder:
    """Whole texts by their units between single spaces.

    A space between two characters that are no white space always begins a
    pre-token, so a text splits there without the pattern.  A text in which some
    unit is empty or begins or ends with white space goes through ``value_of`` as
    a whole.  Values of units are kept, by the unit without its space, in two
    generations of bounded size; units with such edges are never kept, so they
    show up as missing in every text.
    """

    def __init__(self, value_of, most: int = 400_000, longest: int = 40):
        self.value_of, self.most, self.longest = value_of, most, longest
        self.young: dict = {}
        self.old: dict = {}
        self.edge = re.compile(rf"^$|^[{SPACE}]|[{SPACE}]$").search

    def values(self, text: str) -> list:
        units = text.split(" ")
        if self.edge(units[0]):
            return self.value_of([text])
        if len(units) == 1:
            return self.value_of(units)
        head, rest = units[0], units[1:]
        young = self.young
        found = list(map(young.get, rest))
        missing = [i for i, v in enumerate(found) if v is None] if None in found else []
        new = {rest[i] for i in missing}
        if new and any(map(self.edge, new)):
            return self.value_of([text])
        todo = []
        for u in new:
            v = self.old.get(u)
            if v is None:
                todo.append(u)
            else:
                young[u] = v
        first, *made = self.value_of([head, *[" " + u for u in todo]])
        long = {}
        for u, v in zip(todo, made, strict=True):
            (young if len(u) <= self.longest else long)[u] = v
        for i in missing:
            u = rest[i]
            found[i] = young[u] if len(u) <= self.longest else long[u]
        if len(young) > self.most:
            self.old, self.young = young, {}
        return [first, *found]


_ENCODERS: dict = {}


def encoder(path: str) -> UnitEncoder:
    """One per worker process: values are (ids joined by a space, decoded bytes)."""
    if path not in _ENCODERS:
        two, split = TwoTierEncoder(load_ranks(path)), pretokenizer().findall

        known: dict[str, list[int]] = {}

        def encode(t: str) -> list[int]:
            ids = known.get(t)
            if ids is None:
                ids = two.encode(t.encode())
                if len(t) <= 32:
                    if len(known) > 200_000:
                        known.clear()
                    known[t] = ids
            return ids

        def value_of(units: list[str]) -> list:
            out = []
            for u in units:
                ids = [i for t in split(u) for i in encode(t)]
                out.append((" ".join(map(str, ids)).encode(), two.decode(ids)))
            return out

        _ENCODERS[path] = UnitEncoder(value_of)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Token count and digests of the ids and of the bytes they decode to, for every row.

    Null and empty texts have no tokens; their digests are those of empty strings.
    Rows are independent: no shuffle, memory bounded by an Arrow batch and the
    unit memory.  ``ids=True`` adds the ids themselves (array of int).  Columns
    other than ``keep`` are left out.
    """
    cols = [F.col(k) for k in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema)
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches):
        enc = encoder(ranks_path)
        for pdf in batches:
            n, a, b, all_ids = [], [], [], []
            for t in pdf.pop("__text"):
                pairs = enc.values(t) if t else []
                joined = b" ".join([p[0] for p in pairs])
                n.append(joined.count(b" ") + 1 if joined else 0)
                a.append(hashlib.sha256(joined).hexdigest())
                b.append(hashlib.sha256(b"".join([p[1] for p in pairs])).hexdigest())
                if ids:
                    all_ids.append([int(x) for x in joined.split()])
            out = pdf.assign(n_tokens=np.array(n, dtype=np.int64), ids_sha256=a, decoded_sha256=b)
            yield out.assign(ids=all_ids) if ids else out

    return docs.select(*cols, F.col(text).alias("__text")).mapInPandas(run, schema)
