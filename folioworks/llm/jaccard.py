"""N-gram Jaccard join by parity sketches.

Every shingle flips one bit of a wide bit sketch, so the Hamming distance of two
sketches is at most the symmetric difference of the sets, which for a Jaccard
similarity of 3/4 or more is at most (|A| + |B|) / 7 and at most |A| / 3.  The
sketch is cut into blocks.  Of the blocks that are not empty, the first one that
two linked sets share is among the first |A| / 3 + 1 of A and the first
|B| / 3 + 1 of B, as each earlier one differs and costs a bit of the distance.
So joining on these blocks misses nothing.  The number of blocks is fixed for
each size band, and bands overlap so that every pair that may link has one in
common.  Sketches are of shingles that are not frequent; dropping the same
shingles everywhere cannot raise the distance, so the bound holds for any choice
of them.

Sets with too few such blocks (mostly frequent shingles) are few-block sets.  One
of them and any other set share a block, or they do not link.  Two of them meet
on a sketch so wide that each shingle has a block of its own: the first
|A| / 4 + 1 blocks, frequent ones last and the most frequent at the very end.
Where two linked sets share no shingle but frequent ones, all their other
shingles differ, so among the sets of equal frequent part the one with the fewest
others links with every set that any of them links with.  Such a hub stands for
its class: a passage that many documents hold makes no pairs of these documents.

Candidate pairs are verified exactly.  Documents of equal sets are one vertex.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, most_frequent, shuffle_partitions
from .components import across, components, joined_components
from .shingles import U, mix, shingle_sets

GROWTH = 1.5
BLOCK_BITS = 1 << 20


def bands(n: int) -> list[tuple[int, int]]:
    """(band, number of blocks) of every band for a set of n shingles."""
    out = []
    k = int(math.log(max(n, 1)) / math.log(GROWTH)) + 1
    while k >= 0:
        low, high = math.ceil(GROWTH**k), math.ceil(GROWTH ** (k + 1)) - 1
        largest = 4 * high // 3
        if low <= n <= largest:
            out.append((k, math.ceil((0.5 if largest >= 200 else 1.2) * largest) + 8))
        elif n > largest:
            break
        k -= 1
    return out


def block_keys(hashes: np.ndarray, n: int) -> tuple[np.ndarray, bool]:
    """Join keys of the first n / 3 + 1 blocks that are not empty, in each band; and whether every band had so many."""
    need, keys, enough = n // 3 + 1, [], True
    for band, blocks in bands(n):
        spread = mix(hashes, 1000 + band)
        bit = spread % U(blocks * BLOCK_BITS)
        block = bit // U(BLOCK_BITS)
        order = np.argsort(block, kind="stable")
        block, flip = block[order], mix(bit[order], 7)
        if len(block):
            first = np.nonzero(np.concatenate([[True], block[1:] != block[:-1]]))[0]
            parity = np.bitwise_xor.reduceat(flip, first)
            at = block[first][parity != 0]
            parity = parity[parity != 0]
        else:
            at = parity = np.zeros(0, dtype=U)
        enough &= len(at) >= need
        with np.errstate(over="ignore"):
            keys.append(mix(parity[:need] ^ mix(at[:need], 2000 + band), 3))
    return (np.concatenate(keys) if keys else np.zeros(0, dtype=U)), enough


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a set; the first names the set as a vertex."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(mix(s, 21)).view(np.int64)), int(mix(s, 22).sum(dtype=U).view(np.int64))


def parity(s: np.ndarray) -> bytes:
    """The plain parity sketch of a set, of a power of two bits, at least as many as shingles."""
    bits = max(256, 1 << max(0, int(len(s) - 1).bit_length()))
    flips = np.bincount((mix(s, 41) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """The Hamming distance of two sketches; the longer one is folded, which keeps parity."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """One row (kind 0) per document: set size, two keys of its set and its sketch; and (kind 1) shingles that documents of a batch share."""

    def run(batches):
        for pdf in batches:
            rows, sets = [], []
            for s in shingle_sets([t or "" for t in pdf.text], size):
                rows.append((len(s), *set_keys(s), parity(s)))
                sets.append(s)
            own = pd.DataFrame(rows, columns=["n", "k1", "k2", "sketch"])
            yield pd.DataFrame({"kind": np.int32(0), "doc_id": pdf.doc_id.astype("Int64").to_numpy(), "n": own.n, "k1": own.k1, "k2": own.k2, "sketch": own.sketch}).astype({"doc_id": "Int64"})
            if sets:
                values, counts = np.unique(np.concatenate(sets), return_counts=True)
                hot = counts >= 2
                if hot.any():
                    yield pd.DataFrame({"kind": np.int32(1), "doc_id": pd.array([None] * int(hot.sum()), dtype="Int64"), "n": counts[hot].astype(np.int64), "k1": values[hot].view(np.int64), "k2": np.int64(0), "sketch": None})

    return docs.mapInPandas(run, "kind int, doc_id long, n long, k1 long, k2 long, sketch binary")


CLASS = np.dtype([("h", "<i8"), ("others", "<i4"), ("n", "<i4")])


def wide_keys(s: np.ndarray, others: np.ndarray, ranks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a few-block set: join keys of its first shingles that are not frequent, and the ranks of its first frequent ones, in the order all sets share."""
    most = len(s) - -(-percent * len(s) // 100) + 1
    left = max(0, most - len(others))
    return mix(others[:most], 5), np.sort(ranks)[:left].astype(np.int64).view(U)


def blobs(docs: DataFrame, size: int, percent: int, frequent, parts: int) -> DataFrame:
    """Join keys and their vertices, as one pair of arrays for each batch and part of the key space; from part ``parts`` on, ranks of frequent shingles with vertices and their classes."""

    def run(batches):
        (skip, rank), seen = frequent.value, set()
        for pdf in (b.iloc[a : a + 2048] for b in batches for a in range(0, len(b), 2048)):  # small rows, little memory in flight
            keys, ids, hot, hot_ids, hot_class = [], [], [], [], []
            for s in shingle_sets([t or "" for t in pdf.text], size):
                vertex = set_keys(s)
                if vertex in seen or not len(s):  # equal sets of one input partition go out once
                    continue
                seen.add(vertex)
                at = np.minimum(np.searchsorted(skip, s), len(skip) - 1) if len(skip) else None
                often = skip[at] == s if len(skip) else np.zeros(len(s), dtype=bool)
                others = s[~often]
                k, enough = block_keys(others, len(s))
                if not enough:
                    common = s[often]
                    wide, first = wide_keys(s, others, rank[at[often]] if len(skip) else np.zeros(0, dtype=np.int32), percent)
                    k = np.concatenate([k, wide])
                    hot.append(first)
                    hot_ids.append(np.full(len(first), vertex[0], dtype=np.int64))
                    hot_class.append(np.repeat(np.array([(set_keys(common)[0], len(others), len(s))], dtype=CLASS), len(first)))
                keys.append(k)
                ids.append(np.full(len(k), vertex[0], dtype=np.int64))
            rows = []
            if keys:
                k, d = np.concatenate(keys), np.concatenate(ids)
                part = (k % U(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                k, d, cuts = k[by], d[by], np.searchsorted(part[by], np.arange(parts + 1))
                rows = [(p, k[a:b].tobytes(), d[a:b].tobytes(), None) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
            if hot:
                k, d, c = np.concatenate(hot), np.concatenate(hot_ids), np.concatenate(hot_class)
                for a in range(0, len(k), 1 << 16):
                    b = min(a + (1 << 16), len(k))
                    rows.append((parts + int(d[a].view(U) % U(parts)), k[a:b].tobytes(), d[a:b].tobytes(), c[a:b].tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["part", "keys", "docs", "classes"])

    return docs.mapInPandas(run, "part int, keys binary, docs binary, classes binary")


def shared_lists(own: pd.DataFrame) -> pd.DataFrame:
    """Of one part of the key space: each distinct list of two or more documents that share a key, as (list, hub, doc) with hub the least; rows of frequent shingles are passed on without a hub."""
    keys = np.concatenate([np.frombuffer(x, dtype=U) for x in own["keys"]])
    docs = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in own["docs"]])
    if own["classes"].iloc[0] is not None:
        c = np.concatenate([np.frombuffer(x, dtype=CLASS) for x in own["classes"]])
        return pd.DataFrame({"list": keys.view(np.int64), "hub": pd.array([None] * len(keys), dtype="Int64"), "doc": docs, "h": c["h"], "others": c["others"], "n": c["n"]})
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
    keys, docs = keys[fresh], docs[fresh]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    count = np.diff(np.append(first, len(keys)))
    with np.errstate(over="ignore"):
        name = np.add.reduceat(mix(docs.view(U), 31), first) ^ mix(count.astype(U), 32)
    many = np.nonzero(count >= 2)[0]
    _, once = np.unique(name[many], return_index=True)
    many = many[once]
    total = count[many]
    at = np.repeat(first[many] - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(total.sum())
    return pd.DataFrame({"list": np.repeat(name[many].view(np.int64), total), "hub": np.repeat(docs[first[many]], total), "doc": docs[at], "h": np.int64(0), "others": np.int32(0), "n": np.int32(0)})


def may_link(percent: int):
    """A condition on (others, n) of two sets that share frequent shingles only: their sizes allow a link."""
    h = lambda x: F.col(f"{x}n") - F.col(f"{x}others")
    return lambda x, y: (100 + percent) * (F.col(f"{x}others") + F.col(f"{y}others") + F.abs(h(x) - h(y))).cast("long") <= (100 - percent) * (F.col(f"{x}n") + F.col(f"{y}n")).cast("long")  # noqa: E501


class Frequent:
    """Few-block sets by the frequent shingles they meet on: rows (list, h, v, others, n), lists of the same sets once.

    A list is named by the rank of its shingle.  Sets of one class (h) hold the first
    lists of one sequence, so two classes have the same least list in common whichever
    of their sets meet: they are compared there only.
    """

    HUBS = 4

    def __init__(self, rows: DataFrame, percent: int, scratch: Scratch):
        rows = rows.distinct()
        sums = rows.groupBy("list").agg(F.count("*").alias("all"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("name")).where("all > 1")
        once = sums.groupBy("all", "name").agg(F.min("list").alias("list")).select("list")
        self.rows = scratch.save(rows.join(once, "list"))
        self.hubs = scratch.save(self.rows.groupBy("list", "h").agg(F.min(F.struct("others", "v", "n")).alias("m")).select("list", "h", "m.*"))
        self.fit, self.scratch = may_link(percent), scratch

    @staticmethod
    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("list", *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != "list"])

    def pairs(self, left: DataFrame, right: DataFrame, on=("list",)) -> DataFrame:
        both = self.named(left, "l_").join(self.named(right, "r_"), "list").where("l_v != r_v").where(self.fit("l_", "r_"))
        return both

    def stars(self) -> DataFrame:
        """Every set with the hub of its class, and hubs of classes with a few of their list."""
        own = self.rows.join(self.hubs.select("list", "h", F.col("v").alias("r_v"), F.col("others").alias("r_others"), F.col("n").alias("r_n")), ["list", "h"])
        own = own.select(F.col("v").alias("l_v"), F.col("others").alias("l_others"), F.col("n").alias("l_n"), "r_v", "r_others", "r_n").where("l_v != r_v").where(self.fit("l_", "r_"))
        some = [F.min(F.struct("others", "v", "n", "h")).alias("m0")] + [F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("o"), "others", "v", "n", "h")).alias(f"m{k}") for k in range(1, self.HUBS)]
        picked = self.hubs.groupBy("list").agg(*some).select("list", F.explode(F.array(*[F.struct(*[F.col(f"m{k}.{c}").alias(c) for c in ("others", "v", "n", "h")]) for k in range(self.HUBS)])).alias("m")).select("list", "m.*").distinct()
        # a class need not try the hubs of all its lists here: the largest list connects most, rest() sees to the others
        sizes = self.hubs.groupBy("list").agg(F.count("*").alias("classes"))
        largest = self.hubs.join(sizes, "list").groupBy("h").agg(F.max_by("list", F.struct("classes", "list")).alias("list"))
        across_classes = self.pairs(self.hubs.join(largest, ["list", "h"]), picked)
        return own.select("l_v", "r_v").unionByName(across_classes.select("l_v", "r_v"))

    def rest(self, near: DataFrame) -> DataFrame:
        """Sets with the hubs of other classes of their lists, where one of the two is outside of what is connected most in the list."""
        tag = lambda df: df.join(near.select(F.col("id").alias("v"), F.col("component")), "v", "left").withColumn("component", F.coalesce("component", "v"))
        rows = self.scratch.save(tag(self.rows))
        sizes = rows.groupBy("list", "component").agg(F.count("*").alias("n")).groupBy("list").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("parts"))
        classes = self.hubs.groupBy("list").agg(F.count("*").alias("classes")).where("classes > 1").select("list")
        left = self.scratch.save(rows.join(sizes.where("parts > 1").select("list", "major"), "list").join(classes, "list"))
        left = self.scratch.save(left.join(left.groupBy("h").agg(F.collect_set("list").alias("all")), "h"))
        right = left.join(self.hubs.select("list", "v"), ["list", "v"], "left_semi")
        one = self.pairs(left.where("component != major"), right)
        two = self.pairs(left.where("component = major"), right.where("component != major"))
        return one.unionByName(two).where("l_component != r_component and l_h != r_h and list = array_min(array_intersect(l_all, r_all))").select("l_v", "r_v")


BITMAP = 1 << 24


def bitmap(vertices: DataFrame) -> np.ndarray:
    """A bit for each vertex, by its lowest bits: 2 MB whatever the input.  It only saves rows; an exact join follows."""
    low = F.col("v").bitwiseAND(BITMAP - 1)
    words = vertices.select(F.shiftright(low, 5).alias("w"), F.expr("shiftleft(1L, cast(v & 31 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(BITMAP >> 5, dtype=np.uint32)
    out[words.w.to_numpy(dtype=np.int64)] = words.b.to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches are no further apart than linked sets can be."""
    one = sketches.select(F.col("v").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = sketches.select(F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))

    def run(batches):
        for pdf in batches:
            most = ((pdf.n_a + pdf.n_b) * (100 - percent)) // (100 + percent)
            keep = [apart(x, y) <= m for x, y, m in zip(pdf.sketch_a, pdf.sketch_b, most.tolist(), strict=True)]
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    one = sets.select(F.col("v").alias("b"), F.col("items").alias("items_b"))
    two = sets.select(F.col("v").alias("a"), F.col("items").alias("items_a"))

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf.items_a, pdf.items_b, strict=True):
                p, q = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                at = np.searchsorted(p, q)
                both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return pairs.join(one, "b").join(two, "a").mapInPandas(run, "a long, b long").distinct()


def link_documents(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 75, often: int = 12, most: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Documents link when 100 * |A and B| >= ``percent`` * |A or B| over their
    distinct shingles (``percent`` is 75 or more); component_id is the least id that
    links reach.  A document of fewer words than ``size`` is one shingle; one
    without words, or null, has none and links with nothing.  Each row is judged by
    its own text, also where ids repeat; a row with a null id has a null component
    but for the ids it links with.  Other columns are not read.
    """
    if percent < 75:
        raise ValueError("the bounds on blocks hold from 75 percent on")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", F.col(text).alias("text"))
    both = scratch.save(signatures(docs, size))
    rows = both.where("kind = 0").drop("kind", "sketch")
    # at most `most` hashes come to the driver; which ones has no bearing on the result
    shared = scratch.save(both.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).where(F.col("n") >= often))
    hot = most_frequent(shared, "n", most).select("k1", "n").toPandas()
    hashes, totals = hot.k1.to_numpy(dtype=np.int64).view(U), hot.n.to_numpy(dtype=np.int64)
    rank = np.empty(len(hashes), dtype=np.int32)
    rank[np.lexsort((hashes, totals))] = np.arange(len(hashes), dtype=np.int32)
    by_hash = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[by_hash], rank[by_hash]))
    classes = scratch.save(both.where("kind = 0 and n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("sketch").alias("sketch")))
    total = classes.agg(F.sum("n")).collect()[0][0] or 0
    parts = max(shuffle_partitions(spark), total // 1_000_000)
    found = blobs(docs, size, percent, frequent, parts).groupBy("part").applyInPandas(shared_lists, "list long, hub long, doc long, h long, others int, n int")
    raw = scratch.save(found)
    lists = scratch.save(raw.where("hub is not null").select("list", "hub", "doc").distinct().join(classes.select(F.col("k1").alias("doc"), "n"), "doc"))
    often_lists = Frequent(raw.where("hub is null").select("list", "h", F.col("doc").alias("v"), "others", "n"), percent, scratch)
    scratch.drop(raw)
    sketches = classes.select(F.col("k1").alias("v"), "n", "sketch")
    near = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)

    def fetched(pairs: DataFrame) -> DataFrame:
        """The sets of all ends of the pairs."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        filled = spark.sparkContext.broadcast(bitmap(wanted))

        def cut(batches):
            seen, bits = set(), filled.value
            for pdf in batches:
                rows = []
                for s in shingle_sets([t or "" for t in pdf.text], size):
                    v = set_keys(s)[0]
                    at = v & (BITMAP - 1)
                    if len(s) and v not in seen and bits[at >> 5] >> np.uint32(at & 31) & np.uint32(1):
                        seen.add(v)
                        rows.append((v, s.tobytes()))
                yield pd.DataFrame(rows, columns=["v", "items"])

        return scratch.save(docs.mapInPandas(cut, "v long, items binary").join(wanted, "v", "left_semi").groupBy("v").agg(F.first("items").alias("items")))

    hubs = lists.where("doc = hub").select("list", F.col("n").alias("hub_n"))
    stars = lists.where("doc != hub").join(hubs, "list").where(near(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("l_v"), F.col("doc").alias("r_v"))
    stars = stars.unionByName(often_lists.stars()).select(F.least("l_v", "r_v").alias("a"), F.greatest("l_v", "r_v").alias("b")).distinct()
    stars = scratch.save(close(stars, sketches, percent))
    sets = fetched(stars)
    first = components(scratch.save(verified(stars, sets, percent)), scratch)
    scratch.drop(sets)
    # what a hub has not connected meets the rest of its lists
    rest = across(lists.select("list", F.col("doc").alias("v"), "n"), first, scratch).where(near(F.col("l_n"), F.col("r_n"))).select("l_v", "r_v")
    rest = rest.unionByName(often_lists.rest(first)).select(F.least("l_v", "r_v").alias("a"), F.greatest("l_v", "r_v").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    rest = scratch.save(close(rest, sketches, percent))
    sets = fetched(rest)
    near_by = joined_components(first, scratch.save(verified(rest, sets, percent)), scratch)
    scratch.drop(sets, lists)
    tagged = classes.drop("sketch").join(near_by, F.col("k1") == F.col("id"), "left").select("n", "k1", "k2", "members", "rep", F.coalesce("component", "k1").alias("vertex"))
    least = tagged.groupBy("vertex").agg(F.min("rep").alias("component"), F.sum("members").alias("all"))
    grouped = tagged.join(least.where("all > 1"), "vertex").select("n", "k1", "k2", "component")
    out = rows.join(grouped, ["n", "k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
