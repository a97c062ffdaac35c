"""Ranked lexical search: Block-Max MaxScore over compressed lists in shards, and a merge of the shards' heaps.

Documents become shards of a few thousand inside the tasks that read them, so nothing
of the corpus is shuffled.  A shard has one list a term, cut into blocks of delta-coded
documents and frequencies; every block and list has the largest impact of its
postings.  A search adds the lists of largest bound up first, until the bounds of the
others sum to less than the score to beat: those are not essential, and only score
documents that the essential ones brought up.  Block maxima turn such documents down
before a block is decoded.  Heaps live through all shards of a task and meet in a
window by item.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARD_DOCS, BLOCK, ITEM_BYTES = 4096, 64, 4 << 20
ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: bytes to terms: A-Z lower-cased, all other ASCII but digits and letters a space; characters beyond ASCII are terms byte by byte
FOLD = bytes(c if c >= 128 or c in ALNUM else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def counted(text: bytes | None) -> Counter:
    """Occurrences of each term."""
    return Counter((text or b"").translate(FOLD).split())


def least(x: np.ndarray) -> np.ndarray:
    """The same numbers in the least unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


WIDE = {1: np.uint8, 2: np.uint16, 4: np.uint32}
COUNTED = "docs long, tokens long, ids binary, nulls binary, lengths binary, terms array<int>, dfs array<int>, doc binary, tf binary, tf_width int"


def count_shards(docs: DataFrame, vocabulary, shard_docs: int) -> DataFrame:
    """Postings of the terms in ``vocabulary`` (a broadcast dictionary), one row a shard; docs and tokens count all documents with a term."""

    def shard(held):
        ids, nulls, lengths, where, term, tf, docs, tokens = held
        term, where, tf = (np.array(x, dtype=np.int64) for x in (term, where, tf))
        order = np.argsort(term, kind="stable")
        term, where, tf = term[order], where[order], least(tf[order])
        found, df = np.unique(term, return_counts=True)
        return (docs, tokens, np.array(ids, dtype=np.int64).tobytes(), np.array(nulls, dtype=bool).tobytes(), np.array(lengths, dtype=np.int64).tobytes(), found.tolist(), df.tolist(), where.astype(np.uint16).tobytes(), tf.tobytes(), tf.itemsize)

    def run(batches):
        known = vocabulary.value
        held = ([], [], [], [], [], [], 0, 0)
        for pdf in batches:
            for i, text in zip(pdf.id, pdf.text, strict=True):
                found = counted(text)
                n = sum(found.values())
                if not n:
                    continue
                ids, nulls, lengths, where, term, tf, docs, tokens = held
                own = [(known[t], c) for t, c in found.items() if t in known]
                if own:
                    where += [len(ids)] * len(own)
                    term += [k for k, _ in own]
                    tf += [c for _, c in own]
                    ids.append(0 if pd.isna(i) else int(i)), nulls.append(bool(pd.isna(i))), lengths.append(n)
                held = (ids, nulls, lengths, where, term, tf, docs + 1, tokens + n)
                if len(ids) >= shard_docs:
                    yield pd.DataFrame([shard(held)], columns=names)
                    held = ([], [], [], [], [], [], 0, 0)
        if held[6]:
            yield pd.DataFrame([shard(held)], columns=names)

    names = [c.split()[0] for c in COUNTED.split(", ")]
    return docs.mapInPandas(run, COUNTED)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def lengths_factor(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 25 + (25 * length * n) div total of each document."""
    if len(lengths) and 25 * int(lengths.max()) * n >= 1 << 63:
        return np.array([75 + (25 * int(x) * n) // total for x in lengths], dtype=np.int64)
    return 75 + (25 * lengths * n) // total


INDEX = "ids binary, nulls binary, factors binary, terms array<int>, dfs array<int>, cuts binary, first binary, last binary, tops binary, ends binary, payload binary"


def build_index(counts: DataFrame, n: int, total: int, block: int) -> DataFrame:
    """Blocks of every list: first and last document, largest impact, and the coded postings."""

    def shard(r):
        m = lengths_factor(np.frombuffer(r.lengths, dtype=np.int64), n, total)
        doc, tf = np.frombuffer(r.doc, dtype=np.uint16).astype(np.int64), np.frombuffer(r.tf, dtype=WIDE[r.tf_width]).astype(np.int64)
        impact = impacts(tf, m[doc])
        dfs = np.asarray(r.dfs, dtype=np.int64)
        ends = np.cumsum(dfs)
        starts = [np.arange(a, b, block) for a, b in zip((ends - dfs).tolist(), ends.tolist(), strict=True)]
        cuts = np.cumsum([0, *(len(x) for x in starts)]).astype(np.int32)
        starts = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        stops = np.minimum(starts + block, np.repeat(ends, np.diff(cuts)))
        tops = np.maximum.reduceat(impact, starts) if len(starts) else np.zeros(0, dtype=np.int64)
        out = []
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            gap, times = least(np.diff(doc[a:b], prepend=doc[a])), least(tf[a:b])
            out.append(bytes([gap.itemsize, times.itemsize]) + gap.tobytes() + times.tobytes())
        return (r.ids, r.nulls, m.tobytes(), r.terms, r.dfs, cuts.tobytes(), doc[starts].astype(np.int32).tobytes(), doc[stops - 1].astype(np.int32).tobytes(), tops.astype(np.int64).tobytes(), np.cumsum([0, *map(len, out)]).astype(np.int64).tobytes(), b"".join(out))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame([shard(r)], columns=[c.split()[0] for c in INDEX.split(", ")])

    return counts.mapInPandas(run, INDEX)


class Shard:
    """One row of the index: its lists by term, and blocks that are decoded when asked for."""

    def __init__(self, r):
        self.ids, self.nulls = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.nulls, dtype=bool)
        self.factors, self.payload = np.frombuffer(r.factors, dtype=np.int64), r.payload
        self.first, self.last = np.frombuffer(r.first, dtype=np.int32), np.frombuffer(r.last, dtype=np.int32)
        self.tops, self.ends = np.frombuffer(r.tops, dtype=np.int64), np.frombuffer(r.ends, dtype=np.int64)
        cuts = np.frombuffer(r.cuts, dtype=np.int32).tolist()
        self.lists = {t: (a, b) for t, a, b in zip(np.asarray(r.terms).tolist(), cuts[:-1], cuts[1:], strict=True)}
        self.top = {t: int(self.tops[a:b].max()) for t, (a, b) in self.lists.items()}
        self.blocks, self.whole = {}, {}
        self.decoded = 0

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of one block."""
        if k not in self.blocks:
            raw = self.payload[self.ends[k] : self.ends[k + 1]]
            a, b = raw[0], raw[1]
            n = (len(raw) - 2) // (a + b)
            doc = int(self.first[k]) + np.cumsum(np.frombuffer(raw, dtype=WIDE[a], count=n, offset=2), dtype=np.int64)
            tf = np.frombuffer(raw, dtype=WIDE[b], count=n, offset=2 + n * a).astype(np.int64)
            self.blocks[k] = doc, impacts(tf, self.factors[doc])
            self.decoded += 1
        return self.blocks[k]

    def list(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        if t not in self.whole:
            got = [self.block(k) for k in range(*self.lists[t])]
            self.whole[t] = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        return self.whole[t]

    def search(self, weights: list[tuple[int, int]], k: int, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (by place) and scores of this shard that may be among the k best; all of a score of ``beat`` or more that are.

        weights: (term, weight times repeats).
        """
        own = sorted(((self.top[t] * w, t, w) for t, w in weights if w and t in self.lists), reverse=True)
        below = np.cumsum([0, *(b for b, _, _ in reversed(own))])[::-1].tolist()  # what the lists from each place on can add
        beat, score, used = max(beat, 1), np.zeros(len(self.ids), dtype=np.int64), 0
        while used < len(own) and below[used] >= beat:  # an essential list
            doc, impact = self.list(own[used][1])
            score[doc] += own[used][2] * impact
            used += 1
            if (used < 4 or used % 4 == 0) and len(score) >= k:  # the k-th best so far can only rise
                beat = max(beat, int(np.partition(score, -k)[-k]))
        place = np.nonzero(score + below[used] >= np.where(score > 0, beat, np.iinfo(np.int64).max))[0]
        got, rest = score[place], own[used:]
        if len(rest) and len(place):
            spot, bound = np.full((len(rest), len(place)), -1), np.zeros((len(rest), len(place)), dtype=np.int64)
            for j, (_, t, w) in enumerate(rest):
                a, b = self.lists[t]
                at = a + np.searchsorted(self.last[a:b], place)
                inside = at < b
                inside[inside] = self.first[at[inside]] <= place[inside]
                spot[j, inside], bound[j, inside] = at[inside], w * self.tops[at[inside]]
            left = bound.sum(axis=0)
            for j, (_, _, w) in enumerate(rest):
                stay = got + left >= beat
                place, got, left, spot, bound = place[stay], got[stay], left[stay], spot[:, stay], bound[:, stay]
                left = left - bound[j]
                for s in np.unique(spot[j][spot[j] >= 0]).tolist():
                    who = np.nonzero(spot[j] == s)[0]
                    doc, impact = self.block(s)
                    at = np.minimum(np.searchsorted(doc, place[who]), len(doc) - 1)
                    same = doc[at] == place[who]
                    got[who[same]] += w * impact[at[same]]
        stay = got >= beat
        return place[stay], got[stay]


class Heap:
    """The k best documents of an item: highest score, then least id, ids that are null last."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.id = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)

    def beat(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score, null, ids) -> None:
        s, n, i = np.concatenate([self.score, score]), np.concatenate([self.null, null]), np.concatenate([self.id, ids])
        order = np.lexsort((i, n, -s))[: self.k]
        self.score, self.null, self.id = s[order], n[order], i[order]


def search_index(index: DataFrame, queries, k: int) -> DataFrame:
    """item (its place in ``queries``), doc_id, score: the k best of each task for each item."""

    def run(batches):
        asked = queries.value
        heaps = [Heap(k) for _ in asked]
        for pdf in batches:
            for r in pdf.itertuples():
                shard = Shard(r)
                for q, heap in zip(asked, heaps, strict=True):
                    place, score = shard.search(q, k, heap.beat())
                    if len(place):
                        heap.add(score, shard.nulls[place], shard.ids[place])
        rows = [pd.DataFrame({"item": np.int32(j), "doc_id": pd.Series(h.id, dtype="Int64").mask(h.null), "score": h.score}) for j, h in enumerate(heaps) if len(h.score)]
        if rows:
            yield pd.concat(rows, ignore_index=True)

    return index.mapInPandas(run, "item int, doc_id long, score long")


def item_blocks(items: DataFrame, most: int):
    """Lists of (item_id, counted terms) with texts of ``most`` bytes together, or of one longer text; one list is held at a time."""
    held, size = [], 0
    for r in items.toLocalIterator():
        n = len(r.text or b"")
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r.item_id, counted(bytes(r.text or b""))))
        size += n + 64
    if held:
        yield held


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", shard_docs: int = SHARD_DOCS, block: int = BLOCK, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, ties by ascending doc_id.

    Terms are runs of letters and digits, and of all characters beyond ASCII; only A-Z is
    lower-cased.  Null texts have none, and documents without terms are not counted.
    Every row of ``docs`` is a document: repeated ids are ranked each, null ids last among
    equals.  Equal rows of ``items`` are one item; texts that share an id are answered
    each on its own, under that id.  Items without terms that occur get no row.  No other
    columns are read.  Items are the query set: they pass the driver in lists of at most
    ``item_bytes`` of text, and all documents are read once for each list.
    """
    if not 0 < shard_docs <= 1 << 16:
        raise ValueError("a shard holds 1 to 65536 documents")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").cast("binary").alias("text")).distinct()
    answers = None
    for part in item_blocks(asked, item_bytes):
        known = {t: j for j, t in enumerate(sorted({t for _, terms in part for t in terms}))}
        vocabulary = spark.sparkContext.broadcast(known)
        counts = scratch.save(count_shards(rows, vocabulary, shard_docs))
        n, total = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        if not total:
            break
        index = scratch.save(build_index(counts, n, total, block))
        df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
        weight = {r.term: math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1))) for r in df.collect()}  # one row a term of this list of items
        queries = spark.sparkContext.broadcast([[(known[t], weight[known[t]] * c) for t, c in terms.items() if known[t] in weight] for _, terms in part])
        names = spark.createDataFrame([(j, i) for j, (i, _) in enumerate(part)], "item int, item_id long")
        best = search_index(index, queries, k)
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        # the names are one row an item of this list
        found = scratch.save(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        scratch.drop(counts, index)
        vocabulary.unpersist()
        queries.unpersist()
        answers = found if answers is None else answers.unionByName(found)
    return answers if answers is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
  s AS (SELECT count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
  i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
  q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM i GROUP BY ALL),
  u AS (SELECT doc_id, row, len(ws)::BIGINT AS len, unnest(ws) AS term FROM d),
  p AS (SELECT doc_id, row, len, term, count(*)::BIGINT AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
  w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
  x AS (SELECT doc_id, row, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n) // l))) AS part FROM p JOIN w USING (term), s),
  y AS (SELECT item_id, doc_id, row, sum(times * part)::BIGINT AS score FROM q JOIN x USING (term) GROUP BY ALL HAVING sum(times * part) > 0)
  SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM y) WHERE rank <= 20"""
