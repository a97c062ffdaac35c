"""Packing of tokenized documents into sequences: cutting stock by column generation.

The work over documents is Spark's: tokenizing and cutting (a map), a histogram
of piece lengths (at most ``size`` rows), ranks within each length, and one
broadcast join of ranked pieces with the pattern table.  The linear program sees
only the histogram, whose size does not depend on the data.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

_ENCODERS: dict = {}
#: Runs without a blank from this length on go to a merge that stays n log n on any input.
LONG_RUN = 2000


def id_encoder(path: str):
    """Text -> ids as little-endian 32-bit words; one per worker process.

    ids are those of the ``tokenizers`` file.  Its vocabulary numbers tokens in
    merge order, so the same merges run several times faster as ranks in tiktoken
    (tests compare both).  Texts with a very long run without blanks go through
    ``tokenizers`` itself.
    """
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t.content for t in tok.get_added_tokens_decoder().values()}
        ranks = {bytes(letter[c] for c in t): i for t, i in tok.get_vocab().items() if t not in special}
        fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> bytes:
            if max(map(len, text.split(" "))) < LONG_RUN:
                return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            return np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

        _ENCODERS[path] = encode
    return _ENCODERS[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, text: str = "text") -> DataFrame:
    """One row per piece: whole pieces of ``size`` ids and a rest.  A null or empty text is its end id alone."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        import pandas as pd

        enc, step = id_encoder(tokenizer_path), 4 * size
        for pdf in batches:
            rows = []
            for doc_id, t in zip(pdf.doc_id.tolist(), pdf.text.tolist(), strict=True):
                ids = (enc(t) if t else b"") + end
                n = len(ids) // 4
                rows += [(doc_id, k // 4, min(size, n - k // 4), zlib.crc32(ids[k : k + step]), n) for k in range(0, len(ids), step)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(run, PIECES)


def best_pattern(size: int, lengths: np.ndarray, values: np.ndarray) -> tuple[float, dict[int, int]]:
    """The unbounded knapsack by dynamic programming: the most valuable multiset of lengths that fits."""
    use = values > 1e-12
    ls, vs, at = lengths[use], values[use], np.nonzero(use)[0]
    if not len(ls):
        return 0.0, {}
    best, taken = np.zeros(size + 1), np.full(size + 1, -1)
    fits = np.searchsorted(ls, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        best[c], k = best[c - 1], fits[c]
        if k:
            gain = best[c - ls[:k]] + vs[:k]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], taken[c] = gain[i], i
    counts: dict[int, int] = {}
    c = size
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            i = taken[c]
            counts[int(at[i])] = counts.get(int(at[i]), 0) + 1
            c -= int(ls[i])
    return float(best[size]), counts


def column_generation(hist: dict[int, int], size: int, gap: float = 1e-3, rounds: int = 9000) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: copies} with the number of times each is cut; they hold every piece exactly once.

    Revised simplex over patterns: each round prices a new pattern by the knapsack
    over the duals, and stops once no pattern is worth more than 1 + gap, when the
    solution is within that gap of the linear bound (or after ``rounds``).  Counts
    are rounded down; what is left, at most a few pieces per pattern, is packed
    first-fit by falling length.
    """
    lengths = np.array(sorted(k for k, v in hist.items() if v > 0 and k < size), dtype=np.int64)
    out: list[tuple[dict[int, int], int]] = [({size: 1}, hist[size])] if hist.get(size) else []
    m = len(lengths)
    if not m:
        return out
    need = np.array([hist[int(k)] for k in lengths], dtype=float)
    # a tiny, different surplus for each row keeps the ratio test from cycling
    rhs = need + np.arange(1, m + 1) * 1e-7
    copies = size // lengths
    patterns = [{i: int(copies[i])} for i in range(m)]
    inverse, x = np.diag(1.0 / copies), rhs / copies
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        worth, new = best_pattern(size, lengths, duals)
        if worth <= 1 + gap or x.sum() * (1 - 1 / worth) < 0.5:  # within the gap, or half a sequence, of the bound
            break
        way = sum(inverse[:, i] * c for i, c in new.items())
        ratios = np.full(m, np.inf)
        np.divide(x, way, out=ratios, where=way > 1e-9)
        r = int(ratios.argmin())
        if not np.isfinite(ratios[r]):
            break
        row = inverse[r] / way[r]
        t = x[r] / way[r]
        touched = np.nonzero(way)[0]
        inverse[touched] -= np.outer(way[touched], row)
        inverse[r] = row
        x -= way * t
        x[r] = t
        patterns[r] = new
    left = need.astype(np.int64)
    for p, times in sorted(zip(patterns, np.floor(np.maximum(x, 0) + 1e-6).astype(np.int64).tolist(), strict=True), key=lambda z: -z[1]):
        times = min([times, *(int(left[i]) // c for i, c in p.items())])
        if times > 0:
            out.append(({int(lengths[i]): c for i, c in p.items()}, times))
            for i, c in p.items():
                left[i] -= c * times
    while left.any():  # by falling length, each time as many copies as fit
        room, p = size, {}
        for i in np.nonzero(left)[0][::-1].tolist():
            c = min(int(left[i]), room // int(lengths[i]))
            if c:
                p[i] = c
                room -= c * int(lengths[i])
        times = min(int(left[i]) // c for i, c in p.items())
        out.append(({int(lengths[i]): c for i, c in p.items()}, times))
        for i, c in p.items():
            left[i] -= c * times
    return out


SLOTS = "kind long, first long, last long, copies long, sequence long, place long"


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length class, which of its ranks (from 0, last exclusive) go to which pattern, and where in it."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for p, times in patterns:
        place = 0
        for k, c in sorted(p.items(), reverse=True):
            first = given.get(k, 0)
            given[k] = first + c * times
            rows.append((k, first, given[k], c, sequence, place))
            place += c
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, text: str = "text", grain: int = 4, buckets: int = 256) -> DataFrame:
    """Packs every document into sequences of at most ``size`` ids; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null and empty texts are one piece of one id; repeated rows are packed each on
    its own; an empty table gives no rows.  Other columns are left out.

    Lengths are taken in classes of ``grain`` ids, rounded up, for the linear
    program (at most grain - 1 ids of room lost for a piece); offsets then follow
    from the true lengths.  Ranks are taken within (class, bucket of the id) and
    shifted by the counts of earlier buckets, so a length that a third of all
    pieces have is no single group.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(cut_documents(docs, tokenizer_path, size, end_id, text))
    pieces = pieces.withColumn("kind", F.ceil(F.col("length") / grain)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    # at most size / grain x buckets rows, whatever the input
    counts = {(r.kind, r.bucket): r.n for r in pieces.groupBy("kind", "bucket").agg(F.count("*").alias("n")).collect()}
    hist: dict[int, int] = {}
    before = []
    for (k, b), n in sorted(counts.items()):
        before.append((k, b, hist.get(k, 0)))
        hist[k] = hist.get(k, 0) + n
    table = spark.createDataFrame(slots(column_generation(hist, size // grain)), SLOTS)
    shift = spark.createDataFrame(before, "kind long, bucket int, before long")
    within = Window.partitionBy("kind", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(shift), ["kind", "bucket"])  # at most size / grain x buckets rows
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    # patterns number at most a few per class, whatever the input
    placed = ranked.join(F.broadcast(table), "kind").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    k = F.col("rank") - F.col("first")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(k / F.col("copies"))).withColumn("slot", F.col("place") + k % F.col("copies"))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most size rows
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
