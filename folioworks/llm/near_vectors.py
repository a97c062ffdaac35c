"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors of a label are one class with a weight.  Each class is put, in each
of ``tables`` tables, into the bucket of its hash (the nearest signed axis after a
rotation, twice) and shown to the next-best buckets.  A pair is verified where
it first meets; which table and bucket that is follows from the two hashes alone,
so links are counted once without any list of pairs.  Buckets of many members
are cut into blocks that meet two by two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .components import components
from .vectors import rotations, usable

PROBES = 4


def probes(x: np.ndarray, tables: int, seed: int = 5) -> np.ndarray:
    """(rows, tables, PROBES) bucket codes, the own bucket first.

    A code joins the nearest signed axes of two rotations; the others take the
    second nearest axis in one or both of them.
    """
    picks = []
    for y in rotations(x, 2 * tables, seed):
        size = y.shape[1]
        top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
        value = np.take_along_axis(y, top, axis=1)
        swap = np.abs(value[:, 0]) < np.abs(value[:, 1])
        top[swap], value[swap] = top[swap][:, ::-1], value[swap][:, ::-1]
        picks.append(top + size * (value < 0))
    codes = []
    for t in range(tables):
        a, b = picks[2 * t], picks[2 * t + 1]
        width = 1 << 16
        codes.append(np.stack([a[:, 0] * width + b[:, 0], a[:, 1] * width + b[:, 0], a[:, 0] * width + b[:, 1], a[:, 1] * width + b[:, 1]], axis=1))
    return np.stack(codes, axis=1)


def classes_of(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, k1, k2 (keys of label and vector; null if the row links with nothing) and the vector as doubles."""

    def run(batches):
        for pdf in batches:
            k1, k2, raw = [], [], []
            for v, g in zip(pdf.vector, pdf.label, strict=True):
                x = None if pd.isna(g) else usable(v)
                if x is None:
                    k1.append(None), k2.append(None), raw.append(None)
                    continue
                b = (x + 0.0).tobytes()
                h = xxhash.xxh3_128_intdigest(b + str(int(g)).encode())
                k1.append((h >> 64) - (1 << 63)), k2.append((h & ((1 << 64) - 1)) - (1 << 63)), raw.append(b)
            yield pd.DataFrame({"vec_id": pdf.vec_id.astype("Int64"), "label": pdf.label.astype("Int64"), "k1": pd.array(k1, dtype="Int64"), "k2": pd.array(k2, dtype="Int64"), "x": raw})

    picked = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).cast("long").alias("label"))
    return picked.mapInPandas(run, "vec_id long, label long, k1 long, k2 long, x binary")


ENTRY = "bucket long, t int, code long, own boolean, v long, members long, x binary, codes binary"


def entries(classes: DataFrame, tables: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            size = pdf.x.str.len()
            for n, g in pdf.groupby(size):
                x = np.stack([np.frombuffer(b, dtype=np.float64) for b in g.x])
                codes = probes(x / np.linalg.norm(x, axis=1, keepdims=True), tables)
                flat = [c.tobytes() for c in codes]
                for t in range(tables):
                    for p in range(PROBES):
                        code = codes[:, t, p]
                        bucket = [xxhash.xxh3_64_intdigest(f"{a}:{n}:{t}:{c}") - (1 << 63) for a, c in zip(g.label.tolist(), code.tolist(), strict=True)]
                        yield pd.DataFrame({"bucket": bucket, "t": np.int32(t), "code": code, "own": p == 0, "v": g.v.to_numpy(), "members": g.members.to_numpy(), "x": g.x.to_numpy(), "codes": flat})

    return classes.select("label", "v", "members", "x").mapInPandas(run, ENTRY)


def met_before(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Whether each pair of code rows meets in a table before t."""
    if t == 0:
        return np.zeros(len(a), dtype=bool)
    p, q = a[:, :t], b[:, :t]
    return ((p[:, :, :1] == q).any(axis=2) | (q[:, :, :1] == p).any(axis=2)).any(axis=1)


def bucket_links(x, own, codes, block, t, code, cosine):
    """Index pairs (i, j) of a bucket that are linked and meet here first."""
    out_i, out_j = [], []
    for a in range(0, len(x), 1024):
        for b in range(a, len(x), 1024):
            close = x[a : a + 1024] @ x[b : b + 1024].T >= cosine
            i, j = np.nonzero(close)
            i, j = i + a, j + b
            keep = (i < j) & (own[i] | own[j])
            if block is not None:
                keep &= block[i] != block[j]
            i, j = i[keep], j[keep]
            ci, cj = codes[i, t, 0], codes[j, t, 0]
            both_see = (ci[:, None] == codes[j, t]).any(axis=1) & (cj[:, None] == codes[i, t]).any(axis=1)
            keep = ((ci == cj) | ~both_see | (np.minimum(ci, cj) == code)) & ~met_before(codes[i], codes[j], t)
            out_i.append(i[keep]), out_j.append(j[keep])
    return np.concatenate(out_i), np.concatenate(out_j)


def part_links(pdf: pd.DataFrame, tables: int, cosine: float) -> pd.DataFrame:
    """Of all buckets of one part: weights of links for each class, and links that join each bucket's groups."""
    pdf = pdf.sort_values(["bucket", "i", "j"], kind="stable").reset_index(drop=True)
    key = pdf[["bucket", "i", "j"]].to_numpy()
    cut = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))[0]
    ids, members, own_all, block_all = pdf.v.to_numpy(), pdf.members.to_numpy(), pdf.own.to_numpy(), pdf.block.to_numpy()
    n_links, edges = {}, set()
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a < 2 or not own_all[a:b].any():
            continue
        x = np.stack([np.frombuffer(r, dtype=np.float64) for r in pdf.x[a:b]])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        codes = np.stack([np.frombuffer(r, dtype=np.int64).reshape(tables, PROBES) for r in pdf.codes[a:b]])
        across = block_all[a:b] if pdf.i[a] != pdf.j[a] else None
        i, j = bucket_links(x, own_all[a:b], codes, across, int(pdf.t[a]), int(pdf.code[a]), cosine)
        if not len(i):
            continue
        v, w = ids[a:b], members[a:b]
        for k, c in zip(*(z.tolist() for z in (v, np.bincount(i, w[j], len(v)) + np.bincount(j, w[i], len(v)))), strict=True):
            if c:
                n_links[k] = n_links.get(k, 0) + int(c)
        group = np.arange(len(v))
        while True:  # the least index that links reach
            low = group.copy()
            np.minimum.at(low, i, group[j])
            np.minimum.at(low, j, group[i])
            low = low[low]
            if (low == group).all():
                break
            group = low
        edges.update((p, q) for p, q in zip(v.tolist(), v[group].tolist(), strict=True) if p != q)
    rows = [(k, None, c) for k, c in n_links.items()] + [(p, q, 0) for p, q in edges]
    return pd.DataFrame(rows, columns=["v", "u", "n"]).astype({"v": "int64", "u": "Int64", "n": "int64"})


def dedup_vectors(vectors: DataFrame, cosine: float = 0.93, tables: int = 8, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link when their labels are equal and not null and their cosine, in double
    precision, is at least ``cosine``.  n_links counts linked rows other than itself;
    component_id is the least id that links reach; kept is vec_id = component_id.
    Rows whose vector is null, empty, zero or holds null or non-finite components,
    vectors of other length and null labels link with nothing.  Repeated rows link
    with each other.  A null id is never kept.  Other columns are not read.

    Which pairs meet is a matter of hashing: a pair at the threshold meets in one of
    eight tables with probability above 0.999; none below the threshold is linked.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = scratch.save(classes_of(vectors, vec_id, vector, label))
    classes = rows.where("k1 is not null and vec_id is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("v"), F.count("*").alias("members"), F.first("label").alias("label"), F.first("x").alias("x"))
    classes = scratch.save(classes)
    put = entries(classes.repartition(shuffle_partitions(spark), "v"), tables)
    big = scratch.save(put.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 2 * block))
    put = put.join(big, "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)))
    put = put.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    put = put.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")).withColumn("part", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(shuffle_partitions(spark), 48))))
    put = put.drop("n", "blocks", "with")
    found = scratch.save(put.groupBy("part").applyInPandas(lambda pdf: part_links(pdf, tables, cosine), "v long, u long, n long"))
    groups = components(found.where("u is not null").select(F.col("v").alias("a"), F.col("u").alias("b")), scratch)
    counts = found.where("u is null").groupBy("v").agg(F.sum("n").alias("n"))
    known = classes.select("k1", "k2", "v", "members").join(counts, "v", "left").join(groups.withColumnRenamed("id", "v"), "v", "left")
    known = known.select("k1", "k2", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "v").alias("component_id")).where("n_links > 0")
    out = rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
