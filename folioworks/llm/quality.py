"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2], in time
linear in the number of features.  It is fitted on a bounded sample of labelled
rows (``max_train``); every row is scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_DIM = 1 << 15
EDGES = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
STATS = 14
BINS = 24
DIM = WORD_DIM + STATS * BINS + STATS
SYMBOL = re.compile(r"[#*$%&^~<>{}\[\]\\|=_]")
STEP = 128  # rows whose features are there at once
UPPER_WORD = re.compile(r"\b[^\W\d_a-z]{2,}\b")


def structure(text: str, n_chars) -> tuple[list[str], list[float]]:
    """Lower-cased words, and structure statistics between 0 and 1 (the last two are logarithms over 16)."""
    words, n = text.split(), max(1, len(text))
    low = [w.lower() for w in words]
    m = max(1, len(low))
    counts = Counter(low)
    top = max(counts.values(), default=0) / m
    again = sum(a == b for a, b in zip(low, low[1:])) / m
    lines = text.split("\n")
    letters = sum(map(str.isalpha, text)) or 1
    stats = [
        sum(map(str.isupper, text)) / letters,
        text.count("!") / m if m else 0.0,
        len(SYMBOL.findall(text)) / n,
        sum(map(str.isdigit, text)) / n,
        len(counts) / m,
        top,
        again,
        1 - len(set(lines)) / max(1, len(lines)),
        text.count("|") / m,
        (text.count(".") + text.count(",")) / m,
        len(UPPER_WORD.findall(text)) / m,
        min(1.0, n / m / 16),
        min(1.0, np.log1p(len(words)) / 12),
        min(1.0, np.log1p(n_chars) / 16) if n_chars is not None and n_chars >= 0 else 0.0,
    ]
    return low, [min(1.0, float(s)) for s in stats]


def features(text: str | None, n_chars) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values: distinct words with weight 1/sqrt(count of distinct words), one bin and the plain value for each statistic."""
    low, stats = structure(text or "", n_chars)
    words = np.fromiter((zlib.crc32(w.encode()) % WORD_DIM for w in set(low)), dtype=np.int64)
    bins = WORD_DIM + np.arange(STATS) * BINS + np.searchsorted(EDGES, stats)
    plain = WORD_DIM + STATS * BINS + np.arange(STATS)
    weight = 1 / np.sqrt(max(1, len(words)))
    return np.concatenate([words, bins, plain]), np.concatenate([np.full(len(words), weight), np.full(STATS, 0.5), np.array(stats)])


def ragged(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
    return np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts


class FactorMachine:
    def __init__(self, k: int = 8, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(DIM)
        self.v = np.random.default_rng(seed).normal(0, 0.03, (DIM, k))

    def raw(self, at, x, starts):
        vx = self.v[at] * x[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        q = np.add.reduceat(vx * vx, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * (s * s - q).sum(axis=1), vx, s

    def fit(self, rows, labels, rounds: int = 6, batch: int = 128, rate: float = 0.08, decay: float = 1e-4, seed: int = 7):
        """AdaGrad on the logistic loss."""
        rng, y = np.random.default_rng(seed), np.asarray(labels, dtype=float)
        gw, gv, g0 = np.full(DIM, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for b in range(0, len(order), batch):
                own = order[b : b + batch]
                at, x, starts = ragged([rows[i] for i in own])
                z, vx, s = self.raw(at, x, starts)
                err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]
                each = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(at))))
                e = err[each] * x
                ids, inv = np.unique(at, return_inverse=True)
                dw = np.bincount(inv, e, len(ids)) / len(own) + decay * self.w[ids]
                part = e[:, None] * (s[each] - vx)
                dv = np.stack([np.bincount(inv, part[:, f], len(ids)) for f in range(part.shape[1])], axis=1) / len(own) + decay * self.v[ids]
                d0 = err.mean()
                gw[ids] += dw * dw
                gv[ids] += dv * dv
                g0 += d0 * d0
                self.w[ids] -= rate * dw / np.sqrt(gw[ids])
                self.v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
                self.w0 -= rate * d0 / np.sqrt(g0)
        return self

    def score(self, rows) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        z, _, _ = self.raw(*ragged(rows))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bucket(doc_id, n: int = 4):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8000, held_out: int = 2) -> FactorMachine:
    """Fits on at most ``max_train`` labelled rows outside the held-out quarter, those of least hash.

    Ids with contradicting or null labels, null ids and repeated documents beyond
    the first are left out.  Without both labels the machine stays at its prior.
    """
    own = labels.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (F.col("label") == F.col("other")) & (bucket(F.col("doc_id")) != held_out))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select("doc_id", "label")

    def extract(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                part = whole.slice(a, STEP)
                rows = [features(t, n) for t, n in zip(part["text"].to_pylist(), part["n_chars"].to_pylist(), strict=True)]
                at, x, starts = ragged(rows)
                ends = pa.array(np.append(starts, len(at)).astype("int32"))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (at.astype("int32"), x)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], *lists], names=["doc_id", "label", "at", "x"])

    # at most max_train rows are broadcast and come back
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_chars").join(F.broadcast(picked.withColumn("label", F.col("label").cast("int"))), "doc_id").mapInArrow(extract, "doc_id long, label int, at array<int>, x array<double>")
    got = sample.dropDuplicates(["doc_id"]).toArrow().combine_chunks()
    machine = FactorMachine()
    label = got["label"].to_numpy()
    if len(set(label.tolist())) < 2:
        machine.w0 = 2.0 if not len(label) or label[0] == 1 else -2.0
        return machine
    # views of the two columns' values; nothing is copied row by row
    columns = []
    for name in ("at", "x"):
        lists = got[name].combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        columns.append([values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    return machine.fit([(columns[0][i], columns[1][i]) for i in order], label[order])


def with_n_chars(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.length("text").cast("long"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 8000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, held_out, score (0..1) and predicted (1 from ``threshold`` on) for every row.

    A null or empty text is scored by its (zero) statistics; a null id is not held
    out; repeated rows score alike; other columns, whatever their names, are not read.
    """
    docs = with_n_chars(docs)
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train))  # DIM x (k + 1) numbers
    own = {"text": "__text", "n_chars": "__n"}  # what is kept anyway does not go to Python twice
    more = [F.col(c).alias(own[c]) for c in own if c not in keep]
    base = docs.select(*keep, F.coalesce(bucket(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), *more)
    text_at, n_at = [base.columns.index(c if c in keep else own[c]) for c in own]
    given = [f for f in base.schema if f.name not in own.values()]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given]

    def run(batches):
        fm = machine.value
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                part = whole.slice(a, STEP)
                score = fm.score([features(t, n) for t, n in zip(part.column(text_at).to_pylist(), part.column(n_at).to_pylist(), strict=True)])
                columns = [*part.columns[: len(given)], pa.array(score), pa.array((score >= threshold).astype("int32"))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[: len(given)], "score", "predicted"])

    return base.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))
