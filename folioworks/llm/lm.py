"""Gated recurrent language model over words, with a class-factored output.

Counts of all training tokens come from Spark.  The network (numpy, truncated
backpropagation) knows the most frequent words; any other word is one of a few
kinds by its ending, times its share among the words of that kind, so the
probabilities of all words add up to one and the score compares with the
unigram base.  Scoring carries the state across windows of a document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, Scratch, most_frequent

KINDS, CLASSES, HIDDEN = 64, 64, 32
BLANKS = "\t\n\x0b\x0c\r"
LOG10 = float(np.log(10))
TOGETHER = 8192  # rows whose documents are sorted by length: the longest decide the number of steps


def plain(text):
    """A-Z lower-cased and every ASCII white space a blank; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER + BLANKS, ASCII_LOWER + " " * len(BLANKS))


def word_kind(word):
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % KINDS).cast("int")


class Vocabulary:
    """ids: 0 the end, 1..KINDS the kinds of other words, then the known words; each id has a class of like total frequency."""

    def __init__(self, words: list[str], counts: list[int], ends: int, kinds: list[int]):
        self.id_of = {w: 1 + KINDS + i for i, w in enumerate(words)}
        freq = np.array([ends, *kinds, *counts], dtype=float) + 1
        order = np.argsort(-freq, kind="stable")
        mass = np.cumsum(np.sqrt(freq[order]))
        cls = np.empty(len(freq), dtype=np.int64)
        cls[order] = np.minimum(CLASSES - 1, (mass / mass[-1] * CLASSES).astype(np.int64))
        self.size = len(freq)
        self.by_class = np.argsort(cls, kind="stable")  # ids, class by class
        self.start = np.searchsorted(cls[self.by_class], np.arange(CLASSES + 1))
        self.cls, self.place = cls, np.empty(len(freq), dtype=np.int64)
        self.place[self.by_class] = np.arange(len(freq)) - self.start[cls[self.by_class]]
        self.log_freq = np.log(freq)

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.id_of.get
        return np.array([get(w) or 1 + zlib.crc32(w[-2:].encode()) % KINDS for w in words] + [0], dtype=np.int32)


def softmax(x, rows, at):
    """Log-probability of column ``at`` of each row, and the exponentials of ``x`` (in place) and their sums.

    Values beyond the range of float32's exponential are held at its edge.
    """
    np.clip(x, -80, 80, out=x)
    logp = x[rows, at].astype(np.float64)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], dtype=np.float32)
    logp -= np.log(total)
    return logp, x, total


class GatedModel:
    """Parameters in float32: g holds each word's input to the three gates, u the recurrence, c and o the two outputs.

    Rows of o and ob are in the order of the classes, so that the words of a class
    are one slice.  Windows are time-major and their documents sorted by length: at
    each step the live ones are a prefix, and no mask is needed.
    """

    def __init__(self, vocabulary: Vocabulary, seed: int = 11):
        rng, h, v = np.random.default_rng(seed), HIDDEN, vocabulary
        self.v = v
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.p = {"g": f(v.size, 3 * h), "u": f(h, 3 * h), "c": f(h, CLASSES), "o": f(v.size, h)}
        bias = v.log_freq[v.by_class]
        mass = np.array([np.logaddexp.reduce(bias[a:b]) if b > a else -30.0 for a, b in zip(v.start[:-1], v.start[1:], strict=True)])
        self.p["cb"] = (mass - np.logaddexp.reduce(mass)).astype(np.float32)
        self.p["ob"] = (bias - np.repeat(mass, np.diff(v.start))).astype(np.float32)
        self.sums = None

    def forward(self, tokens, live, before, h, keep=None):
        """States (steps, docs, hidden) after each token's left neighbour; appends what the gradient needs to ``keep``.

        ``tokens`` is (steps, docs), ``live`` the count of documents at each step.
        """
        n, u = HIDDEN, self.p["u"]
        inputs = np.concatenate([before[None], tokens[:-1]])
        states = np.zeros((len(tokens) + 1, len(h), n), dtype=np.float32)
        states[0] = h
        for t, k in enumerate(live):
            last, a = states[t, :k], self.p["g"][inputs[t, :k]]
            b = last @ u
            zr = a[:, : 2 * n] + b[:, : 2 * n]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5  # the logistic function
            z, r = zr[:, :n], zr[:, n:]
            m = r * b[:, 2 * n :]
            m += a[:, 2 * n :]
            np.tanh(m, out=m)
            new = states[t + 1, :k]
            np.subtract(last, m, out=new)
            new *= z
            new += m
            if keep is not None:
                keep.append((z, r, m, b[:, 2 * n :]))
        return inputs, states

    def outputs(self, hs, target, train=False):
        """Natural log-probabilities of the targets after the states hs; with ``train`` also the states' gradient, after an update of the output weights."""
        p, v = self.p, self.v
        cls = v.cls[target]
        order = np.argsort(cls, kind="stable")
        hs, cls, place = hs[order], cls[order], v.place[target[order]]
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        rows = np.arange(len(hs))
        x = hs @ p["c"]
        x += p["cb"]
        logp, d, total = softmax(x, rows, cls)
        scale = np.float32(max(1, len(hs)) ** -0.5)
        dh = None
        if train:
            d /= total[:, None]
            d[rows, cls] -= 1
            dh = d @ p["c"].T
            c, cb = hs.T @ d, np.ones(len(d), dtype=np.float32) @ d
        for k in np.nonzero(np.diff(cuts))[0]:
            own, ids = slice(cuts[k], cuts[k + 1]), slice(v.start[k], v.start[k + 1])
            o, part = p["o"][ids], hs[own]
            x = part @ o.T
            x += p["ob"][ids]
            i = rows[: len(x)]
            more, d, total = softmax(x, i, place[own])
            logp[own] += more
            if train:
                d /= total[:, None]
                d[i, place[own]] -= 1
                dh[own] += d @ o
                self.move("o", ids, (d.T @ part) * scale)
                self.move("ob", ids, (np.ones(len(d), dtype=np.float32) @ d) * scale, 0.05)
        if train:
            self.move("c", slice(None), c * scale)
            self.move("cb", slice(None), cb * scale, 0.05)
        back = np.empty_like(order)
        back[order] = rows
        return (logp[back], dh[back]) if train else logp[back]

    def train_window(self, tokens, live, before, h):
        """One window; returns the last states."""
        n, u, kept = HIDDEN, self.p["u"], []
        inputs, states = self.forward(tokens, live, before, h, kept)
        there = np.arange(tokens.shape[1]) < np.array(live)[:, None]
        _, dh = self.outputs(states[1:][there], tokens[there], train=True)
        full = np.zeros_like(states[1:])
        full[there] = dh
        da = np.zeros((*tokens.shape, 3 * n), dtype=np.float32)
        db = np.zeros_like(da)
        d = np.zeros_like(h)
        for t in range(len(live) - 1, -1, -1):
            k = live[t]
            z, r, m, b = kept[t]
            own = d[:k]
            own += full[t, :k]
            dm = own * (1 - z)
            dm *= 1 - m * m
            x, y = da[t, :k], db[t, :k]
            x[:, :n] = own * (states[t, :k] - m) * z * (1 - z)
            x[:, n : 2 * n] = dm * b * r * (1 - r)
            x[:, 2 * n :] = dm
            y[:, : 2 * n] = x[:, : 2 * n]
            y[:, 2 * n :] = dm * r
            own *= z
            own += y @ u.T
        scale = np.float32(max(1, int(there.sum())) ** -0.5)
        self.move("u", slice(None), (states[:-1].reshape(-1, n).T @ db.reshape(-1, 3 * n)) * scale)
        flat = inputs[there]
        order = np.argsort(flat, kind="stable")
        ids, first = np.unique(flat[order], return_index=True)
        self.move("g", ids, np.add.reduceat(da[there][order], first, axis=0) * scale)
        return states[-1]

    def move(self, name, at, gradient, rate=0.15):
        """One step of rows ``at`` of a parameter against a clipped gradient, by the root of the squares so far."""
        if self.sums is None:
            self.sums = {k: np.full_like(x, 1e-8) for k, x in self.p.items()}
        np.clip(gradient, -1, 1, out=gradient)
        seen = self.sums[name][at] + gradient * gradient
        self.sums[name][at] = seen
        gradient *= np.float32(rate)
        gradient /= np.sqrt(seen)
        self.p[name][at] -= gradient

    def fit(self, documents: list[np.ndarray], batch: int = 96, steps: int = 32):
        """One pass; documents of like length go side by side, the state is carried from window to window."""
        order = sorted(range(len(documents)), key=lambda i: len(documents[i]))
        groups = [order[b : b + batch] for b in range(0, len(order), batch)]
        for g in np.random.default_rng(1).permutation(len(groups)):
            self.windows([documents[i] for i in groups[g]], steps, self.train_window)
        return self

    def windows(self, docs, steps, do):
        """Feeds ``docs``, longest first, window by window to ``do(tokens, live, before, h)``, which returns the next states."""
        h, before = np.zeros((len(docs), HIDDEN), dtype=np.float32), np.zeros(len(docs), dtype=np.int64)
        docs = sorted(docs, key=lambda d: -len(d))
        for a in range(0, len(docs[0]), steps):
            some = sum(len(d) > a for d in docs)
            h, before, docs = h[:some], before[:some], docs[:some]
            part = [d[a : a + steps] for d in docs]
            tokens, lens = np.zeros((some, len(part[0])), dtype=np.int64), np.array([len(x) for x in part])
            for r, x in enumerate(part):
                tokens[r, : len(x)] = x
            live = [int(k) for k in (lens[:, None] > np.arange(len(part[0]))).sum(axis=0)]
            tokens = np.ascontiguousarray(tokens.T)
            h = do(tokens, live, before, h)
            before = tokens[-1]

    def score(self, documents: list[np.ndarray], batch: int = 512, steps: int = 32) -> np.ndarray:
        """Natural log-probability of each whole document."""
        out = np.zeros(len(documents))
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        for b in range(0, len(order), batch):
            own = np.array(order[b : b + batch])

            def do(tokens, live, before, h, own=own):
                _, states = self.forward(tokens, live, before, h)
                there = np.arange(tokens.shape[1]) < np.array(live)[:, None]
                logp = np.zeros(tokens.shape)
                logp[there] = self.outputs(states[1:][there], tokens[there])
                out[own[: tokens.shape[1]]] += logp.sum(axis=0)
                return states[-1]

            self.windows([documents[i] for i in own], steps, do)
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> "GatedModel":
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self


CHUNK = 1 << 14


def train(docs: DataFrame, vocabulary: Vocabulary, first: int, total: int) -> np.ndarray:
    """Parameters: a start on about ``first`` whole documents (at most twice as many), then one pass over all training documents.

    In the pass each partition trains a copy on its own documents; the copies are
    averaged by their tokens, in chunks, on the executors.
    """
    spark = docs.sparkSession
    some = [vocabulary.ids([w for w in r.plain.split(" ") if w]) for r in docs.where(F.pmod(F.xxhash64("plain", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, first / max(1, total)) * (1 << 20))).select("plain").limit(2 * first).collect()]
    model = GatedModel(vocabulary)
    if some:
        model.fit(some, batch=24)
    base = spark.sparkContext.broadcast((vocabulary, model.flat()))

    def run(batches):
        voc, flat = base.value
        own, tokens = GatedModel(voc).load(flat), 0
        for whole in batches:
            for a in range(0, len(whole), TOGETHER):
                ids = [voc.ids([w for w in t.split(" ") if w]) for t in whole.plain.iloc[a : a + TOGETHER]]
                own.fit(ids)
                tokens += sum(map(len, ids))
        if tokens:
            got = own.flat().astype(np.float64) * tokens
            yield pd.DataFrame([(k, tokens, got[a : a + CHUNK].tobytes()) for k, a in enumerate(range(0, len(got), CHUNK))], columns=["chunk", "tokens", "sums"])

    def add(pdf):
        total = sum(np.frombuffer(b, dtype=np.float64) for b in pdf.sums) / pdf.tokens.sum()
        return pd.DataFrame([(pdf.chunk.iloc[0], int(pdf.tokens.sum()), total.astype(np.float32).tobytes())], columns=["chunk", "tokens", "sums"])

    schema = "chunk int, tokens long, sums binary"
    rows = docs.select("plain").mapInPandas(run, schema).groupBy("chunk").applyInPandas(add, schema).collect()
    return np.concatenate([np.frombuffer(r.sums, dtype=np.float32) for r in sorted(rows, key=lambda r: r.chunk)]) if rows else model.flat()


def score_documents(docs: DataFrame, text: str = "text", words: int = 4096, lookup: int = 131_072, first: int = 600) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for every row.

    A document is its words and one end; a null or empty text is the end alone.  A
    null id is not held out.  Repeated rows score alike; other columns are not read.
    All training documents count, and the network learns from all of them.  ``words``
    (the network's) and ``lookup`` (broadcast counts) are fixed sizes; counts of
    other words are joined.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = docs.select("doc_id", held.alias("held_out"), plain(F.col(text)).alias("plain"))
    training = docs.where(~F.col("held_out"))
    counts = training.select(F.explode(F.split("plain", " ")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("c"))
    counts = scratch.save(counts)
    ends = training.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).collect()[0]
    top = most_frequent(counts, "c", lookup).toPandas().sort_values(["c", "word"], ascending=[False, True])  # at most `lookup` rows
    known = top.iloc[:words]
    inner = spark.createDataFrame(known[["word"]], "word string") if len(known) else counts.limit(0).select("word")
    rest = counts.join(F.broadcast(inner), "word", "left_anti").groupBy(word_kind(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    kind_n, kind_v = np.zeros(KINDS), np.zeros(KINDS)
    for r in rest:
        kind_n[r.k], kind_v[r.k] = r.n, r.v
    vocabulary = Vocabulary(known.word.tolist(), known.c.tolist(), ends, kind_n.astype(int).tolist())
    n_all, v_all = total + ends, distinct + (ends > 0)
    base_total, kind_total = n_all + 0.1 * (v_all + 1), kind_n + 0.1 * (kind_v + 1)
    flat = train(training, vocabulary, first, ends)
    shared = spark.sparkContext.broadcast((vocabulary, flat, dict(zip(top.word.tolist(), top.c.tolist(), strict=True))))
    log_kind = np.log10(kind_total)

    def run(batches):
        voc, flat, count = shared.value
        model, rid = GatedModel(voc).load(flat), TaskContext.get().partitionId() << 40
        row_of = {w: i for i, w in enumerate(count)}
        c = np.array([*count.values(), 1], dtype=float) + 0.1
        inner = np.array([*map(voc.id_of.get, count), None], dtype=object)
        kind = np.array([zlib.crc32(w[-2:].encode()) % KINDS for w in [*count, ""]])
        outside = np.array([x is None for x in inner])
        id_at = np.where(outside, 1 + kind, np.where(outside, 0, inner)).astype(np.int32)
        base_at, tail_at = np.log10(c / base_total), np.where(outside, np.log10(c) - log_kind[kind], 0.0)
        end = np.log10((ends + 0.1) / base_total)
        for whole in batches:
            for a in range(0, len(whole), TOGETHER):
                pdf = whole.iloc[a : a + TOGETHER]
                ids, base, tail, others, n_known = [], [], [], [], []
                for t in pdf.pop("plain"):
                    ws = [w for w in t.split(" ") if w]
                    at = np.array([row_of.get(w, -1) for w in ws], dtype=np.int64)
                    own = id_at[at]
                    miss = np.nonzero(at < 0)[0].tolist()
                    other = [ws[i] for i in miss]
                    own[miss] = [1 + zlib.crc32(w[-2:].encode()) % KINDS for w in other]
                    ids.append(np.append(own, np.int32(0)))
                    here = at[at >= 0]
                    base.append(end + base_at[here].sum())
                    tail.append(tail_at[here].sum())
                    n_known.append(len(here) + (ends > 0))
                    others.append(other)
                score = model.score(ids) / LOG10 + np.array(tail)
                lens = np.array([len(i) for i in ids], dtype=np.int64)
                yield pdf.assign(rid=rid + np.arange(len(pdf)), n_tokens=lens, n_known=np.array(n_known, dtype=np.int64), base_score=np.array(base), score=score, others=others)
                rid += len(pdf)

    schema = "doc_id long, held_out boolean, rid long, n_tokens long, n_known long, base_score double, score double, others array<string>"
    scored = scratch.save(docs.mapInPandas(run, schema))
    log_kinds = F.array(*[F.lit(float(x)) for x in log_kind])
    c = F.coalesce(F.col("c"), F.lit(0)) + 0.1
    more = scored.select("rid", F.explode("others").alias("word")).join(counts, "word", "left")
    more = more.select("rid", F.col("c").isNotNull().cast("long").alias("k"), (F.log10(c) - F.lit(float(np.log10(base_total)))).alias("b"), (F.log10(c) - F.element_at(log_kinds, word_kind(F.col("word")) + 1)).alias("s"))
    more = more.groupBy("rid").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    zero = lambda x, z=0.0: F.coalesce(F.col(x), F.lit(z))
    return scored.drop("others").join(more, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k", 0)).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"),
    )
