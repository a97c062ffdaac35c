"""Exact top-k by inner product: a pivot-distance index, sorted annuli, and triangle-inequality bounds.

One more component puts all vectors on one sphere, so the largest product is the least
distance.  Every vector is keyed by its nearest pivot and its distance to it; ranges of
that key, in order, become pages.  A page is an annulus around its pivot: a query at
distance d from the pivot is no nearer to any vector of the page than the gap between
d and the annulus.  Queries go in blocks of bounded size against all pages; in a task each
query opens its annuli by ascending gap, and stops where no gap allows a score that
matters.  The page that holds a query's own vector gives it a first score to beat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

PIVOTS, SAMPLE, PAGE, BLOCK_BYTES, GROUP = 128, 2048, 512, 16 << 20, 1024
EXACT, LONG = 1 << 53, (1 << 63) - 1
LEAST = -LONG - 1  # below every score
SLACK = 1e-6


def whole(v, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component, as integers in double precision; None where the vector takes no part."""
    if v is None:
        return None
    x = np.asarray(v, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    return x if np.isfinite(x).all() else None


def narrow(x: np.ndarray) -> bytes:
    """Integers in the least type that holds them, which the first byte names."""
    top = np.abs(x).max() if x.size else 0
    kind = "h" if top < 1 << 15 else "i" if top < 1 << 31 else "d"
    return kind.encode() + x.astype(kind).tobytes()


def wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=chr(b[0]), offset=1).astype(np.float64)


def stacked(rows: list[np.ndarray]) -> np.ndarray:
    """Rows under one another; shorter ones end in zeros."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact; beyond 64 bits they become the nearest long.  Components that one side lacks are zeros."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    most = np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0))
    if most < EXACT / 2:
        return (a @ b.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], dtype=object).reshape(b.shape).T
    return np.array([[min(max(int(x), -LONG), LONG) for x in r] for r in big], dtype=np.int64).reshape(len(a), len(b))


def integers(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """row (differs for every row), vec_id, the integer vector and its square, of all rows that take part."""

    def run(batches):
        for pdf in batches:
            found = [whole(v, scale) for v in pdf.vector]
            use = [k for k, x in enumerate(found) if x is not None]
            yield pd.DataFrame({"row": pdf.row.to_numpy()[use], "vec_id": pdf.vec_id.astype("Int64").to_numpy()[use], "x": [narrow(found[k]) for k in use], "square": [float(found[k] @ found[k]) for k in use]}).astype({"vec_id": "Int64"})

    picked = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    return picked.mapInPandas(run, "row long, vec_id long, x binary, square double")


class Pivots:
    """Vectors with their added component; chosen farthest first from a sample."""

    def __init__(self, sample: list[np.ndarray], longest: float, count: int):
        self.longest = longest
        x = stacked(sample)
        extra = np.sqrt(np.maximum(0, longest - (x * x).sum(axis=1)))
        full = np.concatenate([x, extra[:, None]], axis=1)
        picked, far = [0] if len(full) else [], np.full(len(full), np.inf)
        while picked and len(picked) < count:
            far = np.minimum(far, ((full - full[picked[-1]]) ** 2).sum(axis=1))
            if far.max() <= 0:
                break
            picked.append(int(far.argmax()))
        self.x, self.extra = x[picked], extra[picked]

    def distances(self, x: np.ndarray, square: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """(rows, pivots) distances of vectors with their added component."""
        n = min(x.shape[1], self.x.shape[1])
        d = square[:, None] + (extra**2)[:, None] + self.longest - 2 * (x[:, :n] @ self.x[:, :n].T + extra[:, None] * self.extra)
        return np.sqrt(np.maximum(0, d))

    def keys(self, rows: list[np.ndarray], square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and distance to it."""
        d = self.distances(stacked(rows), square, np.sqrt(np.maximum(0, self.longest - square)))
        near = d.argmin(axis=1)
        return near, d[np.arange(len(rows)), near]


def best_of(query, score, null, ids, row, k: int) -> np.ndarray:
    """Places of the k best rows of each query, ordered by query: highest score, least id, null ids last, then row."""
    order = np.lexsort((row, ids, null, -score, query))
    q = query[order]
    start = np.searchsorted(q, q)
    return order[np.arange(len(q)) - start < k]


PAGES = "pivot int, low double, high double, rows binary, ids binary, nulls binary, squares binary, lengths binary, x binary, asks binary, beats binary"


def make_pages(keyed: DataFrame, page: int, every: int, k: int, broad: int = 1 << 20) -> DataFrame:
    """Pages of at most ``page`` neighbours in the key order of each partition; each has the first score to beat of its queries."""

    def emit(g: pd.DataFrame) -> pd.DataFrame:
        rows = [wide(b) for b in g.x]
        x, null = stacked(rows), g.vec_id.isna().to_numpy()
        ids = g.vec_id.fillna(0).to_numpy(dtype=np.int64)
        asks = ~null & (ids % every == 0)
        beats = np.full(len(g), LEAST, dtype=np.int64)
        if len(g) > k and asks.any():
            s = products(x[asks], x)
            s[np.arange(len(s)), np.nonzero(asks)[0]] = LEAST
            beats[asks] = np.partition(s, -k, axis=1)[:, -k]
        one = (int(g["pivot"].iloc[0]), float(g.distance.min()), float(g.distance.max()), g["row"].to_numpy(dtype=np.int64).tobytes(), ids.tobytes(), null.tobytes(), g.square.to_numpy().tobytes(), np.array([len(r) for r in rows], dtype=np.int32).tobytes(), narrow(x.ravel()), asks.tobytes(), beats.tobytes())
        return pd.DataFrame([one], columns=[c.split()[0] for c in PAGES.split(", ")])

    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held):
                width = np.maximum.accumulate(held.x.str.len().to_numpy()) * np.arange(1, len(held) + 1)
                n = max(1, min(page, int((held["pivot"] == held["pivot"].iloc[0]).to_numpy().argmin()) or len(held), int((width <= 8 * broad).sum())))
                if n == len(held) and n < page:
                    break  # the page may go on in the next batch
                yield emit(held[:n])
                held = held[n:].reset_index(drop=True)
        if held is not None and len(held):
            yield emit(held)

    return keyed.mapInPandas(run, PAGES)


class Page:
    def __init__(self, r):
        self.pivot, self.low, self.high = int(r.pivot), r.low, r.high
        self.rows, self.ids, self.nulls = np.frombuffer(r.rows, dtype=np.int64), np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.nulls, dtype=bool)
        self.raw, self.n = r.x, len(r.rows) // 8

    def x(self) -> np.ndarray:
        v = wide(self.raw)
        return v.reshape(self.n, len(v) // self.n)


class Queries:
    """A block of queries: vectors, rows, and the score that each has to reach."""

    def __init__(self, rows: list, pivots: Pivots):
        self.x = stacked([wide(r.x) for r in rows])
        self.row, self.beat = np.array([r.row for r in rows], dtype=np.int64), np.array([r.beat for r in rows], dtype=np.int64)
        self.square = (self.x * self.x).sum(axis=1)
        self.far = pivots.distances(self.x, self.square, np.zeros(len(rows)))
        self.longest = pivots.longest


def scan(pages: list[Page], q: Queries, at: np.ndarray, k: int) -> tuple[pd.DataFrame, int]:
    """The k best of these pages for the queries ``at``, where they reach their score to beat; and how many pairs were compared."""
    pivot = np.array([p.pivot for p in pages])
    low, high = np.array([p.low for p in pages]), np.array([p.high for p in pages])
    d = q.far[at][:, pivot]
    gap = np.maximum(0, np.maximum(low - d, d - high))
    size = q.longest + q.square[at]
    most = (size[:, None] * (1 + SLACK) - gap * gap) / 2 + SLACK * size[:, None]  # no product of the page is larger
    order = np.argsort(-most, axis=1, kind="stable")
    beat = q.beat[at].copy()
    none = np.zeros(0, dtype=np.int64)
    query, score, null, ids, row, compared = none, none, np.zeros(0, dtype=bool), none, none, 0
    a, step = 0, 1
    while a < len(pages):
        ring = order[:, a : a + step]
        want = np.take_along_axis(most, ring, axis=1) >= beat[:, None]
        if not want.any():
            break  # bounds only fall from here on
        new = [[query], [score], [null], [ids], [row]]
        for p in np.unique(ring[want]).tolist():
            who = np.nonzero((want & (ring == p)).any(axis=1))[0]
            page = pages[p]
            s = products(q.x[at[who]], page.x())
            compared += s.size
            i, j = np.nonzero((s >= beat[who][:, None]) & (page.rows[None, :] != q.row[at[who]][:, None]))
            z = best_of(i, s[i, j], page.nulls[j], page.ids[j], page.rows[j], k)
            i, j = i[z], j[z]
            for out, v in zip(new, (who[i], s[i, j], page.nulls[j], page.ids[j], page.rows[j]), strict=True):
                out.append(v)
        query, score, null, ids, row = (np.concatenate(v) for v in new)
        keep = best_of(query, score, null, ids, row, k)
        query, score, null, ids, row = query[keep], score[keep], null[keep], ids[keep], row[keep]
        full = np.bincount(query, minlength=len(at)) >= k
        last = np.searchsorted(query, np.arange(len(at)), side="right") - 1
        beat[full] = np.maximum(beat[full], score[last[full]])
        a, step = a + step, max(1, a + step)
    return pd.DataFrame({"query": q.row[at[query]], "row": row, "vec_id": pd.Series(ids, dtype="Int64").mask(null), "score": score}), compared


def search_pages(pages: DataFrame, queries, k: int) -> DataFrame:
    def run(batches):
        q = queries.value
        for pdf in batches:
            held = [Page(r) for r in pdf.itertuples()]
            for a in range(0, len(q.row) if held else 0, GROUP):
                yield scan(held, q, np.arange(a, min(a + GROUP, len(q.row))), k)[0]

    return pages.mapInPandas(run, "query long, row long, vec_id long, score long")


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, sample: int = SAMPLE, page: int = PAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products of each query, ties by ascending vec_id; exact.

    Components become floor(scale * x).  Queries are the rows whose id is divisible by
    ``every``; candidates are all rows but the query's own.  Null vectors and those with
    null or non-finite components (also after scaling) take no part; zero and empty
    vectors do, with product 0.  Of vectors of different length the shorter one ends in
    zeros.  Repeated ids: every row asks and answers on its own.  A row without id is a
    candidate, last among equals.  Products beyond 64 bits become the nearest long.  Other
    columns are not read.

    **Bounds.**  Pivots come from the ``sample`` rows of least hash; they decide the speed
    alone.  Queries go in blocks of about ``block_bytes``, each broadcast in turn; a task
    returns k rows a query at most, and none below the score to beat.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    rows = scratch.save(integers(vectors, vec_id, vector, scale))
    facts = rows.agg(F.count("*").alias("n"), F.max("square").alias("longest"), F.sum(F.when(F.col("vec_id") % every == 0, F.length("x") * 4 + 8 * pivots).otherwise(0)).alias("bytes")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not facts.n:
        return spark.createDataFrame([], out)
    some = rows.orderBy(F.xxhash64("row"), "row").limit(sample).select("row", "x").collect()
    shared = spark.sparkContext.broadcast(Pivots([wide(r.x) for r in sorted(some, key=lambda r: r.row)], facts.longest, pivots))  # at most ``pivots`` vectors

    def key(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                g = pdf[a : a + 1024]
                near, far = shared.value.keys([wide(b) for b in g.x], g.square.to_numpy())
                yield g.assign(pivot=near.astype(np.int32), distance=far)

    keyed = rows.mapInPandas(key, "row long, vec_id long, x binary, square double, pivot int, distance double")
    sort = ["pivot", "distance", "row"]
    pages = scratch.save(make_pages(keyed.repartitionByRange(shuffle_partitions(spark), *sort).sortWithinPartitions(*sort), page, every, k))
    blocks = max(1, -(-int(facts.bytes) // block_bytes))
    asking = scratch.save(own_queries(pages).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))))
    found = None
    for b in range(blocks):
        held = asking.where(F.col("block") == b).orderBy("row").collect()  # about block_bytes
        if not held:
            continue
        queries = spark.sparkContext.broadcast(Queries(held, shared.value))
        one = scratch.save(search_pages(pages, queries, k))
        queries.unpersist()
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], out)
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.join(asking.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


def own_queries(pages: DataFrame) -> DataFrame:
    """row, vec_id, x and score to beat of every query in the pages."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                p, asks = Page(r), np.nonzero(np.frombuffer(r.asks, dtype=bool))[0]
                if len(asks):
                    x, n, beat = p.x(), np.frombuffer(r.lengths, dtype=np.int32), np.frombuffer(r.beats, dtype=np.int64)
                    yield pd.DataFrame({"row": p.rows[asks], "vec_id": p.ids[asks], "x": [narrow(x[a, : n[a]]) for a in asks], "beat": beat[asks]})

    return pages.select("pivot", "low", "high", "rows", "ids", "nulls", "x", "lengths", "asks", "beats").mapInPandas(run, "row long, vec_id long, x binary, beat long")


SQL = """WITH v AS (SELECT vec_id, row_number() OVER () AS row, [floor(256 * x::DOUBLE) for x in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.vec_id AS query_id, a.row AS query, b.vec_id, b.row, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 50 = 0)
  SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
