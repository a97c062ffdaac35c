"""Approximate nearest neighbours: NN-descent builds the graph, greedy graph search answers queries.

Equal vectors are one node.  Nearness is the inner product; for the graph every
vector gets one more component that makes all lengths equal, so that largest
product and least distance agree.  The graph starts from brute force inside runs
of vectors that random projections sort together, and is then improved by joins
of neighbours of neighbours.  A search walks the graph for all queries at once:
each hop joins the best nodes not yet opened of every query with the rows of the
graph that hold their neighbours (as 8-bit vectors).  The last step ranks by the
exact products of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import Scratch, shuffle_partitions
from .vectors import usable


def nodes_of(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, keys of the vector, the vector as doubles and its square; rows that take no part are left out."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, v in zip(pdf.vec_id, pdf.vector, strict=True):
                x = usable(v)
                if x is not None and not pd.isna(i):
                    b = (x + 0.0).tobytes()
                    h = xxhash.xxh3_128_intdigest(b)
                    rows.append((int(i), (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), b, float(x @ x)))
            yield pd.DataFrame(rows, columns=["vec_id", "k1", "k2", "x", "square"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).mapInPandas(run, "vec_id long, k1 long, k2 long, x binary, square double")


def small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as 8-bit integers with a scale each."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    return np.round(x / scale).astype(np.int8), scale[:, 0].astype(np.float32)


def quantized(classes: DataFrame, longest: float) -> DataFrame:
    """v, dims, q (8-bit vector with the added component) and scale."""

    def run(batches):
        for pdf in batches:
            for _, g in pdf.groupby(pdf.x.str.len()):
                x = np.stack([np.frombuffer(b, dtype=np.float64) for b in g.x])
                extra = np.sqrt(np.maximum(0, longest - g.square.to_numpy()))[:, None]
                q, scale = small(np.concatenate([x, extra], axis=1))
                yield pd.DataFrame({"v": g.v.to_numpy(), "dims": np.int32(x.shape[1]), "q": [r.tobytes() for r in q], "scale": scale})

    return classes.mapInPandas(run, "v long, dims int, q binary, scale float")


GRAPH = "v long, near binary, sims binary, fresh binary"


def best(v: np.ndarray, u: np.ndarray, s: np.ndarray, fresh: np.ndarray, k: int) -> pd.DataFrame:
    """Of rows (v, u, s): the k best different u of each v, as one row; an old entry wins over its new copy."""
    order = np.lexsort((fresh, u, v))
    v, u, s, fresh = v[order], u[order], s[order], fresh[order]
    once = np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1])]) if len(v) else np.zeros(0, dtype=bool)
    v, u, s, fresh = v[once], u[once], s[once], fresh[once]
    order = np.lexsort((u, -s, v))
    v, u, s, fresh = v[order], u[order], s[order], fresh[order]
    first = np.nonzero(np.concatenate([[True], v[1:] != v[:-1]]))[0] if len(v) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(v))
    last = np.minimum(last, first + k)
    rows = [(n, u[a:b].tobytes(), s[a:b].tobytes(), fresh[a:b].tobytes()) for n, a, b in zip(v[first].tolist(), first.tolist(), last.tolist(), strict=True)]
    return pd.DataFrame(rows, columns=["v", "near", "sims", "fresh"])


def unpacked(pdf: pd.DataFrame):
    u = [np.frombuffer(b, dtype=np.int64) for b in pdf.near]
    n = np.array([len(x) for x in u], dtype=np.int64)
    cat = lambda xs, t: np.concatenate([np.zeros(0, dtype=t), *xs])
    return np.repeat(pdf.v.to_numpy(), n), cat(u, np.int64), cat([np.frombuffer(b, dtype=np.float32) for b in pdf.sims], np.float32), cat([np.frombuffer(b, dtype=bool) for b in pdf.fresh], bool)


def merged(rows: DataFrame, k: int, parts: int) -> DataFrame:
    """One row for each v with its k best neighbours."""
    by = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
    return by.groupBy("part").applyInPandas(lambda pdf: best(*unpacked(pdf), k), GRAPH)


def first_graph(vecs: DataFrame, n: int, k: int, trees: int, run_length: int, parts: int, seed: int = 9) -> DataFrame:
    """Brute force inside runs of ``run_length`` vectors that signs of random projections sort together, ``trees`` times."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / run_length)))))

    def place(batches):
        for pdf in batches:
            for size, g in pdf.groupby(pdf.q.str.len()):
                x = np.stack([np.frombuffer(b, dtype=np.int8) for b in g.q]).astype(np.float32)
                for t in range(trees):
                    y = x @ np.random.default_rng([seed, t, size]).normal(size=(size, bits + 1)).astype(np.float32)
                    code = ((y[:, :bits] > 0) << np.arange(bits)).sum(axis=1).astype(np.int64)
                    yield pd.DataFrame({"tree": np.int32(t), "dims": g.dims.to_numpy(), "code": code, "along": y[:, bits], "v": g.v.to_numpy(), "q": g.q.to_numpy(), "scale": g.scale.to_numpy()})

    def compare(batches):
        for pdf in batches:
            key = pdf[["tree", "dims"]].to_numpy()
            cuts = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))[0]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for c in range(a, b, run_length):
                    g = pdf.iloc[c : min(b, c + run_length)]
                    if len(g) < 2:
                        continue
                    x = np.stack([np.frombuffer(r, dtype=np.int8) for r in g.q]).astype(np.float32) * g.scale.to_numpy()[:, None]
                    s = x @ x.T
                    np.fill_diagonal(s, -np.inf)
                    m, ids = min(k, len(g) - 1), g.v.to_numpy()
                    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    near, sims, fresh = ids[top], np.take_along_axis(s, top, axis=1).astype(np.float32), np.ones(m, dtype=bool).tobytes()
                    yield pd.DataFrame({"v": ids, "near": [r.tobytes() for r in near], "sims": [r.tobytes() for r in sims], "fresh": fresh})

    placed = vecs.mapInPandas(place, "tree int, dims int, code long, along float, v long, q binary, scale float")
    order = ["tree", "dims", "code", "along", "v"]
    spread = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return merged(spread.mapInPandas(compare, GRAPH), k, parts)


def edges_of(graph: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            v, u, s, fresh = unpacked(pdf)
            yield pd.DataFrame({"v": v, "u": u, "fresh": fresh})

    return graph.mapInPandas(run, "v long, u long, fresh boolean")


def around(graph: DataFrame, reverse: int) -> DataFrame:
    """(v, u, fresh): neighbours of v, and up to ``reverse`` nodes that have v as neighbour, drawn by a hash."""
    out = edges_of(graph)
    draw = Window.partitionBy("u").orderBy(F.xxhash64("v", "u"))
    back = out.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= reverse).select(F.col("u").alias("v"), F.col("v").alias("u"), "fresh")
    return out.unionByName(back)


def padded(pdf: pd.DataFrame):
    """Rows (v, u, ...) sorted by v, without repeats: positions in a (nodes, widest) table."""
    pdf = pdf.sort_values(["v", "u", "fresh"], kind="stable").drop_duplicates(["v", "u"], keep="last").reset_index(drop=True)
    v = pdf.v.to_numpy()
    first = np.nonzero(np.concatenate([[True], v[1:] != v[:-1]]))[0]
    count = np.diff(np.append(first, len(v)))
    return pdf, np.repeat(np.arange(len(first)), count), np.arange(len(v)) - np.repeat(first, count), len(first), int(count.max())


def local_join(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Every two neighbours of a node, of which one is fresh, are shown to each other if that betters a list."""
    out = []
    for _, g in pdf.groupby(pdf.q.str.len()):
        g, row, col, n, width = padded(g)
        q = np.stack([np.frombuffer(b, dtype=np.int8) for b in g.q]).astype(np.float32) * g.scale.to_numpy()[:, None]
        ids, worst, fresh = g.u.to_numpy(), g.worst.to_numpy(), g.fresh.to_numpy()
        for a in range(0, n, 512):
            own = (row >= a) & (row < a + 512)
            r, c, m = row[own] - a, col[own], min(512, n - a)
            x = np.zeros((m, width, q.shape[1]), dtype=np.float32)
            x[r, c] = q[own]
            table, low, new = np.zeros((m, width), dtype=np.int64), np.full((m, width), np.inf, dtype=np.float32), np.zeros((m, width), dtype=bool)
            table[r, c], low[r, c], new[r, c] = ids[own], worst[own], fresh[own]
            real = np.isfinite(low) | (low == -np.inf)
            s = x @ x.transpose(0, 2, 1)
            good = (s > low[:, :, None]) & (new[:, :, None] | new[:, None, :]) & real[:, None, :] & (table[:, :, None] != table[:, None, :])
            i, j, h = np.nonzero(good)
            out.append((table[i, j], table[i, h], s[i, j, h]))
    v, u, s = (np.concatenate([o[z] for o in out]) if out else np.zeros(0) for z in range(3))
    return best(v.astype(np.int64), u.astype(np.int64), s.astype(np.float32), np.ones(len(v), dtype=bool), k)


def descend(graph: DataFrame, vecs: DataFrame, k: int, reverse: int, parts: int) -> DataFrame:
    """One round of NN-descent."""

    def bound(batches):
        for pdf in batches:
            yield pd.DataFrame({"u": pdf.v, "worst": [np.frombuffer(b, dtype=np.float32)[-1] if len(b) >= 4 * k else -np.inf for b in pdf.sims]}).astype({"worst": "float32"})

    known = vecs.select(F.col("v").alias("u"), "q", "scale").join(graph.mapInPandas(bound, "u long, worst float"), "u")
    shown = around(graph, reverse).join(known, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
    better = shown.groupBy("part").applyInPandas(lambda pdf: local_join(pdf, k), GRAPH)

    def aged(batches):
        for pdf in batches:
            yield pdf.assign(fresh=[bytes(len(b)) for b in pdf.fresh])

    return merged(graph.mapInPandas(aged, GRAPH).unionByName(better), k, parts)


def adjacency(graph: DataFrame, vecs: DataFrame, reverse: int, parts: int) -> DataFrame:
    """One row for each node: ids, 8-bit vectors and scales of its neighbours in either direction."""

    def pack(pdf):
        rows = []
        for size, g in pdf.groupby(pdf.q.str.len()):
            g = g.drop_duplicates(["v", "u"]).sort_values(["v", "u"])
            v = g.v.to_numpy()
            first = np.nonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))[0]
            u, q, s = g.u.to_numpy(), g.q.to_list(), g.scale.to_numpy().astype(np.float32)
            rows += [(n, u[a:b].tobytes(), b"".join(q[a:b]), s[a:b].tobytes()) for n, a, b in zip(v[first[:-1]].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["v", "ids", "qs", "scales"])

    rows = around(graph, reverse).join(vecs.select(F.col("v").alias("u"), "q", "scale"), "u").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
    return rows.groupBy("part").applyInPandas(pack, "v long, ids binary, qs binary, scales binary")


STATE = "query long, qx binary, ids binary, sims binary, opened binary, go boolean"


def open_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Scores the neighbours of opened nodes against their queries; only what can enter the pool goes on."""
    rows = []
    for qx, query, ids, qs, scales, worst in zip(pdf.qx, pdf["query"], pdf.ids, pdf.qs, pdf.scales, pdf.worst, strict=True):
        x, u = np.frombuffer(qx, dtype=np.float32), np.frombuffer(ids, dtype=np.int64)
        s = (np.frombuffer(qs, dtype=np.int8).reshape(len(u), -1)[:, :-1].astype(np.float32) @ x) * np.frombuffer(scales, dtype=np.float32)
        keep = (s > worst) & (u != query)
        rows.append((query, None, u[keep].tobytes(), s[keep].astype(np.float32).tobytes(), None, None))
    return pd.DataFrame(rows, columns=["query", "qx", "ids", "sims", "opened", "go"])


def pool_up(pdf: pd.DataFrame, pool: int) -> pd.DataFrame:
    """Merges each query's pool with what its opened nodes have shown."""
    rows = []
    for query, g in pdf.groupby("query", sort=True):
        qx, ids, sims, opened = None, [], [], []
        for x, i, s, o in zip(g.qx, g.ids, g.sims, g.opened, strict=True):
            i = np.frombuffer(i, dtype=np.int64)
            ids.append(i), sims.append(np.frombuffer(s, dtype=np.float32))
            opened.append(np.zeros(len(i), dtype=bool) if o is None else np.frombuffer(o, dtype=bool))
            qx = x if x is not None else qx
        ids, sims, opened = np.concatenate(ids), np.concatenate(sims), np.concatenate(opened)
        order = np.lexsort((~opened, ids))
        ids, sims, opened = ids[order], sims[order], opened[order]
        once = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, dtype=bool)
        ids, sims, opened = ids[once], sims[once], opened[once]
        top = np.lexsort((ids, -sims))[:pool]
        ids, sims, opened = ids[top], sims[top], opened[top]
        rows.append((query, qx, ids.tobytes(), sims.tobytes(), opened.tobytes(), bool((~opened).any())))
    return pd.DataFrame(rows, columns=["query", "qx", "ids", "sims", "opened", "go"])


def search(starts: DataFrame, adj: DataFrame, scratch: Scratch, pool: int, width: int, hops: int, parts: int) -> DataFrame:
    """Greedy search of all queries: each hop opens the ``width`` best nodes of each pool that are not open yet."""
    state = scratch.save(starts)

    def pick(batches):
        for pdf in batches:
            rows = []
            for query, qx, ids, sims, opened in zip(pdf["query"], pdf.qx, pdf.ids, pdf.sims, pdf.opened, strict=True):
                u, s, o = np.frombuffer(ids, dtype=np.int64), np.frombuffer(sims, dtype=np.float32), np.frombuffer(opened, dtype=bool)
                worst = float(s[-1]) if len(s) >= pool else -np.inf
                rows += [(n, query, qx, worst) for n in u[~o][:width].tolist()]
            yield pd.DataFrame(rows, columns=["v", "query", "qx", "worst"]).astype({"worst": "float32"})

    def mark(batches):
        for pdf in batches:
            done = []
            for opened in pdf.opened:
                o = np.frombuffer(opened, dtype=bool).copy()
                o[np.nonzero(~o)[0][:width]] = True
                done.append(o.tobytes())
            yield pdf.assign(opened=done)

    for _ in range(hops):
        going = state.where("go")
        wanted = going.mapInPandas(pick, "v long, query long, qx binary, worst float")
        shown = wanted.hint("shuffle_hash").join(adj, "v").select("qx", "query", "ids", "qs", "scales", "worst")
        shown = shown.mapInPandas(lambda batches: (open_nodes(p) for p in batches), STATE)
        rows = state.mapInPandas(mark, STATE).unionByName(shown).withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)))
        then = scratch.save(rows.groupBy("part").applyInPandas(lambda pdf: pool_up(pdf.drop(columns="part"), pool), STATE))
        scratch.drop(state)
        state = then
        if not state.where("go").limit(1).collect():
            break
    return state


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", degree: int = 28, reverse: int = 24,
    trees: int = 8, run_length: int = 256, rounds: int = 3, pool: int = 448, width: int = 32, hops: int = 14,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by ``every``.

    All rows are indexed and searched; a query's own row is no candidate.  Rows with
    a null id, or whose vector is null, empty, zero or holds null or non-finite
    components take no part; vectors of other length than the query's are no
    candidates.  Ties go to the smaller id; rows of equal vectors, repeated rows
    among them, count one by one.  With k + 1 rows or fewer all are returned.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.save(nodes_of(vectors, vec_id, vector))
    found = rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("v"), F.first("x").alias("x"), F.first("square").alias("square"))
    classes = scratch.save(found.repartition(shuffle_partitions(spark), "v"))
    n, longest = classes.agg(F.count("*"), F.max("square")).collect()[0]
    parts = max(shuffle_partitions(spark), n // 4000)
    vecs = scratch.save(quantized(classes.select("v", "x", "square"), longest or 1.0))
    graph = scratch.save(first_graph(vecs, n, degree, trees, run_length, parts))
    for _ in range(rounds):
        then = scratch.save(descend(graph, vecs, degree, reverse, parts))
        scratch.drop(graph)
        graph = then
    adj = scratch.save(adjacency(graph, vecs, reverse, parts)).repartition(parts, "v").persist(StorageLevel.MEMORY_AND_DISK)

    def start(batches):
        for pdf in batches:
            x = [np.frombuffer(b, dtype=np.float64).astype(np.float32) for b in pdf.x]
            yield pd.DataFrame({"query": pdf.v, "qx": [r.tobytes() for r in x], "ids": [v.tobytes() for v in pdf.v.to_numpy(dtype=np.int64)[:, None]], "sims": [np.array([r @ r], dtype=np.float32).tobytes() for r in x], "opened": [b"\0"] * len(pdf), "go": True})

    asked = rows.where(F.col("vec_id") % every == 0).select("k1", "k2", F.col("vec_id").alias("query_id"))
    asking = classes.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("v", "x")
    state = search(asking.mapInPandas(start, STATE), adj, scratch, pool, width, hops, parts)
    adj.unpersist()

    def candidates(batches):
        for pdf in batches:
            keep = [np.frombuffer(b, dtype=np.int64)[: 4 * k] for b in pdf.ids]
            yield pd.DataFrame({"query": np.repeat(pdf["query"].to_numpy(), [len(x) for x in keep]), "v": np.concatenate([np.zeros(0, dtype=np.int64), *keep])})

    pairs = state.mapInPandas(candidates, "query long, v long")
    own = asking.select(F.col("v").alias("query"), F.col("v"))
    pairs = pairs.unionByName(own).distinct()
    x = classes.select("v", "x")

    def product(batches):
        for pdf in batches:
            s = [float(np.frombuffer(a, dtype=np.float64) @ np.frombuffer(b, dtype=np.float64)) if len(a) == len(b) else None for a, b in zip(pdf.x, pdf.y, strict=True)]
            yield pd.DataFrame({"query": pdf["query"], "v": pdf.v, "score": pd.array(s, dtype="Float64")})

    scored = pairs.join(x, "v").join(x.select(F.col("v").alias("query"), F.col("x").alias("y")), "query").mapInPandas(product, "query long, v long, score double").where("score is not null")
    # of equal vectors only the least k + 1 ids can be in a result, and of the classes only the best k + 1
    scored = scored.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "v"))).where(F.col("r") <= k + 1).drop("r")
    ids = classes.select("k1", "k2", "v").join(rows.select("k1", "k2", "vec_id"), ["k1", "k2"]).select("v", "vec_id")
    members = ids.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("v", F.col("vec_id"))
    firsts = scratch.save(scored.join(members, "v").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).select("query", "vec_id", "score", "r"))
    asks = asked.join(classes.select("k1", "k2", F.col("v").alias("query")), ["k1", "k2"]).select("query_id", "query")
    # the own row goes once; rows of the same id beyond it stay
    out = asks.join(firsts, "query")
    mine = F.row_number().over(Window.partitionBy("query_id", F.col("vec_id") == F.col("query_id")).orderBy("r"))
    out = out.withColumn("mine", mine).where((F.col("vec_id") != F.col("query_id")) | (F.col("mine") > 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
