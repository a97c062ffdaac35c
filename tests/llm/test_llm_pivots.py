"""The pivot-distance index against all products."""

import math

import numpy as np
import pytest

from folioworks.llm import pivots

SCHEMA = "vec_id long, embedding array<double>, score long, row int"


def plain(data, k=5, every=50):
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(use):
        if i is None or i % every:
            continue
        scored = sorted((-max(min(sum(x * y for x, y in zip(v, w)), pivots.LONG), -pivots.LONG), j is None, j or 0) for b, (j, w) in enumerate(use) if a != b)  # noqa: B905
        out += [(i, r, None if n else j, -s) for r, (s, n, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def answers(df, **more):
    return sorted((tuple(r) for r in pivots.top_products(df, **more).collect()), key=repr)


@pytest.mark.parametrize("seed, page, blocks", [(1, 512, 16 << 20), (2, 7, 4000), (3, 40, 16 << 20)])
def test_all_products(spark, seed, page, blocks):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(250, 12)), rng.normal(size=(4, 12)).repeat(60, axis=0) + rng.normal(0, 0.05, (240, 12)) * (seed % 2), rng.normal(size=(60, 12)) * 9])
    data = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    data += [(600, None), (650, [0.0] * 12), (700, [math.nan] + [1.0] * 11), (750, [1.0, None]), (800, []), (850, [0.5, -0.5, 3.0]), (-50, x[3].tolist()), (None, x[0].tolist()), (None, (9 * x[0]).tolist()), (100, x[9].tolist()), data[0], data[0], (901, [math.inf] * 12)]
    df = spark.createDataFrame([(*d, 3, 4) for d in data], SCHEMA).repartition(5)
    assert answers(df, page=page, block_bytes=blocks) == plain(data)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 3, 4), (50, [0.5, 0.0], 3, 4), (3, [-1.0, 0.25], 3, 4)], SCHEMA)
    assert answers(df) == plain([(r.vec_id, r.embedding) for r in df.collect()]) and len(answers(df)) == 4
    assert answers(df.limit(0)) == answers(df.where("vec_id = 3")) == answers(df.where("vec_id = 50")) == []


def test_large_components_stay_exact(spark):
    data = [(50 * i, [float(s * (1 << e) + i), 1.0 + i, float(i)]) for i, (s, e) in enumerate([(1, 20), (-1, 20), (3, 21), (1, 30), (1, 55), (1, 60)])]
    df = spark.createDataFrame([(*d, 3, 4) for d in data], SCHEMA)
    assert answers(df) == plain(data)


def test_equal_vectors_hold_a_third(spark):
    data = [(i, [1.0, 0.0, 0.5] if i % 3 == 0 else [math.cos(i), math.sin(i), i / 3000]) for i in range(3000)]
    df = spark.createDataFrame([(*d, 3, 4) for d in data], SCHEMA)
    assert answers(df, page=64) == plain(data)


def test_bounds_leave_most_pages_closed():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(16, 8)) * 4
    x = np.floor(256 * np.concatenate([c + rng.normal(0, 0.05, (256, 8)) for c in centres]))
    square = (x * x).sum(axis=1)
    held = pivots.Pivots(list(x[::8]), square.max(), 64)
    near, far = held.keys(list(x), square)
    order = np.lexsort((far, near))

    class Row:
        def __init__(self, at):
            self.pivot, self.low, self.high = near[at[0]], far[at].min(), far[at].max()
            self.rows, self.ids, self.nulls, self.x = at.astype(np.int64).tobytes(), at.astype(np.int64).tobytes(), np.zeros(len(at), dtype=bool).tobytes(), pivots.narrow(x[at].ravel())

    cuts = np.nonzero(np.diff(near[order]))[0] + 1
    pages = [pivots.Page(Row(p)) for run in np.split(order, cuts) for p in np.array_split(run, max(1, len(run) // 32))]

    class Ask:
        def __init__(self, i):
            self.row, self.x, self.beat = i, pivots.narrow(x[i]), pivots.LEAST

    q = pivots.Queries([Ask(i) for i in range(0, len(x), 64)], held)
    got, compared = pivots.scan(pages, q, np.arange(len(q.row)), 5)
    assert compared < 0.5 * len(q.row) * len(x)
    for i, g in got.groupby("query"):
        s = x @ x[i]
        s[i] = -np.inf
        assert g.vec_id.tolist() == np.lexsort((np.arange(len(x)), -s))[:5].tolist()
