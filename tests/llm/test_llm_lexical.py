"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioworks.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for i, c in counts:
            m = 75 + (25 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def made(seed, n):
    r = random.Random(seed)
    some = ["".join(r.choices("abcé中Z9", k=r.randint(1, 4))) for _ in range(60)]
    at = [1 / (k + 1) for k in range(60)]
    text = lambda m: r.choice([" ", ", ", "\n", "_"]).join(r.choices(some, at, k=m))
    docs = [(i, text(r.choice([1, 3, 20, 90]))) for i in range(n)]
    docs += [(n + i, docs[i % 5][1]) for i in range(60)] + [(None, docs[0][1]), (None, docs[2][1]), docs[3], docs[3], (n + 100, None), (n + 101, ""), (n + 102, " ,;\x7f "), (n + 103, "a " * 30_000 + text(5))]
    items = [(j, text(r.choice([1, 4, 15]))) for j in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (None, docs[1][1]), (3, docs[2][1]), (4, "a a a É é"), (4, "a a a É é")]
    return docs, items


@pytest.mark.parametrize("shard, block", [(16, 4), (64, 64), (4096, 64)])
def test_search_is_exact(spark, shard, block):
    docs, items = made(shard, 300)
    d = spark.createDataFrame([(*x, 1.0, 2) for x in docs], "doc_id long, text string, score double, item int").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = lexical.rank_documents(d, i, shard_docs=shard, block=block, item_bytes=1 << 20 if shard > 16 else 60).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, items)


def test_no_documents_and_no_items(spark):
    docs, items = made(1, 10)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.rank_documents(d.limit(0), i).count() == lexical.rank_documents(d, i.limit(0)).count() == 0
    assert lexical.rank_documents(d.where("text = ''"), i).count() == 0
    assert lexical.rank_documents(d, i.where("text = 'nowhere'")).count() == 0


def test_blocks_are_turned_down_before_they_are_decoded():
    """A rare term decides; the list of the frequent one has one promising block, and only that is decoded."""
    n, word = 2000, lexical.counted(b"rare often")
    texts = [b"often" + b" x" * 40 for _ in range(n)]
    for k in range(20):
        texts[700 + k] = b"rare often often often often"

    class Held:
        value = {t: j for j, t in enumerate(sorted(word))}

    class Rows:
        def mapInPandas(self, run, schema):
            import pandas as pd

            return list(run([pd.DataFrame({"id": range(n), "text": texts})]))[0]

    counts = lexical.count_shards(Rows(), Held, 4096)
    total = int(counts.tokens.sum())

    class Counts:
        def mapInPandas(self, run, schema):
            return list(run([counts]))[0]

    shard = lexical.Shard(next(lexical.build_index(Counts(), n, total, 64).itertuples()))
    assert len(shard.tops) == 1 + math.ceil(n / 64)
    place, score = shard.search([(0, 1), (1, 4000)], 20, 0)
    assert place.tolist() == list(range(700, 720)) and len(set(score.tolist())) == 1
    assert shard.decoded <= 1 + 2
    assert np.array_equal(shard.list(0)[0], np.arange(n))
