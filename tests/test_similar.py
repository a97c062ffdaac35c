"""The most similar names: equal to comparing every pair, without reading every pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.operators import people, similar


def every_pair(a, b, order, least):
    out = set()
    for i, x in enumerate(a):
        scored = [(similar.ratio(x, y), order[j], j) for j, y in enumerate(b)]
        top = max(((s, o) for s, o, _ in scored if s >= least), default=None)
        out |= {(i, j, s) for s, o, j in scored if (s, o) == top}
    return out


def names(seed, n, letters, sizes):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.choice(sizes))) for _ in range(n)})


@pytest.mark.parametrize("letters,sizes,least", [("01234", (5, 6), 0.75), ("абвгд е", (9, 12), 0.72), ("ab", (60, 70), 0.88), ("xyz\U0001f600\x00", (4, 9), 0.5)])
def test_best_of_equals_every_pair(letters, sizes, least):
    a, b = names(1, 90, letters, sizes), names(2, 70, letters, sizes)
    order = np.array([float(-k // 3) for k in range(len(b))])
    assert set(similar.best_of(a, b, order, least)) == every_pair(a, b, order, least)


def test_few_ratios_are_read(monkeypatch):
    calls, plain = [], similar.ratio
    monkeypatch.setattr(similar, "ratio", lambda x, y: calls.append(1) or plain(x, y))
    a, b = [f"customer#{k:09}" for k in range(0, 60_000, 20)], [f"customer#{k:09}" for k in range(1, 60_000, 20)]
    found = similar.best_of(a, b, -np.arange(len(b), dtype=float), 0.88)
    assert {i for i, _, _ in found} == set(range(len(a))) and len(calls) < 4 * len(a)  # of 9 million pairs
    calls.clear()
    b = [f"supplier#{k:09}" for k in range(0, 60_000, 20)]  # 13 of 18 letters in order at most
    assert similar.best_of(a, b, -np.arange(len(b), dtype=float), 0.75) == [] and not calls


def test_parts_of_a_project_and_empty_names(spark):
    a, b = names(3, 60, "01234", (4, 5)), names(4, 60, "01234", (4, 5))
    left = spark.createDataFrame([(p, x) for p in ("p", "q") for x in a], "project_id string, a string")
    right = spark.createDataFrame([(p, y, -k) for p in ("p", "q", "r") for k, y in enumerate(b)], "project_id string, b string, o long")
    want = {(p, a[i], b[j], s) for p in ("p", "q") for i, j, s in every_pair(a, b, [-float(k) for k in range(len(b))], 0.75)}
    for most in (7, 32_768):  # many parts of a project, and projects that share a group
        rows = similar.most_similar(left, right, 0.75, most, most).join(right, ["project_id", "b"]).groupBy("project_id", "a").agg(F.max(F.struct("score", "o", "b")).alias("m")).collect()
        assert {(r.project_id, r.a, r.m.b, r.m.score) for r in rows} == want
    c = spark.createDataFrame([("p", ""), ("p", "anna"), ("p", None)], "project_id string, name string")
    r = spark.createDataFrame([("p", " ", 1), ("p", None, 2), ("p", "Anna", 4), ("p", "ANNA", 3)], "project_id string, name string, roster_ord int")
    assert {(x.name, x.tier, x.trusted) for x in people.best_name_match(c, r).collect()} == {("", "exact", " "), ("anna", "exact", "ANNA"), (None, "no_match", None)}


def test_copies_in_a_roster_are_one_name(spark):
    c = spark.range(300).select(F.lit(1).alias("project_id"), F.format_string("Customer#%09d", F.col("id") * 7).alias("name"))
    r = spark.range(60_000).select(F.lit(1).alias("project_id"), F.format_string("Customer#%09d", F.col("id") % 20 * 7 + 1).alias("name"), F.col("id").alias("roster_ord"))
    plan = people.best_name_match(c, r)._jdf.queryExecution().optimizedPlan().toString()
    pairs = [x for x in plan.splitlines() if "Join " in x and "a#" in x and "b#" in x]
    assert all(x.count(" = ") >= 2 for x in pairs)  # names meet by equality, never by their project alone
    got = {x.name: x.trusted for x in people.best_name_match(c, r).where("score >= 0.9").collect()}
    assert got["Customer#000000000"] == "Customer#000000001" and got["Customer#000000007"] == "Customer#000000001"
