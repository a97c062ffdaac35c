"""The filter audit against plain Python: one document and one order at a time."""

import itertools
import random
import re

import numpy as np

from folioworks.llm import filter_audit

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(rows, labels):
    first: dict = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((part or "", {f for f in bad if bad[f]}, any(a == i and q == 1 for a, q, _ in labels if i is not None), any(a == i and x == 1 for a, _, x in labels if i is not None)))
    out: dict = {}
    for part in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                failing = [d for d in own if f in d[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_audit_matches_plain_python(spark):
    r, rows = random.Random(3), []
    texts = [" ".join(r.choice(["alpha", "beta", "Gamma", "d#lta", "é中", "x" * 9]) + (str(r.random()) if r.random() < k % 3 / 2 else "") for _ in range(r.choice([1, 199, 200, 201, 500]))) for k in range(30)]
    texts += [None, "", " \t\n\x0b", "A" * 40_000, "\x1c " * 300, "ABCDE" * 2 + "a" * 490, "ABCDE" * 2 + "a" * 491]
    for i in range(150):
        rows.append((i, r.choice(texts), r.choice(["s", "s", "t", None, ""])))
    rows += [(None, texts[0], "s"), (None, None, "t"), rows[0], rows[0], (rows[0][0], rows[5][1], "t"), (-4, texts[3], "only")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 150, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*x, 1, 2, True) for x in rows], "doc_id long, text string, source string, mask int, n long, good boolean")
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(x.part, x.filter_order, x.step): [x[c] for c in COLUMNS] for x in filter_audit.audit(docs, marks).collect()}
    assert got == plain(rows, labels)
    assert {k[0] for k in got} == {"s", "t", "", "only"} and len(got) == 4 * 600
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    bare = filter_audit.audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0")
    assert bare.count() == 0


def test_a_hot_text_of_a_hot_part(spark):
    docs = spark.createDataFrame([(i, "same text", "one") for i in range(3000)], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(x.filter_order, x.step): x for x in filter_audit.audit(docs, marks).collect()}
    assert got["EABCD", 1].removed == 2999 and got["EABCD", 1].kept == 1 and got["EABCD", 2].removed == 1 and got["EABCD", 2].redundant == 2999
    assert got["EABCD", 1].toxic_lost == 1 and got["AEBCD", 2].redundant == 2999 and got["AEBCD", 1].removed == 3000


def test_removal_ranks_are_the_first_failing_place():
    names, place = filter_audit.positions("ABCDE")
    fails = (np.arange(32)[:, None] >> np.arange(5)) & 1 > 0
    rank = filter_audit.removal_ranks(fails, place)
    for m in range(32):
        for k, name in enumerate(names):
            assert rank[m, k] == next((s for s, f in enumerate(name) if fails[m]["ABCDE".index(f)]), 5)
