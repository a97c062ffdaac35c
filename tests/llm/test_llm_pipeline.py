"""The pipeline on the smallest tables: what each stage keeps, against plain Python where that can say it."""

import itertools
import re

import corpus_pipeline
from folioworks.llm import pii

SF = "/root/testdata/sf0.001"


def sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.toPandas().set_index("doc_id")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen.append(docs.toPandas().set_index("doc_id"))
    every, good, lines, single, masked = seen
    assert set(good.index) < set(every.index) and (good.text == every.text[good.index]).all()
    assert set(lines.index) == set(good.index) and (lines.n_chars == lines.text.str.len()).all()
    kept = [x for t in lines.text for x in t.split("\n") if re.search(r"\w", x)]
    plain = [re.sub(r"[\W_]+", " ", x.lower()).strip() for x in kept]
    assert len(plain) == len(set(plain)), "no line stays twice"
    linked = [(a, b) for (a, x), (b, y) in itertools.combinations([(d, sets(t)) for d, t in lines.text.items()], 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    assert set(lines.index) - set(single.index) == {max(p) for p in linked} or not linked
    assert set(masked.index) == set(single.index)
    for d, t in masked.text.items():
        assert not pii.base_spans(t) and masked.n_chars[d] == len(t)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == set(masked.index) and (pieces.groupby("sequence_id").length.sum() <= 1024).all()
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_copies_go_by_row(spark):
    w, u = (" ".join(f"{c}{i}" for i in range(30)) for c in "wu")
    rows = [(3, w), (5, w), (5, u), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, w), (None, "left alone by all the others here"), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(3, w), (5, u), (7, "a b c d e f g"), (None, "left alone by all the others here"), (8, None), (8, None), (9, "")], key=repr)
    once = docs.where("doc_id in (3, 9) or (doc_id = 5 and text like 'w%')")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, once, SF).collect()) == [3, 9]
    assert corpus_pipeline.drop_copies(spark, docs.limit(0), SF).count() == 0
