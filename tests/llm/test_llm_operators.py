"""The operators on small tables: brute force, and nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from folioworks.llm import ann, bpe, html_text, jaccard, line_dedup, lm, near_vectors, packing, pii, quality, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, score double, part int, v long, n_lines string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


def rows():
    base = words(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [base, base, " ".join(near), None, "", "   \n\t ", "one two", "One  TWO", words(2, 40), words(2, 40) + "\n" + words(3, 30), words(3, 30), "x" * 30_000, words(4, 6000), "mail me: a.b@c.org or +1 (212) 555-0199, 10.0.0.1"]
    out = [(i, t, "en", "s", len(t) if t is not None else None, 7, 0.5, 3, 9, "z") for i, t in enumerate(texts)]
    out.append((None, words(5, 20), None, None, None, None, None, None, None, None))
    out.append(out[0])
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(ids, linked):
    at = {i: i for i in ids}
    for a, b in linked:
        x, y = at[a], at[b]
        for k in at:
            if at[k] in (x, y):
                at[k] = min(x, y)
    return at


def test_bpe_matches_library(spark, docs, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    ref = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), keep=("doc_id", "rank"), ids=True).collect()
    want = {r[0]: r[1] or "" for r in rows()}
    assert len(got) == len(rows())
    for r in got:
        ids = ref.encode_ordinary(want[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    assert bpe.encode_documents(none, P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.MinimalPerfectHash(keys)
    assert sorted(h.slots) == list(range(5000)) and all(keys[h.slots[h.slot(k)]] == k for k in keys)


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = packing.pack(docs, P.path("byte_bpe_50k.json")).toPandas()
    want = {r[0]: np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4") for r in rows()}
    for r in got.itertuples():
        ids = want[None if np.isnan(r.doc_id) else r.doc_id] if isinstance(r.doc_id, float) else want[r.doc_id]
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    assert got.length.sum() == sum(len(want[r[0]]) for r in rows())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and list(s.offset) == list(np.cumsum([0, *s.length])[:-1])
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0


def test_column_generation_holds_every_piece():
    rng = np.random.default_rng(0)
    hist = {int(k): int(rng.integers(1, 50)) for k in rng.choice(np.arange(1, 257), 90, replace=False)}
    used: dict = {}
    for p, n in packing.column_generation(hist, 256):
        assert sum(k * c for k, c in p.items()) <= 256
        for k, c in p.items():
            used[k] = used.get(k, 0) + c * n
    assert used == hist and packing.column_generation({}, 256) == []


def test_jaccard_matches_brute_force(spark, none):
    r = random.Random(7)
    texts = [words(i, r.choice([3, 8, 60, 200])) for i in range(25)]
    for _ in range(40):
        w = r.choice(texts).split(" ")
        for _ in range(r.choice([0, 1, 2])):
            w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += [None, "", "  "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    sets = [shingle_set(t) for t in texts]
    linked = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(range(len(texts)), linked)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link_documents(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in want}
    assert jaccard.link_documents(none).count() == 0


def test_jaccard_of_documents_that_are_mostly_common_passages(spark):
    r = random.Random(11)
    passages = [words(900 + i, 60).split(" ") for i in range(4)]
    texts = []
    for i in range(160):
        own = words(2000 + i, r.choice([0, 2, 5, 9, 14, 20])).split(" ")
        w = passages[i % 2][: r.choice([60, 60, 60, 57])] + (passages[2 + i % 2] if r.random() < 0.3 else []) + own
        if r.random() < 0.2:
            w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    linked = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(range(len(texts)), linked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for often in (3,):
        got = {x.doc_id: x.component_id for x in jaccard.link_documents(df, often=often).collect()}
        assert got == want and len(set(want.values())) > 3, often


def test_jaccard_odd_rows(spark, docs):
    got = jaccard.link_documents(docs).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[7] == 6 and by[3] == 3 and by[None] is None


def test_lines(spark, docs, none):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0].text == rows()[0][1] and got[1].text == "" and got[2].text == ""
    assert got[3].text is None and got[4].text == "" and got[9].n_removed == 1 and got[10].text == ""
    assert got[9].text == words(3, 30) and got[5].text == rows()[5][1] and got[7].text == ""
    assert line_dedup.dedup_lines(none).count() == 0


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 24)).astype(np.float32)
    x[50:80] = x[:30] + rng.normal(0, 0.06, (30, 24))
    x[80:90] = x[:10]
    data = [(i, v.tolist(), int(i % 2), 5) for i, v in enumerate(x)]
    data += [(200, None, 0, 5), (201, [0.0] * 24, 0, 5), (202, [float("nan")] * 24, 0, 5), (203, x[0].tolist(), None, 5), (204, [1.0, None], 0, 5), (205, [], 0, 5)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, n_links int")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = [(a, b) for a, b in itertools.combinations(range(150), 2) if a % 2 == b % 2 and y[a] @ y[b] >= 0.93]
    assert len(linked) > 10
    want = roots([d[0] for d in data], linked)
    for r in near_vectors.dedup_vectors(df).collect():
        assert r.n_links == sum(r.vec_id in p for p in linked) and r.component_id == want[r.vec_id] and r.kept == (want[r.vec_id] == r.vec_id)
    assert near_vectors.dedup_vectors(df.limit(0)).count() == 0


def test_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:140] = x[0]
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1020, [0.0] * 16, 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(df).toPandas()
    y, hit = x.astype(np.float64), 0
    for q, g in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:20]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id], rtol=0, atol=1e-12)
        hit += len(set(best) & set(g.vec_id))
    assert sorted(set(got.query_id)) == list(range(0, 400, 20)) and hit >= 0.9 * len(got)
    few = ann.nearest(spark.createDataFrame(data[:5], "vec_id long, embedding array<float>, rank int")).collect()
    assert len(few) == 4
    assert ann.nearest(df.limit(0)).count() == 0


def test_language_model(spark, docs, none):
    got = lm.score_documents(docs).toPandas()
    assert len(got) == len(rows())
    toks = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", lower(r[1])) + [None] for r in rows()}
    count: dict = {}
    for r in rows():
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10:
            for t in toks[r[0]]:
                count[t] = count.get(t, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in got.itertuples():
        w = toks[None if np.isnan(r.doc_id) else int(r.doc_id)]
        assert r.n_tokens == len(w) and r.train_tokens == n and r.n_known == sum(count.get(t, 0) > 0 for t in w)
        assert abs(r.base_score - sum(np.log10((count.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in w)) < 1e-6 * len(w)
        assert np.isfinite(r.score) and r.score < 0
    assert lm.score_documents(none).count() == 0


def test_language_model_is_a_distribution():
    v = lm.Vocabulary(["a", "b", "c"], [5, 3, 1], 4, [1] * lm.KINDS)
    m = lm.GatedModel(v)
    hs = np.random.default_rng(0).normal(size=(2, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(m.outputs(hs, np.array([i, i]))) for i in range(v.size))
    assert np.allclose(total, 1, atol=1e-4)


def test_pii(spark, docs, none):
    got = {r.doc_id: r for r in pii.find(docs, keep=("doc_id", "rank"), mask="masked").collect()}
    r = got[13]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1) and r.masked == "mail me: [EMAIL] or [PHONE], [IP]"
    assert got[3].spans == "" and got[3].masked is None and got[0].spans == ""
    assert pii.find(none).count() == 0


@pytest.mark.parametrize("alphabet", ["a@.-_b1", "0123456789.- +()a@", "12.", "45 -", "+1() .-"])
def test_pii_rules_are_the_plain_patterns(alphabet):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choices(alphabet, k=r.randint(1, 40)))
        assert pii.base_spans(t) == [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, t) if pii.passes(k, m.group())]


def test_html_has_no_switch_that_drops_light_runs():
    a, b = words(71, 60), words(72, 60)
    menu = "".join(f"<div><a href=x>{w}</a></div>" for w in "one two three four".split())  # nothing but its links marks it
    page = f"<body>{menu}<p>{a}</p>{menu}<p>{b}</p>{menu}<p>The end.</p></body>"
    assert html_text.main_text(page) == f"{a}\n\n{b}\n\nThe end." and "two" in html_text.lines(page)[0]
    with pytest.raises(TypeError):
        html_text.main_text(page, least=0.2)


def test_quality_sends_a_kept_text_to_python_once(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    own, kept = quality.score_documents(docs, labels), quality.score_documents(docs, labels, keep=("doc_id", "text", "n_chars"))
    assert "__text" in own._jdf.queryExecution().toString() and "__text" not in kept._jdf.queryExecution().toString()
    key = lambda r: (str(r.doc_id), r.score, r.held_out, r.predicted)
    assert sorted(map(key, own.collect())) == sorted(map(key, kept.collect()))
    assert sorted((str(r.doc_id), r.text or "", r.n_chars is None) for r in kept.collect()) == sorted((str(r.doc_id), r.text or "", r.n_chars is None) for r in docs.collect())


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (8, 0, 0), (9, 1, 0), (9, 0, 0), (None, 1, 0), (12, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(14) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert quality.score_documents(none, labels).count() == 0
    assert quality.score_documents(docs, labels.limit(0)).count() == len(rows())


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; more</h1><p>One   two<p>Three<br>four<div class='comments'>no</div></article><aside>side</aside><footer>f</footer>"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "plain &lt; text", "x"), (4, "u", "plain &lt; text", "x"), (5, "u", "<p>a" * 3000, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text == "Head & more\n\nOne two\n\nThree\n\nfour" and by[1].n_chars == len(by[1].text)
    assert by[2].text == "" and by[3].text == "" and by[4].text == "plain < text" and len(got) == 6 and by[5].text.count("a") == 3000
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_every_article_and_text_outside():
    a, b, c = words(11, 40), words(12, 30), words(13, 60)
    nav, small = "<nav><a href=x>menu</a></nav>", "<div><p>short note</p></div>"
    siblings = f"<body>{nav}<article><p>{a}</p></article><article><p>{b}</p></article>{small}<footer>f</footer>"
    assert html_text.main_text(siblings) == f"{a}\n\n{b}\n\nshort note"
    # the text of the page is not in its one short article: surge and dive find it
    assert html_text.main_text(f"<body>{nav}<div><p>{c}</p><p>{a}</p></div><article><p>{b}</p></article>") == f"{c}\n\n{a}\n\n{b}"
    # with and without the element
    one = f"<body>{nav}<article><h1>Head</h1><p>{a}<br>{b}</p><div class='ad'>buy</div><p>{c}</p></article><footer>f</footer>"
    assert html_text.main_text(one) == f"Head\n\n{a}\n\n{b}\n\n{c}" == html_text.main_text(one.replace("article>", "div>"))


def test_html_drops_nothing_but_furniture():
    a, b = words(14, 60), words(15, 40)
    bare = "<div><a href=x>one</a></div><div><a href=y>two</a></div>"
    # a short closing paragraph after a menu, and a block of links between two of text
    assert html_text.main_text(f"<body><p>{a}</p><nav><a href=x>menu</a></nav><p>The end.</p>") == f"{a}\n\nThe end."
    assert html_text.main_text(f"<body>{bare}<p>{a}</p><p><a href=z>See the source</a></p><p>{b}</p>{bare}") == f"{a}\n\nSee the source\n\n{b}"
    assert html_text.main_text(f"<body>{bare}{bare}") == ""


def test_hash_of_a_line_does_not_depend_on_its_repeats(spark):
    line = words(21, 20)
    occ = spark.range(300_000).select("id", F.col("id").alias("row"), F.lit(2).alias("pos"), F.lit(line).alias("norm"))  # 6 million words
    occ = occ.withColumn("v", F.xxhash64("norm")).withColumn("h2", F.xxhash64("norm", F.lit(7)))
    many, once = line_dedup._hashed(occ, 0.85).collect(), line_dedup._hashed(occ.where("id = 0"), 0.85).collect()
    assert len(many) == len(once) == 1 and (many[0].s1, many[0].s2, many[0].n) == (once[0].s1, once[0].s2, once[0].n)
    assert (many[0].id, many[0].row, many[0].pos, many[0].times, once[0].times) == (0, 0, 2, 300_000, 1)


def test_line_texts_are_written_only_to_be_compared(spark, monkeypatch):
    saved, save = [], line_dedup.Scratch.save

    def watch(self, df, by=None):
        out = save(self, df, by)
        saved.append(out.count() if "norm" in out.columns else 0)
        return out

    monkeypatch.setattr(line_dedup.Scratch, "save", watch)
    docs = spark.createDataFrame([(i, "\n".join(words(100 * i + j, 30) for j in range(3))) for i in range(5)], "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).collect()
    assert {(r.n_lines, r.n_removed) for r in got} == {(3, 0)} and sum(saved) == 0
    near = docs.unionByName(docs.where("doc_id = 4").selectExpr("doc_id + 1 AS doc_id", "concat(text, 'x') AS text"))
    saved.clear()
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(near).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 3}
    assert 0 < sum(saved) <= 4


def test_lines_that_differ_in_one_place_are_found_however_short(spark):
    r, texts = random.Random(5), []
    for i in range(90):
        a = words(1000 + i, (2, 5, 10)[i % 3]).split(" ") + ["zzzzzzz"]
        b, k = list(a), r.randrange(len(a))
        b[k] = b[k][:-1] + "y"  # one character
        texts += [" ".join(a), " ".join(b)]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_removed = 1").select("doc_id").collect()
    assert {x.doc_id for x in got} == {2 * i + 1 for i in range(90)}


def test_lines_that_differ_in_four_places_are_found(spark):
    r, texts = random.Random(6), []
    for i in range(60):
        a = words(2000 + i, 80).split(" ")
        b = list(a)
        for k in range(4):
            b[20 * k + r.randrange(5, 15)] = f"other{k}"
        texts += [" ".join(a), " ".join(b)]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_removed = 1").select("doc_id").collect()
    assert {x.doc_id for x in got} <= {2 * i + 1 for i in range(60)} and len(got) >= 48, len(got)


def test_language_model_learns_from_every_training_document(spark):
    # a text that no draw of one in 16 by its hash takes, without a start on a few documents
    texts = spark.createDataFrame([(words(s, 60),) for s in range(40, 48)], "text string")
    text = texts.where(F.pmod(F.xxhash64("text"), F.lit(16)) != 0).orderBy("text").first().text
    got = lm.score_documents(spark.createDataFrame([(i, text) for i in range(3000)], "doc_id long, text string"), first=0).first()
    assert got.score > 0.5 * got.base_score


def test_pii_adds_spans_in_other_forms(spark):
    r = random.Random(3)
    num = lambda n: "".join(r.choices("0123456789", k=n))
    name = lambda: "".join(r.choices("abcdefghij", k=r.randint(3, 8)))
    phone = lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}"
    some = lambda: r.choice([f"{name()}.{name()}@{name()}.org", phone(), f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 255)}"])
    texts = [f"{words(i, 12)} {some()} {words(i + 5000, 9)} {some()} {words(i + 9000, 4)} {num(4)}" for i in range(300)]
    planted = []
    for i in range(40):
        form = r.choice([phone()[1:], f"{name()} @ {name()}.org", "[.]".join(str(r.randint(1, 255)) for _ in range(4))])
        planted.append(f"{words(i + 20000, 8)} {form} {words(i + 30000, 8)}")
    df = spark.createDataFrame(list(enumerate(texts + planted)), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.find(df).collect()}
    for i, t in enumerate(texts):
        assert {(k, a, b) for k, a, b in pii.base_spans(t)} <= {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in got[i].spans.split(","))}
    found = sum(bool(got[len(texts) + i].spans) for i in range(40))
    assert found >= 28, found


@pytest.mark.parametrize("step", [1, 3, 50])
def test_word_hashes_do_not_depend_on_the_step(step):
    r = random.Random(step)
    for _ in range(200):
        texts = ["".join(r.choices("ab é \t\nZ中", k=r.choice([0, 1, 2, 40, 300]))) for _ in range(r.randint(0, 5))]
        whole, first = shingles.word_hashes(texts)
        some, at = shingles.word_hashes(texts, step)
        assert whole.tolist() == some.tolist() and first.tolist() == at.tolist()
        alone = [shingles.word_hashes([w])[0].tolist() for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        assert whole.tolist() == [h for w in alone for h in w]
