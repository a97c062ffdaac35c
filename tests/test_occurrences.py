"""Strings in texts, scrubbed payloads, leaks, previews, sources of names and fingerprints, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folioworks.operators import occurrences, people, privacy
from folioworks.streaming import uploads


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abА[]_1E", k=r.randint(1, 5)))
    needles = [(p, word()) for p in "ppq" for _ in range(40)] + [("p", ""), ("p", None), ("z", "a"), (None, "a")]
    texts = [(r.choice("pqr"), i, " ".join(word() for _ in range(r.choice([0, 1, 30])))) for i in range(n)] + [("p", n, None), ("p", n + 1, "ab" * 20_000)]
    return texts, needles


@pytest.mark.parametrize("bucket, chars", [(20_000, 8 << 20), (7, 100)])
def test_occurring_against_all_pairs(spark, bucket, chars):
    texts, needles = made(bucket)
    got = occurrences.occurring(spark.createDataFrame(texts, "project_id string, file_ord long, text string"), spark.createDataFrame(needles, "project_id string, needle string"), bucket=bucket, chars=chars).collect()
    want = {(p, i, n) for p, i, t in texts for q, n in needles if p == q and n and t and n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scrubbed_as_by_plain_replacement(spark, seed):
    texts, needles = made(seed)
    r, mapping = random.Random(seed), {}
    for p, n in sorted({(p, n) for p, n in needles if p and n}):
        mapping.setdefault(p, {})[n] = f"[{r.choice(['EMAIL', 'E', 'AB'])}_{r.randint(1, 30)}]"
    rows = [(p, m, o) for p, d in mapping.items() for o, m in d.items()]
    rows += [(p, "[A_0]", o) for p, m, o in rows[:5]]  # shorter ones, which come first
    df = spark.createDataFrame([(p, i, t, [t, None, "ab a"] if t is not None else None, 5) for p, i, t in texts], "project_id string, file_ord long, text string, items array<string>, l int")
    got = {(x.project_id, x.file_ord): x for x in privacy.scrub_payload(df, spark.createDataFrame(rows, "project_id string, placeholder string, original string"), ("text", "items")).collect()}

    def plain(p, t):
        for o, m in sorted(mapping.get(p, {}).items(), key=lambda x: (-len(x[0]), x[0])):
            t = t.replace(o, m)
        return t

    for p, i, t in texts:
        assert got[p, i].text == (None if t is None else plain(p, t)) and got[p, i].l == 5
        assert got[p, i]["items"] == (None if t is None else [plain(p, t), None, plain(p, "ab a")])


def test_leaks(spark):
    t = spark.createDataFrame([("p", 1, "write to a@b.org"), ("p", 2, "[EMAIL_1]"), ("q", 1, "a@b.org"), ("p", 3, None)], "project_id string, file_ord long, redacted string")
    e = spark.createDataFrame([("p", "a@b.org"), ("p", "")], "project_id string, original string")
    assert [(r.project_id, r.file_ord) for r in privacy.leaks(t, e).collect()] == [("p", 1)]
    files = spark.createDataFrame([("p", 1, "a.txt", "Mail a@b.org"), ("p", 2, "b.txt", "a@b.org, +7 912 345-67-89")], "project_id string, file_ord long, filename string, text string")
    found = privacy.privacy_pass(files)
    assert privacy.leaks(privacy.redact_text(files, found), found).count() == 0


def test_preview_needs_the_first_files_only(spark):
    texts = [(i, r * "x") for i, r in enumerate([0, 3, 1, 0, 9] * 8)] + [(99, None)]
    df = spark.createDataFrame([("p", i, "f", t) for i, t in texts] + [("q", 1, "f", "y" * 50)], "project_id string, file_ord long, filename string, redacted string")
    whole = "\n\n".join(t or "" for _, t in texts)
    got = {r.project_id: r for r in privacy.safe_payload(df, 20).collect()}
    assert (got["p"].preview, got["p"].total_chars, got["p"].n_files) == (whole[:20], len(whole), len(texts)) and got["q"].preview == "y" * 20


def test_sources_of_names_in_texts(spark):
    c = spark.createDataFrame([("p", "Иван Петров"), ("p", "Пётр Ильин"), ("p", "Анна Белова"), ("p", "Олег Попов"), ("q", "Иван Петров")], "project_id string, name string")
    n = spark.createDataFrame([("p", "Иван Петров", 1, False)], "project_id string, name string, file_ord int, is_ocr boolean")
    f = spark.createDataFrame(
        [("p", 1, "x", None, "docx", "slide 2", None), ("p", 2, "ПЁТР ИЛЬИН", True, "png", None, "t"), ("p", 3, "пётр ильин", False, "pdf", "slide 4", None), ("p", 4, "пётр ильин", False, "txt", None, None), ("p", 5, "анна белова", None, "ocr", None, "e"), ("q", 9, None, None, None, None, None)],
        "project_id string, file_ord long, text string, is_ocr boolean, file_type string, location string, ocr_engine string",
    )
    got = {(r.project_id, r.name): tuple(r)[2:] for r in people.resolve_sources(c, n, f).collect()}
    assert got == {
        ("p", "Иван Петров"): (1, False, "exact", "docx", "slide 2", None), ("p", "Пётр Ильин"): (4, False, "text", "txt", None, None), ("p", "Анна Белова"): (5, True, "text", "ocr", None, "e"),
        ("p", "Олег Попов"): (None, False, "none", None, None, None), ("q", "Иван Петров"): (None, False, "none", None, None, None),
    }


def test_fingerprint_in_two_levels(spark):
    rows = [("p", i, f"f{i}", f"text {i}" if i % 4 else None) for i in range(23)]
    df = spark.createDataFrame(rows, "project_id string, file_ord long, filename string, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = [(i, sha(f"{i}\n{f}\n{t or ''}")) for _, i, f, t in rows]
    outer = "".join(sha("".join(d for i, d in own if i % 5 == part)) for part in range(5))
    first = uploads.fingerprints(df.repartition(3), 5).first().fingerprint
    assert first == sha(f"p\n{outer}")[:24] == uploads.fingerprints(df.repartition(7), 5).first().fingerprint
    changed = df.withColumn("text", F.when(F.col("file_ord") == 7, "other").otherwise(F.col("text")))
    assert uploads.fingerprints(changed, 5).first().fingerprint != first


def test_many_small_projects_share_groups(spark):
    # ids that differ behind a NUL only are different projects
    name = lambda c: F.concat(F.lit("p\x00"), c.cast("string"))
    texts = spark.range(120).select(name(F.col("id") % 40).alias("project_id"), F.col("id").alias("file_ord"), F.concat(F.lit("has "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    needles = spark.range(40).select(name(F.col("id")).alias("project_id"), F.explode(F.array(F.col("id").cast("string"), (F.col("id") + 80).cast("string"), F.lit("none"))).alias("needle"))
    plain = sorted((f"p\x00{i % 40}", i, n) for i in range(120) for n in {str(i % 40), str(i % 40 + 80)} if n in f"has {i}.")
    for bucket, chars in ((20_000, 1 << 23), (20, 200), (2, 1 << 23)):
        assert sorted(tuple(r) for r in occurrences.occurring(texts, needles, bucket=bucket, chars=chars).collect()) == plain
