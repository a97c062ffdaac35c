"""Operators on small inline tables: Cyrillic names, masks and their way back, streams, ranks."""

import os
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioworks.functions import text as tx
from folioworks.operators import classify, evidence, fusion, graph, measure, people, privacy, segment
from folioworks.plans import registry
from folioworks.streaming import uploads

TEXT = "Пациент: Иванов Иван Иванович\nПочта alex.dreval@example.com, телефон +7 (495) 123-45-67"


def files(spark, *texts):
    return spark.createDataFrame([("p", i, f"f{i}.txt", "txt", t) for i, t in enumerate(texts)], "project_id string, file_ord long, filename string, file_type string, text string")


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x"))).collect()[0][0]


def test_privacy_pass(spark):
    f = files(spark, TEXT, None, "nothing here")
    e = privacy.privacy_pass(f)
    kinds = {r.type for r in e.collect()}
    assert {"email", "phone"} <= kinds
    r = {x.file_ord: x.redacted for x in privacy.redact_text(f, e).collect()}
    assert "alex.dreval" not in r[0] and "[EMAIL_1]" in r[0] and r[1] is None and r[2] == "nothing here"
    assert privacy.risk_level(e).collect()[0].risk in ("high", "critical")
    back = privacy.rehydrate(privacy.redact_text(f, e), privacy.mapping_of(e))
    assert {x.file_ord: x.restored for x in back.collect()}[0].count("alex.dreval@example.com") == 1


def test_names_and_organisations(spark):
    f = files(spark, "Автор: Петров Пётр, заказчик: Сидоров Сидор. " + "x" * 60 + " Python Google")
    got = {(r.type, r.original) for r in privacy.detect_entities(f).collect()}
    assert ("person_name", "Петров Пётр") in got and ("organization", "Сидоров Сидор") in got and not any("Google" in o for _, o in got)


def test_kept_spans_do_not_overlap_and_partitions_do_not_matter(spark):
    f = files(spark, *[TEXT + f" {i} user{i}@mail.example.org @telegram_{i}x" for i in range(12)])
    results = []
    for n in (1, 7):
        e = privacy.privacy_pass(f.repartition(n)).collect()
        spans = {}
        for r in e:
            spans.setdefault(r.file_ord, []).append((r.start, r.end))
        for s in spans.values():
            s.sort()
            assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))
        results.append(sorted((r.file_ord, r.start, r.placeholder) for r in e))
    assert results[0] == results[1]


def test_text_functions(spark):
    assert one(spark, tx.normalize_text, "a  b\r\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, tx.normalize_bullet, " • 1) Some   task") == "Some task"
    assert one(spark, tx.extract_dates, "x 01.02.2024 - 03.04.2024 y") == ["01.02.2024 - 03.04.2024"]
    assert one(spark, tx.sanitize_url, "javascript:x") is None and one(spark, tx.sanitize_url, "/a/b") == "/a/b"
    assert one(spark, tx.canonical_tech, "postgres") == "PostgreSQL"
    assert one(spark, tx.person_key, "Иванов Иван https://x.y") == "иванов иван"
    assert one(spark, tx.bullets, "Head\n- one\n- two\n- one") == ["one", "two"]


def test_slides_and_stack(spark):
    got = segment.split_slides(files(spark, "Slide 1:\nTitle here\nbody\nSlide 2:\nNext one")).orderBy("location_index").collect()
    assert [(r.location_index, r.location_label) for r in got] == [(1, "Title here"), (2, "Next one")]
    stack = segment.parse_stack(files(spark, "Backend:\n- Redis\n- Redis\nFrontend:\n- React")).collect()
    assert {r.category: r["items"] for r in stack} == {"Backend": ["Redis"], "Frontend": ["React"]}


def test_domain(spark):
    got = classify.classify_domain(files(spark, "YOLO detection of images", "")).orderBy("file_ord").collect()
    assert got[0].primary_domain == "computer_vision" and got[0].confidence >= 0.45 and got[1].primary_domain == "general" and got[1].confidence == 0.3


def test_names(spark):
    q = lambda s: one(spark, people.name_quality, s)
    assert q("Иванов Иван Иванович") == 1.0 and q("") == 0.0 and q("Ив4нов") < 0.5
    c = spark.createDataFrame([("p", "Иванов Иван"), ("p", "Ивaнов Ивам"), ("p", "Совсем Другой")], "project_id string, name string")
    r = spark.createDataFrame([("p", "Иванов Иван", 1)], "project_id string, name string, roster_ord int")
    got = {x.name: x.tier for x in people.best_name_match(c, r).collect()}
    assert got["Иванов Иван"] == "exact" and got["Ивaнов Ивам"] == "weak_fuzzy" and got["Совсем Другой"] == "no_match"


def test_fusion_of_lists_and_teams(spark):
    rows = [("p", "tasks", "- first task here\n- second task here", 1), ("p", "tasks", "1. First task here\nзадачи проекта", 2)]
    got = fusion.fuse_lists(spark.createDataFrame(rows, "project_id string, field string, value string, rank int")).orderBy("item_ord").collect()
    assert [r.item for r in got] == ["first task here", "second task here"]
    m = spark.createDataFrame([("p", "Иванов Иван", "", "", ["a"], 1), ("p", "Иванов Иван Петрович", "dev", "x", ["b", "a"], 2)], "project_id string, name string, role string, project_area string, contributions array<string>, item_ord int")
    t = fusion.fuse_team(m).collect()
    assert len(t) == 1 and t[0].name == "Иванов Иван Петрович" and t[0].role == "dev" and t[0].contributions == ["a", "b"]


def test_graph_edges_have_both_ends(spark):
    b = spark.createDataFrame([("p", 0, "user", "Redis, PostgreSQL; queue worker"), ("p", 1, "assistant", "parser, Redis")], "project_id string, block_ord int, block_key string, content string")
    e = graph.extract_entities(b, {"user": "module", "assistant": "technology"})
    slugs = {r.slug for r in e.collect()}
    assert "redis" in slugs
    rel = graph.validate_graph(e, graph.build_relations(e, (graph.Relation(("module",), ("technology",), "uses", 8, 6),))).collect()
    assert rel and all(r.source in slugs and r.target in slugs and r.source != r.target for r in rel)


def test_engines(spark):
    runs = spark.createDataFrame([(1, "a", True, 1, 1, True, 577, 0), (1, "b", True, 7, 2, True, 829, 0), (1, "c", False, 0, 0, False, 0, 0)], "page int, engine string, ok boolean, accepted int, known int, section boolean, chars int, rejected int")
    assert measure.best_engine(runs).collect()[0].engine == "b"


def test_technologies(spark):
    got = files(spark, "We use postgres and Docker Compose with YOLOv8").select(evidence.extract_technologies(F.col("text")).alias("t")).collect()[0].t
    assert got == ["Docker Compose", "PostgreSQL", "YOLOv8", "Docker", "YOLO"] or set(got) == {"Docker Compose", "PostgreSQL", "YOLOv8", "Docker", "YOLO"}


def test_stream_equals_batch_and_runs_once(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rec = "project_id string, filename string, file_type string, text string, metadata map<string,string>, warnings array<string>, errors array<string>"
    spark.createDataFrame([("p", "a.txt", "txt", TEXT, None, None, None), ("q", "b.txt", "txt", "none", None, None, None)], rec).write.parquet(f"{top}/in")
    for _ in range(2):
        uploads.stream_upload_pipeline(spark, f"{top}/in", f"{top}/out", f"{top}/ck", "2024-06-01 00:00:00").awaitTermination()
    got = {r.project_id: r for r in spark.read.parquet(f"{top}/out/reports").collect()}
    assert got["p"].has_pii and not got["q"].has_pii and len(got) == 2 and {r.batch for r in got.values()} == {0}


def test_expiry(spark):
    r = spark.createDataFrame([(1, "2024-01-01 00:00:00", None), (2, "2024-01-05 00:00:00", None), (3, None, None)], "id int, created_at string, expires_at string")
    r = r.select("id", F.col("created_at").cast("timestamp").alias("created_at"), F.col("expires_at").cast("timestamp").alias("expires_at"))
    assert {x.id for x in uploads.expire_reports(r, "2024-01-06 00:00:00").collect()} == {2, 3}


def test_known_sections(spark):
    got = segment.split_known_sections(files(spark, "Intro\nStack:\nRedis\n\nPython\n# Team\nIvan\nstack\nGo"), {"stack": "tech", "team": "people"}).collect()
    assert {r.key: r.text for r in got} == {"tech": "Redis\nPython\nGo", "people": "Ivan"}


def test_fusion_sees_whole_texts(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    head = "x" * 250
    rows = [(0, f"{head} one", "en", "s"), (3, f"{head} two", "en", "s"), (1, f"{head}\n- a task far down the list", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", head)], "conv_id long, turn int, role string, text string").write.parquet(f"{top}/conversations.parquet")
    q = registry.queries()
    assert [(r.field, r.n_values) for r in q["fus_09_conflicts"](spark, top).collect()] == [("title", 2)]
    assert "a task far down the list" in {r.item for r in q["fus_05_fuse_lists"](spark, top).collect()}
    assert q["fus_08_fuse_modules"](spark, top).first().description == head


def test_impact_metrics_of_numbers_beyond_a_bigint(spark):
    f = files(spark, "6437 4918187128635271 posts, 9223372036854775807 posts, 007 tests, 2 users", "4918187128635271 posts, 12 tests, 003 days")
    got = {r.label: (r.value, r.digits) for r in measure.impact_metrics(f, {"post": "posts", "test": "tests", "user": "users", "day": "days"}).collect()}
    assert got == {"posts": (None, "64374918187128635271"), "tests": (12, "12"), "days": (3, "3")}


def test_fused_text_sorts_no_project_and_is_the_same(spark):
    head = "A text that is the longest one of its project. It says a good deal of things here" + " and there" * 9
    tail = " and so on" * 150
    rows = [
        ("p", 1, 0.9, head), ("p", 2, 0.5, "A sentence nobody else has. IT SAYS A GOOD DEAL of things here. Another new sentence. Third new sentence here"), ("p", 2, 0.5, "Third new sentence here. And one more of its own"),
        ("p", 3, 0.7, "another  New sentence. too short"), ("p", 4, 0.1, None), ("q", 1, 0.1, head + tail), ("q", 2, 0.9, "Something new that finds no place"), ("r", 1, 0.1, "short"), ("s", 1, 0.1, None),
    ]
    c = spark.createDataFrame(rows, "project_id string, cand_ord long, score double, value string").withColumn("field", F.lit("tasks"))
    got = {r.project_id: r.value for r in fusion.fuse_text(c.repartition(3)).collect()}
    mine = head + " another  New sentence. "
    assert got["q"] == (head + tail)[:1500] and got["r"] == "short" and got["s"] == ""
    # of the two texts of one score and cand_ord either may be first
    assert got["p"] in (mine + "A sentence nobody else has. Third new sentence here. And one more of its own", mine + "Third new sentence here. And one more of its own. A sentence nobody else has")
    ranked = c.where("value is not null and cand_ord != 2").withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), "cand_ord")))
    assert {r.project_id: r.value for r in fusion.fuse_text(ranked).collect()} == {"p": head + " another  New sentence", "q": (head + tail)[:1500], "r": "short"}


def test_many_sentences_fill_a_text(spark):
    rows = [("p", i, 1.0 - i / 1000, f"sentence number {i:03} is new. another one is {i:03} too") for i in range(200)]
    c = spark.createDataFrame(rows, "project_id string, cand_ord long, score double, value string")
    want = rows[0][3] + " " + ". ".join(r[3] for r in rows[1:])
    assert fusion.fuse_text(c.repartition(5)).first().value == want[:1500]
