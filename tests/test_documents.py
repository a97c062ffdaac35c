"""Structured documents, assembly, decisions and graphs on small inline tables."""

from pyspark.sql import functions as F

from folioworks.operators import assemble, classify, documents, people, privacy, topology

DOC = """Помощник врача
Заказчик: ООО Ромашка
Период реализации: 2026
Тимлид: Иванов Иван

Суть проекта
Система для глаукомы и базы знаний.
Задачи проекта
- собрать данные
- собрать данные
- обучить модель
Для чего
Экономия времени
Вводные данные
Снимки
Выходные данные
Отчёты
Команда проекта
Иванов Иван"""


def files(spark, *texts, kind="txt"):
    return spark.createDataFrame([("p", i, f"f{i}.txt", kind, t) for i, t in enumerate(texts)], "project_id string, file_ord long, filename string, file_type string, text string")


def test_structured_documents_and_source_types(spark):
    r = documents.detect_structured(files(spark, DOC, "nothing", None)).orderBy("file_ord").collect()
    assert r[0].is_structured and r[0].structure_confidence == 0.75 and set(r[0].detected_sections) == {"essence", "tasks", "purpose", "inputs", "outputs", "team"}
    assert not r[1].is_structured and r[2].structure_confidence == 0.0 and len(r[2].missing_sections) == 9
    deck = "\n".join(f"Slide {i}:\n{t}" for i, t in enumerate(("Цель проекта", "Этапы проекта", "Подготовка данных", "Итоги проекта", "Команда проекта", "Шаг 1", "x", "y"), 1))
    got = documents.detect_source_type(files(spark, DOC, deck, "цель проекта", "", kind="pptx")).orderBy("file_ord").collect()
    assert [x.source_type for x in got] == ["ready_landing_doc", "project_presentation", "raw_materials", "unknown"]
    assert got[1].type_confidence == round(round(6 / 8 * 0.55 + 0.25, 3) + 0.12, 3)


def test_metadata_bullets_and_modules(spark):
    r = documents.parse_metadata(files(spark, DOC, "Заказчик: x\nb", None)).orderBy("file_ord").collect()
    assert (r[0].title, r[0].client, r[0].timeline, r[0].lead) == ("Помощник врача", "ООО Ромашка", "2026", "Иванов Иван")
    assert r[1].title is None and r[1].client == "x" and r[2].client is None
    b = files(spark, DOC, "a\n\nb").select(documents.section_bullets(F.col("text")).alias("b")).collect()
    assert b[0].b == ["собрать данные", "обучить модель"] and b[1].b == ["a", "b"]
    m = documents.parse_modules(files(spark, "Мы разрабатывали:\n1. GlaucoScan\nокт снимки\n\nмимо\n2) База знаний\n3. Прочее", "none")).orderBy("module_ord").collect()
    assert [(x.name, x.description, x.type) for x in m] == [("GlaucoScan", "окт снимки", "medical_ai / decision_support"), ("База знаний", "", "knowledge_system"), ("Прочее", "", "system")]


def test_model_answers(spark):
    f = spark.createDataFrame([(1, 'Sure:\n```json\n{"title": " T ", "tasks": ["a", "b",], "inputs": "x", "confidence": 7, "odd": 1,}\n```'), (2, "no braces"), (3, None)], "id int, text string")
    r = documents.parse_response(f, ("title", "client"), ("tasks", "inputs")).orderBy("id").collect()
    assert (r[0].title, r[0].client, r[0].tasks, r[0].inputs, r[0].confidence, r[0].warnings, r[0].error) == ("T", None, ["a", "b"], ["x"], 1.0, ["odd"], None)
    assert r[1].error == r[2].error == "no_json" and r[1].tasks == []


def test_context_and_joined_texts(spark):
    f = files(spark, "a" * 5000, "", "b" * 2999, "c" * 9000, "d" * 9000, "e")
    r = {x.file_ord: (x.used, len(x.context)) for x in documents.compact_context(f).collect()}
    assert {k: v[0] for k, v in r.items()} == {0: 3000, 2: 2999, 3: 3000, 4: 3000, 5: 1} and r[0][1] <= 3000
    got = documents.combine_text(files(spark, "Alpha", None, " ", "Beta"), headers=True).collect()
    assert got[0].text == "--- f0.txt ---\nAlpha\n\n--- f3.txt ---\nBeta"
    h = documents.heuristic_payload(files(spark, "Первый абзац.\n\n- a1\n- a2\n- a3\n- a4", None)).orderBy("file_ord").collect()
    assert h[0].essence == "Первый абзац." and h[0].goals == ["a1", "a2", "a3"] and h[0].inputs == ["a4"] and h[1].tasks == []


def test_assembly(spark):
    rows = [("p", 1, "client", "module_presentation", "Заказчик: Модуль"), ("p", 2, "client", "unknown", "x\nЗаказчик: ООО А"), ("p", 3, "client", "primary_project_doc", "Заказчик: ООО Б"), ("p", 4, "tasks", "unknown", "1. Собрать много данных\n- собрать много данных\nмало"), ("p", 5, "tasks", "unknown", "Обучить новую модель")]
    e = spark.createDataFrame(rows, "project_id string, item_ord int, field string, source_role string, text string")
    s = assemble.assemble_scalar(e, {"client": ((r"(?iU)^заказчик:\s*(.+)$", 0.8),)}).collect()
    assert [(x.value, x.score) for x in s] == [("ООО Б", 0.99)]
    assert [x.item for x in assemble.assemble_lists(e).orderBy("n").collect()] == ["Собрать много данных", "Обучить новую модель"]
    long = spark.createDataFrame([("p", 1, "A first sentence that is long enough. Цель: a marked sentence of some length. And one more sentence, also long.")], "project_id string, item_ord int, text string")
    assert assemble.assemble_essence(long, marks=("цель",), take=1).first().essence.startswith("Цель")
    own = spark.createDataFrame([("p", 1, "z" * 2000)], "project_id string, item_ord int, text string")
    assert assemble.assemble_essence(long, own).first().essence == "z" * 1500
    a = spark.createDataFrame([("p", "tasks", ["a"]), ("p", "inputs", ["b"])], "project_id string, field string, items array<string>")
    b = spark.createDataFrame([("p", "tasks", ["own"]), ("p", "inputs", [])], "project_id string, field string, items array<string>")
    assert {x.field: x["items"] for x in assemble.apply_primary(a, b).collect()} == {"tasks": ["own"], "inputs": ["b"]}


def test_decisions(spark):
    s = spark.createDataFrame(
        [(1, 1, ["a.pdf"], 0, False, False, True), (2, 2, ["a.DOCX", "b.pptx"], 0, False, False, False), (3, 2, ["a.pptx"], 3, True, False, False), (4, 2, ["a.pptx"], 3, True, True, True), (5, 2, ["a.txt"], 3, True, True, False), (6, 0, [], 0, False, False, False)],
        "project_id int, source_count int, filenames array<string>, team_structured_count int, contract_has_team boolean, export_has_team boolean, landing_stale boolean",
    )
    s = s.withColumns({"evidence_count": F.lit(0), "team_coverage": F.lit("missing"), "is_technical": F.lit(True)})
    assert [(r.status, r.classification) for r in classify.verdict(s).orderBy("project_id").collect()] == [
        ("USER_ACTION_REQUIRED", "single_file_no_team_source"), ("BUG", "docx_present_but_team_missing"), ("BUG", "contract_has_team_but_export_missing"),
        ("STALE", "stale_generated_landing"), ("OK", "team_pipeline_ok"), ("USER_ACTION_REQUIRED", "technical_or_empty_project"),
    ]
    d = classify.classify_domain(files(spark, "qdrant vector retrieval with whisper"))
    rules = {"knowledge": ("rag_system", ("vector", "retrieval")), "voice": ("speech_ai", ("whisper",)), "doctor": ("medical_ai", ("vector",)), "any": (None, ("with",))}
    a = classify.detect_archetypes(d, rules).first().archetypes
    assert [(x.key, x.confidence) for x in a][0] == ("knowledge", 0.84) and "doctor" not in {x.key for x in a} and len(a) <= 3
    p = classify.detect_patterns(d, {"rag": ("vector", "retrieval"), "stream": ("nope",)}, {("rag", "rag_system"): 0.08}).first().patterns
    assert [(x.key, x.confidence) for x in p] == [("rag", 0.76)]
    v = spark.createDataFrame([("команда и роли", 1), ("", 0), ("x" * 50, 0), ("", 1)], "text string, image_count int")
    assert [r.content_type for r in classify.classify_visual(v, {"team": ("команда", "роли"), "stack": ("redis",)}).collect()] == ["team", "unknown", "generic", "generic"]
    c = spark.createDataFrame([("Иванов Иван", "разработчик", False), ("Поиск Новый", "разработчик", True), ("Иванов Иван", "", True), ("Иванов Иван", "", False)], "name string, role string, in_team_context boolean")
    assert [r.reason for r in classify.candidate_reason(c).collect()] == ["accepted: valid_name_with_role", "rejected: domain_stop_word", "accepted: valid_name_in_team_context", "rejected: outside_team_context"]


def test_people(spark):
    c = spark.createDataFrame([("p", "aaaaaaaaabcd")], "project_id string, name string")
    r = spark.createDataFrame([("p", "aaaaaaaaaefg", 1)], "project_id string, name string, roster_ord int")
    m = people.best_name_match(c, r).first()
    assert m.tier == "weak_fuzzy" and m.score == 0.75
    n = spark.createDataFrame([("p", "Иванов Иван", 4, True), ("p", "Иванов Иван", 9, False), ("p", "Петрова Анна", 2, True)], "project_id string, name string, file_ord long, is_ocr boolean")
    c = spark.createDataFrame([("p", "иванов  иван"), ("p", "Петрава Анна"), ("p", "Совсем Другой")], "project_id string, name string")
    got = {x.name: (x.source_file, x.source_is_ocr, x.resolved) for x in people.resolve_sources(c, n).collect()}
    assert got == {"иванов  иван": (9, False, "exact"), "Петрава Анна": (2, True, "fuzzy"), "Совсем Другой": (None, False, "none")}


def test_placeholders_that_stand_in_a_text_are_no_data(spark):
    f = files(spark, "see [EMAIL_1] and a@b.com and [=EMAIL_1]", "plain [EMAIL_1]")
    e = privacy.privacy_pass(f, names=False, medical=False)
    red = privacy.redact_text(f, e)
    back = {r.file_ord: r.restored for r in privacy.rehydrate(red, privacy.mapping_of(e)).collect()}
    assert back == {0: "see [EMAIL_1] and a@b.com and [=EMAIL_1]", 1: "plain [EMAIL_1]"}
    assert all("a@b.com" not in r.redacted for r in red.collect())
    bundle = privacy.redacted_bundle(red).first().safe_text
    assert "a@b.com" not in bundle and bundle.startswith("### f0.txt\n")
    out = privacy.scrub_payload(files(spark, "write to a@b.com"), privacy.mapping_of(e), ("text",)).first()
    assert "a@b.com" not in out.text


def test_architecture_graph(spark):
    rows = [("p", 1, "React UI", "stack", False), ("p", 2, "FastAPI", "stack", False), ("p", 3, "Redis", "stack", False), ("p", 4, "Redis", "tasks", False), ("p", 5, "Data Ingestion", "inputs", True), ("p", 6, "Worker", "tasks", False), ("p", 7, "unheard of", "tasks", False)]
    labels = spark.createDataFrame(rows, "project_id string, label_ord long, label string, source string, inferred boolean")
    blocks = spark.createDataFrame([("p", 0, "React UI with FastAPI,"), ("p", 1, "Redis and a worker")], "project_id string, block_ord int, content string")
    n = topology.topology_nodes(labels, blocks)
    got = {r.slug: (r.node_type, r.layer, r.inferred, r.sources) for r in n.collect()}
    assert got["redis"] == ("redis", "data", False, ["stack", "tasks"]) and got["data-ingestion"][2] and "unheard-of" not in got
    e = {(r.source, r.target): (r.relation, r.confidence) for r in topology.topology_edges(n).collect()}
    assert e[("data-ingestion", "worker")] == ("process", 0.8) and e[("react-ui", "fastapi")] == ("API", 0.5)
    b = spark.createDataFrame([("p", "essence", "text", []), ("p", "tasks", "", ["x"]), ("p", "team", " ", [])], "project_id string, block_key string, content string, bullets array<string>")
    plan = spark.createDataFrame([("p", 0, "essence", "essence"), ("p", 1, "system", "essence"), ("p", 2, "modules", "tasks"), ("p", 3, "team", "team")], "project_id string, section_ord int, section string, block_key string")
    s = {r.section: (r.missing, r.overall) for r in topology.semantic_sections(b, plan).collect()}
    assert s == {"essence": (False, 0.75), "modules": (False, 0.6), "team": (True, None)}
