"""Graphs, generated sections, cards and checks on small fixtures: nulls, ties, repeats, empty tables."""

from pyspark.sql import functions as F

from folioworks.operators import graph, measure, topology

BLOCKS = "project_id string, block_ord int, block_key string, content string, bullets array<string>"
ENTITY = "project_id string, slug string, rank int, label string, type string, confidence double, inferred boolean"


def test_half_of_the_words_rounded_down(spark):
    b = spark.createDataFrame([("p", 0, "tasks", "a queue of parsers, ai", None), ("q", 0, "tasks", None, None)], BLOCKS)
    rows = [("p", "queue of nothing known", True), ("p", "nothing known queue", True), ("p", "nothing known", False), ("p", "ai", False), ("p", None, False), ("p", "one two three queue", False), ("q", "queue", False)]
    labels = spark.createDataFrame([(p, str(i), x) for i, (p, x, _) in enumerate(rows)], "project_id string, slug string, label string")
    got = {r.slug: r.grounded for r in graph.ground_labels(labels, b).collect()}
    assert got == {str(i): w for i, (_, _, w) in enumerate(rows)}


def test_a_pattern_may_relate_a_technology_to_itself_and_copies_go(spark):
    e = spark.createDataFrame([("p", "redis", 1, "Redis", "technology", 0.8, False), ("p", "bot", 2, "Bot", "pipeline", 0.8, False), ("p", "app", 3, "App", "module", 0.8, False)], ENTITY)
    patterns = spark.createDataFrame([("p", 0, "one", ["Redis", "App", "none"]), ("p", 1, "two", ["App"]), ("q", 0, "one", ["App"])], "project_id string, pattern_ord int, pattern string, related_modules array<string>")
    rows = graph.build_relations(e, patterns=patterns).orderBy("rel_ord").collect()
    assert [(r.source, r.target, r.relation, r.confidence, r.evidence) for r in rows] == [
        ("app", "redis", "uses", 0.7, "module_uses_tech:Redis"), ("bot", "redis", "uses", 0.7, "module_uses_tech:Redis"), ("redis", "redis", "depends_on", 0.45, "pattern:one"), ("app", "redis", "depends_on", 0.45, "pattern:one"),
    ]
    assert graph.build_relations(e.limit(0), patterns=patterns).count() == 0


def test_relations_do_not_depend_on_partitions_and_end_at_the_limit(spark):
    kinds = ("module", "technology", "output")
    e = spark.range(90).select(F.lit("p").alias("project_id"), F.format_string("s%02d", "id").alias("slug"), F.col("id").cast("int").alias("rank"), F.format_string("l%02d", "id").alias("label"), F.get(F.array(*map(F.lit, kinds)), (F.col("id") % 3).cast("int")).alias("type"))
    one = [tuple(r) for r in graph.build_relations(e.coalesce(1)).orderBy("rel_ord").collect()]
    assert one == [tuple(r) for r in graph.build_relations(e.repartition(7)).orderBy("rel_ord").collect()]
    plain = [(m, t) for m in range(0, 90, 3) for t in range(1, 90, 3)[:8]]
    assert len(one) == 240 and [(int(r[1][1:]), int(r[2][1:])) for r in one] == plain


def test_checked_entities(spark):
    rows = [("p", "a", 1, "Redis", "module", 0.9, False), ("p", "b", 2, "redis ", "module", 0.9, False), ("p", "c", 3, "me@host.org", "module", 0.9, False), ("p", "d", 4, "ME@host.org", "module", 0.9, False), ("p", "e", 5, "unheard", "team_role", 0.9, False), ("p", "f", 6, "unheard too", "module", 0.4, False), ("p", "g", 7, "guessed", "module", 0.7, True), ("p", "h", 8, None, "module", 0.9, False)]
    b = spark.createDataFrame([("p", 0, "tasks", "with redis", None)], BLOCKS)
    got = {r.slug: (r.status, r.warnings) for r in graph.check_entities(spark.createDataFrame(rows, ENTITY), b).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "kept", "b": "duplicate", "c": "personal", "d": "duplicate", "e": "ungrounded", "f": "ungrounded", "g": "kept", "h": "kept"}
    assert got["g"][1] == ["inferred_but_sure"] and got["h"][1] == ["not_grounded"] and got["a"][1] == []
    assert graph.check_entities(spark.createDataFrame(rows, ENTITY), b.limit(0)).where("grounded").count() == 0


def test_notes_and_summary(spark):
    b = spark.createDataFrame([("p", 0, "results", " ", []), ("p", 1, "results", "42 %", ["x"]), ("p", 2, "inputs", "Privacy and HIPAA", None), ("q", 0, "tasks", None, None)], BLOCKS)
    p = spark.createDataFrame([("p", "medical_ai"), ("q", None), ("r", "rag_system")], "project_id string, domain string")
    notes = {(r.project_id, r.kind, r.note_ord): r.note for r in graph.graph_notes(p, b).collect()}
    assert notes[("p", "risk", 0)] == graph.RISK_NOTE and notes[("p", "risk", 3)] == graph.NO_RESULTS and notes[("p", "constraint", 2)] == "Privacy and HIPAA"
    assert not any(k[:2] == ("p", "metric") for k in notes)  # the first block of results has no bullets
    assert sum(k[:2] == ("r", "missing") for k in notes) == 5 and notes[("r", "recommendation", 2)] == graph.FILL_NOTE
    e = spark.createDataFrame([("p", "a", 1, "a", "module", 0.9, False)], ENTITY)
    s = graph.graph_summary(e, e.limit(0), p.where("project_id = 'q'").withColumn("confidence", F.lit(1.0))).orderBy("project_id").collect()
    assert [(r.project_id, r.n_entities, r.n_relations, r.overall) for r in s] == [("p", 1, 0, 0.18), ("q", 0, 0, 0.2)]


def test_generated_items_need_support(spark):
    b = spark.createDataFrame([("p", 0, "team", "Ivanov leads; 12.5 percent and 300", None)], BLOCKS)
    rows = [("p", 0, "results", "metric", 0, "12,5 %"), ("p", 0, "results", "metric", 1, "77 of 300"), ("p", 0, "results", "metric", 2, "78"), ("p", 0, "results", "metric", 3, "many"), ("p", 0, "results", "bullet", 0, "anything"), ("p", 1, "team", "bullet", 0, "Petrov"), ("p", 1, "team", "bullet", 1, "Po"), ("p", 1, "team", "bullet", 2, None)]
    items = graph.ground_items(spark.createDataFrame(rows, "project_id string, section_ord int, section string, kind string, item_ord int, item string"), b)
    assert sorted((r.section, r.kind, r.item_ord) for r in items.where("not verified").collect()) == [("results", "metric", 2), ("team", "bullet", 0), ("team", "bullet", 1), ("team", "bullet", 2)]
    s = {r.section: (r.grounding, r.missing, r.n_bullets) for r in graph.ground_sections(items).collect()}
    assert s == {"results": (0.4, ["metrics_unverified"], 1), "team": (0.9, ["team"], 0)}


def test_topology(spark):
    rows = [("p", 1, "Input queue", "tasks", False), ("p", 2, "Core pipeline", "tasks", False), ("p", 3, "x" * 90, "tasks", False), ("p", 4, None, "tasks", False), ("p", 5, "Core pipeline", "kg", True), ("p", 6, "far away", "kg", True)]
    labels = spark.createDataFrame(rows, "project_id string, label_ord long, label string, source string, inferred boolean")
    b = spark.createDataFrame([("p", 0, "outputs", "input queue, core pipeline " + "x" * 90, None), ("q", 0, "inputs", "", [])], BLOCKS)
    labels = labels.unionByName(topology.pipeline_anchors(b))
    n = topology.topology_nodes(labels, b)
    got = {r.slug: (r.confidence, r.inferred, r.sources) for r in n.collect()}
    assert got["core-pipeline"] == (0.85, False, ["tasks", "kg"]) and got["far-away"] == (0.45, True, ["kg"]) and got["x" * 48][0] == 0.85
    assert got["output-delivery"][1:] == (True, ["outputs"]) and "data-ingestion" not in got
    links = spark.createDataFrame([("p", 0, "INPUT QUEUE", "pipe"), ("p", 1, "far away", "nowhere"), ("p", 2, None, "core")], "project_id string, link_ord int, label string, connection string")
    e = {(r.source, r.target): (r.relation, r.confidence, r.inferred) for r in topology.topology_edges(n, links=links).collect()}
    assert e[("input-queue", "core-pipeline")] == ("link", 0.9, False)  # the link stands before the data flow
    assert e[("core-pipeline", "output-delivery")] == ("deliver", 0.8, False)
    edges = spark.createDataFrame([("p", "core-pipeline", "input-queue", 0.4), ("p", "core-pipeline", "gone", 0.9)], "project_id string, source string, target string, confidence double")
    v = topology.validate_topology(n, edges).first()
    assert (v.n_nodes, v.n_edges, v.dropped, v.n_orphans, v.n_weak_edges, v.density) == (5, 1, 1, 3, 1, 0.05) and v.warnings == ["dropped_edges", "orphan_nodes", "low_confidence_edges"]
    assert topology.validate_topology(n, edges.limit(0)).first().n_orphans == 5


def test_cards(spark):
    counts = spark.createDataFrame([("p", 2, None, 0, 0, 0), ("q", 1, 1, 1, 1, 1)], "project_id string, modules long, team long, stack long, tasks long, results long")
    found = spark.createDataFrame([("p", 0, "posts", "12"), ("p", 1, "posts", "37 000+"), ("q", 0, "Команда", "9"), ("q", 1, "days", "1.5.2"), ("none", 0, "x", "1")], "project_id string, ord int, label string, value string")
    got = {}
    for r in measure.project_cards(counts, found).orderBy("card").collect():
        got.setdefault(r.project_id, []).append((r.label, r.value, r.origin))
    assert got["p"] == [("posts", "37 000+", "extracted"), ("Подсистем", "2", "derived"), ("Команда", "0", "fallback"), ("Технологий", "0", "fallback"), ("Задач", "0", "fallback")]
    assert [x[0] for x in got["q"]] == ["Команда", "days", "Подсистем", "Технологий", "Задач", "Результатов"] and "none" not in got


def test_acceptance_without_a_record(spark):
    expected = spark.createDataFrame([("p", None, None, None, None, None, ["sql"], None, None, ["bob"], None, None)], "project_id string, parser_mode string, title_contains array<string>, min_completeness int, min_modules int, min_team int, must_have_stack array<string>, must_have_modules array<string>, must_have_team array<string>, forbidden_team array<string>, reject_generic_title boolean, reject_essence_slide1 boolean")
    contracts = spark.createDataFrame([("p", "A real title", "x", 10, "text")], "project_id string, title string, parser_mode string, completeness int, essence string")
    items = spark.createDataFrame([("p", "team_line", "Bobby T."), ("p", "module", "SQL parser"), ("p", "stack", None)], "project_id string, kind string, name string")
    checks = lambda c: sorted((r.check, r.wanted) for r in measure.acceptance_errors(c, items, expected).collect())
    assert checks(contracts) == [("forbidden_team", "bob"), ("stack", "sql")]
    assert checks(contracts.limit(0)) == [("forbidden_team", "bob"), ("generic_title", ""), ("missing_contract", ""), ("stack", "sql")]
