"""Stack, team and modules from ranked evidence; weights of fields."""

import random

import pytest

from folioworks.operators import assemble, evidence

PEOPLE = "project_id string, source_role string, location_index int, item_ord int, member_ord int, name string, role string, area string, contributions array<string>"
PRIMARY = "project_id string, module_ord int, name string, type string, description string"
ITEMS = "project_id string, item_ord int, source_role string, title string, text string, technologies array<string>"


def test_team_in_the_order_of_roles(spark):
    rows = [("p", "unknown", 1, 1, 1, "Б", "x", "", []), ("p", "primary_project_doc", 3, 2, 1, "А", "", "", ["c"]), ("p", "team_list", None, 3, 2, "В", "r", "a", []), ("p", "team_list", 1, 4, 1, "Г", "", "", []), ("p", "unknown", 1, 5, 1, "а", "later", "", []), ("q", None, 0, 1, 1, "А", "", "", [])]
    got = [(r.project_id, r.n, r.name, r.role) for r in assemble.assemble_team(spark.createDataFrame(rows, PEOPLE)).orderBy("project_id", "n").collect()]
    assert got == [("p", 1, "Г", ""), ("p", 2, "В", "r"), ("p", 3, "А", ""), ("p", 4, "Б", "x"), ("q", 1, "А", "")]
    many = spark.createDataFrame([("p", "unknown", 2, i, 1, f"N{i}", "", "", []) for i in range(50)], PEOPLE)
    assert [r.name for r in assemble.assemble_team(many).orderBy("n").collect()] == [f"N{i}" for i in range(20)] and assemble.assemble_team(many, most=7).count() == 7
    assert assemble.assemble_team(many.limit(0)).count() == 0


def test_stack(spark):
    rows = [("p", 2, "uses Python and redis", ["Own"]), ("p", 1, "Neo4j and python", None), ("q", 1, None, None)]
    got = {(r.category, r.n): r.name for r in assemble.assemble_stack(spark.createDataFrame(rows, "project_id string, item_ord int, text string, technologies array<string>")).collect()}
    assert got["Other", 1] == "Own" and sorted(got.values()) == ["Neo4j", "Own", "Python", "Redis"]


@pytest.mark.parametrize("parts", [1, 6])
def test_modules(spark, parts):
    primary = [("p", 1, "VitaCalc", "", None), ("p", 2, "Архитектура", "system", ""), ("p", 3, "Поиск по базе", "rag", "умный поиск")]
    items = [
        ("p", 1, "module_presentation", "Расчёт calc", "Slide 2:\nпервый", None), ("p", 2, "module_presentation", "Расчёт calc", "первый", None), ("p", 3, "module_presentation", "", "Поиск по базе знаний\nумный", None),
        ("p", 4, "report", "t", "Шаг 1: Лишний", None), ("p", 5, "supporting_presentation", "Наш граф новостей", "Neo4j\n• граф людей\n• прочее\n2. поиск лиц", None), ("p", 6, "unknown", "архитектура", "архитектура", ["Redis"]),
        ("p", 7, "module_presentation", "vita", "второй", None), ("p", 8, "module_presentation", "vita", "второ", None), ("p", 9, "unknown", "x", "Шаг 1: vitacalc\nШаг 2: да", None),
        ("q", 1, "report", None, "Архитектура\nшаг", ["one1", "two2", "three", "four", "five", "six6", "seven"]), ("q", 2, "module_presentation", "Компонент: one1 и two2", None, None), ("q", 3, None, None, None, None),
    ]
    got = assemble.assemble_modules(spark.createDataFrame(primary, PRIMARY).repartition(parts), spark.createDataFrame(items, ITEMS).repartition(parts)).orderBy("project_id", "n").collect()
    p = [(r.name, r.type, r.description) for r in got if r.project_id == "p"]
    assert p == [("VitaCalc", "system", "второй"), ("Поиск по базе", "rag", "Поиск по базе знаний\nумный"), ("граф людей", "analytics_module", ""), ("2. поиск лиц"[3:], "analytics_module", ""), ("Наш граф новостей", "slide_module", "")]
    assert [(r.name, r.type) for r in got if r.project_id == "q"] == [(f"Компонент: {t}", "architecture") for t in ("one1", "two2", "three", "four", "five", "six6")]
    many = spark.createDataFrame([("p", i, "unknown", "", f"Шаг {i}: Модуль номер {i}", None) for i in range(30)], ITEMS)
    assert [r.name for r in assemble.assemble_modules(spark.createDataFrame([], PRIMARY), many).orderBy("n").collect()] == [f"Модуль номер {i}" for i in range(12)]


def test_a_module_is_described_by_what_stands_before_its_time(spark):
    r = random.Random(2)
    for _ in range(3):
        items, module, text = [], None, ""
        for i in range(12):
            if r.random() < 0.3:
                items.append(("p", i, "unknown", "", "Шаг 1: Обнаружение", None))
                module = module if module is not None else i
            else:
                detail = "d" * r.randint(1, 4)
                items.append(("p", i, "module_presentation", "обнаружение тут", detail, None))
                if module is not None and detail not in text:
                    text = detail
        got = assemble.assemble_modules(spark.createDataFrame([], PRIMARY), spark.createDataFrame(items, ITEMS)).collect()
        assert [x.description for x in got] == ([text] if module is not None else [])


def test_weights_of_fields(spark):
    base = {"confidence": 0.5, "text": "x" * 500, "location_type": "slide", "file_ord": 1}
    rows = [
        dict(base, project_id="p", field="title", source_role="primary_project_doc", source_type="ready_landing_doc", inventory_confidence=1.0, location_index=1),
        dict(base, project_id="p", field="title", source_role="module_presentation", source_type="x", inventory_confidence=1.0, location_index=1),
        dict(base, project_id="p", field="tasks", source_role="x", source_type="x", inventory_confidence=0.5, location_index=1),
        dict(base, project_id="p", field="team", source_role="team_list", source_type="team_list", inventory_confidence=None, location_index=2),
    ]
    schema = "project_id string, field string, source_role string, source_type string, inventory_confidence double, location_type string, location_index int, file_ord int, confidence double, text string"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    got = {(r.field, r.source_role): round(r.score, 6) for r in evidence.rank_field_evidence(df).collect()}
    assert got == {("title", "primary_project_doc"): round(0.5 + 0.6 + 0.35 + 0.2 + 0.3 + 0.15, 6), ("title", "module_presentation"): round(0.5 + 0.03 + 0.07 + 0.2 + 0.3, 6), ("tasks", "x"): round(0.5 + 0.09 + 0.07 + 0.1 + 0.3, 6), ("team", "team_list"): 0.8}
    cover = {r.field: r.status for r in evidence.field_coverage(evidence.rank_field_evidence(df)).collect()}
    assert cover["title"] == "strong" and cover["tasks"] == "weak" and cover["client"] == "missing" and len(cover) == 13
