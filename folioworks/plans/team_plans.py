"""Registered queries over team texts.

The test tables hold no team sections, so Spark writes them from ``customer``: names are
the digits of the keys as letters, a sheet has twelve customers.  The statements know
the customers, not the texts: they say what a right parse has to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import lexicons as lx
from folioworks.operators import assemble, presentation, segment, teams
from folioworks.plans.registry import files, query, table

DIGITS, LETTERS = "0123456789", "абвгдежзик"
SHEET = 12
ROLES = ("Парсинг, анализ данных", "backend-разработчик", "архитектор и аналитик", "тимлид группы")

NAMES_SQL = f"""c AS (SELECT c_custkey AS k, c_custkey // {SHEET} AS file_ord, 'P' || ((c_custkey // {SHEET}) % 25) AS project_id, c_mktsegment AS seg,
    'К' || translate(substr(lpad(c_custkey::VARCHAR, 9, '0'), 1, 5), '{DIGITS}', '{LETTERS}') || ' М' || translate(substr(lpad(c_custkey::VARCHAR, 9, '0'), 6, 4), '{DIGITS}', '{LETTERS}') AS name FROM customer)"""


def named(spark, sf):
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    name = F.concat(F.lit("К"), F.translate(F.substring(key, 1, 5), DIGITS, LETTERS), F.lit(" М"), F.translate(F.substring(key, 6, 4), DIGITS, LETTERS))
    sheet = F.floor(F.col("c_custkey") / SHEET).cast("long")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), sheet.alias("file_ord"), F.concat(F.lit("P"), (sheet % 25).cast("string")).alias("project_id"), F.col("c_mktsegment").alias("seg"), name.alias("name"))


def sheet(rows, line, head=None, tail=None):
    """One text a sheet: the lines of its customers in order, between a head and a tail."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("t")))), lambda x: x["t"]), "\n")
    parts = [x for x in (head, body, tail) if x is not None]
    return rows.groupBy("project_id", "file_ord").agg(F.concat_ws("\n", *parts).alias("text"))


def team_sheets(spark, sf):
    """Blocks of three: `n. A, B, C (segment)`, a role, and a bullet a person."""
    c = named(spark, sf).withColumn("block", F.floor((F.col("k") % SHEET) / 3) + 1)
    own = F.array_sort(F.collect_list(F.struct("k", "name", "seg")))
    b = c.groupBy("project_id", "file_ord", "block").agg(own.alias("p"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("file_ord") % len(ROLES) + 1).cast("int"))
    header = F.concat(F.col("block").cast("string"), F.lit(". "), F.array_join("p.name", ", "), F.lit(" ("), F.element_at("p", -1)["seg"], F.lit(")"))
    b = b.withColumn("t", F.concat_ws("\n", header, role, F.array_join(F.transform("p", lambda x: F.concat(F.lit("• Сегмент "), x["seg"])), "\n")))
    text = F.concat(F.lit("Команда проекта\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "t"))), lambda x: x["t"]), "\n"))
    return b.groupBy("project_id", "file_ord").agg(text.alias("text"))


@query("seg_11_team_blocks", f"""WITH {NAMES_SQL},
  b AS (SELECT file_ord, (k % {SHEET}) // 3 AS block, max(k) AS last, string_agg('Сегмент ' || seg, '|' ORDER BY k) AS contributions FROM c GROUP BY ALL)
  SELECT project_id, c.file_ord, name, CASE c.file_ord % 4 WHEN 0 THEN '{ROLES[0]}' WHEN 1 THEN '{ROLES[1]}' WHEN 2 THEN '{ROLES[2]}' ELSE '{ROLES[3]}' END AS role, CASE WHEN k = last THEN seg ELSE '' END AS area, contributions
  FROM c JOIN b ON c.file_ord = b.file_ord AND (k % {SHEET}) // 3 = block""")  # fmt: skip
def _(spark, sf):
    return teams.parse_team_blocks(team_sheets(spark, sf)).select("project_id", "file_ord", "name", "role", "area", F.array_join("contributions", "|").alias("contributions"))


def noisy_role(k):
    """A known role with one letter misread."""
    known = list(teams.tw.ROLES)
    role = F.element_at(F.array(*[F.lit(r) for r in known]), (k % len(known) + 1).cast("int"))
    return F.overlay(role, F.lit("ж"), (F.lit(2) + k % 3).cast("int"), F.lit(1))


#: what a misread role becomes again: itself, but for the helpers of a lead, whose second word holds a known role as it stands
ROLE_CASE = "CASE k % 11 " + " ".join(f"WHEN {i} THEN '{'тимлид' if i in (2, 3) else to}'" for i, to in enumerate(teams.tw.ROLES.values())) + " END"


@query("txt_04_normalize_role", f"WITH {NAMES_SQL} SELECT k, {ROLE_CASE} AS canonical FROM c")
def _(spark, sf):
    rows = named(spark, sf).select("k", F.concat(noisy_role(F.col("k")), F.lit(":")).alias("role"))
    return teams.normalize_role(rows).select("k", "canonical")


@query("txt_03_team_text", f"""WITH {NAMES_SQL} SELECT file_ord, 'Участники команды проекта' || chr(10) || string_agg(name || ' — ' || {ROLE_CASE}, chr(10) ORDER BY k) || chr(10) || '- ждёт "ответа"' AS normal FROM c GROUP BY file_ord""")
def _(spark, sf):
    rough = sheet(named(spark, sf), F.concat(F.lit("  "), "name", F.lit("   -  "), noisy_role(F.col("k")), F.lit(";")), F.lit("Участникикоманды | проекта ®\r\n"), F.lit("\n- ждёт   «ответа»"))
    return teams.normalize_team_text(rough).select("file_ord", "normal")


def people_sheets(spark, sf):
    """By turns: roles without a section, lines of participants, and noisy sections."""
    c = named(spark, sf).withColumn("kind", F.col("file_ord") % 3)
    line = F.when(F.col("kind") == 0, F.concat("name", F.lit(" — дизайнер"))).when(F.col("kind") == 1, F.concat(F.lit("Участник: "), "name", F.lit(" https://e.org/x"))).otherwise(F.concat("name", F.lit(" — помошниктиылида:")))
    kind = F.first("kind")
    head = F.when(kind == 0, "Состав").when(kind == 1, "Отчёт").otherwise("Команда проекта |")
    tail = F.when(kind == 0, "Иван Иванов\nКаждый понедельник встреча").when(kind == 1, "Посты Telegram").otherwise("Граф новостей — аналитик")
    return sheet(c, line, head, tail)


@query("evd_04_people", f"""WITH {NAMES_SQL} SELECT file_ord, (CASE WHEN file_ord % 3 = 2 THEN 0 ELSE 2 END)::INTEGER AS grammar, name, CASE file_ord % 3 WHEN 0 THEN 'дизайнер' WHEN 1 THEN 'Участник' ELSE 'помощник тимлида' END AS role,
  (row_number() OVER (PARTITION BY file_ord ORDER BY k))::INTEGER AS member_ord FROM c""")  # fmt: skip
def _(spark, sf):
    return teams.extract_people(people_sheets(spark, sf)).select("file_ord", "grammar", "name", "role", "member_ord")


@query("evd_05_people_reasons", f"""WITH {NAMES_SQL}, f AS (SELECT file_ord, file_ord % 3 AS kind, count(*) AS n FROM c GROUP BY ALL)
  SELECT file_ord, grammar::INTEGER AS grammar, rule, reason, n FROM (
    SELECT file_ord, 2 AS grammar, 'name' AS rule, 'accepted: valid_name_with_role' AS reason, n FROM f WHERE kind = 0 UNION ALL
    SELECT file_ord, 2, 'name', 'rejected: outside_team_context', 1 FROM f WHERE kind = 0 UNION ALL
    SELECT file_ord, 2, 'role_line', 'accepted: valid_name_in_team_context', n FROM f WHERE kind = 1 UNION ALL
    SELECT file_ord, g, r, 'accepted: valid_name_in_team_context', n FROM f, (VALUES (0, 'block'), (0, 'dash'), (1, 'block'), (2, 'name')) AS v(g, r) WHERE kind = 2 UNION ALL
    SELECT file_ord, 0, 'dash', 'rejected: domain_stop_word', 1 FROM f WHERE kind = 2)""")  # fmt: skip
def _(spark, sf):
    return teams.explain_people(people_sheets(spark, sf)).groupBy("file_ord", "grammar", "rule", "reason").agg(F.count("*").alias("n"))


def decks(spark, sf):
    """Conversations as presentations: every third has a slide of its team, every third only the title of one; and a text file in every second project."""
    c = table(spark, sf, "conversations")
    kind, project = F.col("conv_id") % 3, F.concat(F.lit("P"), (F.col("conv_id") % 10).cast("string"))
    team = F.when(kind == 0, "Slide 99:\nКоманда проекта\nТимлид: Иван Петров").when(kind == 1, "Slide 99:\nКоманда проекта")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("Slide "), (F.col("turn") + 1).cast("string"), F.lit(":\n"), "text").alias("t")))), lambda x: x["t"])
    deck = c.groupBy("conv_id").agg(F.concat_ws("\n", F.array_join(parts, "\n"), F.first(team)).alias("text"))
    deck = deck.select(project.alias("project_id"), F.col("conv_id").alias("file_ord"), F.lit("pptx").alias("file_type"), "text")
    even = c.where("conv_id % 2 = 0").select(project.alias("project_id"), (-1 - F.col("conv_id") % 10).alias("file_ord"), F.lit("txt").alias("file_type"), F.lit("Участники команды").alias("text")).distinct()
    return deck.unionByName(even)


@query("evd_19_team_audit", """WITH s AS (SELECT conv_id, length(trim('Slide ' || (turn + 1) || ':' || chr(10) || text)) < 80 AS low FROM conversations),
  d AS (SELECT conv_id, conv_id % 3 AS kind, count(*) + (CASE WHEN conv_id % 3 < 2 THEN 1 ELSE 0 END) AS slides, sum(low::INT) + (CASE WHEN conv_id % 3 < 2 THEN 1 ELSE 0 END) AS low_slides, conv_id % 2 = 0 AS doc FROM s GROUP BY conv_id),
  r AS (SELECT *, CASE WHEN kind = 0 THEN 'pptx_team_text_found' WHEN kind = 1 OR NOT doc THEN 'pptx_team_text_missing' WHEN low_slides >= greatest(1, slides // 2) THEN 'possible_image_only_team_slide' ELSE 'none' END AS reason FROM d)
  SELECT 'P' || (conv_id % 10) AS project_id, conv_id AS file_ord, (CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS markers, (kind = 0)::BIGINT AS people, (kind < 2)::BIGINT AS team_slides, low_slides::BIGINT AS low_slides, slides,
    CASE WHEN reason IN ('none', 'pptx_team_text_found') THEN 'ok' ELSE 'warning' END AS status, reason, bool_or(reason NOT IN ('none', 'pptx_team_text_found')) OVER (PARTITION BY conv_id % 10) AS ocr_missing FROM r""")  # fmt: skip
def _(spark, sf):
    return teams.team_text_audit(decks(spark, sf))


def project_decks(spark, sf):
    """A presentation a sheet: title and client, a goal, a phase with a line a customer, results, advice, steps and members."""
    c = named(spark, sf)
    own = F.array_sort(F.collect_list(F.struct("k", "name", "seg")))
    d = c.groupBy("project_id", "file_ord").agg(own.alias("p"))
    each = lambda f: F.array_join(F.transform("p", f), "\n")
    k = lambda x: x["k"].cast("string")
    slides = [
        F.concat(F.lit("Стажировка\nПроект номер "), F.col("file_ord").cast("string"), F.lit(" (Заказчик "), "project_id", F.lit(")")),
        F.lit("Цель проекта\nСделать доступ к стоянке быстрым и понятным для всех. Коротко о важном. Уменьшить ручной труд охраны на въезде и на выезде из города."),
        F.concat(F.lit("Этапы проекта (01.02-03.04.2024)\n1. Фаза Подготовка отчётов:\n"), each(lambda x: F.concat(F.lit("Исследование участка номер "), k(x), F.lit(".")))),
        F.concat(F.lit("Итоги проекта\nРезультаты:\n"), each(lambda x: F.concat(F.lit("Получена таблица расчётов участка "), k(x), F.lit("."))), F.lit("\nРекомендации:\n"), each(lambda x: F.concat(F.lit("новая камера участка "), k(x), F.lit(": позже")))),
        F.lit("Шаг 1: Обнаружение машины\n1. Процесс: поиск рамки\n2. Выход: рамка\nШаг 2: Проверка допуска\nиспользуем Python"),
        F.concat(F.element_at("p", 1)["name"], F.lit("\nвидео")),
        F.lit("Команда проекта\nТимлид: Иван Петров\nПомощник тимлида: Олег Попов"),
    ]
    return d.select("project_id", "file_ord", F.concat_ws("\n", *[F.concat(F.lit(f"Slide {i}:\n"), s) for i, s in enumerate(slides, 1)]).alias("text"))


@query("seg_12_slide_kinds", f"""WITH {NAMES_SQL} SELECT DISTINCT file_ord, n::INTEGER AS slide, kind FROM c, (VALUES (1, 'title'), (2, 'goal'), (3, 'stages'), (4, 'results'), (5, 'pipeline_steps'), (6, 'team_member'), (7, 'team')) AS v(n, kind)""")
def _(spark, sf):
    return presentation.classify_slides(segment.split_slides(project_decks(spark, sf))).select("file_ord", F.col("location_index").alias("slide"), "kind")


@query("seg_13_presentation_fields", f"""WITH {NAMES_SQL}, f AS (SELECT project_id, file_ord, min_by(name, k) AS first FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file_ord ORDER BY k) AS n FROM c)
  SELECT file_ord, field, item_ord::INTEGER AS item_ord, value, kind, note FROM (
    SELECT file_ord, 'title' AS field, 1 AS item_ord, 'Проект номер ' || file_ord AS value, '' AS kind, '' AS note FROM f UNION ALL
    SELECT file_ord, 'client', 1, 'Заказчик ' || project_id, '', '' FROM f UNION ALL
    SELECT file_ord, 'timeline', 1, '01.02-03.04.2024', '', '' FROM f UNION ALL
    SELECT file_ord, 'essence', 1, 'Сделать доступ к стоянке быстрым и понятным для всех. Уменьшить ручной труд охраны на въезде и на выезде из города. Этапы: обнаружение машины, проверка допуска. Цель проекта' || chr(10) || 'Сделать доступ к стоянке быстрым и понятным для всех. Коротко о важном. Уменьшить ручной труд охраны на въезде и на выезде из города.', '', '' FROM f UNION ALL
    SELECT file_ord, 'tasks', 1, 'Подготовить отчётов.', '', '' FROM f UNION ALL
    SELECT file_ord, 'tasks', n + 1, 'Исследоватьие участка номер ' || k || '.', '', '' FROM r WHERE n <= 11 UNION ALL
    SELECT file_ord, 'results', n, 'Получена таблица расчётов участка ' || k || '.', '', '' FROM r WHERE n <= 10 UNION ALL
    SELECT file_ord, 'outlook', n, 'Новая камера участка ' || k || '.', '', '' FROM r WHERE n <= 8 UNION ALL
    SELECT file_ord, 'modules', n, name, kind, note FROM f, (VALUES (1, 'Обнаружение машины', 'computer_vision_detection', 'поиск рамки. рамка'), (2, 'Проверка допуска', 'access_control', 'используем Python')) AS v(n, name, kind, note) UNION ALL
    SELECT file_ord, 'outputs', 1, 'Модель машины.', '', '' FROM f UNION ALL
    SELECT file_ord, 'inputs', 1, 'Журнал въездов.', '', '' FROM f UNION ALL
    SELECT file_ord, 'tech_stack', n, name, kind, '' FROM f, (VALUES (1, 'Python', 'Backend / App'), (2, 'video processing', 'Infrastructure')) AS v(n, name, kind) UNION ALL
    SELECT file_ord, 'purpose', 1, 'Ускорить въезд.', '', '' FROM f UNION ALL
    SELECT file_ord, 'lead', 1, 'Иван Петров', '', '' FROM f UNION ALL
    SELECT file_ord, 'team', n, name, kind, '' FROM f, (VALUES (1, 'Иван Петров', 'Тимлид'), (2, 'Олег Попов', 'Помощник тимлида')) AS v(n, name, kind) UNION ALL
    SELECT file_ord, 'team', 3, first, '', 'съёмка' FROM f)""")  # fmt: skip
def _(spark, sf):
    phrases = presentation.Phrases(
        said={"purpose": (("goal", ("стоянк",), "Ускорить въезд."), ("goal", ("лифт",), "Ускорить лифт."))}, named=((("обнаруж", "машин"), "Модель машины."),), always={"inputs": ("Журнал въездов.",)},
        steps="Этапы: %s.", areas=((("видео",), "съёмка"),),
    )
    return presentation.presentation_fields(project_decks(spark, sf), phrases).select("file_ord", "field", "item_ord", "value", "kind", "note")


@query("evd_12_team", f"""WITH {NAMES_SQL}, r AS (SELECT *, CASE file_ord % 3 WHEN 0 THEN 0.15 WHEN 1 THEN 0.95 ELSE 1.0 END AS w, CASE file_ord % 3 WHEN 0 THEN 'дизайнер' WHEN 1 THEN 'Участник' ELSE 'помощник тимлида' END AS role FROM c)
  SELECT project_id, n::INTEGER AS n, name, role FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY w DESC, file_ord, k) AS n FROM r) WHERE n <= 20""")  # fmt: skip
def _(spark, sf):
    sheets = people_sheets(spark, sf)
    role = F.when(F.col("file_ord") % 3 == 1, "primary_project_doc").when(F.col("file_ord") % 3 == 2, "team_list").otherwise("report")
    people = teams.extract_people(sheets).withColumn("source_role", role).withColumn("location_index", F.lit(2)).withColumn("item_ord", F.col("file_ord"))
    return assemble.assemble_team(people).select("project_id", "n", "name", "role")


TECH_SQL = ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{lx.TECHNOLOGIES[k][1]}' END" for k in sorted(lx.TECHNOLOGIES, key=len, reverse=True))
TECH_GROUPS = " ".join(f"WHEN '{n}' THEN '{c}'" for c, n in dict.fromkeys(lx.TECHNOLOGIES.values()))


@query("evd_12_stack", f"""WITH {{FILES}}, t AS (SELECT project_id, file_ord, unnest([{TECH_SQL}]) AS name, generate_subscripts([{TECH_SQL}], 1) AS k FROM files),
  o AS (SELECT project_id, name, min((file_ord, k)) AS first, CASE name {TECH_GROUPS} ELSE 'Other' END AS category FROM t WHERE name IS NOT NULL GROUP BY project_id, name)
  SELECT project_id, category, (row_number() OVER (PARTITION BY project_id, category ORDER BY first, name))::INTEGER AS n, name FROM o""")  # fmt: skip
def _(spark, sf):
    return assemble.assemble_stack(files(spark, sf).withColumnRenamed("file_ord", "item_ord"))


@query("evd_12_modules", f"""WITH {NAMES_SQL}, f AS (SELECT DISTINCT file_ord AS project_id FROM c),
  m AS (SELECT project_id, 0 AS o, 'Проверка номера ' || project_id AS name, 'access' AS type, 'из документа' AS description FROM f WHERE project_id % 2 = 0 UNION ALL
    SELECT project_id, o, name, type, CASE WHEN o = 1 THEN 'Обнаружение: подробности' || chr(10) || 'рамка участка ' || project_id ELSE '' END FROM f, (VALUES (1, 'Обнаружение машины', 'pipeline_step'), (2, 'Проверка допуска', 'pipeline_step')) AS v(o, name, type) UNION ALL
    SELECT project_id, o, name, 'architecture', '' FROM f, (VALUES (3, 'Компонент: Python'), (4, 'Компонент: Neo4j')) AS v(o, name) WHERE project_id % 2 = 1)
  SELECT project_id, (row_number() OVER (PARTITION BY project_id ORDER BY o))::INTEGER AS n, name, type, description FROM m""")  # fmt: skip
def _(spark, sf):
    p = named(spark, sf).select(F.col("file_ord").alias("project_id")).distinct()
    own = p.where("project_id % 2 = 0").select("project_id", F.lit(1).alias("module_ord"), F.concat(F.lit("Проверка номера "), F.col("project_id").cast("string")).alias("name"), F.lit("access").alias("type"), F.lit("из документа").alias("description"))
    told = F.concat(F.lit("Обнаружение: подробности\nрамка участка "), F.col("project_id").cast("string"))
    item = lambda o, role, text, *tech: p.select("project_id", F.lit(o).alias("item_ord"), F.lit(role).alias("source_role"), F.lit("").alias("title"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.array(*[F.lit(t) for t in tech]).cast("array<string>").alias("technologies"))
    items = item(1, "unknown", "Slide 4:\nШаг 1: Обнаружение машины\nШаг 2: Проверка допуска").unionByName(item(2, "module_presentation", told)).unionByName(item(3, "unknown", "Архитектура решения", "Python", "Neo4j")).unionByName(item(4, "module_presentation", "Нечто иное"))
    return assemble.assemble_modules(own, items)
