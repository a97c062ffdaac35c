"""Team sections: blocks, attempts and reasons, noisy text, roles and the audit, on small texts."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folioworks.functions import team_words as tw
from folioworks.operators import classify, teams

FILES = "project_id string, file_ord long, text string"
GROUP = """
12. Егор Быков, Максим Иванков, Алексей Решетников (Алмаз)
Парсинг, анализ данных
• Формирование требований к датасету.
• Анализ тематик и структуры каналов.
• Валидация подготовленных материалов.
"""
SINGLE = """
1. Татьяна Ерюкова — помощник тимлида
Архитектура, кластеризация, парсинг, аналитика
• Переработка архитектуры парсера (многослойная модель).
• Кластеризация BERTopic на датасете 37k постов.
"""


def files(spark, *texts):
    return spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], FILES)


def test_blocks(spark):
    twice = "1. Егор Быков\nРоль А\n• One\n• Two\n1. Егор быков\n2. Егор Быков (Бык)\nРоль Б\nhttp://x.y\n• Two\n• Three"
    wordy = "3. Анна Белова https://a.b/c\nруководитель\nпервое; второе; третье;\nещё\nфраза проекта\nОлег Попов"
    got = {(r.file_ord, r.name): r for r in teams.parse_team_blocks(files(spark, GROUP, SINGLE, twice, wordy, "Посты Telegram, Qdrant Cloud, Google Colab", None, "", " \n\n")).collect()}
    assert {k for k in got if k[0] == 0} == {(0, n) for n in ("Егор Быков", "Максим Иванков", "Алексей Решетников")}
    three = [got[0, n] for n in ("Егор Быков", "Максим Иванков", "Алексей Решетников")]
    assert {r.role for r in three} == {"Парсинг, анализ данных"} and {len(r.contributions) for r in three} == {3} and [r.area for r in three] == ["", "", "Алмаз"]
    one = got[1, "Татьяна Ерюкова"]
    assert one.role == "помощник тимлида" and one.contributions == ["Архитектура, кластеризация, парсинг, аналитика", "Переработка архитектуры парсера (многослойная модель).", "Кластеризация BERTopic на датасете 37k постов."]
    twice = got[2, "Егор Быков"]
    assert (twice.role, twice.area, twice.contributions, twice.mentions) == ("Роль А", "Бык", ["One", "Two", "Three"], 2)
    assert got[3, "Анна Белова"].role == "руководитель" and got[3, "Анна Белова"].contributions == ["первое", "второе", "третье", "ещё"]
    assert got[3, "Олег Попов"].role == "" and {k[0] for k in got} == {0, 1, 2, 3}
    assert [b[:2] for b in teams.team_blocks(GROUP, teams.Grammar())] == [(12, GROUP.split("\n")[1])]


NAMES = (
    "Кравченко Дмитрий", "Кравченко Дмитрий Александрович", "Бугров Алексей", "Посты Telegram", "Из Telegram", "Схема обработки данных", "Векторная БД", "Пользовательский запрос", "Темы BERTopic",
    "Граф новостей", "Google Colab", "Анна-Мария Белова", "12. Егор Быков (Алмаз)", "Егор Быков — тимлид", "Егор  Быков - тимлид", "По Белова", "Егор", "", "  ", None, "Егор Быков Ильич Младший",
    "Егор Быков https://a.b", "Ёлкин Ёж", "Поиск Новый", "егор Быков", "Егор БЫКОВ",
)


def test_the_column_and_the_grammar_agree_on_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {r.name: r.ok for r in df.select("name", classify.person_name_ok(F.col("name")).alias("ok")).collect()}
    assert got == {n: teams.Grammar().is_name(n or "") for n in NAMES}
    assert [n for n in NAMES if got[n]] == ["Кравченко Дмитрий", "Кравченко Дмитрий Александрович", "Бугров Алексей", "12. Егор Быков (Алмаз)", "Егор Быков — тимлид", "Егор  Быков - тимлид", "Егор Быков https://a.b", "Ёлкин Ёж"]


def test_roles_and_context(spark):
    r = spark.createDataFrame([("тимлид проекта", True), ("backend-разработчик", True), ("Посты Telegram", False), ("", False), (None, False), ("лид " * 40, False)], "role string, ok boolean")
    assert all(x.got == x.ok for x in r.withColumn("got", classify.role_ok(F.col("role"))).collect())
    c = spark.createDataFrame([("Команда проекта", "", True), ("", "Участники команды", True), ("Схема обработки данных", "Посты Telegram", False), (None, None, False), ("", "x" * 400 + "тимлид", False)], "s string, t string, ok boolean")
    assert all(x.got == x.ok for x in c.withColumn("got", classify.team_context(F.col("s"), F.col("t"))).collect())


def test_people_and_reasons(spark):
    noisy = "Команда проекта\nТатьяна Ерюкова — помошниктиылида:\nГраф новостей — аналитик\n"
    lines = "Состав\nИван Петров — дизайнер\nПётр Иванов\nПосты Telegram — дизайнер\nВстреча завтра"
    table = "Разработчик системы\nИван Петров | дизайнер\nПосты | дизайнер\nТимлид: Анна Белова\nПомощник тимлида:\nОлег Попов\nОльга Котова, Егор Быков (Алмаз) — аналитик\nОльга Котова"
    f = files(spark, noisy, lines, table, None, "", "Команда заказчика\nИван Петров")
    tried = teams.explain_people(f).cache()
    by = {}
    for r in tried.orderBy("file_ord", "grammar", "try_ord").collect():
        by.setdefault((r.file_ord, r.grammar), []).append((r.rule, r.name, r.role, r.reason.split(": ")[1]))
    ctx, out = "valid_name_in_team_context", "outside_team_context"
    assert by[1, 2] == [("name", "Иван Петров", "дизайнер", "valid_name_with_role"), ("name", "Пётр Иванов", "", out)] and (1, 0) not in by and (1, 1) not in by
    assert by[0, 0] == [("block", "Татьяна Ерюкова", "помощник тимлида", ctx), ("dash", "Татьяна Ерюкова", "помощник тимлида", ctx), ("dash", "Граф новостей", "аналитика", "domain_stop_word")]
    assert by[2, 2] == [
        ("sentence", "Анна Белова", "Тимлид", ctx), ("sentence", "Олег Попов", "Помощник тимлида", ctx), ("table", "Иван Петров", "дизайнер", ctx), ("role_line", "Анна Белова", "Тимлид", ctx),
        ("name", "Олег Попов", "", ctx), ("list", "Ольга Котова", "аналитик", ctx), ("list", "Егор Быков", "аналитик", ctx), ("name", "Ольга Котова", "", ctx),
    ]
    assert by[5, 2] == [("name", "Иван Петров", "", out)]
    people = [(r.file_ord, r.member_ord, r.name, r.role) for r in teams.extract_people(f, tried=tried).orderBy("file_ord", "member_ord").collect()]
    assert [p for p in people if p[0] in (0, 1)] == [(0, 1, "Татьяна Ерюкова", "помощник тимлида"), (1, 1, "Иван Петров", "дизайнер")]
    assert [p[2:] for p in people if p[0] == 2] == [("Анна Белова", "помощник тимлида"), ("Олег Попов", "аналитика"), ("Ольга Котова", "")]
    assert not [p for p in people if p[0] > 2]
    tried.unpersist()


def test_people_do_not_depend_on_partitions(spark):
    f = files(spark, *[GROUP, SINGLE, "Команда проекта\n" + GROUP + SINGLE] * 3)
    one, many = (sorted(map(tuple, teams.extract_people(f.repartition(n)).select("file_ord", "member_ord", "name", "role").collect())) for n in (1, 7))
    assert one == many and len(one) == 3 * 5


def test_noisy_text(spark):
    texts = ["Тимлидпроекта", "Татьяна Ерюкова — помошниктиылида:", "Команда проекта | `Qdrant` © test\r\n\r\n  •  пункт   один", "Участникикоманды проекта.\rИван - аналитик;", None, ""]
    got = [r.normal for r in teams.normalize_team_text(files(spark, *texts)).orderBy("file_ord").collect()]
    assert got == ["Тимлид проекта", "Татьяна Ерюкова — помощник тимлида", "Команда проекта Qdrant test\nпункт один", "Участники команды проекта.\nИван — аналитика", "", ""]


def plain_role(role):
    cleaned = (role or "").strip().rstrip(":;.")
    if not cleaned:
        return ""
    low = cleaned.lower()
    for known in sorted(tw.ROLES, key=len, reverse=True):
        if known in low or low in known:
            return tw.ROLES[known]
    scored = [(SequenceMatcher(None, low, k).ratio(), -i, tw.ROLES[k]) for i, k in enumerate(tw.ROLES)]
    return max(scored)[2] if max(scored)[0] >= 0.72 else cleaned


@pytest.mark.parametrize("seed", [1, 2])
def test_roles_against_all_ratios(spark, seed):
    r = random.Random(seed)
    values = [None, "", " : ", "Тимлид:", "директор", "помошник тимлида", "тимлид проекта"]
    for known, _ in itertools.product(tw.ROLES, range(30)):
        w = list(known)
        for _ in range(r.randint(1, 4)):
            k, how = r.randrange(len(w)), r.random()
            w[k : k + 1] = [] if how < 0.3 else [r.choice("абвжх")] if how < 0.7 else [w[k], r.choice("абв")]
        values.append("".join(w))
    got = teams.normalize_role(spark.createDataFrame([(v, 1) for v in values] * 2, "role string, place int")).collect()
    assert len(got) == 2 * len(values) and all(x.canonical == plain_role(x.role) for x in got)


def test_audit(spark):
    deck = lambda *s: "\n".join(f"Slide {i}:\n{t}" for i, t in enumerate(s, 1))
    rows = [
        ("p", 1, "pptx", deck("x" * 100, "Команда проекта\nТимлид: Иван Петров")), ("p", 2, "pptx", deck("x" * 100, "Команда проекта")), ("p", 3, "pptx", "  "), ("p", 4, "pptx", deck("x" * 100, "y" * 100)),
        ("q", 1, "pptx", deck("short", "y" * 100)), ("q", 2, "docx", "Участники команды"), ("q", 3, "pptx", deck("x" * 100, "y" * 100)), ("r", 1, "pdf", "Команда проекта"), ("s", 1, "pptx", None),
    ]
    got = {(r.project_id, r.file_ord): r for r in teams.team_text_audit(spark.createDataFrame(rows, "project_id string, file_ord long, file_type string, text string")).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        ("p", 1): "pptx_team_text_found", ("p", 2): "pptx_team_text_missing", ("p", 3): "empty_pptx_text", ("p", 4): "pptx_team_text_missing", ("q", 1): "possible_image_only_team_slide", ("q", 3): "none", ("s", 1): "empty_pptx_text",
    }
    assert got["p", 1].people == 1 and got["p", 1].ocr_missing and got["q", 3].ocr_missing and (got["p", 1].markers, got["p", 1].team_slides, got["p", 1].slides) == (2, 1, 2)


def test_merged_blocks(spark):
    rows = [("p", 1, 2, "второй  блок"), ("p", 1, 1, " • первый\n\n"), ("p", 1, 3, None), ("p", 2, 1, "Тимлидпроекта"), ("p", 2, 2, "Иван Петров - тимлид"), ("p", 3, 1, "  ")]
    got = {r.file_ord: r.text for r in teams.merge_ocr_blocks(spark.createDataFrame(rows, "project_id string, file_ord long, block_ord int, text string")).collect()}
    assert got == {1: "- первый\n\nвторой блок", 2: "Тимлид проекта\nИван Петров — помощник тимлида"}
