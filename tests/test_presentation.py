"""Fields of presentations on small decks."""

import pytest
from pyspark.sql import functions as F

from folioworks.operators import presentation as pr
from folioworks.operators import segment

FILES = "project_id string, file_ord long, text string"
DECK = """Slide 1:
Стажировка 2024
Автоматизация открытия шлагбаума (КСК ИТ)
Slide 2:
Цель проекта
Сделать распознавание номеров на Python быстрым. Мелочь тут. Точность больше 90% на всех камерах заказчика.
Slide 3:
Этапы проекта
(01.02–28.03.2024)
1. Фаза Анализ:
Оценка качества данных.
Источники: открытые данные и карты
коротко

2. Разработка моделей:
Создание модели поиска рамок
Slide 4:
Шаг 1: Обнаружение автомобиля
1. Процесс: кадр за кадром
2. Выход: рамка
Шаг 2: Проверка номера в базе данных
Slide 5:
Итоги проекта
Результаты: Достигнута точность выше девяноста. Разработаны несколько вариантов решений. Мало.
Рекомендации:
работа в потоке камер: потом
Снижение числа ложных срабатываний
да
Slide 6:
Бугров Алексей
обработка видео YOLOv8
Slide 7:
Тимлид: Кравченко Дмитрий
Бугров Алексей
"""


def by_field(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r.field, []).append((r.item_ord, r.value, r.kind, r.note))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_fields_of_a_deck(spark, parts):
    phrases = pr.Phrases(
        said={"tasks": (("goal", ("python",), "Писать на Python."), ("goal", ("gpu",), "Нет."))}, named=((("номер", "баз"), "Решение об открытии."),), demo={"outputs": ("Панель.",)}, always={"tasks": ("Сдать отчёт.",), "inputs": ("Видео.",)},
        areas=((("yolov8",), "обучение"),), member_words=("yolov8",),
    )
    files = spark.createDataFrame([("p", 1, DECK), ("p", 2, None), ("p", 3, ""), ("q", 1, DECK + "Slide 8:\nдемо-панель Streamlit\n"), ("r", 1, "просто текст о чём-то")], FILES).repartition(parts)
    rows = pr.presentation_fields(files, phrases).collect()
    got = by_field([r for r in rows if (r.project_id, r.file_ord) == ("p", 1)])
    plain = lambda f: [x[0] for x in got[f]]
    assert plain("title") == ["Автоматизация открытия шлагбаума"] and plain("client") == ["КСК ИТ"] and plain("timeline") == ["01.02–28.03.2024"] and plain("lead") == ["Кравченко Дмитрий"]
    assert plain("tasks") == ["Анализ.", "Оценить качества данных.", "Разработать моделей.", "Создать модели поиска рамок.", "Писать на Python.", "Сдать отчёт."]
    assert got["modules"] == [("Обнаружение автомобиля", "computer_vision_detection", "кадр за кадром. рамка"), ("Проверка номера в базе данных", "access_control", "")]
    assert plain("outputs") == ["Решение об открытии."] and plain("inputs") == ["Видео."]
    assert plain("results") == ["Достигнута точность выше девяноста.", "Разработаны несколько вариантов решений."]
    assert plain("outlook") == ["Работа в потоке камер.", "Снижение числа ложных срабатываний."]
    assert got["team"] == [("Кравченко Дмитрий", "Тимлид", ""), ("Бугров Алексей", "", "обучение")]
    assert ("YOLOv8", "AI / CV", "") in got["tech_stack"] and plain("essence")[0].startswith("Сделать распознавание номеров на Python быстрым. Точность больше 90%")
    demo = by_field([r for r in rows if r.project_id == "q"])
    assert [x[0] for x in demo["outputs"]] == ["Решение об открытии.", "Панель."] and [x[0] for x in demo["modules"]] == plain("modules")
    assert {(r.project_id, r.file_ord) for r in rows} == {("p", 1), ("q", 1), ("r", 1)}
    assert by_field([r for r in rows if r.project_id == "r"])["title"] == [("просто текст о чём-то", "", "")]


def test_caps_and_first_spelling(spark):
    lines = "\n".join(f"Исследование участка номер {i}" for i in range(30))
    deck = f"Slide 2:\nЭтапы проекта\n1. Фаза Один:\n{lines}\nИССЛЕДОВАНИЕ участка номер 3\n"
    got = by_field(pr.presentation_fields(spark.createDataFrame([("p", 1, deck)], FILES)).collect())
    assert len(got["tasks"]) == 12 and got["tasks"][1][0] == "Исследоватьие участка номер 0."
    assert len(by_field(pr.presentation_fields(spark.createDataFrame([("p", 1, deck)], FILES), caps={}).collect())["tasks"]) == 32


def test_kinds_first_match_wins(spark):
    texts = [("Slide 1:\nЦель проекта", "title"), ("Slide 2:\nЦель проекта\nЭтапы проекта", "goal"), ("Slide 3:\nшаг 7 : x", "pipeline_steps"), ("Slide 4:\nАнна Белова\nx", "team_member"), ("Slide 5:\nx\nАнна Белова", "unknown"), ("Slide 11:\nкоманда проекта", "team")]
    s = segment.split_slides(spark.createDataFrame([("p", i, t) for i, (t, _) in enumerate(texts)], FILES))
    assert [r.kind for r in pr.classify_slides(s).orderBy("file_ord").select("kind").collect()] == [k for _, k in texts]
    tasks = spark.createDataFrame([("Интеграция с базой...",), ("  новая задача",), ("",)], "t string").select(pr.as_task(F.col("t")).alias("x")).collect()
    assert [r.x for r in tasks] == ["Интегрироватьия с базой.", "Новая задача.", ""]
