"""Fields of a project from the slides of its presentation (SEG-12, SEG-13).

Each slide is read on its own: its kind decides which rules look for items in it.  Items
are rows from there on, ranked inside (file, field); no row holds a project.  Sentences
that belong to one domain are parameters (``Phrases``), empty by default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.text import let, lines_of, sentences, strip
from folioworks.operators.segment import classify_by_rules, split_slides

KEYS = ("project_id", "file_ord")
# What says of which kind a slide is, first match wins.
KINDS = (
    ("title", r"^slide\s*1\s*:"),
    ("goal", r"цель проекта"),
    ("stages", r"этапы проекта"),
    ("data_preparation", r"подготовка данных"),
    ("pipeline_steps", r"шаг 1|шаг 2|шаг 3"),
    ("demo", r"демо-панель|streamlit"),
    ("results", r"итоги проекта|полученные результаты"),
    ("sources", r"первоисточник|ссылки на"),
    ("team", r"команда управления|команда проекта|участники команды|роли в проекте|тимлид:|помощник тимлида:"),
    ("pipeline_steps", r"(?U)шаг\s*\d+\s*:"),
)
# How a person stands alone in a line, and how title and client, phases, steps and dates are written.
MEMBER = r"(?U)^[А-ЯЁA-Z][а-яёa-z]+\s+[А-ЯЁA-Z][а-яёa-z]+(?:\s+[А-ЯЁA-Z][а-яёa-z]+)?$"
TITLE_CLIENT = r"(?dU)^(.+?)\s*\(([^)]+)\)\s*$"
NO_TITLE, NO_TASK = "стажировка", "источники"
PHASE = r"(?iUu)(\d+)\.\s*(?:Фаза\s+)?([^:\n]+?):\s*\n((?:[^\n]+\n?)*)"
STEP = r"(?isUu)Шаг\s*\d+\s*:\s*(.+?)(?=\nШаг\s*\d+\s*:|\z)"
DATES = (r"(?U)(\d{2}\.\d{2}\s*[-–—]\s*\d{2}\.\d{2}\.\d{4})", r"\((\d{2}\.\d{2}[-–—]\d{2}\.\d{2}\.\d{4})\)")
LEAD, ASSISTANT = r"(?diUu)Тимлид\s*:\s*(.+?)(?:\n|\z)", r"(?diUu)Помощник\s+тимлида\s*:\s*(.+?)(?:\n|\z)"
RESULTS, ADVICE = r"(?iUu)результаты\s*:", r"(?iUu)рекомендации\s*:"
GOAL = r"(?iUu)^цель\s+проекта\s*"
# The verb that a task begins with.
VERBS = (
    ("исследован", "Исследовать"), ("оценка", "Оценить"), ("выделение", "Выделить"), ("обработка", "Обработать"), ("эксперимент", "Провести эксперименты с"), ("оптимизация", "Оптимизировать"),
    ("подготовка отч", "Подготовить отч"), ("интеграц", "Интегрировать"), ("создание", "Создать"), ("разработка", "Разработать"), ("реализация", "Реализовать"),
)
# Types of steps by words of their names.
STEP_TYPES = (
    ("обнаружение", "computer_vision_detection"), ("идентификация", "classification"), ("классификация", "classification"), ("распознавание", "ocr_recognition"), ("проверка", "access_control"),
    ("базе данных", "access_control"), ("демо", "demo_application"), ("streamlit", "demo_application"),
)
# Technologies of a presentation with their groups.
STACK = (
    ("yolov8-n-cls", "AI / CV", "YOLOv8-n-cls"), ("yolov8-n", "AI / CV", "YOLOv8-n"), ("yolov8n", "AI / CV", "YOLOv8-n"), ("yolov8", "AI / CV", "YOLOv8"),
    ("computer vision", "AI / CV", "Computer Vision"), ("компьютерного зрения", "AI / CV", "Computer Vision"), ("bounding box", "AI / CV", "Bounding Box"), ("bbox", "AI / CV", "Bounding Box"),
    ("opencv", "AI / CV", "OpenCV"), ("cvat", "Data / Annotation", "CVAT"), ("roboflow", "Data / Annotation", "Roboflow"), ("supervision", "Data / Annotation", "Supervision"),
    ("python", "Backend / App", "Python"), ("streamlit", "Backend / App", "Streamlit"), ("google colab", "Backend / App", "Google Colab"), ("colab", "Backend / App", "Google Colab"),
    ("*.py", "Backend / App", "*.py scripts"), ("gpu", "Infrastructure", "GPU"), ("видео", "Infrastructure", "video processing"),
)
# How many items of a field stay.
CAPS = {"tasks": 12, "purpose": 8, "inputs": 10, "outputs": 12, "results": 10, "outlook": 8}


@dataclass(frozen=True)
class Phrases:
    """Sentences of a domain.

    said: field -> (kind of slide, words of which one has to occur, sentence); named: words
    that all occur in a step's name -> sentence of ``outputs``; demo: field -> sentences where there
    is a demo slide; always: field -> sentences behind all others; steps: the sentence of the
    essence that lists steps, with %s; areas: words -> area of a team member; member_words:
    words of a slide on which every line that is a name is a member.
    """

    said: dict[str, tuple[tuple[str, tuple[str, ...], str], ...]] = field(default_factory=dict)
    named: tuple[tuple[tuple[str, ...], str], ...] = ()
    demo: dict[str, tuple[str, ...]] = field(default_factory=dict)
    always: dict[str, tuple[str, ...]] = field(default_factory=dict)
    steps: str = ""
    areas: tuple[tuple[tuple[str, ...], str], ...] = ()
    member_words: tuple[str, ...] = ()


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(_array(words), lambda w: F.contains(text, w)) if words else F.lit(False)


def classify_slides(slides: DataFrame, kinds: tuple[tuple[str, str], ...] = KINDS, member: str = MEMBER) -> DataFrame:
    """SEG-12: ``slides`` with kind: the first rule that its text fits, a member if its title is a name, else unknown."""
    low = F.translate(F.lower("text"), "\u000b", " ")
    body = F.filter(F.transform(lines_of(F.regexp_replace("text", r"(?iU)^\s*Slide[^\n]*", "")), strip), lambda x: x != "")
    named = F.coalesce(F.get(body, F.lit(0)).rlike(member), F.lit(False))
    by_rule = classify_by_rules(low, kinds, "")
    return slides.withColumn("kind", F.when(by_rule != "", by_rule).when(named, "team_member").otherwise("unknown"))


def as_task(line: Column) -> Column:
    """A task as a sentence: its noun becomes a verb, and it ends in one full stop."""

    def sentence(x: Column) -> Column:
        low = F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30), F.lit("."))
        first = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))
        for noun, verb in reversed(VERBS):
            whole = F.concat(F.lit(verb), F.substring(low, len(noun) + 1, 1 << 30))
            first = F.when(F.startswith(low, F.lit(noun)), F.concat(F.substring(whole, 1, 1), F.lower(F.substring(whole, 2, 1 << 30)))).otherwise(first)
        return F.when(x == "", "").otherwise(first)

    return let(F.regexp_replace(strip(line), r"\.+$", ""), sentence)


def _some(field_: str, part: int, values: Column, kind: Column | None = None, note: Column | None = None) -> Column:
    """Items of a field, in order."""
    empty = F.lit("")
    return F.transform(values, lambda v: F.struct(F.lit(field_).alias("field"), F.lit(part).alias("part"), v.alias("value"), (kind if kind is not None else empty).alias("kind"), (note if note is not None else empty).alias("note")))


def _phases(body: Column) -> Column:
    """Tasks of a slide of stages: the title and the longer lines of every phase."""
    every = F.regexp_extract_all(body, F.lit(PHASE), 0)

    def tasks(p: Column) -> Column:
        own = F.filter(F.transform(lines_of(F.regexp_extract(p, PHASE, 3)), strip), lambda x: (F.length(x) > 15) & ~F.startswith(F.lower(x), F.lit(NO_TASK)))
        return F.concat(F.array(strip(F.regexp_extract(p, PHASE, 2))), own)

    return F.transform(F.flatten(F.transform(every, tasks)), as_task)


def _after(body: Column, mark: str) -> Column:
    """What follows the last mark."""
    return F.element_at(F.split(body, mark), -1)


def _outlook(body: Column) -> Column:
    def item(x: Column) -> Column:
        head = strip(F.substring_index(x, ":", 1))
        listed = F.when(F.length(head) > 10, F.concat(F.upper(F.substring(head, 1, 1)), F.substring(head, 2, 1 << 30), F.lit(".")))
        return F.when(F.contains(x, F.lit(":")), listed).when(F.length(x) > 20, F.when(F.endswith(x, F.lit(".")), x).otherwise(F.concat(x, F.lit("."))))

    return F.array_compact(F.transform(F.transform(lines_of(_after(body, ADVICE)), strip), item))


def _steps(body: Column) -> Column:
    """(name, description, type) of every step of a slide."""

    def one(m: Column) -> Column:
        name = strip(F.substring_index(strip(F.regexp_extract(m, STEP, 1)), "\n", 1))
        rest = F.slice(F.filter(F.transform(lines_of(m), strip), lambda x: x != ""), 2, 5)
        tail = lambda x: strip(F.regexp_replace(x, r"^[^:]*:", ""))
        told = lambda x: F.when(x.rlike(r"^\d+\."), F.when(F.contains(F.lower(x), F.lit("процесс:")) | F.contains(F.lower(x), F.lit("выход:")), tail(x))).when(F.lower(x).rlike("используем|модель"), x)
        stop = F.array_position(F.transform(rest, lambda x: F.lower(x).rlike("^(шаг|slide)")), True)
        rest = F.when(stop > 0, F.slice(rest, 1, F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(rest)
        note = F.array_join(F.slice(F.array_compact(F.transform(rest, told)), 1, 2), ". ")
        kind = F.lit("pipeline_step")
        for word, label in reversed(STEP_TYPES):
            kind = F.when(F.contains(F.lower(name), F.lit(word)), label).otherwise(kind)
        return F.struct(name.alias("name"), note.alias("note"), kind.alias("kind"))

    return F.transform(F.regexp_extract_all(body, F.lit(STEP), 0), one)


def _area(low: Column, phrases: Phrases) -> Column:
    out = F.lit("")
    for words, area in reversed(phrases.areas):
        out = F.when(_holds(low, words), area).otherwise(out)
    return out


def presentation_items(files: DataFrame, phrases: Phrases = Phrases(), text: str = "text") -> DataFrame:  # noqa: B008
    """Items that single slides say: project_id, file_ord, slide, at, field, part, value, kind, note."""
    clean = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), " \u000b", " \n"), "\r\n", "\n")
    s = classify_slides(split_slides(files.select(*KEYS, clean.alias("text"))))
    s = s.select(*KEYS, F.col("location_index").alias("slide"), "kind", "text", strip(F.regexp_replace("text", r"(?iU)^Slide\s+\d+\s*:[^\n]*", "")).alias("body")).withColumn("low", F.lower("text"))
    body, low, kind = F.col("body"), F.col("low"), F.col("kind")
    lines = F.filter(F.transform(lines_of(body), strip), lambda x: x != "")
    none = _some("", 0, F.array().cast("array<string>"))
    on = lambda c, items: F.when(c, items).otherwise(none)
    fit = F.get(F.filter(lines, lambda x: x.rlike(TITLE_CLIENT) | (F.length(x) > 10) & ~F.startswith(F.lower(x), F.lit(NO_TITLE))), F.lit(0))
    both = fit.rlike(TITLE_CLIENT)
    title = F.when(both, strip(F.regexp_extract(fit, TITLE_CLIENT, 1))).otherwise(fit)
    client = F.when(both, strip(F.regexp_extract(fit, TITLE_CLIENT, 2)))
    first = lambda p, t: F.array_compact(F.array(F.when(t.rlike(p), strip(F.regexp_extract(t, p, 1)))))
    dates = F.when(body.rlike(DATES[0]), first(DATES[0], body)).otherwise(first(DATES[1], body))
    goal = sentences(F.translate(strip(F.regexp_replace(body, GOAL, "")), "\n", " "), 20)
    told = F.concat(F.slice(goal, 1, 1), F.filter(F.slice(goal, 2, 3), lambda x: F.length(x) > 40))
    block = F.get(F.split(_after(body, RESULTS), ADVICE), F.lit(0))
    done = F.filter(sentences(F.translate(block, "\n", " "), 20), lambda x: F.length(x) > 30)
    steps = _steps(F.col("text"))
    step_items = F.transform(steps, lambda m: F.struct(F.when(kind == "pipeline_steps", "modules").otherwise("other_modules").alias("field"), F.lit(0).alias("part"), m["name"].alias("value"), m["kind"].alias("kind"), m["note"].alias("note")))
    found = [
        on(F.col("slide") == 1, F.concat(_some("title", 0, F.array_compact(F.array(title))), _some("client", 0, F.array_compact(F.array(client))))),
        _some("lead", 0, first(LEAD, F.col("text"))),
        on(kind == "stages", F.concat(_some("timeline", 0, dates), _some("tasks", 0, _phases(body)))),
        on(kind == "goal", F.concat(_some("essence", 0, told), _some("goal_text", 0, F.array(F.substring(body, 1, 400))))),
        on((kind == "results") & body.rlike(RESULTS), _some("results", 0, done)),
        on((kind == "results") & body.rlike("(?iUu)рекомендации"), _some("outlook", 0, _outlook(body))),
        step_items,
        on(kind == "demo", _some("demo", 0, F.array(F.lit("demo")))),
    ]
    for k, (label, group, name) in enumerate(STACK):
        found.append(on(F.contains(low, F.lit(label)), _some("tech_stack", k, F.array(F.lit(name)), F.lit(group))))
    for name, rules in phrases.said.items():
        for k, (of, words, sentence) in enumerate(rules):
            found.append(on((kind == of) & _holds(low, words), _some(name, 1 if of == "goal" else 0, F.array(F.lit(sentence)), note=F.lit(f"{k:03d}"))))
    area = _area(low, phrases)
    member = F.filter(lines, lambda x: x.rlike(MEMBER))
    found += [
        on(kind == "team", F.concat(_some("team", 0, first(LEAD, body), F.lit("Тимлид")), _some("team", 0, first(ASSISTANT, body), F.lit("Помощник тимлида")))),
        on(kind == "team_member", _some("team", 1, F.slice(member, 1, 1), note=area)),
        on(_holds(low, phrases.member_words), _some("team", 2, member, note=area)),
    ]
    return s.select(*KEYS, "slide", F.posexplode(F.concat(*found)).alias("at", "x")).select(*KEYS, "slide", "at", "x.*")


def presentation_fields(files: DataFrame, phrases: Phrases = Phrases(), caps: dict[str, int] | None = None, text: str = "text") -> DataFrame:  # noqa: B008
    """SEG-13: project_id, file_ord, field, item_ord, value, kind (group, type or role), note (description or area).

    One row an item; items that differ in case only are one, the first, and of a field
    with a cap the first ones stay.  title, client, lead, timeline and essence have one
    item.  Null and empty texts give no rows.
    """
    caps = CAPS if caps is None else caps
    items = presentation_items(files, phrases, text).where(strip(F.col("value")) != "")
    by_file = Window.partitionBy(*KEYS)
    # steps stand on slides of steps; where a file has none of these, on any
    items = items.withColumn("piped", F.max((F.col("field") == "modules").cast("int")).over(by_file))
    items = items.where("field != 'other_modules' or piped = 0").withColumn("field", F.when(F.col("field") == "other_modules", "modules").otherwise(F.col("field"))).drop("piped")
    named = [items.where((F.col("field") == "modules") & F.forall(_array(words), lambda w: F.contains(F.lower("value"), w))).select(*KEYS, "slide", "at", F.lit("outputs").alias("field"), F.lit(0).alias("part"), F.lit(s).alias("value"), F.lit("").alias("kind"), F.lit("").alias("note")) for words, s in phrases.named]
    some = items.select(*KEYS).distinct()
    fixed = lambda rows, part, sets: [rows.select(*KEYS, F.lit(0).alias("slide"), F.lit(k).alias("at"), F.lit(name).alias("field"), F.lit(part).alias("part"), F.lit(s).alias("value"), F.lit("").alias("kind"), F.lit("").alias("note")) for name, ss in sets.items() for k, s in enumerate(ss)]
    more = [*named, *fixed(items.where("field = 'demo'").select(*KEYS).distinct(), 2, phrases.demo), *fixed(some, 3, phrases.always)]
    every = items.where("field != 'demo'")
    for m in more:
        every = every.unionByName(m)
    every = every.withColumn("value", strip(F.col("value"))).withColumn("place", F.struct("part", "slide", F.when(F.col("note").rlike(r"^\d{3}$"), F.col("note")).otherwise("").alias("rule"), "at"))
    once = every.groupBy(*KEYS, "field", F.lower("value").alias("key")).agg(F.min(F.struct("place", "value", "kind", "note")).alias("m"))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "field").orderBy("m.place"))
    once = once.select(*KEYS, "field", rank.alias("item_ord"), "m.value", "m.kind", F.regexp_replace("m.note", r"^\d{3}$", "").alias("note"))
    most = F.coalesce(*[F.when(F.col("field") == f, n) for f, n in {**caps, "title": 1, "client": 1, "lead": 1, "timeline": 1, "goal_text": 1}.items()], F.lit(1 << 30))
    once = once.where(F.col("item_ord") <= most)
    in_order = lambda f, top=1 << 30: F.transform(F.array_sort(F.collect_list(F.when((F.col("field") == f) & (F.col("item_ord") <= top), F.struct("item_ord", "value")))), lambda x: x["value"])
    told = once.where("field in ('essence', 'goal_text', 'modules')").groupBy(*KEYS).agg(in_order("essence").alias("e"), in_order("goal_text").alias("g"), in_order("modules", 6).alias("m"))
    steps = F.when((F.size("m") > 0) & F.lit(bool(phrases.steps)), F.array(F.format_string(phrases.steps or "%s", F.array_join(F.transform("m", F.lower), ", ")))).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat("e", steps), " ")
    whole = F.when((F.length(whole) < 280) & (F.size("g") > 0), strip(F.concat_ws(" ", whole, F.get("g", F.lit(0))))).otherwise(whole)
    essence = told.select(*KEYS, F.lit("essence").alias("field"), F.lit(1).alias("item_ord"), F.substring(whole, 1, 1200).alias("value"), F.lit("").alias("kind"), F.lit("").alias("note")).where("value != ''")
    return once.where("field not in ('essence', 'goal_text')").unionByName(essence)
