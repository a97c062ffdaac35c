"""A record from ranked evidence: scalars, lists, essence, stack, team, modules, and the primary document on top (EVD-9 .. 13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.lexicons import TECHNOLOGIES
from folioworks.functions.text import lines_of, sentences, strip, text_key
from folioworks.operators.evidence import ROLE_WEIGHTS, extract_technologies, weight_of
from folioworks.operators.presentation import STEP

# Most items of a list field.
CAPS = {"tasks": 14, "purpose": 10, "inputs": 12, "outputs": 12, "results": 12, "outlook": 10}


def assemble_scalar(evidence: DataFrame, patterns: dict[str, tuple[tuple[str, float], ...]]) -> DataFrame:
    """EVD-9: (project_id, field, value, score) from items (project_id, field, source_role, item_ord, text).

    ``patterns`` gives each field its forms, the value in group 1, with a score.  A line
    of the primary document counts 0.99 at least, one of a module presentation 0.2 at
    most; the best line wins, first item and line on ties.
    """
    rows = evidence.select("project_id", "field", "source_role", "item_ord", F.posexplode(lines_of(F.col("text"))).alias("line_ord", "line"))
    out = None
    for field, forms in patterns.items():
        for p, base in forms:
            one = rows.where((F.col("field") == field) & F.col("line").rlike(p)).withColumn("value", strip(F.regexp_extract("line", p, 1))).withColumn("base", F.lit(base))
            out = one if out is None else out.unionByName(one)
    score = F.when(F.col("source_role") == "primary_project_doc", F.greatest("base", F.lit(0.99))).when(F.col("source_role") == "module_presentation", F.least("base", F.lit(0.2))).otherwise(F.col("base"))
    best = out.where("value != ''").withColumn("score", score).groupBy("project_id", "field").agg(F.min(F.struct((-F.col("score")).alias("neg"), "item_ord", "line_ord", "value")).alias("m"))
    return best.select("project_id", "field", F.col("m.value").alias("value"), (-F.col("m.neg")).alias("score"))


def assemble_lists(evidence: DataFrame, caps: dict[str, int] = CAPS, least: int = 15) -> DataFrame:
    """EVD-10: (project_id, field, item, n): lines of ``least`` characters or more, bullets and numbers off, in item order, each once by its first 100 lower-case characters, at most the field's cap."""
    rows = evidence.where(F.col("field").isin(*caps)).select("project_id", "field", "item_ord", F.posexplode(lines_of(F.col("text"))).alias("line_ord", "line"))
    item = strip(F.regexp_replace("line", r"(?U)^[\s•\-*·–—]*(?:\d+[.)]\s*)?", ""))
    rows = rows.withColumn("item", item).where(F.length("item") >= least).withColumn("key", F.substring(F.lower("item"), 1, 100))
    first = rows.groupBy("project_id", "field", "key").agg(F.min(F.struct("item_ord", "line_ord", "item")).alias("m"))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("field")]
    n = F.row_number().over(Window.partitionBy("project_id", "field").orderBy("m.item_ord", "m.line_ord"))
    return first.withColumn("n", n).where(F.col("n") <= max(caps.values())).where(F.col("n") <= cap).select("project_id", "field", "n", F.col("m.item").alias("item"))


def assemble_essence(evidence: DataFrame, primary: DataFrame | None = None, marks: tuple[str, ...] = (), most: int = 1500, take: int = 3) -> DataFrame:
    """EVD-11: (project_id, essence): a primary section of 200 characters or more, else sentences with a mark, else the first ``take`` ones; cut at ``most``."""
    rows = evidence.select("project_id", "item_ord", F.posexplode(sentences(F.translate("text", "\n", " "))).alias("k", "s"))
    marked = F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(F.lower("s"), m)) if marks else F.lit(False)
    w = Window.partitionBy("project_id").orderBy(F.desc("marked"), "item_ord", "k")
    some = rows.withColumn("marked", marked).withColumn("r", F.row_number().over(w)).where(F.col("r") <= take)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]), " ")
    out = some.groupBy("project_id").agg(F.substring(text, 1, most).alias("found"))
    if primary is None:
        return out.select("project_id", F.col("found").alias("essence"))
    own = primary.where(F.length("text") >= 200).groupBy("project_id").agg(F.substring(F.min_by("text", "item_ord"), 1, most).alias("own"))
    return out.join(own, "project_id", "full_outer").select("project_id", F.coalesce("own", "found").alias("essence"))


def apply_primary(fields: DataFrame, primary: DataFrame) -> DataFrame:
    """EVD-13: (project_id, field, items): what the primary document says replaces what was assembled, where it is not empty."""
    p = primary.where(F.size("items") > 0).select("project_id", "field", F.col("items").alias("own"))
    out = fields.join(p, ["project_id", "field"], "full_outer")
    return out.select("project_id", "field", F.coalesce("own", "items").alias("items"), F.col("own").isNotNull().alias("from_primary"))


# Names that are no modules, titles that say nothing, texts and lines that speak of modules, and names that mean each other.
NO_MODULES = ("задачи проекта", "этапы работы", "схема обработки данных", "пользовательский запрос → qdrant", "пользовательский запрос", "направления развития", "архитектура", "команда проекта")
NO_TITLES = ("проект", "презентация", "слайд", "landing", "slide 1", "slide 1:")
MODULE_TEXTS, MODULE_LINES = ("семантический поиск", "bertopic", "neo4j", "граф новостей"), ("qdrant", "bertopic", "neo4j", "поиск", "граф", "запрос")
SAME_MODULES = (("copilot", ("copilot",)), ("glauco", ("glauco",)), ("vitacalc", ("vita", "calc")))


def assemble_stack(evidence: DataFrame, dictionary: dict[str, tuple[str, str]] = TECHNOLOGIES) -> DataFrame:
    """EVD-12: (project_id, category, n, name): technologies that items name or hold, each once, in the order of items and of places in them.

    ``evidence`` is (project_id, item_ord, text), with technologies where they are known.
    """
    known = F.coalesce("technologies", F.array().cast("array<string>")) if "technologies" in evidence.columns else F.array().cast("array<string>")
    names = F.array_distinct(F.concat(known, extract_technologies(F.col("text"), dictionary)))
    rows = evidence.select("project_id", "item_ord", F.posexplode(names).alias("k", "name"))
    category = F.create_map(*[F.lit(x) for c, n in dict.fromkeys((c, n.lower()) for c, n in dictionary.values()) for x in (n, c)])
    once = rows.groupBy("project_id", "name").agg(F.min(F.struct("item_ord", "k")).alias("first")).withColumn("category", F.coalesce(category[F.lower("name")], F.lit("Other")))
    return once.select("project_id", "category", F.row_number().over(Window.partitionBy("project_id", "category").orderBy("first", "name")).alias("n"), "name")


def assemble_team(people: DataFrame, roles: dict = ROLE_WEIGHTS, most: int = 20) -> DataFrame:
    """EVD-12: (project_id, n, name, role, area, contributions): people in the order of their sources' roles, then first slides, then items; each name once, ``most`` a project.

    ``people`` is (project_id, source_role, location_index, item_ord, member_ord, name, role,
    area, contributions); names that differ in case only are one, the first.
    """
    rank = weight_of(roles, F.coalesce("source_role", F.lit("unknown")), 0.15, F.lit("team"))
    place = F.struct((-rank).alias("role"), (F.coalesce("location_index", F.lit(0)) != 1).alias("later"), F.coalesce(F.nullif("location_index", F.lit(0)), F.lit(99)).alias("at"), "item_ord", "member_ord")
    first = people.withColumn("place", place).groupBy("project_id", F.lower("name").alias("key")).agg(F.min(F.struct("place", "name", "role", "area", "contributions")).alias("m"))
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("m.place", "key"))
    return first.withColumn("n", n).where(F.col("n") <= most).select("project_id", "n", "m.name", "m.role", "m.area", "m.contributions")


def _module_title(item_title, body):
    """The title of an item: its own, or its first line that says something."""
    line = F.get(F.filter(F.transform(lines_of(body), strip), lambda x: (F.length(x) > 8) & ~F.lower(x).isin(*NO_TITLES)), F.lit(0))
    return F.coalesce(F.nullif(strip(F.coalesce(item_title, F.lit(""))), F.lit("")), line, F.lit(""))


def _listed(body):
    """Texts of bullet lines, then of numbered ones; each once."""
    marked = F.regexp_extract_all(body, F.lit(r"(?Um)^[\s]*(?:[-•*·]|–|\d+[.)])\s+(.+)$"), 1)
    numbered = F.regexp_extract_all(body, F.lit(r"(?Um)^\s*\d+\.\s+(.+)$"), 1)
    return F.array_distinct(F.filter(F.transform(F.concat(marked, numbered), strip), lambda x: x != ""))


def assemble_modules(primary: DataFrame, evidence: DataFrame, most: int = 12, detail: int = 400, technologies: int = 6, same: tuple = SAME_MODULES) -> DataFrame:
    """EVD-12: (project_id, n, name, type, description): modules of the primary document, then those of evidence items, ``most`` a project.

    ``primary`` is (project_id, module_ord, name, type, description), ``evidence`` (project_id,
    item_ord, source_role, title, text, technologies).  Items give steps, lines and titles
    of texts that speak of modules, and components of architectures where there is no
    primary module; where there is one, only presentations that support it and unknown
    sources do.  Presentations of a module are no modules: the first ``detail`` characters
    describe the first module before them that their title names, and the last such text
    that is not part of the description stands.  Names that agree in their first 80
    lower-case characters are one module, the first.
    """
    body = strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?iU)^\s*Slide\s+\d+\s*:[^\n]*", ""))
    own = primary.select("project_id", F.struct(F.lit(0).alias("src"), F.lit(0).cast("long").alias("item"), F.lit(0).alias("rule"), F.col("module_ord").cast("int").alias("at")).alias("place"), "name", F.coalesce(F.nullif("type", F.lit("")), F.lit("system")).alias("type"), F.coalesce("description", F.lit("")).alias("description"))
    has = own.where("name != ''").select("project_id").distinct().withColumn("has_primary", F.lit(True))
    e = evidence.select("project_id", F.col("item_ord").cast("long").alias("item"), F.coalesce("source_role", F.lit("unknown")).alias("source_role"), _module_title(F.col("title"), body).alias("title"), body.alias("body"), F.slice(F.coalesce("technologies", F.array().cast("array<string>")), 1, technologies).alias("technologies"))
    e = e.join(has, "project_id", "left").withColumn("has_primary", F.coalesce("has_primary", F.lit(False))).withColumn("low", F.lower("body"))
    gives = (F.col("source_role") != "module_presentation") & (~F.col("has_primary") | F.col("source_role").isin("supporting_presentation", "unknown"))
    holds = lambda t, ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(t, w))
    none = F.array().cast("array<string>")
    steps = F.transform(F.regexp_extract_all("body", F.lit(STEP), 0), lambda m: F.substring(strip(F.substring_index(strip(F.regexp_extract(m, STEP, 1)), "\n", 1)), 1, 120))
    spoken = holds(F.col("low"), MODULE_TEXTS)
    named = F.when(spoken, F.transform(F.filter(_listed(F.col("body")), lambda x: holds(F.lower(x), MODULE_LINES)), lambda x: F.substring(x, 1, 120))).otherwise(none)
    titled = F.when(spoken & (F.length("title") > 8), F.array("title")).otherwise(none)
    parts = F.when(~F.col("has_primary") & F.contains(F.col("low"), F.lit("архитектура")), F.transform("technologies", lambda t: F.concat(F.lit("Компонент: "), t))).otherwise(none)
    kinds = (("pipeline_step", steps), ("analytics_module", named), ("slide_module", titled), ("architecture", parts))

    def tagged(k: int, kind: str, names):
        return F.transform(names, lambda x, i: F.struct(F.lit(k).alias("rule"), i.alias("at"), x.alias("name"), F.lit(kind).alias("type")))

    every = F.flatten(F.array(*[tagged(k, kind, names) for k, (kind, names) in enumerate(kinds)]))
    rest = e.where(gives).select("project_id", "item", F.explode(every).alias("x"))
    rest = rest.select("project_id", F.struct(F.lit(1).alias("src"), "item", F.col("x.rule").alias("rule"), F.col("x.at").alias("at")).alias("place"), "x.name", "x.type", F.lit("").alias("description"))
    plain = text_key(F.replace("name", F.lit("Компонент:"), F.lit("")))
    empty = plain.isin(*NO_MODULES) | (F.length(plain) < 4) | F.startswith(plain, F.lit("slide ")) | (F.contains("name", F.lit("→")) & (F.length(plain) < 40)) | (F.contains(plain, F.lit("пользовательский запрос")) & F.contains(plain, F.lit("qdrant")))
    rows = own.unionByName(rest).where(~empty & (F.length("name") >= 2))
    once = rows.groupBy("project_id", F.substring(F.lower("name"), 1, 80).alias("key")).agg(F.min(F.struct("place", "name", "type", "description")).alias("m"))
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("m.place"))
    top = once.withColumn("n", n).where(F.col("n") <= most).select("project_id", "n", "m.*")
    # one row a project, of ``most`` modules at most
    lists = top.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("n", "place", F.lower("name").alias("name")))).alias("modules"))
    told = e.where((F.col("source_role") == "module_presentation") & (F.col("title") != "")).select("project_id", "item", F.lower("title").alias("title"), strip(F.substring("body", 1, detail)).alias("detail")).join(lists, "project_id")

    def related(m, title):
        word = F.get(F.split(strip(m["name"]), r"(?U)\s+"), F.lit(0))
        out = F.contains(title, m["name"]) | F.contains(m["name"], title) | ((word != "") & F.contains(title, word))
        for mark, others in same:
            out = out | (F.contains(m["name"], F.lit(mark)) & holds(title, others))
        return out

    fit = F.get(F.filter("modules", lambda m: ((m["place"]["src"] == 0) | (m["place"]["item"] < F.col("item"))) & related(m, F.col("title"))), F.lit(0))
    told = told.withColumn("n", fit["n"]).where("n is not null and detail != ''").groupBy("project_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "detail"))), lambda x: x["detail"]).alias("details"))
    out = top.join(told, ["project_id", "n"], "left")
    last = F.aggregate(F.coalesce("details", none), F.col("description"), lambda a, d: F.when(F.contains(a, d), a).otherwise(d))
    return out.select("project_id", "n", "name", "type", last.alias("description"))
