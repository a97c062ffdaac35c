"""Structured documents and model answers: detectors, simple parsers, context and payloads (CLS-1/2, SEG-7/8/9, TXT-14/15/16/20, EVD-18)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.text import bullets, first_paragraph, let, lines_of, strip

# Header lines of the sections of a structured document.
SECTIONS = {
    "essence": ("суть проекта", "описание проекта"),
    "tasks": ("задачи проекта", "задачи"),
    "purpose": ("для чего", "цель проекта", "цели проекта"),
    "inputs": ("вводные данные", "исходные данные"),
    "outputs": ("выходные данные", "результирующие данные"),
    "results": ("результаты проекта", "результаты"),
    "outlook": ("перспектива развития", "roadmap", "дальнейшее развитие"),
    "tech_stack": ("используемый технологический стек", "технологический стек", "стек"),
    "team": ("команда проекта", "участники команды проекта"),
}
# Lines with facts of a project; the group is the fact.
METADATA = {"client": r"заказчик\s*:", "timeline": r"период\s+реализации\s*:", "lead": r"тимлид\s*:"}
# Words that speak for a presentation.
PRESENTATION = {
    "goal": r"цель проекта",
    "stages": r"этапы проекта",
    "data_prep": r"подготовка данных",
    "results": r"итоги проекта",
    "team": r"команда управления|команда проекта",
    "demo": r"демо-панель|демо панель",
    "pipeline": r"шаг\s*1|шаг\s*2",
    "sources": r"первоисточник|ссылки на",
}
# What a module's name and text say about its type, first match wins.
MODULE_TYPES = (
    (r"glauco|окт|глауком", "medical_ai / decision_support"),
    (r"copilot|транскриб|диаризац|медкарт", "ai_copilot / speech_ai"),
    (r"vitacalc|питани|нутрит|диет|menu", "recommendation_engine"),
    (r"rag|баз[аы]\s+знан", "knowledge_system"),
)


def _clean(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), " \u000b", " \n"), "\r\n", "\n"))


def _named(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def detect_structured(files: DataFrame, sections: dict[str, tuple[str, ...]] = SECTIONS, metadata: dict[str, str] = METADATA, text: str = "text") -> DataFrame:
    """CLS-1: which sections and facts a text has, and whether that makes it a structured document; an empty text has none."""
    low = files.withColumn("__low", _clean(F.col(text)))
    header = lambda ws: F.col("__low").rlike(r"(?:^|\n)\s*#{0,3}\s*(?:" + "|".join(map(re.escape, ws)) + r")\s*(?:\n|$)")
    out = low.withColumns({"detected_sections": _named({k: header(ws) for k, ws in sections.items()}), "n_meta": F.size(_named({k: F.col("__low").rlike(p) for k, p in metadata.items()}))})
    n = F.size("detected_sections")
    out = out.withColumn("structure_confidence", F.round(n / len(sections) * 0.75 + F.col("n_meta") / max(1, len(metadata)) * 0.25, 3))
    out = out.withColumn("missing_sections", F.array_except(F.array(*[F.lit(k) for k in sections]), "detected_sections"))
    return out.withColumn("is_structured", (F.col("structure_confidence") >= 0.65) & (n >= 5)).drop("__low", "n_meta")


def detect_source_type(files: DataFrame, sections: dict[str, tuple[str, ...]] = SECTIONS, metadata: dict[str, str] = METADATA, markers: dict[str, str] = PRESENTATION, text: str = "text") -> DataFrame:
    """CLS-2: ready document, presentation, raw materials or unknown, with the confidence and the signals."""
    d = detect_structured(files, sections, metadata, text).withColumn("__low", _clean(F.col(text)))
    count = lambda p: F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), 0))
    d = d.withColumns({"signals": _named({k: F.col("__low").rlike(p) for k, p in markers.items()}), "slides": count(r"(?i)(?:^|\n)\s*Slide\s+\d+\s*:"), "headers": count(r"(?:^|\n)\s*[А-ЯЁA-Z][А-ЯЁA-Z\s\-]{3,40}(?:\n|$)")})
    hits = F.size("signals")
    base = F.round(hits / len(markers) * 0.55 + F.least(F.col("slides") / 8.0, F.lit(1.0)) * 0.25 + F.least(F.col("headers") / 6.0, F.lit(1.0)) * 0.20, 3)
    d = d.withColumn("c", F.when(F.col("file_type") == "pptx", F.least(F.round(base + 0.12, 3), F.lit(1.0))).otherwise(base))
    deck, part = (F.col("c") >= 0.6) & (hits >= 3), (hits >= 1) | (F.col("slides") >= 2)
    empty = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    kind = F.when(empty, "unknown").when(F.col("is_structured"), "ready_landing_doc").when(deck, "project_presentation").when(part, "raw_materials").otherwise("unknown")
    conf = F.when(empty, 0.0).when(F.col("is_structured"), F.col("structure_confidence")).when(deck, F.col("c")).when(part, F.round(F.col("c") * 0.7, 3)).otherwise(F.col("c"))
    return d.withColumn("source_type", kind).withColumn("type_confidence", conf).drop("__low", "c", "headers", "slides")


def parse_metadata(files: DataFrame, patterns: dict[str, str] = METADATA, text: str = "text") -> DataFrame:
    """SEG-7: the first fact of each kind, null where there is none, and the title."""
    out = files
    for k, p in patterns.items():
        found = strip(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), rf"(?iU){p}\s*(.+?)(?:\n|$)", 1))
        out = out.withColumn(k, F.when(found != "", found))
    first = F.get(F.filter(F.transform(lines_of(F.col(text)), strip), lambda x: x != ""), 0)
    no_title = first.rlike(r"(?iU)^(?:" + next(iter(patterns.values())) + ")") | F.endswith(first, F.lit(":")) | (F.length(first) >= 120)
    return out.withColumn("title", F.when(~no_title, first))


def section_bullets(col: Column) -> Column:
    """SEG-8: the bullets of a section, each once; without any, its lines."""
    found = F.transform(F.regexp_extract_all(col, F.lit(r"(?m)^[ \t]*(?:[-•*·–])[ \t]+(.+)$"), 1), strip)
    rows = F.filter(F.transform(lines_of(col), strip), lambda x: x != "")
    return F.when(F.size(found) > 0, F.array_distinct(F.filter(found, lambda x: x != ""))).otherwise(rows)


def parse_modules(sections: DataFrame, keys: tuple[str, ...] = ("project_id", "file_ord"), types: tuple[tuple[str, str], ...] = MODULE_TYPES, text: str = "text") -> DataFrame:
    """SEG-9: numbered items with the first block of text below each, in order, and a type by hints."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), r"(?m)^(?=[ \t]*\d+[.)][ \t]+\S)"), 2, 1 << 30)
    rows = sections.where(F.col(text).isNotNull()).select(*keys, F.posexplode(parts).alias("module_ord", "part"))
    name = strip(F.regexp_extract("part", r"^[ \t]*\d+[.)][ \t]+([^\n]+)", 1))
    body = strip(F.get(F.split(strip(F.regexp_replace("part", r"^[^\n]*\n?", "")), r"\n\n"), 0))
    low = F.lower(F.concat_ws(" ", name, body))
    kind = F.lit("system")
    for p, t in reversed(types):
        kind = F.when(low.rlike(p), t).otherwise(kind)
    return rows.select(*keys, (F.col("module_ord") + 1).alias("module_ord"), name.alias("name"), body.alias("description"), kind.alias("type")).where("name != ''")


def repair_json(col: Column) -> Column:
    """TXT-14: code fences off, the outermost braces, no commas before a closing bracket; null without braces."""
    t = F.regexp_extract(F.regexp_replace(col, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.when(t != "", F.regexp_replace(t, r",\s*([}\]])", "$1"))


def parse_response(df: DataFrame, scalars: tuple[str, ...], lists: tuple[str, ...], text: str = "text") -> DataFrame:
    """TXT-14: allowed fields of a model's JSON answer; scalars where lists are due become lists of one, confidence goes to 0..1, other keys go to warnings."""
    out = df.withColumn("__m", F.from_json(repair_json(F.col(text)), "map<string,string>", {"mode": "PERMISSIVE"}))
    value = lambda k: F.when(strip(F.col("__m")[k]) != "", strip(F.col("__m")[k]))
    for k in scalars:
        out = out.withColumn(k, value(k))
    for k in lists:
        many = F.when(F.startswith(value(k), F.lit("[")), F.from_json(value(k), "array<string>")).otherwise(F.array(value(k)))
        out = out.withColumn(k, F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    known = F.array(*[F.lit(k) for k in (*scalars, *lists, "confidence")])
    out = out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("__m")["confidence"].try_cast("double"), F.lit(0.0)))))
    out = out.withColumn("warnings", F.array_sort(F.coalesce(F.array_except(F.map_keys("__m"), known), F.array().cast("array<string>"))))
    return out.withColumn("error", F.when(F.col("__m").isNull(), "no_json")).drop("__m")


def normalize_output(df: DataFrame, scalars: tuple[str, ...], team: str | None = None) -> DataFrame:
    """TXT-15: strings stripped, empty ones null; team members (name, role, contribution) become lines."""
    out = df
    for k in scalars:
        out = out.withColumn(k, F.when(strip(F.col(k)) != "", strip(F.col(k))))
    if team:
        filled = lambda x: F.when(x != "", x)
        line = lambda m: F.concat_ws(" — ", filled(m["name"]), filled(m["role"]), filled(m["contribution"]))
        out = out.withColumn(team, F.filter(F.transform(team, line), lambda x: x != ""))
    return out


def missing_fields(df: DataFrame, scalars: tuple[str, ...], lists: tuple[str, ...] = ()) -> DataFrame:
    """TXT-15: the names of the empty fields, in the given order."""
    empty = {k: F.coalesce(F.col(k), F.lit("")) == "" for k in scalars} | {k: F.coalesce(F.size(k), F.lit(0)) <= 0 for k in lists}
    return df.withColumn("missing_fields", _named(empty))


def compact_text(col: Column, per_file: int = 3000) -> Column:
    """TXT-16: a text as it is, or the first 70 % and the last 25 % of the characters allowed."""
    head, tail = int(per_file * 0.7), int(per_file * 0.25)
    return F.when(F.length(col) <= per_file, col).otherwise(F.concat(F.substring(col, 1, head), F.lit("\n...\n"), F.right(col, F.lit(tail))))


def compact_context(files: DataFrame, per_file: int = 3000, total: int = 12000) -> DataFrame:
    """TXT-16: (project_id, file_ord, used, context): files in order, each cut to ``per_file``, until ``total`` characters of a project are used.

    A file with text takes a character at least, so no more than ``total`` files of a
    project matter: the rank is limited before anything is summed.  Files without
    text use nothing and are left out.
    """
    w = Window.partitionBy("project_id").orderBy("file_ord")
    some = files.where(F.length("text") > 0).select("project_id", "file_ord", F.least(F.length("text"), F.lit(per_file)).alias("n"), F.row_number().over(w).alias("r")).where(F.col("r") <= total)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = some.withColumn("before", before).where(F.col("before") < total).select("project_id", "file_ord", F.least(F.col("n"), total - F.col("before")).cast("int").alias("used"))
    return files.join(used, ["project_id", "file_ord"]).select("project_id", "file_ord", "used", F.substring(compact_text(F.col("text"), per_file), F.lit(1), F.col("used")).alias("context"))


def combine_text(files: DataFrame, key: str = "project_id", order: str = "file_ord", headers: bool = False) -> DataFrame:
    """TXT-20: texts that are not empty, in order, between blank lines; with headers each below its file's name.  One row holds all of a key."""
    t = F.concat(F.lit("--- "), "filename", F.lit(" ---\n"), "text") if headers else F.col("text")
    part = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), t.alias("t")))), lambda x: x["t"])
    return files.where(strip(F.col("text")) != "").groupBy(key).agg(F.array_join(part, "\n\n").alias("text"))


def heuristic_payload(files: DataFrame, text: str = "text") -> DataFrame:
    """EVD-18: a record without a model: the first paragraph (500 characters) and slices of the bullets; empty lists where there is no text."""
    b = let(bullets(F.coalesce(F.col(text), F.lit("")), 20), lambda x: F.struct(F.slice(x, 1, 3).alias("goals"), F.slice(x, 1, 6).alias("tasks"), F.slice(x, 4, 3).alias("inputs"), F.slice(x, 7, 3).alias("results")))
    return files.withColumn("essence", F.substring(first_paragraph(F.coalesce(F.col(text), F.lit(""))), 1, 500)).withColumn("__b", b).select("*", "__b.*").drop("__b")
