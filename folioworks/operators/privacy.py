"""Personal data: detect, resolve, number, mask, report, restore (PII-1 .. PII-17)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.lexicons import PREFIXES, PRIORITIES
from folioworks.operators.occurrences import occurring
from folioworks.sources.scratch import written

# Patterns of each kind of data, with the confidence of a match; the order is the order of rules.
RULES = (
    ("email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95),
    ("phone", r"(?:\+?\d{1,3}[\s\-().]*)?(?:\(?\d{2,4}\)?[\s\-.]*)?\d{3}[\s\-.]?\d{2,3}[\s\-.]?\d{2,4}\b", 0.9),
    ("url", r"(?i)https?://[^\s<>\"']+|\b(?:www\.)[a-z0-9][-a-z0-9.]*\.[a-z]{2,}(?:/[^\s]*)?", 0.85),
    ("telegram", r"(?i)(?:https?://)?(?:t\.me|telegram\.me)/[A-Za-z0-9_]{3,32}|@[A-Za-z][A-Za-z0-9_]{4,31}", 0.9),
    ("passport_id", r"(?i)\b(?:паспорт|серия|№)\s*[\d\s]{4,12}\b", 0.92),
    ("passport_id", r"(?i)\b(?:ИНН|inn)[\s:]*\d{10,12}\b", 0.88),
    ("passport_id", r"\b\d{3}-\d{3}-\d{3}\s\d{2}\b", 0.9),
    ("address", r"(?i)\b(?:ул\.|улица|пр\.|проспект|пер\.|д\.|дом|кв\.|квартира|г\.|город|обл\.|область|район|индекс|street|st\.|avenue|ave\.|road|rd\.)\s*[^,\n]{3,80}", 0.75),
    ("organization", r"(?i)\b(?:ООО|ОАО|ЗАО|ПАО|АО|ИП|LLC|Inc\.?|Ltd\.?|GmbH|Corp\.?)\s+[«\"]?[А-ЯЁA-Za-z0-9][А-ЯЁA-Za-z0-9\s«»\".-]{2,60}", 0.8),
    ("role_person", r"(?i)(?:главный|ведущий|старший|младший)?\s*(?:врач|эндокринолог|хирург|терапевт|директор|руководитель|менеджер|архитектор|разработчик|аналитик|консультант)\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?", 0.82),
)
# Medical words, and how names are written.
MEDICAL = r"(?i)\b(?:диагноз|МКБ[-\s]?\d|пациент|история\s+болезни|глюкоз|инсулин|гипертония|онколог|эндокринолог|аллергия|рецепт|дозировка|лабораторн)\b"
NAMES = (r"\b[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){1,2}\b", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b")
# Capitalised words that begin no name, and parts of words that rule a name out.
NO_NAMES = (
    "Проект", "Задача", "Задачи", "Результат", "Результаты", "Цель", "Цели", "Клиент", "Команда", "Стек", "Вводные", "Выходные", "Landing", "Factory",
    "Microsoft", "Google", "OpenAI", "Python", "FastAPI", "PostgreSQL", "Qwen", "Meditron", "МОНИКИ", "Natasha",
)
# Parts of names that are no persons, and words beside a client's name.
NO_PERSONS = ("openai", "qwen", "meditron", "моники", "владимирского", "microsoft", "google")
CLIENT_WORDS = ("клиент", "заказчик", "customer", "client", "компания", "организация")

ENTITY = "type string, original string, confidence double, start int, end int, rule_ord int"


def find_spans(rules=RULES, names: bool = True, medical: bool = True):
    """The one Arrow helper of this module: every match of every rule in a text, with code point offsets."""
    compiled = [(kind, re.compile(p), conf) for kind, p, conf in rules]
    name_rules, medical_rule = [re.compile(p) for p in NAMES], re.compile(MEDICAL)

    def spans(text: str) -> list[dict]:
        out = []
        row = lambda kind, s, conf, a, b, k: out.append({"type": kind, "original": s, "confidence": conf, "start": a, "end": b, "rule_ord": k})
        for k, (kind, p, conf) in enumerate(compiled):
            if p.pattern == RULES[0][1] and "@" not in text:  # no match of this pattern is without one
                continue
            for m in p.finditer(text):
                s = m.group(0).strip()
                if len(s) >= 3 or kind == "email":
                    row(kind, s, conf, m.start(), m.end(), k)
        if medical:
            for m in medical_rule.finditer(text):
                a, b = max(0, m.start() - 10), min(len(text), m.end() + 40)
                row("medical_data", text[a:b].strip(), 0.7, a, b, len(compiled))
        if names:
            for k, p in enumerate(name_rules):
                for m in p.finditer(text):
                    s = m.group(0).strip()
                    low = s.lower()
                    if s.split()[0] in NO_NAMES or any(t in low for t in NO_PERSONS):
                        continue
                    before = text[max(0, m.start() - 40) : m.start()].lower()
                    row("organization" if any(w in before for w in CLIENT_WORDS) else "person_name", s, 0.78, m.start(), m.end(), len(compiled) + 1 + k)
        return out

    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in ENTITY.split(', '))}>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spans(t) if t else [])

    return run


def prefix_of(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])[kind]


def _priority(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])[kind], F.lit(5))


def detect_entities(files: DataFrame, rules=RULES, names: bool = True, medical: bool = True) -> DataFrame:
    """PII-1, PII-2, PII-3: one row per match, as found (item_ord is its place in rule order)."""
    found = files.where(F.col("text").isNotNull()).select("project_id", "file_ord", F.posexplode(find_spans(rules, names, medical)("text")).alias("item_ord", "e"))
    return found.select("project_id", "file_ord", "item_ord", "e.*")


def dedupe_names(entities: DataFrame) -> DataFrame:
    """PII-4: of equal names in a file the surest stays, the first on ties; other types stay."""
    key = F.lower(F.regexp_replace(F.trim("original"), r"(?U)\s+", " "))
    is_name = F.col("type").isin("person_name", "role_person")
    first = F.row_number().over(Window.partitionBy("project_id", "file_ord", is_name, F.when(is_name, key).otherwise(F.col("item_ord").cast("string"))).orderBy(F.desc("confidence"), "item_ord"))
    return entities.withColumn("r", first).where("r = 1").drop("r")


def resolve_overlaps(entities: DataFrame) -> DataFrame:
    """PII-5: greedy by priority, length, confidence and start; an entity stays if it overlaps none that stayed."""
    item = F.struct((-_priority(F.col("type"))).alias("p"), (F.col("start") - F.col("end")).alias("l"), (-F.col("confidence")).alias("c"), "start", "item_ord", "end", "type", "original", "confidence", "rule_ord")
    grouped = entities.groupBy("project_id", "file_ord").agg(F.array_sort(F.collect_list(item)).alias("a"))
    # the struct's type is taken from the sorted array itself
    kept = F.aggregate("a", F.slice("a", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: (x["start"] < k["end"]) & (x["end"] > k["start"])), acc).otherwise(F.concat(acc, F.array(x))))
    out = grouped.select("project_id", "file_ord", F.explode(kept).alias("e"))
    return out.select("project_id", "file_ord", *[F.col(f"e.{c}").alias(c) for c in ("item_ord", "type", "original", "confidence", "start", "end", "rule_ord")])


def context_preview(files: DataFrame, entities: DataFrame, width: int = 30) -> DataFrame:
    """PII-6: the text around an entity, personal data replaced."""
    j = entities.join(files.select("project_id", "file_ord", "text"), ["project_id", "file_ord"])
    start = F.greatest(F.col("start") - width, F.lit(0))
    ctx = F.substring(F.col("text"), start + 1, F.least(F.col("end") + width, F.length("text")) - start)
    ctx = F.when(F.col("original") != "", F.replace(ctx, F.col("original"), F.lit("[REDACTED]"))).otherwise(ctx)
    for p in (RULES[0][1], NAMES[0], RULES[1][1], r"(?U)[\w.+-]+@[\w.-]+"):
        ctx = F.regexp_replace(ctx, "(?U)" + p if not p.startswith("(?") else p.replace("(?i)", "(?iU)"), "[REDACTED]")
    return j.withColumn("context_preview_redacted", ctx).drop("text")


def assign_placeholders(entities: DataFrame) -> DataFrame:
    """PII-7: [PREFIX_n], counted over a project in (file, start) order; one number for equal originals of a file.

    Numbers are taken inside (file, prefix) first and shifted by the counts of
    earlier files, so a project with very many files is no single sorted group.
    """
    e = entities.withColumn("prefix", prefix_of(F.col("type")))
    once = e.groupBy("project_id", "file_ord", "original").agg(F.min(F.struct("start", "item_ord", "prefix")).alias("m"))
    once = once.select("project_id", "file_ord", "original", "m.prefix", F.col("m.start").alias("first"), "m.item_ord")
    inside = Window.partitionBy("project_id", "prefix", "file_ord").orderBy("first", "item_ord")
    counts = once.groupBy("project_id", "prefix", "file_ord").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("project_id", "prefix").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    numbered = once.withColumn("n", F.row_number().over(inside)).join(before, ["project_id", "prefix", "file_ord"])
    numbered = numbered.select("project_id", "file_ord", "original", F.concat(F.lit("["), "prefix", F.lit("_"), (F.col("n") + F.col("before")).cast("string"), F.lit("]")).alias("placeholder"))
    return e.drop("prefix").join(numbered, ["project_id", "file_ord", "original"])


def _marked(text, back: bool = False):
    """What looks like a placeholder in a text gets one more ``=`` behind its bracket (or one less), so that it is never taken for one."""
    return F.regexp_replace(text, r"\[=(=*[A-Z]+_\d+\])" if back else r"\[(=*[A-Z]+_\d+\])", "[$1" if back else "[=$1")


def redact_text(files: DataFrame, entities: DataFrame) -> DataFrame:
    """PII-8: spans replaced by their placeholders; the rest stays as it is, but that placeholders which stand there already are marked."""
    spans = entities.groupBy("project_id", "file_ord").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("spans"))
    piece = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], _marked(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])), s["placeholder"]).alias("out"), s["end"].alias("at")),
        lambda acc: F.concat(acc["out"], _marked(F.substring(F.col("text"), acc["at"] + 1, F.length("text")))),
    )
    j = files.join(spans, ["project_id", "file_ord"], "left")
    return j.withColumn("redacted", F.when(F.col("spans").isNull(), _marked(F.col("text"))).otherwise(piece)).drop("spans")


def mapping_of(entities: DataFrame) -> DataFrame:
    """PII-10: which placeholder stands for which original."""
    return entities.select("project_id", "placeholder", "original").distinct()


def bundle_parts(redacted: DataFrame) -> DataFrame:
    """PII-10: the safe text of a project as one row per file; in the order of file_ord, with a blank line between, they are the bundle."""
    return redacted.where(F.coalesce(F.col("redacted"), F.lit("")) != "").select("project_id", "file_ord", F.concat(F.lit("### "), "filename", F.lit("\n"), "redacted").alias("safe_text"))


def redacted_bundle(redacted: DataFrame) -> DataFrame:
    """PII-10: the safe text of a project in one value, for projects whose text fits into one (2 GB at most); ``bundle_parts`` has no such bound."""
    part = F.struct("file_ord", "safe_text")
    return bundle_parts(redacted).groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["safe_text"]), "\n\n").alias("safe_text"))


def rehydrate(texts: DataFrame, mapping: DataFrame, column: str = "redacted") -> DataFrame:
    """PII-11: placeholders back to originals; unknown ones stay, marked ones lose the mark.  Tokens meet the mapping by an equi-join."""
    token = r"\[[A-Z]+_\d+\]"
    t = texts.withColumn("__row", F.struct("project_id", "file_ord"))
    parts = t.select("project_id", "file_ord", F.posexplode(F.split(column, f"(?={token})|(?<=\\])")).alias("k", "piece"))
    done = parts.join(mapping.withColumnRenamed("placeholder", "piece"), ["project_id", "piece"], "left")
    back = done.groupBy("project_id", "file_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("original", _marked(F.col("piece"), back=True)).alias("s")))), lambda x: x["s"]), "").alias("restored"))
    return texts.join(back, ["project_id", "file_ord"], "left")


def risk_level(entities: DataFrame) -> DataFrame:
    """PII-12: one row per project with entities."""
    has = lambda *k: F.bool_or(F.col("type").isin(*k))
    a = entities.groupBy("project_id").agg(F.count("*").alias("n_entities"), has("medical_data", "passport_id").alias("critical"), has("person_name").alias("person"), has("email", "phone").alias("contact"))
    risk = F.when(F.col("critical"), "critical").when((F.col("n_entities") >= 15) | (F.col("person") & F.col("contact")), "high").when(F.col("n_entities") >= 5, "medium").otherwise("low")
    return a.select("project_id", "n_entities", risk.alias("risk"))


def pii_report(files: DataFrame, entities: DataFrame, now: str, ttl_hours: int = 72) -> DataFrame:
    """PII-13: every project, with distinct placeholders, source files, risk and lifetime."""
    found = entities.groupBy("project_id").agg(F.countDistinct("placeholder").alias("n_placeholders"), F.countDistinct("file_ord").alias("n_sources"))
    created = F.lit(now).cast("timestamp")
    out = files.select("project_id").distinct().join(found, "project_id", "left").join(risk_level(entities), "project_id", "left")
    return out.select(
        "project_id", F.col("n_entities").isNotNull().alias("has_pii"), F.coalesce("n_placeholders", F.lit(0)).alias("n_placeholders"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.coalesce("risk", F.lit("low")).alias("risk"), created.alias("created_at"), (created + F.expr(f"interval {ttl_hours} hours")).alias("expires_at"),
    )


def audit_rollup(entities: DataFrame) -> DataFrame:
    """PII-17: counts and kinds by project; never originals."""
    return entities.groupBy("project_id").agg(F.count("*").alias("redactions"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("entity_types"), F.sum(F.length("original")).cast("long").alias("redacted_chars"))


def privacy_pass(files: DataFrame, rules=RULES, names: bool = True, medical: bool = True) -> DataFrame:
    """The entities of all files with their placeholders.

    Numbering reads the entities more than once, so they are written once, into the
    job's folder (they hold originals: it must be as safe as the files); texts are
    searched in one pass.
    """
    return assign_placeholders(written(resolve_overlaps(dedupe_names(detect_entities(files, rules, names, medical))), "entities"))


def scrub_payload(payloads: DataFrame, mapping: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """PII-9: every known original of the project out of the given text or list columns, longest first.

    Equal to replacing all originals of the project one after the other.  Only those that
    occur in a value are tried on it, and those that a placeholder put there before could
    complete: with a bracket, or of a placeholder's own signs and not longer than one.  An
    original of several placeholders gets the last of them.  (project_id, file_ord) names a
    payload; nulls stay.
    """
    last = mapping.where("original != ''").groupBy("project_id", "original").agg(F.max_by("placeholder", F.struct(F.length("placeholder"), "placeholder")).alias("placeholder"))
    size = last.groupBy("project_id").agg(F.max(F.length("placeholder")).alias("__most"))
    odd = last.join(size, "project_id").where((F.length("original") <= F.col("__most")) & F.col("original").rlike(r"^[A-Z]*_?[0-9]*$") | F.col("original").rlike(r"[\[\]]"))
    odd = odd.groupBy("project_id").agg(F.collect_set(F.struct("original", "placeholder")).alias("__odd"))
    lists = {f.name for f in payloads.schema if f.dataType.typeName() == "array"}
    out = payloads.join(odd, "project_id", "left")
    none = F.array().cast("array<struct<original:string,placeholder:string>>")
    for c in columns:
        whole = F.array_join(c, "\n") if c in lists else F.col(c)
        here = occurring(payloads.select("project_id", "file_ord", whole.alias("text")), last.select("project_id", F.col("original").alias("needle")))
        here = here.join(last, (last["project_id"] == here["project_id"]) & (last["original"] == here["needle"])).groupBy(here["project_id"], here["file_ord"]).agg(F.collect_list(F.struct("original", "placeholder")).alias("__m"))
        out = out.join(here, ["project_id", "file_ord"], "left")
        known = F.transform(F.array_union(F.coalesce("__m", none), F.coalesce("__odd", none)), lambda m: F.struct((-F.length(m["original"])).alias("l"), m["original"].alias("original"), m["placeholder"].alias("placeholder")))
        out = out.withColumn("__m", F.array_sort(known))
        scrubbed = lambda t: F.aggregate("__m", t, lambda a, m: F.replace(a, m["original"], m["placeholder"]))
        out = out.withColumn(c, F.transform(c, scrubbed) if c in lists else scrubbed(F.col(c))).drop("__m")
    return out.select(*payloads.columns)


def public_report(entities: DataFrame) -> DataFrame:
    """PII-14: entities without their originals."""
    keep = [c for c in ("project_id", "file_ord", "type", "placeholder", "confidence", "start", "end", "context_preview_redacted") if c in entities.columns]
    return entities.select(*keep, F.substring(F.sha2("original", 256), 1, 16).alias("original_hash"))


def leaks(texts: DataFrame, entities: DataFrame, column: str = "redacted") -> DataFrame:
    """PII-14: public texts in which an original of the same project occurs; must be empty."""
    found = occurring(texts, entities.select("project_id", F.col("original").alias("needle")), column)
    return texts.join(found.select("project_id", "file_ord").distinct(), ["project_id", "file_ord"], "left_semi")


def route_privacy(reports: DataFrame, mode: str = "mode") -> DataFrame:
    """PII-15: which view a project's text gets, whether it is safe, and why it is blocked."""
    m = F.col(mode)
    view = F.when(m == "local_only", "raw").when(m == "hybrid_safe", "redacted").otherwise("raw")
    blocked = F.when((m == "hybrid_safe") & (F.col("risk") == "unknown"), "prescan_failed").when((m == "hybrid_safe") & (F.col("risk") == "critical"), "critical_risk")
    return reports.withColumn("view", view).withColumn("is_safe", (m == "local_only") | ((m == "hybrid_safe") & blocked.isNull())).withColumn("block_reason", blocked)


def safe_payload(redacted: DataFrame, preview: int = 4000) -> DataFrame:
    """PII-16: the first ``preview`` characters of a project's safe texts, all their characters, and how many files they are.

    The texts stand in the order of file_ord with a blank line between.  Each file has
    two characters of that at least, so the first half of ``preview`` files are enough,
    and no row holds a project.  Names of files are in ``bundle_parts``.
    """
    r = redacted.select("project_id", "file_ord", F.coalesce("redacted", F.lit("")).alias("t"))
    sums = r.groupBy("project_id").agg((F.sum(F.length("t")) + 2 * (F.count("*") - 1)).cast("long").alias("total_chars"), F.count("*").alias("n_files"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("file_ord"))
    first = r.select("project_id", "file_ord", F.substring("t", 1, preview).alias("t")).withColumn("rank", rank).where(F.col("rank") <= preview // 2 + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n\n")
    return sums.join(first.groupBy("project_id").agg(F.substring(text, 1, preview).alias("preview")), "project_id").select("project_id", "preview", "total_chars", "n_files")
