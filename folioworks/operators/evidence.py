"""Evidence: features, field ranking, coverage, completeness (EVD-1 .. EVD-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import text as tx
from folioworks.functions.lexicons import TECHNOLOGIES

# What a field needs to count as covered.
COVERAGE_CHARS = {"title": 15, "essence": 200, "tasks": 80, "purpose": 60, "inputs": 60, "outputs": 60, "results": 60, "outlook": 40, "modules": 40, "tech_stack": 10, "team": 5}
# Fields that need this many characters when nothing else is said.
COVERAGE_OTHER = {"client": 50, "timeline": 50}
# What the role of a source counts for a field, and what its type counts.
ROLE_WEIGHTS = {
    "title": {"primary_project_doc": 1.0, "supporting_presentation": 0.45, "module_presentation": 0.05},
    "client": {"primary_project_doc": 1.0, "supporting_presentation": 0.3, "module_presentation": 0.05},
    "timeline": {"primary_project_doc": 1.0, "supporting_presentation": 0.5, "module_presentation": 0.05},
    "essence": {"primary_project_doc": 1.0, "module_presentation": 0.55, "supporting_presentation": 0.5},
    "tasks": {"primary_project_doc": 1.0, "supporting_presentation": 0.6},
    "purpose": {"primary_project_doc": 1.0, "supporting_presentation": 0.6},
    "inputs": {"primary_project_doc": 0.95, "technical_spec": 1.0},
    "outputs": {"primary_project_doc": 0.95, "technical_spec": 1.0},
    "results": {"primary_project_doc": 0.95, "report": 1.0},
    "outlook": {"primary_project_doc": 0.95, "report": 1.0},
    "team": {"primary_project_doc": 0.95, "team_source": 1.0, "team_list": 1.0},
    "modules": {"primary_project_doc": 1.0, "module_presentation": 0.85, "supporting_presentation": 0.75},
    "tech_stack": {"primary_project_doc": 0.95, "module_presentation": 0.8, "supporting_presentation": 0.7},
}
TYPE_WEIGHTS = {
    "title": {"ready_landing_doc": 1.0, "pptx_project_presentation": 0.9},
    "inputs": {"technical_spec": 1.0, "pptx_project_presentation": 0.7},
    "outputs": {"technical_spec": 1.0, "pptx_project_presentation": 0.75},
    "team": {"team_list": 1.0, "ready_landing_doc": 0.9},
    "results": {"report": 1.0, "pptx_project_presentation": 0.7},
    "outlook": {"report": 1.0, "pptx_project_presentation": 0.6},
    "modules": {"pptx_project_presentation": 1.0, "architecture_doc": 0.9},
    "essence": {"ready_landing_doc": 1.0, "pptx_project_presentation": 0.85},
}
# Least counts of the eleven completeness checks.
COMPLETE = {"essence": 200, "tasks": 5, "purpose": 3, "inputs": 3, "outputs": 3, "results": 3, "outlook": 3, "team": 3, "stack": 1, "modules": 1}


def extract_technologies(col: Column, dictionary: dict[str, tuple[str, str]] = TECHNOLOGIES) -> Column:
    """EVD-2: names of technologies whose text occurs, longest text first, each once."""
    low = F.translate(F.lower(F.coalesce(col, F.lit(""))), " ", " ")
    keys = sorted(dictionary, key=len, reverse=True)
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dictionary[k][1]).alias("name")) for k in keys])
    return tx.let(low, lambda t: F.array_distinct(F.transform(F.filter(pairs, lambda p: F.contains(t, p["k"])), lambda p: p["name"])))


def group_technologies(df: DataFrame, technologies: str = "technologies", dictionary: dict[str, tuple[str, str]] = TECHNOLOGIES) -> DataFrame:
    """EVD-3: (project, category) -> names in first-seen order; unknown names go to Other."""
    category = F.create_map(*[F.lit(x) for c, n in dict.fromkeys((c, n.lower()) for c, n in dictionary.values()) for x in (n, c)])
    rows = df.select("project_id", "file_ord", F.posexplode(technologies).alias("k", "name"))
    rows = rows.withColumn("category", F.coalesce(category[F.lower("name")], F.lit("Other")))
    once = rows.groupBy("project_id", "category", "name").agg(F.min(F.struct("file_ord", "k")).alias("first"))
    return once.groupBy("project_id", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("names"))


def extract_keywords(df: DataFrame, keys: tuple[str, ...] = ("project_id", "file_ord"), limit: int = 12) -> DataFrame:
    """TXT-11: the most frequent words of five letters or more, ties by first place."""
    words = df.select(*keys, F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[а-яёa-z]{5,}"), 0)).alias("pos", "word")).where(~F.col("word").isin(*tx.STOP_WORDS))
    counted = words.groupBy(*keys, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit).select(*keys, "rank", "word", "n")


def build_evidence(parts: DataFrame) -> DataFrame:
    """EVD-1: segments with normalised text, features, a confidence by length and an id that depends on the content alone."""
    t = tx.normalize_text(F.col("text"))
    out = parts.withColumn("normalized_text", t).withColumn("technologies", extract_technologies(F.col("text"))).withColumn("dates", tx.extract_dates(F.col("text")))
    out = out.withColumn("confidence", F.lit(0.5) + F.least(F.length("text") / 2000.0, F.lit(0.4)))
    return out.withColumn("evidence_id", tx.hash16(F.concat_ws("|", "project_id", F.col("file_ord").cast("string"), "location_type", F.col("location_index").cast("string")), 24))


def field_labels(evidence: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """EVD-6: (item, field) for every field one of whose marks occurs."""
    found = lambda t: F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(t, m)), F.lit(f)) for f, marks in rules.items()]))
    return evidence.select("*", F.explode(tx.let(F.lower("text"), found)).alias("field"))


def weight_of(weights: dict, label: Column, other: float, field: Column | None = None) -> Column:
    """The weight of a role or type, ``other`` where it has none; ``weights`` is by field and label, or by label alone."""
    flat = {f"{f}|{k}": w for f, m in weights.items() if isinstance(m, dict) for k, w in m.items()} or weights
    if not flat:
        return F.lit(other)
    key = F.concat_ws("|", field, label) if flat is not weights else label
    return F.coalesce(F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])[key], F.lit(other))


def rank_field_evidence(labelled: DataFrame, roles: dict = ROLE_WEIGHTS, types: dict = TYPE_WEIGHTS, top: int = 8) -> DataFrame:
    """EVD-7: the best items of each field by confidence, role, type, inventory confidence, length, and the first slide for the title.

    Sources that no inventory knows (a null inventory_confidence) get no weight of role or type.
    """
    f = F.col("field")
    known = 0.6 * weight_of(roles, F.col("source_role"), 0.15, f) + 0.35 * weight_of(types, F.col("source_type"), 0.2, f) + 0.2 * F.col("inventory_confidence")
    score = F.col("confidence") + F.coalesce(known, F.lit(0.0)) + F.least(F.length("text") / 500.0, F.lit(0.3))
    if {"location_type", "location_index"} <= set(labelled.columns):
        first = (f == "title") & (F.col("location_type") == "slide") & (F.col("location_index") == 1) & (F.coalesce("source_role", F.lit("")) != "module_presentation")
        score = score + F.when(first, 0.15).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("project_id", "field").orderBy(F.desc("score"), "file_ord", "location_index"))
    return labelled.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= top).withColumn("snippet", F.substring("text", 1, 800))


def field_coverage(ranked: DataFrame, fields: dict[str, int] | None = None) -> DataFrame:
    """EVD-8: every project and field (a bounded cross with a literal list): strong, weak or missing; fields without a least length of their own need 50 characters."""
    fields = {**COVERAGE_CHARS, **COVERAGE_OTHER} if fields is None else fields
    every = ranked.select("project_id").distinct().select("project_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(n).alias("least")) for f, n in fields.items()])).alias("f")).select("project_id", "f.*")
    a = ranked.groupBy("project_id", "field").agg(F.count("*").alias("items"), F.sum(F.length("snippet")).alias("chars"), F.sum(F.when(F.col("rank") <= 5, F.col("confidence"))).alias("c"))
    out = every.join(a, ["project_id", "field"], "left")
    enough = (F.col("chars") >= F.col("least")) & (~F.col("field").isin("tasks", "modules") | (F.col("items") >= 2))
    status = F.when(F.coalesce("chars", F.lit(0)) == 0, "missing").when(enough, "strong").otherwise("weak")
    return out.select("project_id", "field", F.coalesce("items", F.lit(0)).alias("items"), status.alias("status"), F.when(F.col("items").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("c") / 5 + 0.1)).alias("confidence"))


def assembly_confidence(coverage: DataFrame) -> DataFrame:
    """EVD-15."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    a = coverage.groupBy("project_id").agg(is_("strong").alias("strong"), is_("weak").alias("weak"), is_("missing").alias("missing"), F.sum("items").alias("n"))
    c = F.lit(0.08) * F.col("strong") + F.lit(0.03) * F.col("weak") - F.lit(0.04) * F.col("missing") + F.least(F.col("n") / 30.0, F.lit(0.25))
    return a.withColumn("confidence", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), c)), 3))


def completeness(contracts: DataFrame) -> DataFrame:
    """EVD-16: eleven checks over has_title, essence_chars and n_<field> columns."""
    checks = [F.col("has_title"), F.col("essence_chars") > COMPLETE["essence"], *[F.col(f"n_{f}") >= n for f, n in COMPLETE.items() if f != "essence"]]
    passed = sum(c.cast("int") for c in checks)
    return contracts.withColumn("passed", passed).withColumn("score", F.round(passed * 100.0 / len(checks)).cast("int")).withColumn("can_export", F.col("score") >= 70)


# Least sizes of the fields for a strong assembly.
GAP_MINIMUM = {"essence": 300, "tasks": 4, "purpose": 3, "inputs": 3, "outputs": 3, "results": 3, "tech_stack": 3, "modules": 3, "outlook": 2, "team": 1}


def gap_analysis(sizes: DataFrame, minimum: dict[str, int] = GAP_MINIMUM) -> DataFrame:
    """EVD-14: (project, field, size) -> missing, weak or strong."""
    least = F.create_map(*[F.lit(x) for kv in minimum.items() for x in kv])[F.col("field")]
    return sizes.withColumn("gap", F.when(F.coalesce("size", F.lit(0)) == 0, "missing").when(F.col("size") < F.coalesce(least, F.lit(1)), "weak").otherwise("strong"))


def source_usage(inventory: DataFrame, ranked: DataFrame) -> DataFrame:
    """EVD-17: what each source gave: number of items, its fields, and used, weak, empty or ignored."""
    used = ranked.groupBy("project_id", "file_ord").agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    out = inventory.join(used, ["project_id", "file_ord"], "left")
    status = F.when(F.col("items") >= 2, "used").when(F.col("items") == 1, "weak").when(F.col("char_count") == 0, "empty").otherwise("ignored")
    return out.select("project_id", "file_ord", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("fields", F.lit("")).alias("fields"), status.alias("status"))
