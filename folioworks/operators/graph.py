"""Knowledge graph (KG-1 .. KG-7) and generated sections held against their sources (SEM-2)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import text as tx
from folioworks.operators.occurrences import occurring


class Relation(NamedTuple):
    """KG-4: the first entities of some kinds relate to the first of others; pairs come source by source, or target by target."""

    sources: tuple[str, ...]
    targets: tuple[str, ...]
    relation: str
    most_sources: int | None = None
    most_targets: int | None = None
    note: str = ""
    by_target: bool = False
    inferred: bool = False


# Which kinds of entities are related, in this order, and how many of each.
MODULES = ("module", "pipeline")
TECHNOLOGIES = ("technology", "llm", "database", "vector_db")
RELATIONS = (
    Relation(MODULES, TECHNOLOGIES, "uses", most_targets=8, note="module_uses_tech:"),
    Relation(MODULES, ("data_source",), "consumes", most_sources=6, note="module_consumes:", by_target=True),
    Relation(MODULES, ("output",), "produces", most_targets=4, note="module_produces:"),
    Relation(("metric",), ("output",), "validates", most_targets=3, note="metric_validates:"),
    Relation(("project",), MODULES, "belongs_to", most_sources=1, most_targets=8, note="project_contains_module", inferred=True),
)
PATTERN_RELATION = Relation((), TECHNOLOGIES, "depends_on", most_targets=3, note="pattern:", inferred=True)
# Confidence of a relation, given and inferred.
SURE, INFERRED = 0.7, 0.45
# What may stand in no label of a report.
PERSONAL = (r"\b[\w.-]+@[\w.-]+\.\w+\b", r"\b\+?\d[\d\s\-()]{8,}\d\b")
PERSONAL_WORDS = ("@gmail", "@mail", "passport", "inn ", "снилс")
# Notes of a graph's summary.
RISK_WORDS, RISK_NOTE = ("pii", "privacy"), "PII handling requires validation"
MEDICAL_RISKS = ("Clinical validation required", "Physician-in-the-loop recommended")
NO_RESULTS = "Missing measurable results in contract"
CONSTRAINT_WORDS, PRIVACY_NOTE = ("gdpr", "hipaa", "compliance"), "Privacy-first data handling"
NEEDED_BLOCKS = ("tasks", "inputs", "outputs", "results", "tech_stack")
ADVICE = {
    "medical_ai": ("Emphasize clinical workflow and audit trail", "Highlight validation metrics"),
    "education_ai": ("Show learning path personalization", "Include progress analytics"),
    "analytics_platform": ("Highlight ingestion and semantic search", "Show trend detection dashboards"),
    "rag_system": ("Document retrieval pipeline", "Knowledge base grounding"),
}
FILL_NOTE = "Fill missing contract blocks before final landing"


def contract_corpus(blocks: DataFrame) -> DataFrame:
    """KG-1: one lower-case text of all blocks of a project, in order."""
    part = F.struct("block_ord", F.lower(F.coalesce("content", F.lit(""))).alias("t"))
    return blocks.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n").alias("corpus"))


def grounded(label: Column, corpus: Column) -> Column:
    """KG-2: the label occurs, or at least half (rounded down, but one) of its words of more than two characters do; none of under three characters is."""
    low = F.lower(tx.strip(label))
    words = F.filter(F.split(low, r"(?U)[^\w]+"), lambda w: F.length(w) > 2)
    hits = F.size(F.filter(words, lambda w: F.contains(corpus, w)))
    return (F.length(low) >= 3) & (F.contains(corpus, low) | ((F.size(words) > 0) & (hits >= _half(F.size(words)))))


def _half(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / 2))


def ground_labels(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """KG-2 for many labels: (project_id, slug, label) with grounded, against the blocks of their project.

    Labels and their words are looked for once each, wherever they stand in the project's
    blocks; no label meets a whole corpus.  A null or short label is not grounded.
    """
    low = F.lower(tx.strip(F.coalesce("label", F.lit(""))))
    words = F.filter(F.split(low, r"(?U)[^\w]+"), lambda w: F.length(w) > 2)
    rows = labels.select("project_id", "slug", "label", low.alias("whole"), words.alias("words"))
    asked = rows.where(F.length("whole") >= 3).select("project_id", F.explode(F.array_union(F.array("whole"), "words")).alias("needle")).where("needle != ''").distinct()
    text = F.lower(F.coalesce("content", F.lit("")))
    found = occurring(blocks.select("project_id", F.col("block_ord").cast("long").alias("file_ord"), text.alias("text")), asked).select("project_id", "needle").distinct()
    parts = rows.select("project_id", "slug", "label", "whole", F.size("words").alias("n"), F.explode(F.concat(F.array("whole"), "words")).alias("needle"))
    seen = parts.join(found.withColumn("there", F.lit(True)), ["project_id", "needle"], "left")
    # the whole label stands first among its needles; a word may equal it
    sums = seen.groupBy("project_id", "slug", "label", "n").agg(F.count_if(F.col("there")).alias("hits"), F.bool_or(F.coalesce("there", F.lit(False)) & (F.col("needle") == F.col("whole"))).alias("direct"))
    long = F.length(tx.strip(F.coalesce("label", F.lit("")))) >= 3
    return sums.select("project_id", "slug", "label", (long & (F.col("direct") | ((F.col("n") > 0) & (F.col("hits") >= _half(F.col("n")))))).alias("grounded"))


def extract_entities(blocks: DataFrame, types: dict[str, str], top: int = 120) -> DataFrame:
    """KG-3: labels of blocks, by slug, first wins, surest first, at most ``top``.  A label is a piece of its block, so all of them are grounded; labels from elsewhere go through ``ground_labels``."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[F.col("block_key")], F.lit("concept"))
    rows = blocks.select("project_id", "block_ord", kind.alias("type"), F.posexplode(tx.label_tokens(F.col("content"))).alias("k", "label"))
    rows = rows.withColumn("slug", tx.slugify(F.col("label"))).withColumn("confidence", F.when(F.col("type") == "concept", 0.75).otherwise(0.82))
    first = rows.groupBy("project_id", "slug").agg(F.min(F.struct("block_ord", "k", "label", "type", "confidence")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("m.confidence"), "m.block_ord", "m.k", "slug"))
    return first.withColumn("rank", rank).where(F.col("rank") <= top).select("project_id", "slug", "rank", F.col("m.label").alias("label"), F.col("m.type").alias("type"), F.col("m.confidence").alias("confidence"))


def build_relations(entities: DataFrame, rules: tuple[Relation, ...] = RELATIONS, patterns: DataFrame | None = None, pattern_rule: Relation = PATTERN_RELATION, top: int = 240) -> DataFrame:
    """KG-4: (project_id, source, target, relation, rel_ord, confidence, inferred, evidence) of entities (project_id, slug, rank, label, type).

    The kinds of a rule go one after the other, each by rank.  ``patterns`` is
    (project_id, pattern_ord, pattern, related_modules): the entity of each module's
    slug relates to the first technologies.  Of equal relations the first stays, of
    a project's at most ``top``; so no side of a rule needs more than ``top``.
    """
    every = (*rules, pattern_rule)
    sides = [(i, side, kinds, most) for i, r in enumerate(every) for side, kinds, most in ((0, r.sources, r.most_sources), (1, r.targets, r.most_targets)) if kinds]
    lit = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(s).alias("side"), F.array(*map(F.lit, k)).alias("kinds"), F.lit(m or top).alias("most")) for i, s, k, m in sides])
    own = entities.select("project_id", "slug", "label", "rank", F.col("type").alias("t")).select("*", F.explode(F.filter(lit, lambda x: F.array_contains(x["kinds"], F.col("t")))).alias("m"))
    place = F.row_number().over(Window.partitionBy("project_id", "m.rule", "m.side").orderBy(F.array_position("m.kinds", F.col("t")), "rank", "slug"))
    own = own.withColumn("place", place).where("place <= m.most").select("project_id", "slug", "label", "m.rule", "m.side", "place")
    y = own.where("side = 1").select("project_id", "rule", F.col("slug").alias("target"), F.col("label").alias("target_label"), F.col("place").alias("y"))
    x = own.where("side = 0").select("project_id", "rule", F.col("slug").alias("source"), F.col("place").alias("x"), F.lit(0).alias("z"), F.lit("").alias("pattern"))
    if patterns is not None:
        named = patterns.select("project_id", "pattern_ord", "pattern", F.posexplode("related_modules").alias("k", "module")).withColumn("slug", tx.slugify(F.col("module")))
        found = named.join(entities.select("project_id", "slug"), ["project_id", "slug"])
        x = x.unionByName(found.select("project_id", F.lit(len(rules)).alias("rule"), F.col("slug").alias("source"), F.col("pattern_ord").cast("int").alias("x"), F.col("k").alias("z"), "pattern"))
    of = lambda f: F.get(F.array(*[F.lit(f(r)) for r in every]), F.col("rule"))
    rows = x.join(y, ["project_id", "rule"]).where((F.col("source") != F.col("target")) | (F.col("rule") == len(rules)))
    rows = rows.withColumns({"relation": of(lambda r: r.relation), "inferred": of(lambda r: r.inferred), "first": F.when(of(lambda r: r.by_target), F.col("y")).otherwise(F.col("x"))})
    note = F.when(of(lambda r: r.note.endswith(":")), F.concat(of(lambda r: r.note), F.when(F.col("rule") == len(rules), F.col("pattern")).otherwise(F.col("target_label")))).otherwise(of(lambda r: r.note))
    order = F.struct("rule", "first", "z", F.when(of(lambda r: r.by_target), F.col("x")).otherwise(F.col("y")).alias("second"))
    once = rows.groupBy("project_id", "source", "target", "relation").agg(F.min(F.struct(order.alias("o"), "inferred", note.alias("evidence"))).alias("m"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("m.o", "source", "target"))
    out = once.withColumn("rel_ord", rank).where(F.col("rel_ord") <= top)
    return out.select("project_id", "source", "target", "relation", "rel_ord", F.when(F.col("m.inferred"), INFERRED).otherwise(SURE).alias("confidence"), "m.inferred", "m.evidence")


def has_personal(text: Column) -> Column:
    """KG-5: an e-mail address, a long number or one of the forbidden words."""
    low = F.lower(text)
    found = F.lit(False)
    for p in PERSONAL:
        found = found | text.rlike("(?U)" + p)
    for w in PERSONAL_WORDS:
        found = found | F.contains(low, F.lit(w))
    return F.coalesce(found, F.lit(False))


def check_entities(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """KG-5: ``entities`` with status, warnings and grounded, against the blocks of their project.

    Entities are (project_id, slug, rank, label, type, confidence) and, optionally,
    description, inferred and pii_safe.  status is the first that holds of
    *duplicate* (a label, but for case, of a lower rank is there, kept or not),
    *personal*, *ungrounded* (a role of a team, or below 0.5, that nothing in the blocks
    supports; inferred ones need no support) and *kept*.  warnings are those of kept ones.
    """
    e = entities
    for name, value in (("description", F.lit("")), ("inferred", F.lit(False)), ("pii_safe", F.lit(True))):
        if name not in e.columns:
            e = e.withColumn(name, value)
    e = e.join(ground_labels(e, blocks), ["project_id", "slug", "label"], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    key = F.lower(tx.strip(F.coalesce("label", F.lit(""))))
    again = F.row_number().over(Window.partitionBy("project_id", "key").orderBy("rank", "slug")) > 1
    loose = ~F.col("inferred") & ~F.col("grounded")
    status = F.when(F.col("again"), "duplicate").when(has_personal(F.col("label")) | has_personal(F.col("description")), "personal")
    status = status.when(loose & ((F.col("type") == "team_role") | (F.col("confidence") < 0.5)), "ungrounded").otherwise("kept")
    notes = F.array(F.when(F.col("inferred") & (F.col("confidence") > 0.6), "inferred_but_sure"), F.when(loose, "not_grounded"), F.when(~F.col("pii_safe"), "not_pii_safe"))
    e = e.withColumn("key", key).withColumn("again", again).withColumn("status", status)
    return e.withColumn("warnings", F.when(F.col("status") == "kept", F.array_compact(notes)).otherwise(F.array().cast("array<string>"))).drop("key", "again")


def validate_graph(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """KG-5: edges both of whose ends are there."""
    ends = entities.select("project_id", "slug")
    return relations.join(ends.withColumnRenamed("slug", "source"), ["project_id", "source"], "left_semi").join(ends.withColumnRenamed("slug", "target"), ["project_id", "target"], "left_semi")


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """KG-5 / TOP-3: nodes without an edge."""
    used = relations.select("project_id", F.explode(F.array("source", "target")).alias("slug"))
    return entities.join(used, ["project_id", "slug"], "left_anti")


def orphan_modules(entities: DataFrame, relations: DataFrame, more_than: int = 3, named: int = 5) -> DataFrame:
    """KG-5: projects with more than ``more_than`` modules without an edge: how many, and the first ``named`` of them by rank."""
    lone = orphans(entities.where("type = 'module'"), relations)
    lone = lone.withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy("rank", "slug")))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= named, F.struct("r", "label"))))
    return lone.groupBy("project_id").agg(F.count("*").alias("n"), F.transform(first, lambda x: x["label"]).alias("labels")).where(F.col("n") > more_than)


def stale_reports(contracts: DataFrame, reports: DataFrame) -> DataFrame:
    """KG-7: projects without a report, or with one older than the contract."""
    last = reports.groupBy("project_id").agg(F.max("created_at").alias("report_at"))
    return contracts.join(last, "project_id", "left").where(F.col("report_at").isNull() | (F.col("report_at") < F.col("updated_at"))).select("project_id", "updated_at", "report_at")


def graph_summary(entities: DataFrame, relations: DataFrame, profiles: DataFrame | None = None, archetypes: DataFrame | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """KG-6: counts and mean confidences of a project's five parts (0 where it has none), and their mean of at most 0.95.

    Every project of any part is there; a project has one profile.
    """
    parts = {"domain": profiles, "archetype": archetypes, "pattern": patterns, "entity": entities, "relation": relations}
    rows = None
    for name, df in parts.items():
        if df is not None:
            one = df.select("project_id", F.lit(name).alias("part"), F.col("confidence").cast("double").alias("c"))
            rows = one if rows is None else rows.unionByName(one)
    mean = [F.coalesce(F.avg(F.when(F.col("part") == p, F.col("c"))), F.lit(0.0)).alias(f"{p}_confidence") for p in parts]
    out = rows.groupBy("project_id").agg(*[F.count_if(F.col("part") == p).alias(n) for p, n in (("entity", "n_entities"), ("relation", "n_relations"))], *mean)
    five = sum((F.col(f"{p}_confidence") for p in list(parts)[1:]), F.col("domain_confidence")) / 5
    return out.select("project_id", "n_entities", "n_relations", *[F.round(f"{p}_confidence", 6).alias(f"{p}_confidence") for p in parts], F.round(F.least(F.lit(0.95), five), 6).alias("overall"))


def graph_notes(profiles: DataFrame, blocks: DataFrame, metrics: int = 10, chars: int = 120) -> DataFrame:
    """KG-6: (project_id, kind, note_ord, note) with the kinds risk, metric, constraint, missing and recommendation; one row a note.

    ``profiles`` is (project_id, domain), all projects; ``blocks`` (project_id, block_ord,
    block_key, content, bullets).  metric: the first ``metrics`` bullets of the first
    block *results*; constraint: the first ``chars`` characters of each block that
    names one.  Of blocks with one key the first decides whether it is missing.
    """
    low = F.lower(F.coalesce("content", F.lit("")))
    has = lambda words: reduce_or([F.contains(low, F.lit(w)) for w in words])
    empty = (tx.strip(F.coalesce("content", F.lit(""))) == "") & (F.coalesce(F.size("bullets"), F.lit(0)) <= 0)
    b = blocks.select("project_id", "block_ord", "block_key", "content", "bullets", empty.alias("empty"), has(RISK_WORDS).alias("risky"), has(("pii",)).alias("pii"), has(CONSTRAINT_WORDS).alias("bound"))
    first = lambda k: F.min(F.when(F.col("block_key") == k, F.struct("block_ord", "empty")))["empty"]
    lost_results = F.coalesce(F.bool_or((F.col("block_key") == "results") & F.col("empty")), F.lit(False)).alias("lost_results")
    facts = b.groupBy("project_id").agg(F.bool_or("risky").alias("risky"), F.bool_or("pii").alias("pii"), F.bool_or("bound").alias("bound"), lost_results, *[first(k).alias(f"no_{k}") for k in NEEDED_BLOCKS])
    p = profiles.select("project_id", "domain").join(facts, "project_id", "left").fillna(False, ["risky", "pii", "bound", "lost_results"])
    missing = F.array_compact(F.array(*[F.when(F.coalesce(f"no_{k}", F.lit(True)), F.lit(f"Contract block '{k}' is empty")) for k in NEEDED_BLOCKS]))
    medical = F.col("domain") == "medical_ai"
    risk = F.array_compact(F.array(F.when(F.col("risky"), RISK_NOTE), *[F.when(medical, r) for r in MEDICAL_RISKS], F.when(F.col("lost_results"), NO_RESULTS)))
    constraint = F.array_compact(F.array(F.when(F.col("pii") & ~F.col("bound"), PRIVACY_NOTE)))
    advice = F.array_compact(F.array(*[F.when(F.col("domain") == d, a) for d, two in ADVICE.items() for a in two], F.when(F.size(missing) > 0, FILL_NOTE)))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("notes")) for k, a in (("risk", risk), ("constraint", constraint), ("missing", missing), ("recommendation", advice))])
    own = p.select("project_id", F.explode(kinds).alias("k")).select("project_id", "k.kind", F.posexplode("k.notes").alias("note_ord", "note"))
    results = b.where("block_key = 'results'").groupBy("project_id").agg(F.min_by("bullets", "block_ord").alias("bullets"))
    lines = F.slice(F.filter("bullets", lambda x: tx.strip(x) != ""), 1, metrics)
    found = results.select("project_id", F.lit("metric").alias("kind"), F.posexplode(lines).alias("note_ord", "note"))
    named = b.where("bound").select("project_id", F.lit("constraint").alias("kind"), F.col("block_ord").cast("int").alias("note_ord"), F.substring("content", 1, chars).alias("note"))
    return own.unionByName(found).unionByName(named)


def reduce_or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


NUMBER = r"\d+(?:[.,]\d+)?"


def ground_items(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """SEM-2: ``items`` (project_id, section_ord, section, kind, item_ord, item) with verified, against the blocks of their project.

    A *metric* is verified if it has no number or any of its numbers (a comma as a
    point) occurs; a *bullet* of a section *team* if any of its words of more than
    three characters does; other bullets always.  Numbers and words are looked for
    once each, wherever they stand.
    """
    low = F.lower(F.coalesce("item", F.lit("")))
    numbers = F.transform(F.regexp_extract_all(low, F.lit(NUMBER), 0), lambda n: F.replace(n, F.lit(","), F.lit(".")))
    words = F.filter(F.split(low, r"(?U)\W+"), lambda w: F.length(w) > 3)
    team = (F.col("kind") == "bullet") & (F.col("section") == "team")
    asked = F.when(F.col("kind") == "metric", numbers).when(team, words).otherwise(F.array().cast("array<string>"))
    rows = items.withColumn("__asked", F.array_distinct(asked))
    needles = rows.select("project_id", F.explode("__asked").alias("needle")).distinct()
    texts = blocks.select("project_id", F.col("block_ord").cast("long").alias("file_ord"), F.lower(F.coalesce("content", F.lit(""))).alias("text"))
    found = occurring(texts, needles).select("project_id", "needle").distinct()
    keys = ["project_id", "section_ord", "kind", "item_ord"]
    seen = rows.select(*keys, F.explode("__asked").alias("needle")).join(found, ["project_id", "needle"], "left_semi").select(*keys).distinct().withColumn("__seen", F.lit(True))
    free = (F.size("__asked") == 0) & ~team
    return rows.join(seen, keys, "left").withColumn("verified", free | F.coalesce("__seen", F.lit(False))).drop("__asked", "__seen")


def ground_sections(items: DataFrame, grounding: float = 0.9, most: float = 0.4) -> DataFrame:
    """SEM-2: by section, from ``ground_items``: kept and removed items, its grounding, and what is missing: *metrics_unverified*, *team* (every bullet is gone)."""
    metric, bullet, ok = F.col("kind") == "metric", F.col("kind") == "bullet", F.col("verified")
    n = items.groupBy("project_id", "section_ord", "section").agg(
        F.count_if(metric & ok).alias("n_metrics"), F.count_if(metric & ~ok).alias("lost_metrics"), F.count_if(bullet & ok).alias("n_bullets"), F.count_if(bullet & ~ok).alias("lost_bullets")
    )
    out = n.withColumn("grounding", F.when(F.col("lost_metrics") > 0, F.least(F.lit(grounding), F.lit(most))).otherwise(F.lit(grounding)))
    gone = (F.col("section") == "team") & (F.col("n_bullets") == 0) & (F.col("lost_bullets") > 0)
    return out.withColumn("missing", F.array_compact(F.array(F.when(F.col("lost_metrics") > 0, "metrics_unverified"), F.when(gone, "team"))))


def ground_metrics(metrics: DataFrame, corpus: DataFrame) -> DataFrame:
    """SEM-2 for short texts, one row a project: metrics without a number, or any of whose numbers occurs."""
    numbers = F.transform(F.regexp_extract_all("metric", F.lit(NUMBER), 0), lambda n: F.replace(n, F.lit(","), F.lit(".")))
    return metrics.join(corpus, "project_id").where((F.size(numbers) == 0) | F.exists(numbers, lambda n: F.contains(F.col("corpus"), n))).drop("corpus")
