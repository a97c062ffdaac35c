"""Lexicon classifiers and decision tables (CLS-3 .. CLS-16).

Lexicons are literal arrays in the plan: the keywords of all keys are compared in
one pass over the lower-cased text, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import team_words as tw
from folioworks.functions.lexicons import ARCHETYPES, DOMAINS, LAYOUTS, PATTERN_BOOSTS, PATTERNS, PROFILES, SECTION_PLAN, SECTION_PLANS, SOURCE_TYPES, STYLES
from folioworks.functions.text import let, squeeze, strip


def keyword_hits(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """Array of (key_ord, key, hits, size, markers) for every key, in the lexicon's order."""
    keys = []
    for i, (key, words) in enumerate(lexicon.items()):
        found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
        keys.append(F.struct(F.lit(i).alias("key_ord"), F.lit(key).alias("key"), F.size(found).alias("hits"), F.lit(len(words)).alias("size"), found.alias("markers")))
    return F.array(*keys)


def _ranked(hits: Column) -> Column:
    """Keys with hits, most hits first, then lexicon order."""
    some = F.transform(F.filter(hits, lambda h: h["hits"] > 0), lambda h: F.struct((-h["hits"]).alias("neg"), h["key_ord"].alias("key_ord"), h["key"].alias("key"), h["hits"].alias("hits"), h["markers"].alias("markers")))
    return F.array_sort(some)


def classify_domain(texts: DataFrame, lexicon: dict[str, tuple[str, ...]] = DOMAINS, text: str = "text") -> DataFrame:
    """CLS-7 / CLS-8: primary domain, up to two secondary ones of at least half its hits, confidence and evidence."""
    ranked = texts.withColumn("__r", let(F.lower(F.coalesce(F.col(text), F.lit(""))), lambda t: _ranked(keyword_hits(t, lexicon))))
    best, total = F.get("__r", 0), F.aggregate("__r", F.lit(0), lambda a, h: a + h["hits"])
    second = F.slice(F.filter(F.slice("__r", 2, 100), lambda h: h["hits"] * 2 >= best["hits"]), 1, 2)
    none = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", 0.3).otherwise(0.4)
    out = ranked.withColumn("primary_domain", F.coalesce(best["key"], F.lit("general"))).withColumn("confidence", F.when(F.size("__r") == 0, none).otherwise(F.least(F.lit(0.95), F.lit(0.45) + F.lit(0.5) * best["hits"] / total)))
    return out.withColumn("secondary", F.transform(second, lambda h: h["key"])).withColumn("evidence", F.slice(F.flatten(F.transform("__r", lambda h: h["markers"])), 1, 10)).drop("__r")


def build_inventory(files: DataFrame, lexicon: dict[str, tuple[str, ...]] = SOURCE_TYPES) -> DataFrame:
    """CLS-3: source type with the largest share of its marks, first in lexicon order on ties."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = let(F.translate(F.lower(text), " ", " "), lambda t: keyword_hits(t, lexicon))
    slides = F.size(F.regexp_extract_all(text, F.lit(r"(?i)(?:^|\n)\s*Slide\s+\d+\s*:"), 0))
    people = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[А-ЯЁ][а-яё]+\s+[А-ЯЁ]"), 0))
    f = files.withColumn("__h", hits).withColumn("slides", slides).withColumn("__people", people)
    boost = F.when((F.col("file_type") == "pptx") & (F.col("slides") > 0), F.least(F.col("slides") / 10.0, F.lit(1.0))).otherwise(0.0)
    team = F.when((F.col("__people") >= 3) & F.lower(text).contains("тимлид"), 0.6).otherwise(0.0)

    def score(h):
        share = h["hits"] / h["size"]
        share = F.when(h["key"] == "pptx_project_presentation", F.greatest(share, boost)).when(h["key"] == "team_list", F.greatest(share, team)).otherwise(share)
        return F.struct((-share).alias("neg"), h["key_ord"].alias("key_ord"), h["key"].alias("key"))

    f = f.withColumn("__b", F.get(F.array_sort(F.filter(F.transform("__h", score), lambda s: s["neg"] < 0)), 0))
    n = F.length(text)
    short = F.col("file_type").isin("txt", "md") & (n < 200)
    f = f.withColumn("detected_source_type", F.coalesce(F.col("__b")["key"], F.when(short, "raw_notes").when(n > 500, "mixed_project_materials").otherwise("unknown")))
    conf = F.when(F.col("__b").isNotNull(), F.round(F.least(-F.col("__b")["neg"] + 0.15, F.lit(1.0)), 3)).when(short, 0.3).when(n > 500, 0.4).otherwise(0.2)
    markers = F.slice(F.array_distinct(F.flatten(F.transform("__h", lambda h: h["markers"]))), 1, 20)
    return f.withColumn("confidence", conf).withColumn("markers", markers).withColumn("char_count", n).drop("__h", "__b", "__people")


def infer_roles(inventory: DataFrame) -> DataFrame:
    """CLS-4: the surest, then longest ready document of a project is primary; other roles follow from type and file type."""
    ready = (F.col("detected_source_type") == "ready_landing_doc") & (F.col("confidence") >= 0.65)
    order = Window.partitionBy("project_id").orderBy(ready.desc(), F.desc("confidence"), F.desc("char_count"), "file_ord")
    primary = ready & (F.row_number().over(order) == 1)
    kind = F.col("detected_source_type")
    role = F.when(primary, "primary_project_doc").when(kind == "ready_landing_doc", "ready_landing_doc").when((kind == "pptx_project_presentation") | (F.col("file_type") == "pptx"), "supporting_presentation").when(kind == "report", "report").when(kind.isin("technical_spec", "team_list", "architecture_doc"), "auxiliary").otherwise("unknown")
    return inventory.withColumn("source_role", role)


def single_ready_doc(inventory: DataFrame) -> DataFrame:
    """CLS-5: exactly one strong ready document, and no other source of more than 100 characters."""
    strong = (F.col("detected_source_type") == "ready_landing_doc") & (F.col("confidence") >= 0.65)
    a = inventory.groupBy("project_id").agg(F.count_if(strong).alias("n"), F.count_if(~strong & (F.col("char_count") > 100)).alias("others"))
    return a.select("project_id", ((F.col("n") == 1) & (F.col("others") == 0)).alias("single_ready_doc"))


def primary_text(files: DataFrame, prefer: tuple[str, ...] = ("docx", "pdf", "pptx")) -> DataFrame:
    """CLS-6: the longest text of a project, preferred file types first."""
    rank = F.struct(F.col("file_type").isin(*prefer), F.length("text"), -F.col("file_ord"))
    return files.groupBy("project_id").agg(F.max_by("file_ord", rank).alias("file_ord"), F.max_by(F.length("text"), rank).alias("char_count"))


def route_visual(items: DataFrame, min_chars: int = 40) -> DataFrame:
    """CLS-13: which way a page goes by content type, text layer, images and OCR flag."""
    text, images, ocr = F.col("text_chars"), F.col("image_count"), F.col("ocr_enabled")
    diagram = F.col("content_type").isin("architecture", "stack", "diagram")
    route = F.when((text == 0) & (images == 0), "skip").when((text >= min_chars) & ~(diagram & (images > 0)), "text_layer").when((images > 0) & ~ocr, "vlm").when((images > 0) & diagram, "ocr_vlm").when(images > 0, "ocr").otherwise("text_layer")
    return items.withColumn("route", route).withColumn("needs_vlm", route.isin("vlm", "ocr_vlm"))


def ocr_targets(pages: DataFrame, min_chars: int = 40, cap: int = 40) -> DataFrame:
    """CLS-14: pages with images and little text, and the last page of a file, at most ``cap`` a file in page order."""
    w = Window.partitionBy("project_id", "file_ord")
    last = F.col("page") == F.max("page").over(w)
    hit = pages.withColumn("last", last).where((F.col("image_count") > 0) & ((F.col("text_chars") < min_chars) | F.col("last")))
    return hit.withColumn("r", F.row_number().over(w.orderBy("page"))).where(F.col("r") <= cap).drop("r", "last")


def user_projects(projects: DataFrame, technical: str = r"(?iU)\b(test|smoke|demo|debug|tmp|sample)\b") -> DataFrame:
    """CLS-16: projects with material whose names are no technical ones."""
    return projects.where(~F.coalesce("name", F.lit("")).rlike(technical) & (F.col("n_files") > 0))


def classify_profile(texts: DataFrame, lexicon: dict[str, tuple[str, ...]] = PROFILES, text: str = "text", other: str = "general") -> DataFrame:
    """CLS-8: the one profile with most hits, first in the lexicon's order on ties, with hits, a confidence and the first eight marks of all profiles.

    0.45 and half of the share of the best among all hits, at most 0.95; 0.4 without marks, 0.3 without a text.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = texts.withColumn("__h", let(low, lambda t: keyword_hits(t, lexicon))).withColumn("__b", F.get(_ranked(F.col("__h")), 0))
    total = F.aggregate("__h", F.lit(0), lambda a, h: a + h["hits"])
    conf = F.when(F.col("__b").isNotNull(), F.least(F.lit(0.95), F.lit(0.45) + F.col("__b")["hits"] / total * 0.5)).when(strip(low) == "", 0.3).otherwise(0.4)
    marks = F.slice(F.flatten(F.transform("__h", lambda h: F.transform(h["markers"], lambda m: F.concat(h["key"], F.lit(":"), m)))), 1, 8)
    signals = F.when(F.col("__b").isNotNull(), marks).when(strip(low) == "", F.array(F.lit("empty_contract"))).otherwise(F.array(F.lit("no_domain_signals")))
    out = out.withColumns({"profile": F.coalesce(F.col("__b")["key"], F.lit(other)), "hits": F.coalesce(F.col("__b")["hits"], F.lit(0)), "profile_confidence": F.round(conf, 6), "signals": signals})
    return out.drop("__b", "__h")


def _scored(hits: Column, confidence, top: int) -> Column:
    """The keys with hits as (confidence, key, markers), best first, then lexicon order, at most ``top``."""
    some = F.transform(F.filter(hits, lambda h: h["hits"] > 0), lambda h: F.struct((-confidence(h)).alias("neg"), h["key_ord"].alias("o"), h["key"].alias("key"), h["markers"].alias("markers")))
    return F.transform(F.slice(F.array_sort(some), 1, top), lambda h: F.struct(h["key"].alias("key"), F.round(-h["neg"], 6).alias("confidence"), F.slice(h["markers"], 1, 5).alias("evidence")))


def detect_archetypes(classified: DataFrame, rules: dict[str, tuple[str | None, tuple[str, ...]]] = ARCHETYPES, text: str = "text", top: int = 3) -> DataFrame:
    """CLS-9: archetypes of texts that CLS-7 has classified.

    ``rules`` gives each archetype the domain it needs (None: any) and its words.  0.5
    and 0.12 for each word found, at most 0.92; 0.1 more, at most 0.95, where the
    domain is the primary one.
    """
    need = F.create_map(*[F.lit(x) for k, (d, _) in rules.items() for x in (k, d or "")])
    base = lambda h: F.least(F.lit(0.92), F.lit(0.5) + 0.12 * h["hits"])
    conf = lambda h: F.when(need[h["key"]] == F.col("primary_domain"), F.least(F.lit(0.95), base(h) + 0.1)).otherwise(base(h))
    fits = lambda h: (need[h["key"]] == "") | (need[h["key"]] == F.col("primary_domain")) | F.array_contains("secondary", need[h["key"]])
    hits = let(F.lower(F.coalesce(F.col(text), F.lit(""))), lambda t: keyword_hits(t, {k: w for k, (_, w) in rules.items()}))
    return classified.withColumn("__h", hits).withColumn("archetypes", _scored(F.filter("__h", fits), conf, top)).drop("__h")


#: what parts a list of tasks into modules
TASK_ENDS = r"[\n;,]+"


def detect_patterns(classified: DataFrame, rules: dict[str, tuple[str, ...]] = PATTERNS, boosts: dict[tuple[str, str], float | tuple[float, float]] = PATTERN_BOOSTS, text: str = "text", top: int = 10, tasks: str | None = None) -> DataFrame:  # noqa: B006
    """CLS-10: patterns by their words: 0.48 and 0.1 for each, at most 0.9; ``boosts`` adds for (pattern, primary domain), up to a most of its own (0.95).

    With ``tasks``, the column of a record's tasks, every pattern has the first five of them
    that hold one of its words, as related.
    """
    base = lambda h: F.least(F.lit(0.9), F.lit(0.48) + 0.1 * h["hits"])

    def conf(h):
        out = base(h)
        for (pattern, domain), more in (boosts or {}).items():
            add, most = more if isinstance(more, tuple) else (more, 0.95)
            out = F.when((h["key"] == pattern) & (F.col("primary_domain") == domain), F.least(F.lit(most), base(h) + add)).otherwise(out)
        return out

    hits = let(F.lower(F.coalesce(F.col(text), F.lit(""))), lambda t: keyword_hits(t, rules))
    out = classified.withColumn("__h", hits).withColumn("patterns", _scored(F.col("__h"), conf, top)).drop("__h")
    if tasks is None:
        return out
    words = F.create_map(*[x for k, ws in rules.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in ws]))])
    parts = F.filter(F.transform(F.split(F.coalesce(tasks, F.lit("")), TASK_ENDS), lambda x: F.regexp_replace(x, r"^[ \-–—•]+|[ \-–—•]+$", "")), lambda x: (F.length(x) > 2) & (F.length(x) <= 80))
    related = lambda p: F.slice(F.filter("__t", lambda x: F.exists(words[p["key"]], lambda w: F.contains(F.lower(x), w))), 1, 5)
    return out.withColumn("__t", parts).withColumn("patterns", F.transform("patterns", lambda p: F.struct(p["key"].alias("key"), p["confidence"].alias("confidence"), p["evidence"].alias("evidence"), related(p).alias("related")))).drop("__t")


def plan_sections(domains: DataFrame, plan: dict[str, tuple[str, ...]] = SECTION_PLANS, default: tuple[str, ...] = SECTION_PLAN, domain: str = "primary_domain") -> DataFrame:
    """CLS-11: one row for each planned section of a project, in order, with the page's layout and style; domains without a plan get the default."""
    lists = F.create_map(*[x for k, v in plan.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    rows = F.coalesce(lists[F.col(domain)], F.array(*[F.lit(s) for s in default]))
    of = lambda m, other: F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(domain)], F.lit(other))
    return domains.select(*domains.columns, of(LAYOUTS, LAYOUTS["general"]).alias("layout"), of(STYLES, STYLES["general"]).alias("style"), F.posexplode(rows).alias("section_ord", "section"))


def classify_visual(items: DataFrame, lexicon: dict[str, tuple[str, ...]], text: str = "text") -> DataFrame:
    """CLS-12: content type with most marks (first on ties): 0.45 and 0.12 for each, 0.08 more for images alone, at most 0.95; without marks generic, or unknown where there is neither text nor image."""
    best = let(F.lower(F.coalesce(F.col(text), F.lit(""))), lambda t: F.get(_ranked(keyword_hits(t, lexicon)), 0))
    alone = (F.col("image_count") > 0) & (F.length(F.coalesce(F.col(text), F.lit(""))) < 40)
    out = items.withColumn("__b", best)
    nothing = (F.col("image_count") == 0) & (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0)
    kind = F.coalesce(F.col("__b")["key"], F.when(nothing, "unknown").otherwise("generic"))
    conf = F.when(F.col("__b").isNotNull(), F.least(F.lit(0.95), F.lit(0.45) + 0.12 * F.col("__b")["hits"] + F.when(alone, 0.08).otherwise(0.0))).when(nothing, 0.2).otherwise(0.4)
    return out.withColumn("content_type", kind).withColumn("confidence", F.round(conf, 6)).drop("__b")


def verdict(states: DataFrame) -> DataFrame:
    """CLS-15: status and classification of a project's state, first matching rule.

    Columns: source_count, filenames, evidence_count, team_structured_count,
    contract_has_team, export_has_team, landing_stale, team_coverage, is_technical.
    """
    n, team, has, shown = F.col("source_count"), F.col("team_structured_count"), F.col("contract_has_team") | (F.col("team_structured_count") > 0), F.col("export_has_team")
    listed = F.exists("filenames", lambda f: F.endswith(F.lower(f), F.lit(".docx")) | F.endswith(F.lower(f), F.lit(".txt")))
    rules = (
        ((n == 1) & ~has & ~shown & F.coalesce("team_coverage", F.lit("")).isin("missing", ""), "USER_ACTION_REQUIRED", "single_file_no_team_source"),
        ((n >= 2) & listed & (team == 0), "BUG", "docx_present_but_team_missing"),
        (has & ~shown, "BUG", "contract_has_team_but_export_missing"),
        (F.col("landing_stale"), "STALE", "stale_generated_landing"),
        ((n >= 2) & (team > 0) & shown, "OK", "team_pipeline_ok"),
        ((n == 0) & (F.size("filenames") == 0) & (F.col("evidence_count") == 0) & F.col("is_technical"), "USER_ACTION_REQUIRED", "technical_or_empty_project"),
    )
    status, name = F.lit("BUG"), F.lit("ambiguous_inconsistent_state")
    for c, s, k in reversed(rules):
        status, name = F.when(c, s).otherwise(status), F.when(c, k).otherwise(name)
    return states.withColumn("status", status).withColumn("classification", name)


def choose_parser(projects: DataFrame) -> DataFrame:
    """CLS-17: structured alone; fusion of two sources or more; else the presentation if it is more complete, assembly from 70 (or 55, if no less than the presentation), any presentation, or heuristic.

    Columns: single_ready_doc, n_sources, multi_score, presentation_score (null: no presentation).
    """
    multi, deck = F.coalesce("multi_score", F.lit(0)), F.col("presentation_score")
    some = deck.isNotNull()
    mode = (
        F.when(F.col("single_ready_doc"), "structured").when(F.col("n_sources") >= 2, "fusion").when(some & (deck > multi), "project_presentation")
        .when((multi >= 70) | ((multi >= 55) & (multi >= F.coalesce(deck, F.lit(0)))), "multi_source_assembly").when(some, "project_presentation").otherwise("heuristic")
    )
    return projects.withColumn("parser_mode", mode)


def bare_name(name: Column) -> Column:
    """CLS-18: a name without links, a last remark in brackets, a number before it and a role behind a dash."""
    n = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r"(?U)\s+https?://\S+", "")
    n = F.regexp_replace(F.regexp_replace(n, r"(?U)\s*\([^)]+\)\s*$", ""), r"(?U)^\d+\.\s+", "")
    return strip(F.when(F.contains(n, F.lit(" — ")), F.substring_index(n, " — ", 1)).otherwise(F.substring_index(n, " - ", 1)))


def has_stop_word(bare: Column, stop: tuple[str, ...] = tw.NO_NAME) -> Column:
    return F.arrays_overlap(F.split(F.lower(bare), r"(?U)\s+"), F.array(*[F.lit(w) for w in stop]))


def person_name_ok(name: Column, form: str = tw.NAME_FORM, stop: tuple[str, ...] = tw.NO_NAME) -> Column:
    """CLS-18: two or three capitalised words of one script, no preposition first and none a stop word; the form is a parameter."""

    def good(n: Column) -> Column:
        words = F.split(n, r"(?U)\s+")
        first = F.lower(F.get(words, F.lit(0))).isin(*tw.PREPOSITIONS)
        return n.rlike("(?U)" + form) & F.size(words).isin(2, 3) & ~first & ~has_stop_word(n, stop)

    return F.coalesce(let(bare_name(name), good), F.lit(False))


def role_ok(role: Column, words: tuple[str, ...] = tw.ROLE_MARKERS, form: str = tw.NAME_FORM, stop: tuple[str, ...] = tw.NO_NAME) -> Column:
    """CLS-18: a role holds a role marker, has at most 120 characters and is no name."""
    low = F.lower(F.coalesce(role, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)) & (F.length(low) <= 120) & ~person_name_ok(role, form, stop)


def team_context(section: Column, text: Column, hints: tuple[str, ...] = tw.CONTEXT_HINTS) -> Column:
    """CLS-18: a section title or the start of a text speaks of a team."""
    low = F.lower(F.concat_ws("\n", F.coalesce(section, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 400)))
    return F.exists(F.array(*[F.lit(w) for w in hints]), lambda w: F.contains(low, w))


def inline_role(name: Column, first_lines: Column, words: tuple[str, ...] = tw.ROLE_MARKERS, form: str = tw.NAME_FORM, stop: tuple[str, ...] = tw.NO_NAME) -> Column:
    """CLS-18: a role behind a dash in the name itself, or else in one of the text's first lines that holds the name."""
    tail = lambda x: F.when(F.contains(x, F.lit(" — ")), F.substring(x, F.locate(" — ", x) + 3, 1 << 30)).when(F.contains(x, F.lit(" - ")), F.substring(x, F.locate(" - ", x) + 3, 1 << 30))
    near = F.exists(first_lines, lambda x: F.contains(x, name) & F.coalesce(role_ok(tail(x), words, form, stop), F.lit(False)))
    own = tail(name)
    return F.when(own.isNotNull(), role_ok(own, words, form, stop)).otherwise(F.coalesce(near, F.lit(False)))


def candidate_reason(candidates: DataFrame, form: str = tw.NAME_FORM, words: tuple[str, ...] = tw.ROLE_MARKERS, stop: tuple[str, ...] = tw.NO_NAME) -> DataFrame:
    """CLS-18: whether a candidate is accepted, and why (not); a null name is none.

    Columns: name, role, in_team_context; first_lines (of its text), where there are any.
    """
    ok, role = person_name_ok(F.col("name"), form, stop), role_ok(F.col("role"), words, form, stop)
    if "first_lines" in candidates.columns:
        role = role | inline_role(F.col("name"), F.col("first_lines"), words, form, stop)
    # The reasons.
    bad = F.when(F.coalesce(has_stop_word(bare_name(F.col("name")), stop), F.lit(False)), "rejected: domain_stop_word").otherwise("rejected: not_person_name")
    good = F.when(F.col("in_team_context"), "accepted: valid_name_in_team_context").when(role, "accepted: valid_name_with_role").otherwise("rejected: outside_team_context")
    return candidates.withColumn("reason", F.when(ok, good).otherwise(bad)).withColumn("accepted", F.startswith("reason", F.lit("accepted")))
