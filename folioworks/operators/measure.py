"""Impact metrics and evaluation (MET-1, MET-2, EVAL-1 .. EVAL-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import text as tx
from folioworks.operators.occurrences import occurring

# Labels of a project's own counts, in order; the first four fill up too few cards; how few and how many there are.
COUNT_CARDS = (("modules", "Подсистем"), ("team", "Команда"), ("stack", "Технологий"), ("tasks", "Задач"), ("results", "Результатов"))
FILLING, LEAST_CARDS, MOST_CARDS = 4, 4, 6
# Titles that say nothing.
GENERIC_TITLES = ("проект", "презентация", "слайд", "landing", "slide 1", "slide 1:")


def impact_metrics(texts: DataFrame, units: dict[str, str], text: str = "text") -> DataFrame:
    """MET-1: number and unit pairs; the largest number of each label, 3 at least.

    Numbers of any length are compared by their digits.  ``digits`` is the largest one as
    written, without blanks and leading zeros; ``value`` is the same as a bigint, null where that cannot hold it.
    """
    number, unit = r"(\d[\d  ]*\d|\d)\+?\s*(", "|".join(units)
    pattern = F.lit("(?i)" + number + unit + ")")
    rows = texts.select("project_id", F.explode(F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("n"), F.regexp_extract_all(text, pattern, 2).alias("u"))).alias("m"))
    label = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])[F.lower("m.u")]
    digits = F.regexp_replace(F.regexp_replace("m.n", "[  ]", ""), "^0+(?=.)", "")
    sized = F.struct(F.length("digits").alias("n"), "digits")  # of equal length, digits sort as their numbers
    largest = rows.select("project_id", label.alias("label"), digits.alias("digits")).where("length(digits) > 1 OR digits >= '3'").groupBy("project_id", "label").agg(F.max(sized)["digits"].alias("digits"))
    return largest.withColumn("value", F.col("digits").try_cast("long")).select("project_id", "label", "value", "digits")


def engine_scores(runs: DataFrame) -> DataFrame:
    """EVAL-1: ten for each accepted, five for each known name, three for a section, up to five for text; 50 off for a failure."""
    score = 10 * F.col("accepted") + 5 * F.col("known") + 3 * F.col("section").cast("int") + F.least(F.col("chars") / 300.0, F.lit(5.0)) - F.col("rejected")
    return runs.withColumn("score", F.round(F.when(F.col("ok"), score).otherwise(F.lit(-50.0)), 2))


def best_engine(runs: DataFrame) -> DataFrame:
    """EVAL-1: the best run of a page by score, accepted, known, chars."""
    w = Window.partitionBy("page").orderBy(F.desc("score"), F.desc("accepted"), F.desc("known"), F.desc("chars"), "engine")
    return engine_scores(runs).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def known_name_hits(texts: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """EVAL-2: how many of the (few, given) names occur with all their parts."""
    low = F.lower(F.col(text))
    parts = F.array(*[F.array(*[F.lit(p) for p in n.lower().split()]) for n in names])
    return texts.withColumn("hits", F.size(F.filter(parts, lambda n: F.forall(n, lambda p: F.contains(low, p)))))


def acceptance(found: DataFrame, expected: DataFrame) -> DataFrame:
    """EVAL-3: required items that were not found, by project."""
    need = expected.select("project_id", F.explode("must_have").alias("item")).distinct()
    return need.join(found.select("project_id", "item"), ["project_id", "item"], "left_anti").groupBy("project_id").agg(F.count("*").alias("missing"))


def team_consistency(evidence: DataFrame, contract: DataFrame, page: DataFrame) -> DataFrame:
    """EVAL-4: where a project's team is lost between evidence, contract and page."""
    j = evidence.join(contract, "project_id", "full_outer").join(page, "project_id", "full_outer").fillna(0, ["n_evidence", "n_contract", "n_page"])
    lost = F.when((F.col("n_evidence") > 0) & (F.col("n_contract") == 0), "contract").when((F.col("n_contract") > 0) & (F.col("n_page") == 0), "page").otherwise("none")
    return j.withColumn("lost_at", lost)


def product_metrics(texts: DataFrame, names: tuple[str, ...] = ("recall", "precision", "accuracy", "f1"), text: str = "text") -> DataFrame:
    """MET-2: the first number within 16 characters behind a measure's name."""
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.regexp_extract(F.lower(text), n + r"\D{0,16}?(\d+(?:[.,]\d+)?)", 1).alias("value")) for n in names])
    return texts.select("project_id", "file_ord", F.explode(F.filter(pairs, lambda p: p["value"] != "")).alias("p")).select("project_id", "file_ord", "p.label", "p.value")


def metric_cards(sources: DataFrame, most: int = 6) -> DataFrame:
    """MET-3: (project, source_ord, label, value): the first of each label, at most ``most`` a project in source order."""
    first = sources.groupBy("project_id", "label").agg(F.min(F.struct("source_ord", "value")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("m.source_ord", "label"))
    return first.withColumn("card", rank).where(F.col("card") <= most).select("project_id", "card", "label", F.col("m.value").alias("value"))


def numeric_weight(value: Column) -> Column:
    """MET-3: the number that a value's digits and points spell, 0 where they spell none."""
    return F.coalesce(F.regexp_replace(value, r"[^\d.]", "").try_cast("double"), F.lit(0.0))


def project_cards(counts: DataFrame, extracted: DataFrame | None = None, product: DataFrame | None = None, most: int = MOST_CARDS, least: int = LEAST_CARDS) -> DataFrame:
    """MET-3: (project_id, card, label, value, origin), ``least`` to ``most`` cards for every project of ``counts``.

    ``counts`` is (project_id, modules, team, stack, tasks, results), null as 0;
    ``extracted`` and ``product`` are (project_id, ord, label, value).  In order: extracted ones
    by falling weight of the value, product ones, counts above 0, and, where these
    are fewer than ``least`` labels, the zero counts of the first four.  The first of a label stays.
    """
    n = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(label).alias("label"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for i, (c, label) in enumerate(COUNT_CARDS)])
    own = counts.select("project_id", F.explode(n).alias("c")).select("project_id", "c.*").where(F.col("n").__gt__(0) | (F.col("ord") < FILLING))
    card = lambda df, phase, weight, at, origin: df.select("project_id", phase.alias("phase"), weight.alias("weight"), at.cast("long").alias("ord"), "label", F.col("value").cast("string").alias("value"), origin.alias("origin"))
    zero = F.col("n") == 0
    rows = card(own.withColumn("value", F.col("n")), F.when(zero, 3).otherwise(2), F.lit(0.0), F.col("ord"), F.when(zero, "fallback").otherwise("derived"))
    for df, phase in ((extracted, 0), (product, 1)):
        if df is not None:
            df = df.join(counts.select("project_id"), "project_id", "left_semi").withColumn("value", F.col("value").cast("string"))
            rows = rows.unionByName(card(df, F.lit(phase), -numeric_weight(F.col("value")) if phase == 0 else F.lit(0.0), F.col("ord"), F.lit("extracted")))
    first = rows.groupBy("project_id", "label").agg(F.min(F.struct("phase", "weight", "ord", "value", "origin")).alias("m"))
    w = Window.partitionBy("project_id")
    real = F.count_if(F.col("m.phase") < 3).over(w)
    place = F.row_number().over(w.orderBy("m.phase", "m.weight", "m.ord", "label"))
    out = first.withColumn("real", real).where((F.col("m.phase") < 3) | (F.col("real") < least)).withColumn("card", place).where(F.col("card") <= most)
    return out.select("project_id", "card", "label", "m.value", "m.origin")


def is_generic_title(title: Column, generic: tuple[str, ...] = GENERIC_TITLES) -> Column:
    """EVAL-3: no title, one of under four characters, or one that says nothing."""
    low = F.regexp_replace(F.lower(tx.strip(F.coalesce(title, F.lit("")))), ":+$", "")
    return (F.length(low) < 4) | low.isin(*generic)


def acceptance_errors(contracts: DataFrame, items: DataFrame, expected: DataFrame) -> DataFrame:
    """EVAL-3: (project_id, check, wanted), one row for each expectation that a project's record fails.

    ``contracts`` is (project_id, title, parser_mode, completeness, essence), one row a project;
    ``items`` (project_id, kind, name) with the kinds stack, module, team and team_line
    (lines of the team block: they are searched for names but not counted);
    ``expected`` (project_id, parser_mode, title_contains, min_completeness,
    min_modules, min_team, must_have_stack, must_have_modules, must_have_team,
    forbidden_team, reject_generic_title, reject_essence_slide1), where null asks
    for nothing, but for the last two: null is true.  Checks: *missing_contract*, *parser_mode*,
    *generic_title*, *title*, *completeness*, *essence*, *stack*, *module*, *modules_count*, *team*,
    *team_count*, *forbidden_team*.  Words are found inside one name, whatever the case.
    """
    kinds = {"must_have_stack": "stack", "must_have_modules": "module", "must_have_team": "team", "forbidden_team": "team"}
    names = items.select("project_id", F.when(F.col("kind") == "team_line", "team").otherwise(F.col("kind")).alias("kind"), F.lower("name").alias("text")).where("text is not null").distinct()
    asked = None
    for column, kind in kinds.items():
        one = expected.select("project_id", F.explode(column).alias("wanted")).where("wanted is not null").distinct().select("project_id", F.lit(column).alias("column"), F.lit(kind).alias("kind"), "wanted", F.lower("wanted").alias("needle"))
        asked = one if asked is None else asked.unionByName(one)
    # names and words of one kind meet: the key of a search is project and kind
    key = F.concat_ws("\x00", "kind", F.col("project_id").cast("string"))
    found = occurring(names.select(key.alias("project_id"), F.xxhash64("text").alias("file_ord"), "text"), asked.select(key.alias("project_id"), "needle")).select(F.col("project_id").alias("key"), "needle").distinct()
    seen = asked.withColumn("key", key).join(found.withColumn("there", F.lit(True)), ["key", "needle"], "left").withColumn("there", F.coalesce("there", F.lit(False)) | (F.col("needle") == ""))
    forbidden = F.col("column") == "forbidden_team"
    check = F.when(forbidden, "forbidden_team").otherwise(F.col("kind"))
    words = seen.where(F.when(forbidden, F.col("there")).otherwise(~F.col("there"))).select("project_id", check.alias("check"), "wanted")
    n = items.groupBy("project_id").agg(F.count_if(F.col("kind") == "module").alias("n_modules"), F.count_if(F.col("kind") == "team").alias("n_team"))
    c = contracts.select("project_id", "title", F.col("parser_mode").alias("got_mode"), "completeness", "essence", F.lit(True).alias("known"))
    j = expected.join(c, "project_id", "left").join(n, "project_id", "left").fillna(0, ["n_modules", "n_team", "completeness"])
    title = F.lower(F.coalesce("title", F.lit("")))
    dumped = F.startswith(F.lower(tx.strip(F.coalesce("essence", F.lit("")))), F.lit("slide 1"))
    under = lambda got, least: F.when(F.col(got) < F.col(least), F.col(least).cast("string"))
    wrong = (
        ("missing_contract", F.when(F.col("known").isNull(), "")),
        ("parser_mode", F.when((F.col("parser_mode") != "") & F.col("known") & (F.coalesce("got_mode", F.lit("")) != F.col("parser_mode")), F.col("parser_mode"))),
        ("generic_title", F.when(F.coalesce("reject_generic_title", F.lit(True)) & is_generic_title(F.col("title")), "")),
        ("title", F.when((F.size("title_contains") > 0) & ~F.exists("title_contains", lambda p: F.contains(title, F.lower(p))), F.array_join("title_contains", "|"))),
        ("completeness", under("completeness", "min_completeness")),
        ("essence", F.when(F.coalesce("reject_essence_slide1", F.lit(True)) & dumped, "")),
        ("modules_count", under("n_modules", "min_modules")),
        ("team_count", under("n_team", "min_team")),
    )
    rows = j.select("project_id", F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("check"), w.alias("wanted")) for k, w in wrong]), lambda x: x["wanted"].isNotNull())).alias("e"))
    return rows.select("project_id", "e.check", "e.wanted").unionByName(words)


def consistency(states: DataFrame) -> DataFrame:
    """EVAL-4: ``states``, one row a project, with stale and lost_at: the first of ten rules that holds.

    Columns: exists, has_contract, has_page, contract_at, page_at (timestamps), n_team (structured), page_has_team,
    export_has_team, n_sources, has_docx, docx_empty, team_coverage and team_refs (of the evidence, 0 or null: none).
    A page is stale if the contract is newer, or has a team that the page has not.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    team = F.coalesce("n_team", F.lit(0)) > 0
    both = yes("has_contract") & yes("has_page")
    stale = both & (F.coalesce(F.col("contract_at") > F.col("page_at"), F.lit(False)) | (team & ~yes("page_has_team")))
    evidence = F.coalesce(F.col("team_coverage").isin("strong", "weak"), F.lit(False)) | (F.coalesce("team_refs", F.lit(0)) > 0)
    lost = F.when(~yes("exists"), "stale_export_or_wrong_project").when(stale, "stale_generated_landing").when(yes("has_docx") & yes("docx_empty"), "uploaded_docx_but_extraction_missing")
    lost = lost.when(evidence & ~team, "evidence_has_team_but_contract_missing").when(team & yes("has_page") & ~yes("page_has_team"), "contract_has_team_but_landing_missing")
    lost = lost.when(yes("page_has_team") & ~yes("export_has_team"), "landing_has_team_but_export_missing").when(team & ~yes("export_has_team"), "contract_has_team_but_export_missing")
    lost = lost.when((F.col("n_sources") == 1) & ~team, "single_file_no_team_source").when(yes("has_docx") & (F.coalesce("team_coverage", F.lit("missing")) != "strong") & ~team, "uploaded_docx_but_extraction_missing")
    return states.withColumn("stale", stale).withColumn("lost_at", lost.otherwise("OK"))
