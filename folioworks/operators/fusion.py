"""Several sources into one record (FUS-1 .. FUS-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import text as tx
from folioworks.functions.lexicons import HEADINGS, PARSER_PRIORITY, ROLE_PRIORITY
from folioworks.sources.scratch import written


def _map(m: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[key], F.lit(default))


def field_candidates(rows: DataFrame) -> DataFrame:
    """FUS-1: confidence and priority from parser mode and source role; empty values go."""
    p, r = _map(PARSER_PRIORITY, F.col("parser_mode"), 40), _map(ROLE_PRIORITY, F.col("source_role"), 30)
    base = F.round(F.least(p / 100.0 + 0.3 * r / 100.0, F.lit(1.0)), 3)
    conf = F.when((F.col("field") == "team") & (F.col("source_role") == "primary_project_doc"), 0.98).when((F.col("field") == "modules") & F.col("source_role").isin("module_presentation", "supporting_presentation"), 0.9).otherwise(base)
    return rows.where(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("confidence", conf).withColumn("priority", p + r)


def score_candidates(candidates: DataFrame) -> DataFrame:
    """FUS-2 without its rank: the weighted score of a field."""
    r, p, c = _map(ROLE_PRIORITY, F.col("source_role"), 30) / 100.0, _map(PARSER_PRIORITY, F.col("parser_mode"), 40) / 100.0, F.col("confidence")
    n = F.col("n_items")
    score = (
        F.when(F.col("field").isin("title", "client", "timeline", "lead"), 0.55 * r + 0.25 * p + 0.15 * c + F.col("priority") / 200.0)
        .when(F.col("field") == "team", F.when(F.col("source_role").isin("primary_project_doc", "ready_landing_doc"), 0.95).otherwise(0.4 * c + 0.35 * r + 0.25 * p))
        .when(F.col("field") == "modules", F.when(F.col("source_role").isin("module_presentation", "supporting_presentation"), 0.85 + 0.1 * c).otherwise(0.5 * c + 0.3 * p + 0.2 * r))
        .otherwise(0.45 * c + 0.3 * p + 0.15 * r + F.least(0.02 * n, F.lit(0.15)))
    )
    return candidates.withColumn("score", F.round(score, 6))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """FUS-2: the weighted score of a field, falling, first come first on ties."""
    return score_candidates(candidates).withColumn("rank", F.row_number().over(Window.partitionBy("project_id", "field").orderBy(F.desc("score"), "cand_ord")))


def fuse_single(ranked: DataFrame, generic: tuple[str, ...] = ("project", "проект", "untitled")) -> DataFrame:
    """FUS-3: the first valid candidate, or else the best one."""
    ok = (F.col("source_role") == "primary_project_doc") | (~F.lower(F.trim("value")).isin(*generic) & (F.col("source_role") != "module_presentation"))
    return ranked.groupBy("project_id", "field").agg(F.coalesce(F.min_by("value", F.when(ok, F.col("rank"))), F.min_by("value", "rank")).alias("value"))


def fuse_lists(ranked: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """FUS-5: union in rank order, no headings, eight characters or more, first of each key, capped by field."""
    caps = caps or {"tasks": 10}
    rows = ranked.select("project_id", "field", "rank", F.posexplode(tx.lines_of(F.col("value"))).alias("k", "raw"))
    rows = rows.withColumn("item", tx.normalize_bullet(F.col("raw"))).withColumn("key", tx.text_key(F.col("item")))
    heading = F.col("key").isin(*HEADINGS) | ((F.length("raw") < 25) & F.col("key").endswith(":"))
    rows = rows.where((F.length("item") >= 8) & ~heading)
    first = rows.groupBy("project_id", "field", "key").agg(F.min(F.struct("rank", "k", "item")).alias("m"))
    order = F.row_number().over(Window.partitionBy("project_id", "field").orderBy("m.rank", "m.k", "key"))
    capped = first.withColumn("item_ord", order).where(F.col("item_ord") <= _map(caps, F.col("field"), 8))
    return capped.select("project_id", "field", "item_ord", F.col("m.item").alias("item"))


def fuse_stack(items: DataFrame) -> DataFrame:
    """FUS-6: canonical technologies, each once in a project, in its first category."""
    t = items.withColumn("tech", tx.canonical_tech(F.col("name")))
    once = t.groupBy("project_id", F.lower("tech").alias("key")).agg(F.min(F.struct("cand_ord", "item_ord", "category", "tech")).alias("m"))
    return once.groupBy("project_id", F.col("m.category").alias("category")).agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["tech"]).alias("technologies"))


def fuse_team(members: DataFrame, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """FUS-7: one row per person key: longest name, first role and area, contributions in order."""
    m = members.withColumn("key", tx.person_key(F.col("name"))).where(~tx.text_key(F.col("name")).isin(*forbidden or ("",)))
    some = lambda c: F.min_by(F.col(c), F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col("item_ord")))
    lists = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("item_ord", "contributions"))), lambda x: x["contributions"])))
    return m.groupBy("project_id", "key").agg(F.max_by("name", F.struct(F.length("name"), -F.col("item_ord"))).alias("name"), some("role").alias("role"), some("project_area").alias("project_area"), lists.alias("contributions"))


def fusion_conflicts(candidates: DataFrame) -> DataFrame:
    """FUS-9: single fields with more than one value."""
    single = candidates.where(F.col("field").isin("title", "client", "timeline", "lead", "quote"))
    a = single.groupBy("project_id", "field").agg(F.countDistinct(F.trim("value")).alias("n_values"), F.count("*").alias("n_candidates"))
    return a.where("n_values > 1")


def fusion_decisions(ranked: DataFrame) -> DataFrame:
    """FUS-10: the selected source and those that were not, by field."""
    return ranked.groupBy("project_id", "field").agg(
        F.min_by("source_id", "rank").alias("selected"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("rank") > 1, F.col("source_id")))), ",").alias("rejected"),
        F.round(F.avg("confidence"), 6).alias("confidence"),
    )


def fuse_text(candidates: DataFrame, least: int = 80, most: int = 1500) -> DataFrame:
    """FUS-4: the longest text of ``least`` characters or more, plus up to two new sentences of each other, cut at ``most``.

    ``candidates`` are ranked (rank) or only scored (score, cand_ord): then no project is sorted,
    and of one score and cand_ord a hash of the text decides.  A longest text of ``most`` characters fills
    the result, so sentences are looked for in the other projects alone; there every text is
    shorter than ``most``, and so many sentences as fill the rest are put together.
    """
    rank = F.col("rank") if "rank" in candidates.columns else F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))), "cand_ord", F.xxhash64("value"))
    rows = candidates.select("project_id", "value", F.coalesce(F.length("value"), F.lit(-1)).alias("n"), rank.alias("rank"))
    longest = F.min(F.struct(F.col("n") < least, -F.col("n"), "rank", F.substring("value", 1, most).alias("base"), "n")).alias("m")
    base = written(rows.groupBy("project_id").agg(longest).select("project_id", "m.base", "m.rank", "m.n"), "bases")
    open_ = written(base.where(F.col("n") < most).select("project_id", "base", F.col("rank").alias("own")), "open-bases")
    parts = F.filter(F.transform(F.split("value", r"\. "), tx.strip), lambda x: (F.length(x) > 20) & ~F.contains(F.lower("base"), F.lower(x)))
    more = rows.where(F.col("n") < most).join(open_, "project_id").where(F.col("rank") != F.col("own")).select("project_id", "rank", F.posexplode(parts).alias("k", "s"))
    first = more.groupBy("project_id", tx.text_key(F.col("s")).alias("key")).agg(F.min(F.struct("rank", "k", "s")).alias("m")).select("project_id", "m.*")
    two = first.withColumn("o", F.row_number().over(Window.partitionBy("project_id", "rank").orderBy("k"))).where("o <= 2").drop("o")
    # every sentence has more than 20 characters
    enough = two.withColumn("o", F.row_number().over(Window.partitionBy("project_id").orderBy("rank", "k"))).where(F.col("o") <= most // 21 + 1)
    extra = enough.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]).alias("e"))
    out = base.join(extra, "project_id", "left")
    return out.select("project_id", F.substring(F.concat_ws(" ", "base", F.array_join("e", ". ")), 1, most).alias("value"))


def fuse_modules(modules: DataFrame, generic: tuple[str, ...] = HEADINGS, cap: int = 12) -> DataFrame:
    """FUS-8: by name key, in order; descriptions that say something new are joined, 400 characters at most."""
    key = tx.text_key(F.replace("name", F.lit("Компонент:"), F.lit("")))
    m = modules.withColumn("key", key).where(~F.col("key").isin(*generic) & (F.length("key") >= 4) & ~F.col("key").startswith("slide "))
    g = m.groupBy("project_id", "key").agg(F.min(F.struct("item_ord", "name")).alias("first"), F.array_sort(F.collect_list(F.struct("item_ord", "description"))).alias("d"))
    text = F.aggregate("d", F.lit(""), lambda t, x: F.when(F.contains(t, F.coalesce(x["description"], F.lit(""))), t).otherwise(F.trim(F.concat_ws(" ", t, x["description"]))))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("first.item_ord", "key"))
    return g.withColumn("module_ord", rank).where(F.col("module_ord") <= cap).select("project_id", "module_ord", F.col("first.name").alias("name"), F.substring(text, 1, 400).alias("description"))


def fused_contract(values: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """FUS-11: fused values as one row per project."""
    return values.groupBy("project_id").pivot("field", list(fields)).agg(F.first("value"))
