"""People verification (TEAM-1 .. TEAM-9)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions.text import normalize_person, strip
from folioworks.operators.occurrences import occurring
from folioworks.operators.similar import most_similar

# Endings that point to a misread name.
ODD_ENDINGS = ("ец", "св", "енда", "аный")


def name_quality(col: Column) -> Column:
    """TEAM-1: 1 minus the penalties of a name, between 0 and 1."""
    n = strip(col)
    latin, cyr = F.length(F.regexp_replace(n, "[^A-Za-z]", "")), F.length(F.regexp_replace(n, "[^А-Яа-яЁё]", ""))
    parts = F.split(n, r"(?U)\s+")
    odd = F.size(F.filter(parts, lambda p: (F.length(p) > 4) & F.exists(F.array(*[F.lit(e) for e in ODD_ENDINGS]), lambda e: F.endswith(F.lower(p), e))))
    pen = lambda c, x: F.when(c, x).otherwise(0.0)
    score = (
        F.lit(1.0) - pen(F.length(n) < 5, 0.4) - pen(F.length(n) > 80, 0.3) - pen(n.rlike(r"(?U)\d"), 0.5)
        - pen((latin > 0) & (cyr > 0) & (latin / F.greatest(latin + cyr, F.lit(1)) > 0.15), 0.5)
        - pen(~n.rlike(r"^[А-ЯЁ][а-яё-]+(?:\s+[А-ЯЁ][а-яё-]+){1,2}$"), 0.25) - pen(F.size(parts) < 2, 0.2) - 0.15 * odd
        - pen(F.length(F.regexp_replace(n, "[^Il1O0|]", "")) >= 2, 0.3)
        - pen((F.upper(n) == n) & (F.lower(n) != n) & (F.length(n) > 10), 0.1)
    )
    return F.when(n == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def role_quality(role: Column, contributions: Column) -> Column:
    """TEAM-2."""
    return F.when(strip(F.coalesce(role, F.lit(""))) != "", 0.9).when(F.size(contributions) > 0, 0.7).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest matching blocks."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def trusted_roster(given: DataFrame, found: DataFrame) -> DataFrame:
    """TEAM-3: names from lists, then from documents, first seen first, each once."""
    both = given.select("project_id", "name", "item_ord", F.lit(0).alias("src")).unionByName(found.select("project_id", "name", "item_ord", F.lit(1).alias("src")))
    once = both.groupBy("project_id", normalize_person(F.col("name")).alias("key")).agg(F.min(F.struct("src", "item_ord", "name")).alias("m"))
    return once.withColumn("roster_ord", F.row_number().over(Window.partitionBy("project_id").orderBy("m.src", "m.item_ord", "key"))).select("project_id", "roster_ord", F.col("m.name").alias("name"))


def _numbered_letters(col: Column) -> Column:
    """Each character of a name with how often it has stood there so far: two names share as many of these as characters."""
    all_ = F.filter(F.split(col, ""), lambda x: x != "")
    return F.transform(all_, lambda x, i: F.concat(x, F.size(F.filter(F.slice(all_, 1, i + 1), lambda y: y == x)).cast("string")))


def best_name_match(candidates: DataFrame, roster: DataFrame, least: float = 0.75) -> DataFrame:
    """TEAM-4: the most similar roster name of the project, first on ties, and its tier.

    Different names are compared once: equal ones meet by a join, and of the others
    ``similar.most_similar`` reads only pairs whose bounds allow ``least`` and the best ratio so far.
    """
    c = candidates.select("project_id", "name", normalize_person(F.col("name")).alias("a")).distinct().where("a is not null and project_id is not null")
    r = roster.groupBy("project_id", normalize_person(F.col("name")).alias("b")).agg(F.max(F.struct((-F.col("roster_ord")).alias("o"), F.col("name").alias("trusted"))).alias("first"))
    r = r.where("b is not null and project_id is not null")
    own = c.select("project_id", "a").distinct()
    equal = own.join(r.withColumnRenamed("b", "a"), ["project_id", "a"]).select("project_id", "a", F.struct(F.lit(1.0).alias("score"), "first.o", "first.trusted").alias("m"))
    other = own.join(r.select("project_id", F.col("b").alias("a")), ["project_id", "a"], "left_anti")
    near = most_similar(other, r.select("project_id", "b", "first.o"), least).join(r, ["project_id", "b"])
    near = near.groupBy("project_id", "a").agg(F.max(F.struct("score", "first.o", "first.trusted")).alias("m"))
    best = c.join(equal.unionByName(near), ["project_id", "a"]).select("project_id", "name", "m")
    out = candidates.join(best, ["project_id", "name"], "left").withColumn("score", F.col("m.score")).withColumn("trusted", F.col("m.trusted")).drop("m")
    tier = F.when(F.col("score") >= 1, "exact").when(F.round("score", 3) >= 0.88, "strong_fuzzy").when(F.round("score", 3) >= 0.75, "weak_fuzzy").otherwise("no_match")
    return out.withColumn("tier", tier)


def team_metrics(candidates: DataFrame) -> DataFrame:
    """TEAM-7."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return candidates.groupBy("project_id").agg(F.count("*").alias("total"), n("verified"), n("needs_review"), n("rejected"))


def public_team(members: DataFrame, candidates: DataFrame, accepted: DataFrame, mode: str = "safe") -> DataFrame:
    """TEAM-8: manual members, accepted candidates, and in safe mode verified ones of quality 0.5 or more, in draft mode all but rejected; each name once."""
    ok = (F.col("status") == "verified") & (F.col("quality") >= 0.5) if mode == "safe" else F.col("status") != "rejected"
    one = members.select("project_id", "name", "item_ord", F.lit(0).alias("bucket"))
    two = candidates.join(accepted, ["project_id", "candidate_id"], "left_semi").select("project_id", "name", "item_ord", F.lit(1).alias("bucket"))
    three = candidates.where(ok).select("project_id", "name", "item_ord", F.lit(2).alias("bucket"))
    every = one.unionByName(two).unionByName(three)
    first = every.groupBy("project_id", normalize_person(F.col("name")).alias("key")).agg(F.min(F.struct("bucket", "item_ord", "name")).alias("m"))
    return first.select("project_id", F.col("m.name").alias("name"), F.col("m.bucket").alias("bucket"))


def review_summary(candidates: DataFrame) -> DataFrame:
    """TEAM-9: totals of a project and whether its team can be published."""
    a = team_metrics(candidates)
    return a.withColumn("can_publish", (F.col("verified") > 0) & (F.col("needs_review") == 0))


def resolve_sources(candidates: DataFrame, names: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """TEAM-5: where each candidate's name stands: the file of an equal name, files without OCR first, then of the most similar one (0.88 or more), then any text that holds it.

    ``names`` is (project_id, name, file_ord, is_ocr).  ``files`` is (project_id, file_ord, text,
    is_ocr, file_type, location, ocr_engine): names that no list has are looked for in
    its lower-cased texts, the last file without OCR first, else the last one; and
    what it says of the file found comes along.
    """
    index = names.groupBy("project_id", normalize_person(F.col("name")).alias("key")).agg(F.min(F.struct("is_ocr", "file_ord", "name")).alias("m"))
    exact = candidates.withColumn("key", normalize_person(F.col("name"))).join(index, ["project_id", "key"], "left")
    open_ = exact.where("m is null").select("project_id", "name").distinct()
    roster = index.select("project_id", F.col("m.name").alias("name"), F.col("m.file_ord").alias("roster_ord"), "m")
    near = best_name_match(open_, roster.drop("m"), 0.88).where("trusted is not null").select("project_id", "name", normalize_person(F.col("trusted")).alias("near_key"))
    near = near.join(index.select("project_id", F.col("key").alias("near_key"), F.col("m").alias("near")), ["project_id", "near_key"]).select("project_id", "name", "near")
    out = exact.join(near, ["project_id", "name"], "left")
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.is_ocr").alias("is_ocr"), F.col(f"{c}.file_ord").cast("long").alias("file_ord")))
    out = out.withColumn("found", F.coalesce(place("m"), place("near")))
    how = F.when(F.col("m").isNotNull(), "exact").when(F.col("near").isNotNull(), "fuzzy")
    if files is None:
        return out.select("project_id", "name", F.col("found.file_ord").alias("source_file"), F.coalesce("found.is_ocr", F.lit(False)).alias("source_is_ocr"), F.coalesce(how, F.lit("none")).alias("resolved"))
    f = files.withColumn("is_ocr", F.coalesce("is_ocr", F.lit(False)) | (F.coalesce("file_type", F.lit("")) == "ocr"))
    left = out.where("found is null").select("project_id", F.lower("name").alias("needle")).distinct()
    seen = occurring(f.select("project_id", "file_ord", F.lower("text").alias("text")), left).join(f.select("project_id", "file_ord", "is_ocr"), ["project_id", "file_ord"])
    last = seen.groupBy("project_id", "needle").agg(F.max_by(F.struct("is_ocr", F.col("file_ord").cast("long").alias("file_ord")), F.struct(~F.col("is_ocr"), "file_ord")).alias("held"))
    out = out.withColumn("needle", F.lower("name")).join(last, ["project_id", "needle"], "left")
    out = out.withColumn("resolved", F.coalesce(how, F.when(F.col("held").isNotNull(), "text"), F.lit("none"))).withColumn("source_file", F.coalesce("found.file_ord", "held.file_ord")).withColumn("source_is_ocr", F.coalesce("found.is_ocr", "held.is_ocr", F.lit(False)))
    about = f.select("project_id", F.col("file_ord").alias("source_file"), F.when(F.col("is_ocr"), "ocr").otherwise(F.col("file_type")).alias("source_type"), "location", "ocr_engine")
    return out.select("project_id", "name", "source_file", "source_is_ocr", "resolved").join(about, ["project_id", "source_file"], "left").select("project_id", "name", "source_file", "source_is_ocr", "resolved", "source_type", "location", "ocr_engine")


def verify(candidates: DataFrame, reject: float = 0.4, garbage: float = 0.5, strong: float = 0.88, weak: float = 0.75) -> DataFrame:
    """TEAM-6: status and reason of a candidate, first matching rule.

    Columns: quality, mixed_script, source_is_ocr, source_type (empty: unknown),
    match_score, trusted, has_role (a role or contributions).
    """
    q, ocr, known = F.col("quality"), F.col("source_is_ocr"), ~F.coalesce("source_type", F.lit("")).isin("", "ocr")
    m = F.round(F.coalesce("match_score", F.lit(0.0)), 3)
    hit = F.col("trusted").isNotNull()
    rules = (
        (q < reject, "rejected", "name_quality_below_threshold"),
        (F.col("mixed_script") & (q < garbage), "rejected", "mixed_script_noise"),
        (~ocr & known & (q >= 0.5), "verified", "trusted_non_ocr_source"),
        ((m >= strong) & hit, "verified", "ocr_matched_trusted_roster"),
        ((m >= weak) & (m < strong) & hit, "needs_review", "ocr_weak_fuzzy_match"),
        (ocr & (q < 0.6), "rejected", "ocr_low_quality_no_trusted_match"),
        (ocr & ~F.col("has_role"), "needs_review", "ocr_only_no_role_or_contributions"),
        (ocr, "needs_review", "ocr_only_unverified"),
        (F.coalesce("source_type", F.lit("")) == "", "needs_review", "unknown_source_unverified"),
    )
    status, reason = F.lit("probable"), F.lit("unverified_probable")
    for c, s, k in reversed(rules):
        status, reason = F.when(c, s).otherwise(status), F.when(c, k).otherwise(reason)
    out = candidates.withColumn("status", status).withColumn("reason", reason)
    return out.withColumn("corrected_name", F.when((F.col("status") == "verified") & (m >= strong), F.col("trusted")))
