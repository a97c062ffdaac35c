"""Which of very many strings occur in which texts of a project.

The strings of a project go into buckets of bounded size, each one automaton in a task;
the texts go into salted ranges of bounded length.  Every range meets every bucket, so no
list grows with the project and a hot project is as many tasks as it needs.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _in_texts(texts: pd.DataFrame, needles: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a text and a string of its project that stands in it, each once."""
    # plain dictionaries: ids of projects may hold any character, and pandas ends a key at a NUL
    strings: dict = {}
    for p, n in zip(needles.project_id, needles.needle, strict=True):
        strings.setdefault(p, []).append(n)
    own: dict = {}
    for p, f, t in zip(texts.project_id, texts.file_ord, texts.text, strict=True):
        own.setdefault(p, []).append((f, t))
    rows = []
    for p in own.keys() & strings.keys():
        automaton = ahocorasick.Automaton()
        for n in strings[p]:
            automaton.add_word(n, n)
        automaton.make_automaton()
        rows += [(p, f, n) for f, t in own[p] for n in {n for _, n in automaton.iter(t)}]
    return pd.DataFrame(rows, columns=["project_id", "file_ord", "needle"])


def occurring(texts: DataFrame, needles: DataFrame, text: str = "text", bucket: int = 20_000, chars: int = 8 << 20) -> DataFrame:
    """(project_id, file_ord, needle): the strings of the project that occur in each text, each pair once.

    ``needles`` is (project_id, needle).  Null and empty strings and texts meet nothing.
    ``bucket`` strings and ``chars`` characters (or one longer text) meet in a group, about;
    projects that are smaller than that share groups, so many of them are few groups.
    """
    kind = {f.name: f.dataType.simpleString() for f in texts.schema}
    n = needles.select(F.col("project_id").cast(kind["project_id"]).alias("project_id"), "needle").where("needle != '' and project_id is not null").distinct()
    t = texts.select("project_id", "file_ord", F.col(text).alias("text")).where("text != ''")
    buckets = n.groupBy("project_id").agg(F.count("*").alias("strings"))
    salts = t.groupBy("project_id").agg(F.sum(F.length("text")).alias("length"))
    both = buckets.join(salts, "project_id").withColumn("one", F.lit(1))
    # one row: how many groups the small projects need
    small = (F.col("strings") <= bucket) & (F.col("length") <= chars)
    slots = both.where(small).groupBy("one").agg((F.ceil(F.sum("strings") / bucket) + F.ceil(F.sum("length") / chars)).alias("slots"))
    hashed = F.xxhash64("project_id")
    slot = F.when(small, F.pmod(hashed, F.coalesce("slots", F.lit(1)))).otherwise(hashed)
    sizes = both.join(F.broadcast(slots), "one", "left").select("project_id", slot.alias("slot"), F.ceil(F.col("strings") / bucket).alias("buckets"), F.ceil(F.col("length") / chars).alias("salts"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    put = n.join(sizes, "project_id").withColumn("bucket", F.pmod(F.xxhash64("needle"), F.col("buckets"))).withColumn("salt", every("salts")).select("project_id", "slot", "bucket", "salt", "needle")
    at = t.join(sizes, "project_id").withColumn("salt", F.pmod(F.xxhash64("file_ord"), F.col("salts"))).withColumn("bucket", every("buckets")).select("project_id", "slot", "bucket", "salt", "file_ord", "text")
    keys = ("slot", "bucket", "salt")
    put = put.select(*[F.col(c).alias(c) for c in put.columns])  # columns of its own, where both sides come from one table
    found = f"project_id {kind['project_id']}, file_ord {kind['file_ord']}, needle string"

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _in_texts(left, right) if len(left) and len(right) else pd.DataFrame([], columns=["project_id", "file_ord", "needle"])

    return at.groupBy(*keys).cogroup(put.groupBy(*keys)).applyInPandas(meet, found).distinct()
