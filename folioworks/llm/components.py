"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star over (a, b) with a > b: every vertex moves to the least id near it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.*").where("a != b").distinct()


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(id, component) for every vertex of ``links`` that is not its component's least id; component is that least id.

    Self links and nulls are ignored.  Each round is written to the shared folder,
    so lineage stays short; rounds grow with the logarithm of the longest path.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()) if (a, b) == ("a", "b") else links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = scratch.save(edges.where("a != b").distinct())
    mark = None
    for _ in range(rounds):
        then = scratch.save(_stars(now))
        scratch.drop(now)
        now = then
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).collect()[0]
        if (seen.n, seen.s) == mark or not seen.n:
            break
        mark = (seen.n, seen.s)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def across(lists: DataFrame, near: DataFrame, scratch: Scratch, member: str = "v") -> DataFrame:
    """Pairs of rows of a list whose members are not connected yet: (left columns l_*, right columns r_*).

    ``near`` is (id, component) of what is connected so far.  Of a list, the members
    of its largest component meet no one of it; every other member meets all members
    of other components.  A list that is connected as a whole goes.
    """
    tagged = lists.join(near.withColumnRenamed("id", member), member, "left").withColumn("component", F.coalesce("component", member))
    tagged = scratch.save(tagged)
    sizes = tagged.groupBy("list", "component").agg(F.count("*").alias("n")).groupBy("list").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("parts"))
    open_lists = scratch.save(tagged.join(sizes.where("parts > 1").drop("parts"), "list"))
    cols = [c for c in open_lists.columns if c not in ("list", "major")]
    left = open_lists.where("component != major").select("list", *[F.col(c).alias(f"l_{c}") for c in cols])
    right = open_lists.select("list", *[F.col(c).alias(f"r_{c}") for c in cols])
    return left.join(right, "list").where("l_component != r_component")


def joined_components(first: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of all links, from the components of the first ones and further links (a, b)."""
    at = lambda name: first.select(F.col("id").alias(name), F.col("component").alias(f"{name}_c"))
    links = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    upper = components(links, scratch)
    top = upper.select(F.col("id").alias("component"), F.col("component").alias("top"))
    known = first.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return known.unionByName(upper.join(first.select("id"), "id", "left_anti"))
