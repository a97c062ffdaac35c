"""Filter interaction audit by min-plus removal ranks: what each filter removes in every order of the filters.

Documents are counted by (part, failure mask, labels) first, at most 2^(filters + 2)
rows a part.  Of a part the masks are a matrix that is 0 where a filter fails and
infinite elsewhere; every order of the filters gives a column of inverse-permutation
positions.  Their min-plus product is the step at which each mask leaves in each
order.  Weighted scatter counts by that step give all figures.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
NEVER = np.iinfo(np.int64).max // 2


def positions(filters: str) -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and (filters, orders) the place of each filter in each order."""
    orders = list(permutations(range(len(filters))))
    place = np.empty((len(filters), len(orders)), dtype=np.int64)
    for k, order in enumerate(orders):
        place[list(order), k] = np.arange(len(filters))
    return ["".join(filters[f] for f in order) for order in orders], place


def removal_ranks(fails: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(masks, orders): the min-plus product of the mask and position matrices; the number of filters where nothing fails."""
    cost = np.where(fails, 0, NEVER)
    rank = np.full((len(fails), place.shape[1]), len(place), dtype=np.int64)
    for f in range(len(place)):
        np.minimum(rank, cost[:, f : f + 1] + place[f], out=rank)
    return rank


def scatter(rank: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
    """(orders, steps + 1): the weights of the masks that leave at each step; the last column stays."""
    out = np.zeros((rank.shape[1], steps + 1), dtype=np.int64)
    np.add.at(out, (np.arange(rank.shape[1])[None, :], rank), weight[:, None])
    return out


def part_figures(cells: pd.DataFrame, filters: str) -> pd.DataFrame:
    """Rows of one part for every order and step; ``cells`` has mask, good, toxic and n."""
    names, place = positions(filters)
    k, n = len(filters), cells.n.to_numpy(dtype=np.int64)
    fails = (cells["mask"].to_numpy(dtype=np.int64)[:, None] >> np.arange(k)) & 1 > 0
    rank = removal_ranks(fails, place)
    gone = scatter(rank, n, k)
    good, toxic = (scatter(rank, np.where(cells[c].to_numpy(dtype=bool), n, 0), k) for c in ("good", "toxic"))
    redundant, unique = np.zeros((len(names), k), dtype=np.int64), np.zeros(k, dtype=np.int64)
    for f in range(k):
        unique[f] = n[fails[:, f] & (fails.sum(axis=1) == 1)].sum()
        earlier = fails[:, f, None] & (rank < place[f])
        redundant[np.arange(len(names)), place[f]] = (earlier * n[:, None]).sum(axis=0)
    order = np.argsort(place, axis=0).T  # (orders, steps): the filter of each step
    shapley = np.zeros(k, dtype=np.int64)
    np.add.at(shapley, order, gone[:, :k])
    rows = {"filter_order": np.repeat(names, k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))}
    rows |= {"kept": (n.sum() - np.cumsum(gone[:, :k], axis=1)).ravel(), "removed": gone[:, :k].ravel(), "redundant": redundant.ravel(), "unique_fails": unique[order].ravel()}
    rows |= {"good_lost": good[:, :k].ravel(), "toxic_lost": toxic[:, :k].ravel(), "shapley": shapley[order].ravel()}
    return pd.DataFrame(rows)


def interactions(counts: DataFrame, filters: str) -> DataFrame:
    """The figures of every (part, order, step) from ``counts``: part, mask (bit f: filter f fails), good, toxic, n.

    One row a distinct (part, mask, good, toxic), so a part is a group of bounded size
    however many documents it has.  At most seven filters: there is a row for every order.
    """
    if not 0 < len(set(filters)) == len(filters) <= 7:
        raise ValueError("one to seven different filter letters")

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        out = part_figures(cells, filters)
        out.insert(0, "part", key[0])
        return out

    return counts.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def count_failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask of the five filters A to E, good, toxic and n over all documents.

    Only digests of texts are shuffled.  Rows are counted by (id, digest) first, so
    repeats are no hot key.  The first id of each digest comes from partial minima, and
    meets the rows by (digest, id): many copies of one text are many keys.
    """
    scratch = Scratch(docs.sparkSession, "filters")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("t"))
    words = F.filter(F.split("t", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    own = own.withColumn("words", words)
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    checks = [n < MIN_WORDS, 100 * different < DISTINCT_PERCENT * n, 100 * upper.cast("long") > UPPER_PERCENT * F.length("t").cast("long"), F.col("t").rlike(SYMBOLS)]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(checks)), F.lit(0))
    rows = own.select("id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), mask.alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = scratch.save(rows)  # texts are read once
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(first, ["digest", "id"], "left").join(marks, "id", "left")
    later = F.col("id").isNotNull() & F.col("first").isNull()
    rows = rows.withColumn("mask", F.col("mask") + F.when(later, 1 << len(checks)).otherwise(0))
    return rows.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters ABCDE and step, zeros included.

    Failures: A under 200 words, B fewer than half of the words distinct, C more than 2 %
    capitals A-Z, D one of ``#$%&*|``, E the same text as a smaller id anywhere in the
    table.  Null and empty texts are one text; null and empty parts are one part.  A row
    without id never fails E, and is the copy of nothing; repeated rows count each,
    and those of the first id are no copies.  An id is good or toxic if any label row
    of it says so.  No documents: no rows.  Other columns are not read.
    """
    return interactions(count_failures(docs, labels, doc_id, text, part), "ABCDE")


assert len(positions("ABCDE")[0]) == factorial(5)

SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
  f AS (SELECT part, doc_id,
      (len(ws) < 200) AS a, (100 * len(list_distinct(ws)) < 50 * len(ws)) AS b, (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)) AS c,
      regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
  l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, [a, b, c, d, e] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
  o AS (SELECT [p, q, r, s, u] AS o FROM range(1, 6) AS _1(p), range(1, 6) AS _2(q), range(1, 6) AS _3(r), range(1, 6) AS _4(s), range(1, 6) AS _5(u) WHERE len(list_distinct([p, q, r, s, u])) = 5),
  x AS (SELECT array_to_string([substr('ABCDE', k::BIGINT, 1) for k in o], '') AS filter_order, step, o[step] AS k, o[1:step - 1] AS earlier FROM o, range(1, 6) AS _s(step)),
  y AS (SELECT part, filter_order, step, k, n, good, toxic, fails[k] AS hit, len([j for j in earlier if fails[j]]) > 0 AS gone, len([v for v in fails if v]) AS many FROM m, x),
  z AS (SELECT part, filter_order, step, k, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
      sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN hit AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
      sum(CASE WHEN hit AND NOT gone THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost FROM y GROUP BY part, filter_order, step, k)
  SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM z"""
