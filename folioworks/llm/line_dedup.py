"""Fuzzy line dedup with DataFrame functions only.

Lines are normalised once and made distinct; the hashes of a line's different words
stand on a circle, and ``ARCS`` arcs of ``ARC`` words each, from fixed places on, are
keys: lines that agree in an arc (and in their length band) are candidates.  A key is
of so many words that unlike lines share few, and the number of lines does not change
that much.  The bands of the arcs are shifted against each other, so two lines of like
length are in one band for most arcs.  Lines that agree in their first or last
two fifths are candidates too: whatever differs in one place only (a typo, a word
replaced, put in or left out) is found, however few words a line has.  Candidates
are verified by edit similarity, and one occurrence of each connected group of lines
is kept: the first by document id and line number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import across, components, joined_components

ARCS, ARC = 4, 8  # keys of a line, and words of a key
HUBS, MANY = 3, 8  # a list of ``MANY`` lines or more has so many hubs, others one


def normalised(text):
    """Lower case, runs of anything but letters and digits to one blank; line ends stay."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def _end_bands(n, similarity: float):
    """The bands of length whose lists of line ends hold a line: its own and the one below.  A band is as wide as ``similarity`` allows a pair to be."""
    own = F.floor(F.log(n) / F.log(F.lit(1 / similarity)))
    return F.array(own - 1, own)


def _end_keys(norm, n, similarity: float):
    """Hashes of the first and the last characters of a line, for each of its bands; none where no other line is near enough.

    Lines of one pair that differ in one place only share a start and an end that hold
    all but ``gap`` of the shorter one, so one of the two is half of that or more.
    """
    gap = (1 - similarity) / similarity
    # a thousandth less than the bound: the band's lower end is a rounded power
    least = lambda b: F.pow(F.lit(1 / similarity), b) * ((1 - gap) / 2 * 0.999)
    size = lambda b: F.greatest(F.floor(least(b)), F.lit(3)).cast("int")
    key = lambda b: F.array(F.xxhash64(F.lit("start"), b, F.substring(norm, F.lit(1), size(b))), F.xxhash64(F.lit("end"), b, F.right(norm, size(b))))
    return F.when(F.floor(n * (1 - similarity)) >= 1, F.flatten(F.transform(_end_bands(n, similarity), key)))


def _arc_keys(words, n):
    """Hashes of the arcs of a line's sorted word hashes, each with its place and band of length, half again as long each, shifted by a quarter of a band from arc to arc.

    A line of no more words than an arc has all of them as its arc, in two bands
    shifted by half: any pair of like lengths shares one of the two.
    """
    circle = F.concat(words, F.slice(words, 1, ARC))
    band = lambda i: F.floor(F.log(n) / F.log(F.lit(1.5)) + i / ARCS)
    least = lambda i: F.lit(i * ((1 << 64) // ARCS) - (1 << 63))
    arc = lambda i: F.slice(circle, F.size(F.filter(words, lambda x: x < least(i))) + 1 if i else 1, ARC)
    key = lambda i, x: F.xxhash64(F.lit(i), band(i), x)
    return [F.when(F.size(words) > ARC, key(i, arc(i))).otherwise(F.lit(None).cast("long") if i % 2 else key(i, words)) for i in range(ARCS)]


def _hashed(occ: DataFrame, similarity: float) -> DataFrame:
    """Distinct lines as (v, h2, n, times, id, row, pos, e0 .. e3, s0 .. s3), from occurrences (id, row, pos, v, h2, norm).

    Keys of ends and arcs are made where lines are cut from the texts, so no text is
    moved.  Each different word of a line counts once, or the few words that stand in
    every line would decide.
    """
    keys = [f"e{i}" for i in range(4)] + [f"s{i}" for i in range(ARCS)]
    lines = occ.withColumn("n", F.length("norm").cast("int")).withColumn("words", F.sort_array(F.array_distinct(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)))))
    lines = lines.withColumn("ends", _end_keys(F.col("norm"), F.col("n"), similarity))
    made = [*[F.get("ends", F.lit(i)) for i in range(4)], *_arc_keys(F.col("words"), F.col("n"))]
    lines = lines.select("v", "h2", "n", "id", "row", "pos", *[x.alias(k) for x, k in zip(made, keys, strict=True)])
    once = lines.groupBy("v", "h2").agg(F.min(F.struct("id", "row", "pos")).alias("place"), F.count("*").alias("times"), *[F.max(c).alias(c) for c in ("n", *keys)])
    return once.select("v", "h2", "n", "times", "place.*", *keys)


def _lists(hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """(list, v, n, times): lines that share a key with another line; lists of the same lines once."""
    parts = []
    # keys of different arcs, and of starts and ends, are never equal: some at a time, so that the shuffles of few are on disk together
    for some in ([f"s{i}" for i in range(ARCS)], ["e0", "e2"], ["e1", "e3"]):
        keys = hashed.select(F.explode(F.filter(F.array(*some), lambda x: x.isNotNull())).alias("list"), "v", "n", "times")
        # most keys are of one line: they go by a count before anything else moves
        shared = keys.groupBy("list").agg(F.count("*").alias("all")).where("all > 1").select("list")
        parts.append(scratch.save(keys.join(shared, "list")))
    lists = reduce(DataFrame.unionByName, parts)
    named = lists.groupBy("list").agg(F.count("*").alias("all"), F.sum(F.shiftright(F.xxhash64("v"), 20)).alias("sum"), F.bit_xor(F.xxhash64("v", F.lit(3))).alias("name"))
    once = scratch.save(lists.join(named.groupBy("all", "sum", "name").agg(F.min("list").alias("list")).select("list"), "list"))
    scratch.drop(*parts)
    return once


def _pairs(both: DataFrame, x: str, y: str, similarity: float) -> DataFrame:
    """Different pairs (a, b) of the lines ``x``v and ``y``v whose lengths allow the similarity."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    long = F.least(n, m) >= F.greatest(n, m) * similarity
    return both.where((F.col(f"{x}v") != F.col(f"{y}v")) & long).select(F.least(f"{x}v", f"{y}v").alias("a"), F.greatest(f"{x}v", f"{y}v").alias("b")).distinct()


def _hubs(lists: DataFrame) -> DataFrame:
    """(list, hub_v, hub_n): the lines of a list that all others meet.

    The most frequent line is the likeliest original of the others.  Orders are the
    same for all lists, so that lists of like lines have the same hubs.
    """
    found = lists.groupBy("list").agg(
        F.count("*").alias("all"), F.max(F.struct("times", F.xxhash64("v").alias("h"), "v", "n")).alias("m0"),
        *[F.max(F.struct(F.xxhash64("v", F.lit(k)).alias("h"), "v", "n")).alias(f"m{k}") for k in range(1, HUBS)],
    )
    own = [F.struct(F.col(f"m{k}.v").alias("v"), F.col(f"m{k}.n").alias("n")) for k in range(HUBS)]
    hub = F.explode(F.when(F.col("all") < MANY, F.array(own[0])).otherwise(F.array_distinct(F.array(*own)))).alias("hub")
    return found.select("list", hub).select("list", F.col("hub.v").alias("hub_v"), F.col("hub.n").alias("hub_n"))


def _made_once(df: DataFrame, **columns) -> DataFrame:
    """``df`` and further columns; a later filter would make those of a projection again in each place that names them, but not what a generator gives."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _stripped(both: DataFrame) -> DataFrame:
    """x and y without most of the start and end that they share: that leaves their distance as it is."""
    n = F.least(F.length("x"), F.length("y"))
    part = lambda k: F.floor(F.col("least") * k / 8).cast("int")

    def shared(end):
        found = F.lit(0)
        for k in (1, 2, 4, 6, 7):
            found = F.when(end(F.col("x"), part(k)) == end(F.col("y"), part(k)), F.lit(k)).otherwise(found)
        return found

    both = _made_once(_made_once(both, least=n), p=shared(F.left), q=shared(F.right))
    both = _made_once(both, start=part(F.col("p")), ends=part(F.col("p")) + part(F.least("q", 8 - F.col("p"))))
    cut = lambda c: F.substring(c, F.col("start") + 1, F.length(c) - F.col("ends"))
    return _made_once(both.select("a", "b", "most", "start", "ends", F.col("x").alias("u"), F.col("y").alias("w")), x=cut("u"), y=cut("w")).select("a", "b", "most", "x", "y")


def _apart(x, y):
    """The characters of the words that differ where both have as many words: never less than the edit distance; null otherwise."""
    cost = F.zip_with(x, y, lambda a, b: F.when(a == b, 0).otherwise(F.greatest(F.length(a), F.length(b))))
    return F.when(F.size(x) == F.size(y), F.aggregate(cost, F.lit(0), lambda s, c: s + c))


WIDE = 1 << 20


def _texts(lists: DataFrame, occ: DataFrame, hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, norm) of the lines in ``lists``."""
    wanted = lists.select("v").distinct()
    # at most 2^20 rows whatever the input: it only keeps most texts from being moved, an exact join follows
    low = wanted.select(F.pmod("v", F.lit(WIDE)).alias("low")).distinct()
    first = hashed.join(wanted, "v", "left_semi").select("v", "id", "row", "pos")
    some = occ.withColumn("low", F.pmod("v", F.lit(WIDE))).join(F.broadcast(low), "low", "left_semi").select("v", "id", "row", "pos", "norm")
    return scratch.save(some.join(first, ["v", "id", "row", "pos"]).select("v", "norm").dropDuplicates(["v"]))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch, likely: bool) -> DataFrame:
    """The pairs (a, b) with the edit similarity; where most are ``likely`` to have it, low limits are tried first."""
    x = texts.select(F.col("v").alias("a"), F.col("norm").alias("x"))
    y = texts.select(F.col("v").alias("b"), F.col("norm").alias("y"))
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * (1 - similarity)).cast("int")
    both = _stripped(pairs.join(x, "a").join(y, "b").withColumn("most", most))
    # words side by side bound the distance of most copies; time grows with the limit, and most of the others differ by little
    limits = ["most div 4", "most div 2", "most"] if likely else ["most"]
    near = F.expr("CASE WHEN apart <= most THEN true " + " ".join(f"WHEN levenshtein(x, y, {n}) >= 0 THEN true" for n in limits) + " ELSE false END")
    return scratch.save(_made_once(both, apart=_apart(F.split("x", " "), F.split("y", " "))).where(near).select("a", "b"))


def named_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with __id (null ids last) and __row, different for every row: the id where ids are unique and not null; else the rows are written once with numbers."""
    last = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not repeats:
        return docs.withColumn("__id", last).withColumn("__row", last)
    return scratch.save(docs.withColumn("__id", last).withColumn("__row", F.monotonically_increasing_id()))


def mark_lines(rows: DataFrame, scratch: Scratch, text: str = "text", similarity: float = 0.85) -> DataFrame:
    """(__id, __row, gone): the numbers of the lines that go, for each row of ``rows`` that loses any."""
    base = rows.where(F.col(text).isNotNull()).select(F.col("__id").alias("id"), F.col("__row").alias("row"), normalised(F.col(text)).alias("lines"))
    occ = base.select("id", "row", F.posexplode(F.split("lines", "\n")).alias("pos", "norm")).select("id", "row", "pos", F.trim("norm").alias("norm")).where("norm != ''")
    # not written: the lines are most of the input once more, and are cut from it again where they are read
    occ = occ.select("id", "row", "pos", F.xxhash64("norm").alias("v"), F.xxhash64("norm", F.lit(7)).alias("h2"), "norm")
    hashed = scratch.save(_hashed(occ, similarity))
    lists = _lists(hashed, scratch)
    texts = _texts(lists, occ, hashed, scratch)
    tried = scratch.save(_pairs(lists.join(_hubs(lists), "list"), "", "hub_", similarity))
    first = components(_verified(tried, texts, similarity, scratch, likely=True), scratch)
    # what its hubs have not connected meets the rest of its list
    rest = across(lists.select("list", "v", "n"), first, scratch)
    rest = scratch.save(_pairs(rest, "l_", "r_", similarity).join(tried, ["a", "b"], "left_anti"))
    scratch.drop(lists, tried)
    found = joined_components(first, _verified(rest, texts, similarity, scratch, likely=False), scratch)
    scratch.drop(rest, texts)
    # lines that repeat: each of a linked group but the first, and each occurrence beyond the first
    grouped = hashed.join(found.select(F.col("id").alias("v"), "component"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    kept = grouped.groupBy("component").agg(F.min(F.struct("id", "row", "pos")).alias("kept"), F.sum("times").alias("all")).where(F.col("all") > 1).drop("all")
    kept = grouped.select("v", "h2", "component").join(kept, "component").select("v", "h2", "kept")
    gone = occ.select("id", "row", "pos", "v", "h2").join(kept, ["v", "h2"]).where(F.struct("id", "row", "pos") != F.col("kept"))
    return scratch.save(gone.groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__gone")))


def dedup_lines(docs: DataFrame, text: str = "text", similarity: float = 0.85) -> DataFrame:
    """``docs`` with repeated lines cut out of ``text``, and columns n_lines and n_removed (long).

    Every line with a letter or a digit takes part, however short; lines without
    are always kept.  A null text stays null with no lines; an empty one is one
    blank line.  Of exact and fuzzy repeats the occurrence of least (doc_id, line
    number) stays, null ids last.  Rows of one id are documents of their own, one of
    them the first, and so are rows without an id.  Other columns are passed on as
    they are, but n_lines and n_removed, if there are any, are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = named_rows(docs.select(*cols), scratch)
    joined = rows.join(mark_lines(rows, scratch, text, similarity), ["__id", "__row"], "left")
    parts = F.split(text, "\n")
    stays = F.filter(parts, lambda x, i: ~F.array_contains("__gone", i))
    out = joined.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col(text).isNull() | F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"))
    out = out.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(stays, "\n")))
    return out.select(*cols, "n_lines", "n_removed")
