"""One row into many: slides, pages, headings, paragraphs, sections (SEG-1 .. SEG-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.text import lines_of, strip

KEYS = ("project_id", "file_ord")


def _by_header(files: DataFrame, header: str, kind: str) -> DataFrame:
    """Splits before every header line; a text without one is a single part."""
    parts = F.when(F.col("text").rlike("(?im)" + header), F.filter(F.split("text", f"(?im)(?={header})"), lambda x: x.rlike("(?im)" + header))).otherwise(F.array("text"))
    rows = files.where(strip(F.col("text")) != "").select(*KEYS, F.posexplode(parts).alias("k", "body"))
    index = F.regexp_extract("body", r"(?i)^\s*[^\d\n]*?(\d+)\s*:", 1)
    return rows.select(*KEYS, F.lit(kind).alias("location_type"), F.when(index != "", index.cast("int")).otherwise(F.col("k") + 1).alias("location_index"), strip(F.col("body")).alias("text"))


def split_slides(files: DataFrame) -> DataFrame:
    """SEG-1: parts from ``Slide N:`` headers, with the first line behind the header of more than 3 characters as label."""
    out = _by_header(files, r"^[ \t]*Slide\s+\d+\s*:", "slide")
    body = F.transform(lines_of(F.regexp_replace("text", r"(?i)^\s*Slide\s+\d+\s*:", "")), strip)
    return out.withColumn("location_label", F.get(F.filter(body, lambda x: F.length(x) > 3), 0))


def split_pages(files: DataFrame) -> DataFrame:
    """SEG-2."""
    return _by_header(files, r"^[ \t]*(?:Page|Страница)\s+\d+\s*:", "page")


def split_headings(files: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """SEG-3: a line that begins with #, is in capitals and below 80 characters, or is a known header opens a section."""
    rows = files.select(*KEYS, F.posexplode(lines_of(F.col("text"))).alias("k", "line")).withColumn("line", strip(F.col("line")))
    caps = F.col("line").rlike(r"(?U)\p{L}") & (F.upper("line") == F.col("line")) & (F.length("line") < 80)
    head = F.col("line").startswith("#") | caps | F.lower("line").isin(*known or ("",)) & (F.col("line") != "")
    order = Window.partitionBy(*KEYS).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(order))
    part = F.array_sort(F.collect_list(F.when((F.col("line") != "") & ~F.col("head"), F.struct("k", "line"))))
    out = marked.groupBy(*KEYS, "section").agg(F.max(F.when(F.col("head"), F.regexp_replace("line", r"^#+\s*", ""))).alias("title"), part.alias("p"))
    return out.where((F.size("p") > 0) | F.col("title").isNotNull()).select(*KEYS, F.col("section").alias("location_index"), "title", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"))


def split_paragraphs(files: DataFrame) -> DataFrame:
    """SEG-4: blank-line blocks; of one block over 400 characters the lines over 40; blocks below 15 go; else the whole text."""
    text = F.col("text")
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")
    rows = F.filter(F.transform(lines_of(text), strip), lambda x: F.length(x) > 40)
    parts = F.when((F.size(blocks) <= 1) & (F.length(text) > 400), rows).otherwise(blocks)
    numbered = F.filter(F.transform(parts, lambda x, i: F.struct((i + 1).alias("location_index"), x.alias("text"))), lambda x: F.length(x["text"]) >= 15)
    whole = F.array(F.struct(F.lit(1).alias("location_index"), text.alias("text")))
    out = files.where(strip(text) != "").select(*KEYS, F.explode(F.when(F.size(numbered) > 0, numbered).otherwise(whole)).alias("b"))
    return out.select(*KEYS, F.lit("paragraph").alias("location_type"), "b.location_index", "b.text")


def segment(files: DataFrame) -> DataFrame:
    """SEG-5: each file by its type and by the headers in its text."""
    kind, text = F.lower("file_type"), F.col("text")
    slide = kind.isin("vlm", "ocr", "pptx") | text.rlike(r"(?im)^[ \t]*Slide\s+\d+\s*:")
    page = (kind == "pdf") | text.rlike(r"(?im)^[ \t]*(?:Page|Страница)\s+\d+\s*:")
    f = files.withColumn("route", F.when(slide, "slide").when(page, "page").when(kind.isin("docx", "doc"), "heading").otherwise("paragraph"))
    cols = [*KEYS, "location_type", "location_index", "text"]
    heads = split_headings(f.where("route = 'heading'")).withColumn("location_type", F.lit("section"))
    parts = [split_slides(f.where("route = 'slide'")), split_pages(f.where("route = 'page'")), heads, split_paragraphs(f.where("route = 'paragraph'"))]
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*[F.col(c).cast("int") if c == "location_index" else F.col(c) for c in cols]))
    return out


def split_known_sections(files: DataFrame, titles: dict[str, str]) -> DataFrame:
    """SEG-6: text between known header lines; ``titles`` maps a header (lower case) to a key; repeats are joined."""
    lexicon = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    rows = files.select(*KEYS, F.posexplode(lines_of(F.col("text"))).alias("k", "line")).withColumn("line", strip(F.col("line")))
    key = lexicon[F.regexp_replace(F.lower("line"), r"(?U)^[#\s]+|[\s:.]+$", "")]
    order = Window.partitionBy(*KEYS).orderBy("k")
    filled = rows.withColumn("own", key).withColumn("key", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = filled.where(F.col("key").isNotNull() & F.col("own").isNull() & (F.col("line") != ""))
    return body.groupBy(*KEYS, "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def parse_stack(sections: DataFrame) -> DataFrame:
    """SEG-10: category lines end with a colon; bullets below fall into the category, each once, in order."""
    rows = sections.select(*KEYS, F.posexplode(lines_of(F.col("text"))).alias("k", "line")).withColumn("line", strip(F.col("line"))).where("line != ''")
    is_cat = F.col("line").endswith(":") & ~F.col("line").rlike(r"^[-*•–]")
    order = Window.partitionBy(*KEYS).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("category", F.last(F.when(is_cat, F.regexp_replace("line", ":+$", "")), ignorenulls=True).over(order)).where(~is_cat)
    item = F.regexp_replace("line", r"^[-*•–]\s*", "")
    once = filled.groupBy(*KEYS, F.coalesce("category", F.lit("Other")).alias("category"), item.alias("item")).agg(F.min("k").alias("k"))
    return once.groupBy(*KEYS, "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("items"))


def classify_by_rules(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """SEG-12: the first rule whose pattern occurs; rules are (label, pattern)."""
    out = None
    for label, pattern in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(default)
