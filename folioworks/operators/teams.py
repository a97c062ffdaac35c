"""Team sections of texts: blocks of persons, attempts at names with reasons, and repair of noisy text (SEG-11, EVD-4, EVD-5, TXT-3, TXT-4, EVD-19).

The block grammar looks ahead and back over the lines of one text, so it is a small
Arrow helper.  All other rules are Column expressions over the array of lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import team_words as tw
from folioworks.functions.text import clean_ocr_text, let, lines_of, strip
from folioworks.operators.classify import candidate_reason, person_name_ok, role_ok, team_context
from folioworks.operators.people import _numbered_letters, sequence_ratio
from folioworks.operators.segment import split_slides

LINK = r"\s+https?://\S+"


@dataclass(frozen=True)
class Grammar:
    """What is a name; plain Python, for one text in a task."""

    form: str = tw.NAME_FORM
    stop: tuple[str, ...] = tw.NO_NAME

    def is_name(self, text: str) -> bool:
        """The rule of ``classify.person_name_ok``."""
        n = re.sub(r"^\d+\.\s+", "", re.sub(r"\s*\([^)]+\)\s*$", "", re.sub(LINK, "", text.strip())))
        n = n.split(" — " if " — " in n else " - ")[0].strip()
        words = n.lower().split()
        return len(words) in (2, 3) and words[0] not in tw.PREPOSITIONS and bool(re.match(self.form, n)) and not set(words) & set(self.stop)

    def person(self, text: str, with_alias: bool = True) -> tuple[str, str] | None:
        """Name and alias of one person, or None."""
        name, alias = re.sub(LINK, "", text).strip(), ""
        found = re.search(r"\s*\(([^)]+)\)\s*$", name) if with_alias else None
        if found:
            name, alias = name[: found.start()].strip(), found[1].strip()
        return (name, alias) if self.is_name(name) else None

    def header(self, line: str) -> tuple[list[tuple[str, str]], str]:
        """The persons that a line names, and what it says behind a dash."""
        payload = re.sub(r"^\d+\.\s+", "", line).strip()
        dash = re.match(r"^(.+?)\s*[—–-]\s*(.+)$", payload)
        role = dash[2].strip() if dash else ""
        listed = re.sub(tw.GROUP_PREFIX, "", payload, flags=re.I).strip()
        persons = []
        if listed and not any(m in listed.lower() for m in tw.NO_GROUP):
            dash = re.match(r"^(.+?)\s*[—–-]\s*(.+)$", listed)
            parts = [p.strip() for p in (dash[1] if dash else listed).split(",") if p.strip()]
            persons = [x for k, p in enumerate(parts) if (x := self.person(p, k == len(parts) - 1))]
        if not persons and (x := self.person(line)):
            persons = [x]
        return persons, role


def team_blocks(text: str, grammar: Grammar) -> list[tuple]:
    """(block, header, [(name, alias)], role, [contribution]) of every block of a text, in order.

    A header with names opens a block.  The role stands behind its dash or is the next
    line that is no list item; list items, long lines and what follows them are
    contributions, up to a numbered line or the end of the section.  As many lines as
    there are contributions are used up: the next header is looked for behind them.
    """
    lines, out, at = [x.strip() for x in text.splitlines()], [], 0
    numbered = lambda x: re.match(r"\d+\.\s+", x)
    item = lambda x: re.match(r"(?:[-•*·]|–)\s+(.+)$", x)
    hinted = lambda x: "," in x or any(h in x.lower() for h in tw.ROLE_HINTS)
    while at < len(lines):
        header = lines[at]
        at += 1
        if not header or header.lower() in tw.PLAIN_HEADERS + tw.SECTION_ENDS:
            continue
        persons, inline = grammar.header(header)
        if not persons:
            continue
        while at < len(lines) and lines[at].startswith("http"):
            at += 1
        role = inline if len(persons) == 1 else ""
        if not role:
            for k in range(at, len(lines)):
                line = lines[k]
                if not line or line.startswith("http"):
                    continue
                if item(line) or numbered(line) or grammar.is_name(re.sub(LINK, "", line)):
                    break
                if len(line) < 120 or len(line) == 120 and hinted(line):
                    role, at = line, k + 1
                    break
        found, used = [], []  # contributions, and the places behind their lines
        for k in range(at, len(lines)):
            line = lines[k]
            if numbered(line) or line.lower() in tw.SECTION_ENDS:
                break
            if not line or line.startswith("http"):
                continue
            used.append(k + 1)
            named = grammar.is_name(re.sub(LINK, "", line))
            if mark := item(line):
                found.append(mark[1].strip())
            elif named and not found:
                break
            elif line.endswith(";") or len(line) > 40:
                found += [p.strip() for p in line.split(";") if p.strip()]
            elif found or not hinted(line):
                found.append(line)
        number = re.match(r"(\d+)\.", header)
        out.append((int(number[1]) if number and len(number[1]) < 10 else len(out) + 1, header, persons, role, found))
        if found and used:
            at = used[min(len(found), len(used)) - 1]
    return out


BLOCK = "array<struct<block:int,header:string,persons:array<struct<name:string,alias:string>>,role:string,contributions:array<string>>>"


def blocks_of(text: Column, grammar: Grammar) -> Column:
    @F.pandas_udf(BLOCK)
    def run(texts: pd.Series) -> pd.Series:
        as_row = lambda b: {"block": b[0], "header": b[1], "persons": [{"name": n, "alias": a} for n, a in b[2]], "role": b[3], "contributions": b[4]}
        return pd.Series([[as_row(b) for b in team_blocks(t or "", grammar)] for t in texts])

    return run(text)


def block_members(files: DataFrame, grammar: Grammar = Grammar(), text: str = "text") -> DataFrame:  # noqa: B008
    """SEG-11: one row per person of every block: project_id, file_ord, block, member_ord, name, role, area, contributions; null and empty texts have none."""
    b = files.select("project_id", "file_ord", F.posexplode(blocks_of(F.col(text), grammar)).alias("block_ord", "b"))
    b = b.select("project_id", "file_ord", "block_ord", "b", F.posexplode("b.persons").alias("at", "p"))
    order = F.struct("block_ord", "at")
    return b.select("project_id", "file_ord", "b.block", order.alias("member_ord"), "p.name", "b.role", F.col("p.alias").alias("area"), "b.contributions")


def parse_team_blocks(files: DataFrame, grammar: Grammar = Grammar(), text: str = "text") -> DataFrame:  # noqa: B008
    """SEG-11: one row per person of a file, with member_ord.  Names that differ in case only are one person.

    Of several mentions the first non-empty role and area count, and all contributions,
    each once.
    """
    m = block_members(files, grammar, text)
    some = lambda c: F.min_by(c, "member_ord").alias(c) if c == "name" else F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("member_ord"))), F.lit("")).alias(c)
    once = m.groupBy("project_id", "file_ord", F.lower("name").alias("key")).agg(
        *[some(c) for c in ("name", "role", "area")], F.min("member_ord").alias("member_ord"), F.count("*").alias("mentions"), F.array_sort(F.collect_list(F.struct("member_ord", "contributions"))).alias("all")
    )
    every = F.flatten(F.col("all.contributions"))
    return once.withColumn("contributions", F.when(F.col("mentions") > 1, F.array_distinct(every)).otherwise(every)).drop("key", "all")


def text_marks(text: Column, marks: tuple[str, ...] = tw.TEXT_MARKS) -> Column:
    """The team marks of a text; none where it speaks of another's team."""
    low = F.lower(F.translate(F.coalesce(text, F.lit("")), " ", " "))
    has = lambda ws: F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w))
    return F.when(F.size(has(tw.FALSE_MARKS)) > 0, F.array().cast("array<string>")).otherwise(has(marks))


def canonical_roles(values: DataFrame, role: str = "role", roles: dict[str, str] = tw.ROLES, least: float = 0.72) -> DataFrame:
    """TXT-4: (role, canonical) of every different value.

    The longest known role that holds the value or is held by it wins; else the most
    similar one of ``least`` or more, the first on ties; else the value stays, without
    its last punctuation.  Similarity is only worked out where the letters that two
    words share allow ``least``.
    """
    v = values.select(F.col(role).alias("role")).where("role is not null").distinct().withColumn("value", F.regexp_replace(strip(F.col("role")), "[:;.]+$", ""))
    low = F.lower("value")
    longest = sorted(roles, key=len, reverse=True)
    held = F.coalesce(*[F.when(F.contains(low, F.lit(r)) | F.contains(F.lit(r), low), F.lit(roles[r])) for r in longest])
    v = v.withColumn("held", F.when(F.col("value") == "", "").otherwise(held))
    known = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(r).alias("known"), F.lit(to).alias("to")) for k, (r, to) in enumerate(roles.items())]))
    pairs = v.where("held is null").select("role", low.alias("a"), known.alias("k")).select("role", "a", F.col("k.known").alias("b"), "k.place", "k.to")
    la, lb = F.length("a"), F.length("b")
    pairs = pairs.where(2.0 * F.least(la, lb) / (la + lb) >= least)
    pairs = pairs.where(2.0 * F.size(F.array_intersect(_numbered_letters(F.col("a")), _numbered_letters(F.col("b")))) / (la + lb) >= least)
    near = pairs.withColumn("score", sequence_ratio("a", "b")).where(F.col("score") >= least).groupBy("role").agg(F.max_by("to", F.struct("score", -F.col("place"))).alias("near"))
    return v.join(near, "role", "left").select("role", F.coalesce("held", "near", "value").alias("canonical"))


def normalize_role(df: DataFrame, role: str = "role", roles: dict[str, str] = tw.ROLES, least: float = 0.72) -> DataFrame:
    """TXT-4: ``df`` with the column ``canonical``; a null role is empty."""
    known = canonical_roles(df, role, roles, least).withColumnRenamed("role", "__role")
    return df.join(known, F.col(role) == F.col("__role"), "left").drop("__role").withColumn("canonical", F.coalesce("canonical", F.lit("")))


def repaired_lines(text: Column) -> Column:
    """TXT-3 without its roles: the lines of a noisy text, signs removed, quotes unified, glued words taken apart, no empty ones."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, tw.NOISE, " "), tw.QUOTES, '"')
    t = F.regexp_replace(t, r"(?Um)^\s*[-•●▪◦·]\s+", "- ")
    for found, put in tw.GLUED:
        t = F.regexp_replace(t, "(?iUu)" + found, put)
    return F.filter(F.transform(lines_of(t), lambda x: F.regexp_replace(strip(x), "[ \t]{2,}", " ")), lambda x: x != "")


DASHED = r"(?dU)^(.+?)\s*[—–-]\s*(.+)$"


def normalize_team_text(files: DataFrame, text: str = "text", roles: dict[str, str] = tw.ROLES) -> DataFrame:
    """TXT-3: ``files`` with the column ``normal``: repaired lines, and `name — role` with the known form of each role.

    Roles are looked up once per different value (TXT-4); a text's lines come together
    again by file.  A null text is an empty one.
    """
    lines = files.select("project_id", "file_ord", F.posexplode(repaired_lines(F.col(text))).alias("line_ord", "line"))
    head, role = F.regexp_extract("line", DASHED, 1), F.regexp_extract("line", DASHED, 2)
    lines = lines.withColumn("head", strip(head)).withColumn("said", F.when(F.col("line").rlike(DASHED), strip(role)))
    known = canonical_roles(lines.where("said is not null"), "said", roles)
    lines = lines.join(known, F.col("said") == F.col("role"), "left")
    line = F.when(F.col("said").isNull(), F.col("line")).otherwise(F.concat("head", F.lit(" — "), F.coalesce("canonical", F.lit(""))))
    back = lines.groupBy("project_id", "file_ord").agg(F.array_sort(F.collect_list(F.struct("line_ord", line.alias("t")))).alias("l"))
    back = back.select("project_id", "file_ord", strip(F.array_join("l.t", "\n")).alias("normal"))
    return files.join(back, ["project_id", "file_ord"], "left").withColumn("normal", F.coalesce("normal", F.lit("")))


def merge_ocr_blocks(blocks: DataFrame, text: str = "text") -> DataFrame:
    """TXT-2: (project_id, file_ord, text): the cleaned blocks of a file in the order of block_ord, a blank line between; a text with marks of a team is repaired (TXT-3).

    Null and blank blocks go; a file of such blocks alone gives no row.
    """
    some = blocks.select("project_id", "file_ord", "block_ord", clean_ocr_text(F.col(text)).alias("t")).where("t != ''")
    merged = some.groupBy("project_id", "file_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "t"))), lambda x: x["t"]), "\n\n").alias("text"))
    noisy = F.exists(F.array(*[F.lit(w) for w in tw.NOISY_MARKS]), lambda w: F.contains(F.lower("text"), w))
    repaired = normalize_team_text(merged.where(noisy)).select("project_id", "file_ord", F.col("normal").alias("text"))
    return merged.where(~noisy).unionByName(repaired)


TRY = "array<struct<rule:string,name:string,role:string>>"


def _try(rule: str, name: Column, role: Column) -> Column:
    return F.array(F.struct(F.lit(rule).alias("rule"), name.alias("name"), role.alias("role")))


def _line_tries(line: Column, context: Column, noisy: bool, grammar: Grammar, words: tuple[str, ...]) -> Column:
    """The attempts at names of one line, by the first rule that fits it."""
    none = F.array().cast(TRY)
    group = lambda p, k: strip(F.regexp_extract(line, p, k))
    clean = strip(F.regexp_replace(line, "(?U)" + LINK, "")) if not noisy else line
    number = r"(?U)^\d+\.\s+(.+)$"
    payload = F.when(clean.rlike(number), strip(F.regexp_extract(clean, number, 1))).otherwise(clean)
    name_ok = lambda c: person_name_ok(c, grammar.form, grammar.stop)
    dashed = payload.rlike(DASHED)
    head = F.when(dashed, strip(F.regexp_extract(payload, DASHED, 1))).otherwise(payload)
    tail = F.when(dashed, strip(F.regexp_extract(payload, DASHED, 2))).otherwise("")
    own = F.regexp_replace(clean, r"^.*$", "")  # an empty role
    said = tail if noisy else F.when(context | role_ok(tail, words, grammar.form, grammar.stop), tail).otherwise("")
    part = lambda p: strip(F.regexp_replace(F.regexp_replace(strip(p), r"(?U)\s*\([^)]+\)\s*$", ""), "(?U)" + LINK, ""))
    listed = lambda role: F.flatten(F.transform(F.split(head, ","), lambda p: let(part(p), lambda n: F.when(name_ok(n), _try("list", n, role)).otherwise(none))))
    low = F.lower(line)
    role_line = "(?iUu)" + tw.ROLE_LINE
    by_role = _try("role_line", group(role_line, 2), group(role_line, 1))
    if noisy:
        skip = (line == "") | low.isin(*tw.PLAIN_HEADERS) | F.exists(F.array(*[F.lit(w) for w in tw.NOISY_NO_PERSON]), lambda w: F.contains(low, w))
        return F.when(skip, none).when(line.rlike(role_line), by_role).when(dashed, _try("dash", head, tail)).when(F.contains(payload, F.lit(",")), listed(own)).when(name_ok(payload), _try("name", payload, own)).otherwise(none)
    skip = (line == "") | F.exists(F.array(*[F.lit(w) for w in tw.SKIPPED_STARTS]), lambda w: F.startswith(low, w))
    cells = r"(?dU)^(.+?)\s*\|\s*(.+?)(?:\s*\|\s*(.+))?$"
    table = F.when(name_ok(group(cells, 1)), _try("table", group(cells, 1), F.coalesce(F.nullif(group(cells, 2), F.lit("")), group(cells, 3)))).otherwise(none)
    return F.when(skip, none).when(context & line.rlike(cells), table).when(line.rlike(role_line), by_role).when(F.contains(head, F.lit(",")), listed(said)).when(name_ok(head), _try("name", head, said)).otherwise(none)


def explain_people(files: DataFrame, grammar: Grammar = Grammar(), words: tuple[str, ...] = tw.ROLE_MARKERS, text: str = "text", roles: dict[str, str] = tw.ROLES) -> DataFrame:  # noqa: B008
    """EVD-5: every attempt at a name, with its reason.

    Columns: project_id, file_ord, grammar (0 noisy text, 1 blocks, 2 lines), try_ord,
    rule, name, role, area, contributions, reason, accepted.  ``files`` may say section and
    in_team_section.  The noisy and the block grammar are tried where the context
    and the marks of a team stand; lines are tried in every text.  Lines that fit no rule
    give no row.
    """
    section = F.col("section") if "section" in files.columns else F.lit("")
    within = F.coalesce(F.col("in_team_section"), F.lit(False)) if "in_team_section" in files.columns else F.lit(False)
    f = files.select("project_id", "file_ord", F.coalesce(text, F.lit("")).alias("text"), section.alias("section"), within.alias("within"))
    marked = F.size(text_marks(F.col("text"))) > 0
    f = f.withColumn("marked", marked).withColumn("context", F.col("within") | team_context(F.col("section"), F.col("text")) | F.col("marked"))
    noisy = F.exists(F.array(*[F.lit(w) for w in tw.NOISY_MARKS]), lambda w: F.contains(F.lower("text"), w))
    # only texts with the marks of a team are repaired and read twice
    repaired = normalize_team_text(f.where(F.col("context") & noisy), roles=roles)
    no = F.array().cast("array<string>")

    def lines_tried(df: DataFrame, number: int, body: str, tries) -> DataFrame:
        own = df.withColumn("lines", F.transform(lines_of(F.col(body)), strip))
        own = own.select("project_id", "file_ord", "context", F.slice("lines", 1, 6).alias("first_lines"), F.posexplode(tries(F.col("lines"), F.col(body))).alias("at", "x"))
        name = strip(F.regexp_replace(strip(F.col("x.name")), "(?U)" + LINK, ""))
        return own.select("project_id", "file_ord", F.lit(number).alias("grammar"), F.struct(F.lit(1 if number == 0 else 0).alias("part"), "at", F.lit(0).alias("person")).alias("try_ord"), "x.rule", name.alias("name"), "x.role", F.lit("").alias("area"), no.alias("contributions"), F.col("context").alias("in_team_context"), "first_lines").where("name != ''")

    def blocks_tried(df: DataFrame, number: int, body: str) -> DataFrame:
        m = block_members(df, grammar, body)
        return m.select("project_id", "file_ord", F.lit(number).alias("grammar"), F.struct(F.lit(0).alias("part"), F.col("member_ord.block_ord").alias("at"), F.col("member_ord.at").alias("person")).alias("try_ord"), F.lit("block").alias("rule"), "name", "role", "area", "contributions", F.lit(True).alias("in_team_context"), no.alias("first_lines"))

    def plain(lines: Column, body: Column) -> Column:
        named = lambda p, role: F.transform(F.regexp_extract_all(body, F.lit("(?diUu)" + p), 1), lambda n: F.struct(F.lit("sentence").alias("rule"), n.alias("name"), F.lit(role).alias("role")))
        return F.concat(named(tw.LEAD, tw.LEAD_ROLE), named(tw.ASSISTANT, tw.ASSISTANT_ROLE), F.flatten(F.transform(lines, lambda x: _line_tries(x, F.col("context"), False, grammar, words))))

    def rough(lines: Column, body: Column) -> Column:
        return F.flatten(F.transform(lines, lambda x: _line_tries(x, F.lit(True), True, grammar, words)))

    zero = lines_tried(repaired, 0, "normal", rough).unionByName(blocks_tried(repaired, 0, "normal"))
    zero = normalize_role(zero, "role", roles).withColumn("role", F.col("canonical")).drop("canonical").withColumn("area", F.lit("")).withColumn("contributions", no)
    tried = zero.unionByName(blocks_tried(f.where("context and marked"), 1, "text")).unionByName(lines_tried(f, 2, "text", plain))
    return candidate_reason(tried, grammar.form, words, grammar.stop).drop("first_lines", "in_team_context")


def extract_people(files: DataFrame, grammar: Grammar = Grammar(), words: tuple[str, ...] = tw.ROLE_MARKERS, text: str = "text", roles: dict[str, str] = tw.ROLES, tried: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """EVD-4: the persons of each file: accepted attempts of its first grammar that has any; names that differ in case only are one.

    The first attempt at a name counts; in blocks the first non-empty role and area, and
    all contributions of the name.  ``tried`` takes the rows of ``explain_people`` where they are there already.
    """
    a = (explain_people(files, grammar, words, text, roles) if tried is None else tried).where("accepted")
    filled = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("try_ord"))), F.lit(""))
    once = a.groupBy("project_id", "file_ord", "grammar", F.lower("name").alias("key")).agg(
        F.min_by("name", "try_ord").alias("name"), F.when(F.col("grammar") == 1, filled("role")).otherwise(F.min_by("role", "try_ord")).alias("role"), filled("area").alias("area"),
        F.array_sort(F.collect_list(F.struct("try_ord", "contributions"))).alias("all"), F.min("try_ord").alias("try_ord"), F.count("*").alias("mentions"),
    )
    every = F.flatten(F.col("all.contributions"))
    once = once.withColumn("contributions", F.when(F.col("mentions") > 1, F.array_distinct(every)).otherwise(every)).drop("all", "mentions", "key")
    by = Window.partitionBy("project_id", "file_ord")
    best = once.withColumn("first", F.min("grammar").over(by)).where("grammar = first").drop("first")
    return best.withColumn("member_ord", F.row_number().over(by.orderBy("try_ord"))).drop("try_ord")


def team_text_audit(files: DataFrame, grammar: Grammar = Grammar(), words: tuple[str, ...] = tw.ROLE_MARKERS) -> DataFrame:  # noqa: B008
    """EVD-19: one finding per presentation about its team, and whether its project lacks OCR.

    Columns: project_id, file_ord, markers, people, team_slides, low_slides, slides, status,
    reason, ocr_missing (any presentation of the project has a warning).  Counts of files
    and flags of projects come from one grouped pass.
    """
    f = files.select("project_id", "file_ord", "file_type", strip(F.coalesce("text", F.lit(""))).alias("text"))
    marks = text_marks(F.col("text"))
    low = F.lower("text")
    doc = F.col("file_type").isin("docx", "txt") & (F.contains(low, F.lit(tw.SLIDE_MARKS[0])) | F.contains(low, F.lit(tw.SLIDE_MARKS[1])))
    decks = f.where("file_type = 'pptx'").withColumn("in_team_section", F.size(marks) > 0)
    named = extract_people(decks, grammar, words).select("project_id", "file_ord", F.lit(1).alias("people"))
    slide = split_slides(decks.select("project_id", "file_ord", "text"))
    title = F.get(F.filter(F.transform(F.slice(lines_of(F.col("text")), 2, 1 << 30), strip), lambda x: (F.length(x) > 4) & ~F.lower(x).isin("проект:", "проект") & ~F.startswith(F.lower(x), F.lit("сроки"))), F.lit(0))
    head = F.concat_ws("\n", F.substring(F.coalesce(title, F.lit("")), 1, 120), F.substring("text", 1, 200))
    slide = slide.select("project_id", "file_ord", (F.size(text_marks(head, tw.SLIDE_MARKS)) > 0).cast("int").alias("team_slides"), (F.length("text") < 80).cast("int").alias("low_slides"), F.lit(1).alias("slides"))
    own = f.select("project_id", "file_ord", F.size(marks).alias("markers"), doc.cast("int").alias("doc"), (F.col("file_type") == "pptx").cast("int").alias("deck"), (F.col("text") == "").cast("int").alias("empty"))
    counts = ["markers", "doc", "deck", "empty", "people", "team_slides", "low_slides", "slides"]
    rows = own.unionByName(named, allowMissingColumns=True).unionByName(slide, allowMissingColumns=True)
    both = rows.groupingSets([["project_id", "file_ord"], ["project_id"]], "project_id", "file_ord").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.grouping("file_ord").alias("whole"))
    team_doc = both.where("whole = 1").select("project_id", (F.col("doc") > 0).alias("team_doc"))
    d = both.where("whole = 0 and deck > 0").join(team_doc, "project_id")
    spoken = (F.col("markers") > 0) | (F.col("team_slides") > 0)
    nobody = F.col("people") == 0
    # The findings.
    reason = (
        F.when(F.col("empty") > 0, "empty_pptx_text").when(spoken & nobody, "pptx_team_text_missing").when(spoken, "pptx_team_text_found").when(nobody & ~F.col("team_doc"), "pptx_team_text_missing")
        .when(nobody & (F.col("low_slides") >= F.greatest(F.lit(1), F.floor(F.col("slides") / 2))), "possible_image_only_team_slide").otherwise("none")
    )
    d = d.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isin("none", "pptx_team_text_found"), "ok").otherwise("warning"))
    lacking = d.groupBy("project_id").agg(F.max(F.col("status") == "warning").alias("ocr_missing"))
    return d.join(lacking, "project_id").select("project_id", "file_ord", *[F.col(c).cast("long").alias(c) for c in ("markers", "people", "team_slides", "low_slides", "slides")], "status", "reason", "ocr_missing")
