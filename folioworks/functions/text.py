"""Text functions as Column builders: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]"
# The date forms that are looked for, in this order.
DATE_PATTERNS = (
    r"\d{2}\.\d{2}\.\d{2,4}\s*[-–—]\s*\d{2}\.\d{2}\.\d{2,4}",
    r"\d{2}\.\d{2}\s*[-–—]\s*\d{2}\.\d{2}\.\d{4}",
    r"\(\d{2}\.\d{2}[-–—]\d{2}\.\d{2}\.\d{4}\)",
)
DATE_FIELD = r"(?iU)Сроки проекта:\s*([^\n]+)"
# Words that are no keywords.
STOP_WORDS = ("который", "которые", "проект", "слайд", "slide", "данных", "система", "модель", "можно", "будет", "этого")
# Other spellings of technologies.
TECH_ALIASES = {
    "qdrant cloud": "Qdrant",
    "neo4j graph database": "Neo4j",
    "sentence transformers": "Sentence Transformers",
    "sentence-transformers": "Sentence Transformers",
    "bertopic": "BERTopic",
    "fastapi": "FastAPI",
    "postgresql": "PostgreSQL",
    "postgres": "PostgreSQL",
    "docker compose": "Docker Compose",
    "docker-compose": "Docker Compose",
    "google colab": "Google Colab",
    "chatgpt": "ChatGPT",
    "gigachat": "GigaChat",
}


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def squeeze(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def lines_of(col: Column) -> Column:
    """The lines of a text, without the empty piece behind a last line end."""
    parts = F.split(col, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def normalize_text(col: Column) -> Column:
    """TXT-1: unified line ends, at most one empty line in a row, blanks squeezed in every line."""
    t = F.regexp_replace(F.translate(col, " \u000b", " \n"), "\r\n", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(lines_of(t), lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))), "\n"))


def clean_ocr_text(col: Column) -> Column:
    """TXT-2: bullets become "- ", blanks are squeezed, empty lines go."""
    rows = F.transform(lines_of(col), lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"(?U)^\s*[•·▪●◦*]\s*", "- "), "[ \t]+", " ")))
    return F.array_join(F.filter(rows, lambda x: x != ""), "\n")


def normalize_bullet(col: Column) -> Column:
    """TXT-5: marks and numbering off the front, blanks squeezed."""
    t = F.regexp_replace(strip(col), r"(?U)^[\s•\-*·–]+", "")
    return squeeze(F.regexp_replace(t, r"(?U)^\d+[.)]\s*", ""))


def text_key(col: Column) -> Column:
    """TXT-5: lower case, squeezed, the first 120 characters."""
    return F.substring(F.regexp_replace(F.lower(strip(col)), r"(?U)\s+", " "), 1, 120)


def slugify(col: Column, max_len: int = 64, fallback: str = "item") -> Column:
    """TXT-6."""
    t = F.regexp_replace(F.lower(strip(col)), r"(?U)[^\w\s-]", "")
    t = F.substring(F.regexp_replace(F.regexp_replace(t, r"(?U)[\s_]+", "-"), "^-+|-+$", ""), 1, max_len)
    return F.when(t == "", fallback).otherwise(t)


def label_tokens(col: Column) -> Column:
    """TXT-7: pieces between separators, dashes off, 3 to 80 characters."""
    parts = F.transform(F.split(col, r"[,;|\n•·]"), lambda x: F.regexp_replace(x, r"(?U)^[\s\-–—]+|[\s\-–—]+$", ""))
    return F.filter(parts, lambda x: (F.length(x) >= 3) & (F.length(x) <= 80))


def sentences(col: Column, min_len: int = 25) -> Column:
    """TXT-8: cut behind . ! ?, longer than ``min_len``."""
    return F.filter(F.transform(F.split(col, r"(?U)(?<=[.!?])\s+"), strip), lambda x: F.length(x) > min_len)


def bullets(col: Column, limit: int = 8) -> Column:
    """TXT-9: texts of bullet or numbered lines, each once, the first ``limit``."""
    found = F.regexp_extract_all(col, F.lit(r"(?m)^[ \t]*(?:[-*•–]|\d+[.)])[ \t]+(.+)$"), 1)
    return F.slice(F.array_distinct(F.transform(found, strip)), 1, limit)


def first_paragraph(col: Column) -> Column:
    """TXT-9: the first block before an empty line."""
    return strip(F.element_at(F.split(strip(col), r"\n[ \t]*\n"), 1))


def extract_dates(col: Column) -> Column:
    """TXT-10: date ranges, by pattern, then place, each once."""
    found = [F.regexp_extract_all(col, F.lit("(?i)" + p), 0) for p in DATE_PATTERNS] + [F.regexp_extract_all(col, F.lit(DATE_FIELD), 1)]
    return F.filter(F.array_distinct(F.transform(F.concat(*found), strip)), lambda x: x != "")


def sanitize_url(col: Column) -> Column:
    """TXT-12: http(s) and relative paths pass; anything else is null."""
    t = strip(col)
    low = F.lower(t)
    return F.when(low.rlike(r"^\s*(javascript|vbscript|data|file):"), F.lit(None)).when(low.rlike("^https?://[^\\s]+$"), t).when(t.rlike(r"^(/|\./|\.\./)[^\s]*$") & ~t.startswith("//"), t)


def hash16(col: Column, digits: int = 16) -> Column:
    """TXT-17."""
    return F.substring(F.sha2(col, 256), 1, digits)


def candidate_id(name: Column, filename: Column) -> Column:
    """TXT-17: the id of a person of a file, the same whenever it is found again; nulls count as empty."""
    return hash16(F.concat(F.lower(strip(F.coalesce(name, F.lit("")))), F.lit("|"), F.coalesce(filename, F.lit(""))))


def normalize_person(col: Column) -> Column:
    """TXT-18."""
    return F.regexp_replace(F.translate(F.lower(strip(col)), "ё", "е"), r"(?U)\s+", " ")


def person_key(col: Column) -> Column:
    """TXT-18: the first two words without addresses; of a single word its text key."""
    parts = F.filter(F.split(F.regexp_replace(col, r"https?://\S+", ""), r"(?U)\s+"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.lower(F.array_join(F.slice(parts, 1, 2), " "))).otherwise(text_key(col))


def canonical_tech(col: Column) -> Column:
    """TXT-19."""
    t = strip(col)
    low = F.lower(t)
    out = F.when(low == list(TECH_ALIASES)[0], TECH_ALIASES[list(TECH_ALIASES)[0]])
    for k, v in list(TECH_ALIASES.items())[1:]:
        out = out.when(low == k, v)
    return out.when(low.startswith("neo4j"), "Neo4j").when(low.contains("qdrant"), "Qdrant").when(low.contains("bertopic"), "BERTopic").otherwise(t)
