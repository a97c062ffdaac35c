"""Registered queries over the test tables, each with its DuckDB statement where SQL has one.

Bindings: a document is a file of the project named by its source; its language
stands for a file type; conversations are blocks of contracts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import lexicons as lx
from folioworks.functions import text as tx
from folioworks.operators import classify, evidence, fusion, graph, measure, people, privacy, segment, teams, topology
from folioworks.sources import files as src
from folioworks.streaming import uploads

NOW = "2024-06-01 00:00:00"
TYPES = {"en": "docx", "de": "pptx", "fr": "pdf", "es": "txt"}
SIMPLE_RULES = (privacy.RULES[0], privacy.RULES[3])


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("project_id"), F.col("doc_id").alias("file_ord"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), kinds[F.col("lang")].alias("file_type"), "text")


FILES_SQL = """files AS (SELECT source AS project_id, doc_id AS file_ord, 'doc_' || doc_id || '.txt' AS filename,
  CASE lang WHEN 'en' THEN 'docx' WHEN 'de' THEN 'pptx' WHEN 'fr' THEN 'pdf' ELSE 'txt' END AS file_type, text FROM documents)"""
#: white space at both ends, as the Unicode-aware strip sees it
STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\x0B\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+$', '', 'g')"

Q: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql.replace("{FILES}", FILES_SQL)
        return f

    return add


def joined(col, sep="|"):
    return F.array_join(col, sep)


# ---- sources


@query("src_03_file_kind", "WITH {FILES} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN lower(filename) LIKE '%screenshot%' THEN 'screenshot' WHEN filename LIKE '%.txt' THEN 'text' ELSE 'other' END AS kind FROM files) GROUP BY kind")
def _(spark, sf):
    return src.with_file_kind(files(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("src_04_snapshot_type", "WITH {FILES} SELECT file_ord, filename AS source_name, 'txt' AS source_type FROM files WHERE filename LIKE '%.txt'")
def _(spark, sf):
    return src.corpus_snapshot_type(files(spark, sf)).select("file_ord", "source_name", "source_type")


@query("src_05_list_projects", "SELECT o_custkey AS project_id, max(o_orderdate) AS updated_at FROM orders GROUP BY o_custkey ORDER BY updated_at DESC, project_id LIMIT 50")
def _(spark, sf):
    p = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.max("o_orderdate").alias("updated_at")).withColumn("created_at", F.col("updated_at"))
    return src.list_projects(p).select("project_id", "updated_at")


# ---- text


@query("txt_01_normalize_text", "WITH {FILES} SELECT file_ord, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'))) AS digest FROM files")
def _(spark, sf):
    return files(spark, sf).select("file_ord", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@query("txt_05_text_key", "WITH {FILES} SELECT file_ord, left(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), 120) AS text_key FROM files")
def _(spark, sf):
    return files(spark, sf).select("file_ord", tx.text_key(F.col("text")).alias("text_key"))


@query("txt_06_slugify", "SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g'), 64) AS slug FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.slugify(F.col("url")).alias("slug"))


@query("txt_07_label_tokens", "WITH {FILES}, t AS (SELECT file_ord, unnest(regexp_split_to_array(text, '[,;|\\n•·]')) AS x FROM files), u AS (SELECT file_ord, regexp_replace(x, '^[\\s\\-–—]+|[\\s\\-–—]+$', '', 'g') AS x FROM t) SELECT file_ord, count(*) AS n, sum(length(x))::BIGINT AS chars FROM u WHERE length(x) BETWEEN 3 AND 80 GROUP BY file_ord")
def _(spark, sf):
    rows = files(spark, sf).select("file_ord", F.explode(tx.label_tokens(F.col("text"))).alias("x"))
    return rows.groupBy("file_ord").agg(F.count("*").alias("n"), F.sum(F.length("x")).cast("long").alias("chars"))


@query("txt_08_sentences", "WITH {FILES}, t AS (SELECT file_ord, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS x FROM files) SELECT file_ord, count(*) AS n, sum(length(trim(x)))::BIGINT AS chars FROM t WHERE length(trim(x)) > 25 GROUP BY file_ord")
def _(spark, sf):
    rows = files(spark, sf).select("file_ord", F.explode(tx.sentences(F.col("text"))).alias("x"))
    return rows.groupBy("file_ord").agg(F.count("*").alias("n"), F.sum(F.length("x")).cast("long").alias("chars"))


@query("txt_09_first_paragraph", "WITH {FILES} SELECT file_ord, md5(trim(regexp_split_to_array(trim(text), '\\n[ \\t]*\\n')[1])) AS digest FROM files")
def _(spark, sf):
    return files(spark, sf).select("file_ord", F.md5(tx.first_paragraph(F.col("text"))).alias("digest"))


@query("txt_11_keywords", """WITH {FILES}, w AS (SELECT file_ord, unnest(regexp_extract_all(lower(text), '[а-яёa-z]{5,}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[а-яёa-z]{5,}'), 1) AS pos FROM files),
  c AS (SELECT file_ord, word, count(*) AS n, min(pos) AS p FROM w WHERE word <> 'slide' GROUP BY file_ord, word)
  SELECT file_ord, rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY file_ord ORDER BY n DESC, p)::INTEGER AS rank FROM c) WHERE rank <= 12""")  # fmt: skip
def _(spark, sf):
    return evidence.extract_keywords(files(spark, sf), ("file_ord",))


@query("txt_12_sanitize_url", "SELECT page_id, CASE WHEN regexp_matches(lower(trim(url)), '^(javascript|vbscript|data|file):') THEN NULL WHEN regexp_matches(lower(trim(url)), '^https?://[^\\s]+$') THEN trim(url) END AS safe_url FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.sanitize_url(F.col("url")).alias("safe_url"))


@query("txt_16_context_budget", """WITH {FILES}, p AS (SELECT project_id, file_ord, least(length(text), 3000) AS n FROM files),
  q AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY project_id ORDER BY file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
  SELECT project_id, file_ord, least(n, 12000 - before)::BIGINT AS used FROM q WHERE before < 12000""")  # fmt: skip
def _(spark, sf):
    from pyspark.sql import Window

    p = files(spark, sf).select("project_id", "file_ord", F.least(F.length("text"), F.lit(3000)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("project_id").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.withColumn("before", before).where("before < 12000").select("project_id", "file_ord", F.least(F.col("n"), 12000 - F.col("before")).cast("long").alias("used"))


@query("txt_17_hash16", "WITH {FILES} SELECT file_ord, left(sha256(text), 16) AS h FROM files")
def _(spark, sf):
    return files(spark, sf).select("file_ord", tx.hash16(F.col("text")).alias("h"))


@query("txt_18_person_key", "SELECT c_custkey, lower(c_name) AS person FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.normalize_person(F.col("c_name")).alias("person"))


@query("txt_19_canonical_tech", "SELECT event_type, event_type AS tech, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return table(spark, sf, "events").withColumn("tech", tx.canonical_tech(F.col("event_type"))).groupBy("event_type", "tech").agg(F.count("*").alias("n"))


@query("txt_20_combine_text", "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE text <> '' GROUP BY conv_id")
def _(spark, sf):
    part = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf, "conversations").where("text <> ''").groupBy("conv_id").agg(F.md5(F.array_join(part, "\n\n")).alias("digest"))


# ---- segments


def slides(spark, sf):
    """Conversations as slide decks of one text each."""
    c = table(spark, sf, "conversations")
    part = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("Slide "), (F.col("turn") + 1).cast("string"), F.lit(":\n"), "text").alias("t")))), lambda x: x["t"])
    return c.groupBy(F.col("conv_id").alias("file_ord")).agg(F.array_join(part, "\n").alias("text")).withColumn("project_id", F.lit("p")).withColumn("file_type", F.lit("pptx"))


@query("seg_01_split_slides", "SELECT conv_id AS file_ord, (turn + 1)::INTEGER AS location_index, length(trim('Slide ' || (turn + 1) || ':' || chr(10) || text)) AS chars FROM conversations")
def _(spark, sf):
    return segment.split_slides(slides(spark, sf)).select("file_ord", "location_index", F.length("text").cast("long").alias("chars"))


@query("seg_03_split_headings")
def _(spark, sf):
    return segment.split_headings(files(spark, sf)).select("file_ord", "location_index", "title", F.md5("text").alias("digest"))


@query("seg_04_split_paragraphs", """WITH {FILES}, b AS (SELECT file_ord, text, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS blocks,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 40) AS rows FROM files WHERE trim(text) <> ''),
  p AS (SELECT file_ord, text, CASE WHEN len(blocks) <= 1 AND length(text) > 400 THEN rows ELSE blocks END AS parts FROM b),
  n AS (SELECT file_ord, len(list_filter(parts, lambda x: length(x) >= 15)) AS k, list_sum(list_transform(list_filter(parts, lambda x: length(x) >= 15), lambda x: length(x))) AS c, length(text) AS whole FROM p)
  SELECT file_ord, CASE WHEN k > 0 THEN k ELSE 1 END AS n, CASE WHEN k > 0 THEN c ELSE whole END::BIGINT AS chars FROM n""")  # fmt: skip
def _(spark, sf):
    return segment.split_paragraphs(files(spark, sf)).groupBy("file_ord").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("seg_05_segment")
def _(spark, sf):
    return segment.segment(files(spark, sf)).groupBy("project_id", "location_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# ---- classifiers


def _hits_sql(lexicon):
    cols = ", ".join("(" + " + ".join(f"(contains(t, '{w}'))::INT" for w in ws) + f") AS {k}" for k, ws in lexicon.items())
    return cols


_S = lx.SAMPLE_DOMAINS
_BEST = "greatest(" + ", ".join(_S) + ")"


@query("cls_07_classify_domain", f"""WITH {{FILES}}, h AS (SELECT file_ord, {_hits_sql(_S)} FROM (SELECT file_ord, lower(text) AS t FROM files))
  SELECT file_ord, CASE WHEN {_BEST} = 0 THEN 'general' {' '.join(f"WHEN {k} = {_BEST} THEN '{k}'" for k in _S)} END AS primary_domain,
  CASE WHEN {_BEST} = 0 THEN 0.4::DOUBLE ELSE least(0.95::DOUBLE, 0.45::DOUBLE + 0.5::DOUBLE * {_BEST} / ({' + '.join(_S)})) END AS confidence FROM h""")  # fmt: skip
def _(spark, sf):
    return classify.classify_domain(files(spark, sf), lx.SAMPLE_DOMAINS).select("file_ord", "primary_domain", "confidence")


@query("cls_03_inventory")
def _(spark, sf):
    return classify.build_inventory(files(spark, sf)).select("project_id", "file_ord", "detected_source_type", "confidence", "char_count")


@query("cls_04_roles")
def _(spark, sf):
    return classify.infer_roles(classify.build_inventory(files(spark, sf))).groupBy("project_id", "source_role").agg(F.count("*").alias("n"))


@query("cls_06_primary_text", "WITH {FILES} SELECT project_id, file_ord, char_count FROM (SELECT project_id, file_ord, length(text)::BIGINT AS char_count, row_number() OVER (PARTITION BY project_id ORDER BY file_type IN ('docx', 'pdf', 'pptx') DESC, length(text) DESC, file_ord) AS r FROM files) WHERE r = 1")
def _(spark, sf):
    return classify.primary_text(files(spark, sf)).select("project_id", "file_ord", F.col("char_count").cast("long").alias("char_count"))


@query("cls_13_route_visual", """SELECT page_id, CASE WHEN n >= 4000 AND i = 0 THEN 'text_layer' WHEN n >= 40 AND NOT (i > 0 AND d) THEN 'text_layer' WHEN i > 0 AND d THEN 'ocr_vlm' ELSE 'text_layer' END AS route
  FROM (SELECT page_id, length(html) AS n, page_id % 3 AS i, page_id % 2 = 0 AS d FROM pages)""")  # fmt: skip
def _(spark, sf):
    p = table(spark, sf, "pages")
    items = p.select("page_id", F.length("html").alias("text_chars"), (F.col("page_id") % 3).alias("image_count"), F.lit(True).alias("ocr_enabled"), F.when(F.col("page_id") % 2 == 0, "diagram").otherwise("text").alias("content_type"))
    return classify.route_visual(items).select("page_id", "route")


@query("cls_16_user_projects", "SELECT c_custkey AS project_id FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def _(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("n_files"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name")).join(n, "project_id", "left").fillna(0)
    return classify.user_projects(c).select("project_id")


# ---- personal data

_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
_SPANS = f"""e AS (SELECT project_id, file_ord, unnest(regexp_extract_all(text, '{_EMAIL}')) AS original, generate_subscripts(regexp_extract_all(text, '{_EMAIL}'), 1) AS i, text FROM files),
  s AS (SELECT project_id, file_ord, original, i, (list_sum(list_transform(string_split_regex(text, '{_EMAIL}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{_EMAIL}')[1:i-1], lambda x: length(x))), 0))::INTEGER AS start FROM e)"""


def simple_entities(spark, sf):
    return privacy.privacy_pass(files(spark, sf), SIMPLE_RULES, names=False, medical=False)


@query("pii_01_detect_entities", f"WITH {{FILES}}, {_SPANS} SELECT project_id, file_ord, original, start, (start + length(original))::INTEGER AS \"end\" FROM s")
def _(spark, sf):
    return privacy.detect_entities(files(spark, sf), SIMPLE_RULES[:1], names=False, medical=False).select("project_id", "file_ord", "original", "start", "end")


@query("pii_03_detect_names")
def _(spark, sf):
    return privacy.detect_entities(files(spark, sf)).groupBy("project_id", "type").agg(F.count("*").alias("n"))


@query("pii_05_resolve_overlaps", f"WITH {{FILES}}, {_SPANS} SELECT project_id, file_ord, 'email' AS type, original, start FROM s")
def _(spark, sf):
    e = privacy.detect_entities(files(spark, sf), SIMPLE_RULES, names=False, medical=False)
    return privacy.resolve_overlaps(privacy.dedupe_names(e)).select("project_id", "file_ord", "type", "original", "start")


@query("pii_07_assign_placeholders", f"""WITH {{FILES}}, {_SPANS}, o AS (SELECT project_id, file_ord, original, min(start) AS first FROM s GROUP BY project_id, file_ord, original)
  SELECT project_id, file_ord, original, '[EMAIL_' || row_number() OVER (PARTITION BY project_id ORDER BY file_ord, first) || ']' AS placeholder FROM o""")  # fmt: skip
def _(spark, sf):
    return simple_entities(spark, sf).select("project_id", "file_ord", "original", "placeholder").distinct()


@query("pii_08_redact_text")
def _(spark, sf):
    f = files(spark, sf)
    return privacy.redact_text(f, privacy.privacy_pass(f)).select("project_id", "file_ord", F.md5("redacted").alias("digest"))


@query("pii_11_rehydrate", "WITH {FILES} SELECT file_ord, md5(text) AS digest FROM files")
def _(spark, sf):
    f, e = files(spark, sf), simple_entities(spark, sf)
    back = privacy.rehydrate(privacy.redact_text(f, e), privacy.mapping_of(e))
    return back.select("file_ord", F.md5("restored").alias("digest"))


@query("pii_12_risk_level", f"""WITH {{FILES}}, {_SPANS} SELECT project_id, count(*) AS n_entities, CASE WHEN count(*) >= 15 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS risk FROM s GROUP BY project_id""")
def _(spark, sf):
    return privacy.risk_level(simple_entities(spark, sf))


@query("pii_13_report")
def _(spark, sf):
    f = files(spark, sf)
    return privacy.pii_report(f, privacy.privacy_pass(f), NOW).select("project_id", "has_pii", "n_placeholders", "n_sources", "risk")


@query("pii_17_audit", f"WITH {{FILES}}, {_SPANS} SELECT project_id, count(*) AS redactions, 'email' AS entity_types, sum(length(original))::BIGINT AS redacted_chars FROM s GROUP BY project_id")
def _(spark, sf):
    return privacy.audit_rollup(simple_entities(spark, sf))


# ---- evidence


@query("evd_02_technologies", "WITH {FILES} SELECT file_ord, array_to_string(list_distinct_ordered, '|') AS technologies FROM (SELECT file_ord, list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{lx.TECHNOLOGIES[k][1]}' END" for k in sorted(lx.TECHNOLOGIES, key=len, reverse=True)) + "], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM files)")
def _(spark, sf):
    return files(spark, sf).select("file_ord", joined(evidence.extract_technologies(F.col("text"))).alias("technologies"))


@query("evd_03_group_technologies")
def _(spark, sf):
    t = files(spark, sf).withColumn("technologies", evidence.extract_technologies(F.col("text")))
    return evidence.group_technologies(t).select("project_id", "category", joined(F.col("names")).alias("names"))


FIELD_RULES = {"title": ("license",), "tech_stack": ("rag", "llm"), "team": ("@", "+1 ("), "results": ("trend",)}


def ranked_evidence(spark, sf):
    inv = classify.build_inventory(files(spark, sf)).select("file_ord", F.col("confidence").alias("inventory_confidence"), F.col("detected_source_type").alias("source_type"))
    parts = evidence.build_evidence(segment.split_paragraphs(files(spark, sf)))
    lab = evidence.field_labels(parts, FIELD_RULES).join(inv, "file_ord").withColumn("source_role", F.lit("unknown"))
    return evidence.rank_field_evidence(lab, {"unknown": 0.3}, {"raw_notes": 0.1})


@query("evd_07_rank_field_evidence")
def _(spark, sf):
    return ranked_evidence(spark, sf).select("project_id", "field", "rank", "file_ord", "location_index", F.round("score", 6).alias("score"))


@query("evd_08_field_coverage")
def _(spark, sf):
    return evidence.field_coverage(ranked_evidence(spark, sf)).select("project_id", "field", "items", "status")


@query("evd_15_assembly_confidence")
def _(spark, sf):
    return evidence.assembly_confidence(evidence.field_coverage(ranked_evidence(spark, sf)))


@query("evd_16_completeness", """WITH a AS (SELECT o_custkey AS project_id, count(*) AS n, sum(length(o_comment))::BIGINT AS chars FROM (SELECT o_custkey, o_orderpriority AS o_comment FROM orders) GROUP BY o_custkey),
  b AS (SELECT project_id, 1 + (chars > 200)::INT + (n >= 5)::INT + 6 * (n >= 3)::INT + 2 * (n >= 1)::INT AS passed FROM a)
  SELECT project_id, passed::INTEGER AS passed, round(passed * 100.0 / 11)::INTEGER AS score FROM b""")  # fmt: skip
def _(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("n"), F.sum(F.length("o_orderpriority")).alias("essence_chars")).withColumn("has_title", F.lit(True))
    for f in evidence.COMPLETE:
        a = a.withColumn(f"n_{f}", F.col("n"))
    return evidence.completeness(a).select("project_id", "passed", "score")


# ---- fusion


def candidates(spark, sf):
    modes = F.array(*[F.lit(x) for x in lx.PARSER_PRIORITY])
    roles = F.array(*[F.lit(x) for x in ("primary_project_doc", "report", "supporting_presentation", "unknown")])
    f = files(spark, sf)
    one = f.select("project_id", F.col("file_ord").alias("cand_ord"), F.concat(F.lit("s"), F.col("file_ord").cast("string")).alias("source_id"), F.get(modes, (F.col("file_ord") % 4).cast("int")).alias("parser_mode"), F.get(roles, (F.floor(F.col("file_ord") / 4) % 4).cast("int")).alias("source_role"), F.get(F.array(F.lit("title"), F.lit("tasks"), F.lit("client")), (F.col("file_ord") % 3).cast("int")).alias("field"), F.col("text").alias("value"))
    return fusion.field_candidates(one.withColumn("n_items", F.size(tx.lines_of(F.col("value")))))


_CAND = """c AS (SELECT source AS project_id, doc_id AS cand_ord, 's' || doc_id AS source_id, [95, 85, 70, 40][doc_id % 4 + 1] AS p, [100, 70, 60, 30][(doc_id // 4) % 4 + 1] AS r,
  ['title', 'tasks', 'client'][doc_id % 3 + 1] AS field, text AS value FROM documents),
  k AS (SELECT *, round(least(p::DOUBLE / 100.0::DOUBLE + 0.3::DOUBLE * r / 100.0::DOUBLE, 1.0::DOUBLE), 3) AS confidence, p + r AS priority FROM c WHERE trim(value) <> '')"""


@query("fus_01_field_candidates", f"WITH {_CAND} SELECT project_id, cand_ord, field, confidence, priority::INTEGER AS priority FROM k")
def _(spark, sf):
    return candidates(spark, sf).select("project_id", "cand_ord", "field", "confidence", "priority")


@query("fus_02_rank_candidates")
def _(spark, sf):
    return fusion.rank_candidates(candidates(spark, sf)).select("project_id", "field", "cand_ord", "score", "rank")


@query("fus_03_fuse_single")
def _(spark, sf):
    return fusion.fuse_single(fusion.rank_candidates(candidates(spark, sf)))


@query("fus_05_fuse_lists")
def _(spark, sf):
    return fusion.fuse_lists(fusion.rank_candidates(candidates(spark, sf)))


@query("fus_09_conflicts", f"WITH {_CAND} SELECT project_id, field, count(DISTINCT trim(value)) AS n_values, count(*) AS n_candidates FROM k WHERE field IN ('title', 'client') GROUP BY project_id, field HAVING count(DISTINCT trim(value)) > 1")
def _(spark, sf):
    return fusion.fusion_conflicts(candidates(spark, sf))


@query("fus_10_decisions")
def _(spark, sf):
    return fusion.fusion_decisions(fusion.rank_candidates(candidates(spark, sf)))


# ---- people


#: digits, no Cyrillic name, one word; and two artifact characters or more
@query("team_01_name_quality", "SELECT s_suppkey, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.5::DOUBLE - 0.25::DOUBLE - 0.2::DOUBLE - CASE WHEN length(regexp_replace(s_name, '[^Il1O0|]', '', 'g')) >= 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score FROM supplier")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(people.name_quality(F.col("s_name")), 6).alias("score"))


@query("team_04_best_name_match")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("name"))
    r = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("roster_ord"))
    return people.best_name_match(c, r).groupBy("project_id", "tier").agg(F.count("*").alias("n"))


@query("team_07_metrics", "SELECT o_custkey AS project_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderstatus = 'O') AS needs_review, count(*) FILTER (o_orderstatus = 'P') AS rejected FROM orders GROUP BY o_custkey")
def _(spark, sf):
    s = F.create_map(F.lit("F"), F.lit("verified"), F.lit("O"), F.lit("needs_review"), F.lit("P"), F.lit("rejected"))
    return people.team_metrics(table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), s[F.col("o_orderstatus")].alias("status")))


# ---- graph


def blocks(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("block_ord"), F.col("role").alias("block_key"), F.col("text").alias("content"))


@query("kg_01_corpus", "SELECT conv_id AS project_id, md5(string_agg(lower(coalesce(text, '')), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return graph.contract_corpus(blocks(spark, sf)).select("project_id", F.md5("corpus").alias("digest"))


def entities(spark, sf):
    return graph.extract_entities(blocks(spark, sf), {"user": "module", "assistant": "technology"})


KG_RULES = (graph.Relation(("module",), ("technology",), "uses", 8, 6), graph.Relation(("technology",), ("module",), "produces", 4, 3))


@query("kg_03_entities")
def _(spark, sf):
    return entities(spark, sf)


@query("kg_04_relations")
def _(spark, sf):
    return graph.build_relations(entities(spark, sf), KG_RULES)


@query("kg_05_validate")
def _(spark, sf):
    e = entities(spark, sf)
    return graph.validate_graph(e, graph.build_relations(e, KG_RULES))


@query("top_03_topology")
def _(spark, sf):
    e = entities(spark, sf)
    e = e.withColumn("inferred", F.lit(False))
    return topology.validate_topology(e, graph.build_relations(e, KG_RULES)).withColumn("warnings", joined(F.col("warnings")))


@query("kg_07_stale_reports", "WITH c AS (SELECT user_id AS project_id, max(ts) AS updated_at FROM events GROUP BY user_id), r AS (SELECT user_id AS project_id, max(ts) AS report_at FROM events WHERE event_id % 2 = 0 GROUP BY user_id) SELECT c.project_id, updated_at, report_at FROM c LEFT JOIN r USING (project_id) WHERE report_at IS NULL OR report_at < updated_at")
def _(spark, sf):
    e = table(spark, sf, "events")
    c = e.groupBy(F.col("user_id").alias("project_id")).agg(F.max("ts").alias("updated_at"))
    return graph.stale_reports(c, e.where("event_id % 2 = 0").select(F.col("user_id").alias("project_id"), F.col("ts").alias("created_at")))


# ---- metrics, evaluation, increments


@query("met_01_impact_metrics", "WITH {FILES}, m AS (SELECT project_id, unnest(regexp_extract_all(text, '(?i)(\\d[\\d ]*\\d|\\d)\\+?\\s*(version|inha|st|the)', 1)) AS n, unnest(regexp_extract_all(text, '(?i)(\\d[\\d ]*\\d|\\d)\\+?\\s*(version|inha|st|the)', 2)) AS u FROM files) SELECT project_id, lower(u) AS label, max(replace(n, ' ', '')::BIGINT) AS value FROM m WHERE replace(n, ' ', '')::BIGINT >= 3 GROUP BY project_id, lower(u)")
def _(spark, sf):
    return measure.impact_metrics(files(spark, sf), {"version": "version", "inha": "inha", "st": "st", "the": "the"}).drop("digits")


def engine_runs(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("engine"), (F.col("l_returnflag") != "R").alias("ok"), (F.col("l_suppkey") % 8).alias("accepted"), (F.col("l_partkey") % 4).alias("known"), (F.col("l_linestatus") == "F").alias("section"), F.col("l_partkey").alias("chars"), (F.col("l_suppkey") % 3).alias("rejected"))


_RUNS = """r AS (SELECT l_orderkey AS page, l_linenumber AS engine, l_returnflag <> 'R' AS ok, l_suppkey % 8 AS accepted, l_partkey % 4 AS known, l_linestatus = 'F' AS section, l_partkey AS chars, l_suppkey % 3 AS rejected FROM lineitem),
  s AS (SELECT *, CASE WHEN ok THEN round(10 * accepted + 5 * known + 3 * section::INT + least(chars / 300.0::DOUBLE, 5.0::DOUBLE) - rejected, 2) ELSE -50.0::DOUBLE END AS score FROM r)"""


@query("eval_01_best_engine", f"WITH {_RUNS} SELECT page, engine, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, accepted DESC, known DESC, chars DESC, engine) AS k FROM s) WHERE k = 1")
def _(spark, sf):
    return measure.best_engine(engine_runs(spark, sf)).select("page", "engine", "score")


@query("eval_02_known_names", "WITH {FILES} SELECT file_ord, ((contains(lower(text), 'gnu') AND contains(lower(text), 'license'))::INT + contains(lower(text), 'apache')::INT)::INTEGER AS hits FROM files")
def _(spark, sf):
    return measure.known_name_hits(files(spark, sf), ["GNU License", "Apache"]).select("file_ord", "hits")


@query("eval_04_team_consistency", "SELECT coalesce(a.k, b.k) AS project_id, coalesce(n1, 0) AS n_evidence, coalesce(n2, 0) AS n_contract, CASE WHEN coalesce(n1, 0) > 0 AND coalesce(n2, 0) = 0 THEN 'contract' WHEN coalesce(n2, 0) > 0 AND coalesce(n3, 0) = 0 THEN 'page' ELSE 'none' END AS lost_at FROM (SELECT c_nationkey AS k, count(*) AS n1 FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n2 FROM supplier GROUP BY 1) b ON a.k = b.k LEFT JOIN (SELECT n_nationkey AS k, count(*) AS n3 FROM nation WHERE n_regionkey = 1 GROUP BY 1) c ON c.k = coalesce(a.k, b.k)")
def _(spark, sf):
    n = lambda t, k, c: table(spark, sf, t).groupBy(F.col(k).alias("project_id")).agg(F.count("*").alias(c))
    page = table(spark, sf, "nation").where("n_regionkey = 1").groupBy(F.col("n_nationkey").alias("project_id")).agg(F.count("*").alias("n_page"))
    out = measure.team_consistency(n("customer", "c_nationkey", "n_evidence"), n("supplier", "s_nationkey", "n_contract"), page)
    return out.where("n_evidence > 0 or n_contract > 0").select("project_id", "n_evidence", "n_contract", "lost_at")


@query("str_02_skip_unchanged", "WITH {FILES} SELECT DISTINCT project_id FROM files WHERE contains(text, 'license') AND file_ord % 2 = 1")
def _(spark, sf):
    f = files(spark, sf)
    before = f.withColumn("text", F.when(F.col("text").contains("license") & (F.col("file_ord") % 2 == 1), F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return uploads.skip_unchanged(uploads.fingerprints(f), uploads.fingerprints(before)).select("project_id")


@query("str_03_expire_reports", "SELECT event_id FROM events WHERE ts + INTERVAL 72 HOUR > TIMESTAMP '2024-01-20 00:00:00'")
def _(spark, sf):
    r = table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    return uploads.expire_reports(r, "2024-01-20 00:00:00").select("event_id")


# ---- more of the same modules


@query("txt_02_clean_ocr_text", "WITH {FILES} SELECT file_ord, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '^\\s*[•·▪●◦*]\\s*', '- '), '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS digest FROM files")
def _(spark, sf):
    return files(spark, sf).select("file_ord", F.md5(tx.clean_ocr_text(F.col("text"))).alias("digest"))


@query("txt_02_merge_ocr_blocks", "SELECT conv_id AS file_ord, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS digest FROM (SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '^\\s*[•·▪●◦*]\\s*', '- '), '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM conversations) WHERE t <> '' GROUP BY conv_id")
def _(spark, sf):
    c = table(spark, sf, "conversations").select(F.lit("p").alias("project_id"), F.col("conv_id").alias("file_ord"), F.col("turn").alias("block_ord"), "text")
    return teams.merge_ocr_blocks(c).select("file_ord", F.md5("text").alias("digest"))


@query("txt_05_normalize_bullet", "SELECT p_partkey, regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS item FROM part")
def _(spark, sf):
    mark = F.element_at(F.array(*[F.lit(m) for m in ("- ", " • 12. ", "3)  ", "* – ", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", tx.normalize_bullet(F.concat(mark, "p_name", F.lit("  "))).alias("item"))


@query("txt_17_candidate_id", "SELECT c_custkey, left(sha256(lower(trim(c_name)) || '|' || c_mktsegment), 16) AS candidate_id FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.candidate_id(F.concat(F.lit("  "), "c_name"), F.col("c_mktsegment")).alias("candidate_id"))


@query("txt_09_bullets")
def _(spark, sf):
    return files(spark, sf).select("file_ord", joined(tx.bullets(F.col("text"))).alias("bullets"))


@query("txt_10_dates", "WITH {FILES} SELECT file_ord, array_to_string(regexp_extract_all(text, '\\d{2}\\.\\d{2}\\.\\d{2,4}\\s*[-–—]\\s*\\d{2}\\.\\d{2}\\.\\d{2,4}'), '|') AS dates FROM files")
def _(spark, sf):
    return files(spark, sf).select("file_ord", joined(tx.extract_dates(F.col("text"))).alias("dates"))


@query("seg_02_split_pages", "WITH {FILES} SELECT file_ord, count(*) AS n FROM files WHERE trim(text) <> '' GROUP BY file_ord")
def _(spark, sf):
    return segment.split_pages(files(spark, sf)).groupBy("file_ord").agg(F.count("*").alias("n"))


HEADERS = {"the and attion to thanedble the, anea. eriner thanea": "opening", "of onthshes": "second"}


@query("seg_06_known_sections")
def _(spark, sf):
    return segment.split_known_sections(files(spark, sf), HEADERS).select("file_ord", "key", F.md5("text").alias("digest"))


@query("seg_10_parse_stack")
def _(spark, sf):
    return segment.parse_stack(files(spark, sf)).groupBy("project_id", "category").agg(F.sum(F.size("items")).cast("long").alias("n"))


@query("seg_12_classify_slides", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)license') THEN 'sources' WHEN regexp_matches(text, '\\?') THEN 'goal' WHEN length(text) < 60 THEN 'title' ELSE 'member' END AS kind FROM (SELECT conv_id, turn, text FROM conversations)")
def _(spark, sf):
    rules = (("sources", "(?i)license"), ("goal", r"\?"), ("title", r"(?s)^.{0,59}$"))
    return table(spark, sf, "conversations").select("conv_id", "turn", segment.classify_by_rules(F.col("text"), rules, "member").alias("kind"))


@query("cls_05_single_ready_doc")
def _(spark, sf):
    return classify.single_ready_doc(classify.build_inventory(files(spark, sf)))


@query("cls_14_ocr_targets", """WITH p AS (SELECT o_custkey AS file_ord, o_orderkey AS page, (o_orderkey % 3) AS image_count, (o_orderkey % 97) AS text_chars, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders),
  h AS (SELECT *, row_number() OVER (PARTITION BY file_ord ORDER BY page) AS r FROM p WHERE image_count > 0 AND (text_chars < 40 OR page = last)) SELECT file_ord, page FROM h WHERE r <= 40""")  # fmt: skip
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("p").alias("project_id"), F.col("o_custkey").alias("file_ord"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 3).alias("image_count"), (F.col("o_orderkey") % 97).alias("text_chars"))
    return classify.ocr_targets(o).select("file_ord", "page")


@query("pii_02_detect_medical")
def _(spark, sf):
    return privacy.detect_entities(files(spark, sf), (), names=False).groupBy("project_id").agg(F.count("*").alias("n"))


@query("pii_04_dedupe_names")
def _(spark, sf):
    return privacy.dedupe_names(privacy.detect_entities(files(spark, sf), (), medical=False)).groupBy("project_id", "type").agg(F.count("*").alias("n"))


@query("pii_06_context_preview")
def _(spark, sf):
    return privacy.context_preview(files(spark, sf), simple_entities(spark, sf)).select("file_ord", "start", "context_preview_redacted")


@query("pii_10_redacted_bundle")
def _(spark, sf):
    f = files(spark, sf)
    return privacy.bundle_parts(privacy.redact_text(f, privacy.privacy_pass(f))).select("project_id", "file_ord", F.md5("safe_text").alias("digest"))


@query("fus_06_fuse_stack")
def _(spark, sf):
    t = files(spark, sf).withColumn("technologies", evidence.extract_technologies(F.col("text")))
    rows = t.select("project_id", F.col("file_ord").alias("cand_ord"), F.posexplode("technologies").alias("item_ord", "name")).withColumn("category", F.lit("found"))
    return fusion.fuse_stack(rows).select("project_id", "category", joined(F.col("technologies")).alias("technologies"))


@query("fus_07_fuse_team", "SELECT c_nationkey AS project_id, lower(c_name) AS key, max(c_name) AS name FROM customer GROUP BY c_nationkey, lower(c_name)")
def _(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("name"), F.lit("").alias("role"), F.lit("").alias("project_area"), F.array(F.lit("a")).alias("contributions"), F.col("c_custkey").alias("item_ord"))
    return fusion.fuse_team(m).select("project_id", "key", "name")


@query("team_03_roster", "SELECT k AS project_id, row_number() OVER (PARTITION BY k ORDER BY src, i, lower(name))::INTEGER AS roster_ord, name FROM (SELECT s_nationkey AS k, s_name AS name, s_suppkey AS i, 0 AS src FROM supplier UNION ALL SELECT c_nationkey, c_name, c_custkey, 1 FROM customer)")
def _(spark, sf):
    given = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("item_ord"))
    found = table(spark, sf, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("item_ord"))
    return people.trusted_roster(given, found)


@query("kg_05_orphans")
def _(spark, sf):
    e = entities(spark, sf)
    return graph.orphans(e, graph.build_relations(e, KG_RULES)).select("project_id", "slug")


@query("eval_03_acceptance", "SELECT doc_id AS project_id, count(*) AS missing FROM (SELECT doc_id, 'quality' AS item, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) WHERE v = 0 GROUP BY doc_id")
def _(spark, sf):
    l = table(spark, sf, "labels")  # noqa: E741
    need = l.select(F.col("doc_id").alias("project_id"), F.array(F.lit("quality"), F.lit("toxic")).alias("must_have"))
    have = l.select(F.col("doc_id").alias("project_id"), F.explode(F.filter(F.array(F.when(F.col("quality") != 0, F.lit("quality")), F.when(F.col("toxic") != 0, F.lit("toxic"))), lambda x: x.isNotNull())).alias("item"))
    return measure.acceptance(have, need)


_PRINTS = """f AS (SELECT project_id, file_ord, sha256(file_ord || chr(10) || filename || chr(10) || coalesce(text, '')) AS digest, count(*) OVER (PARTITION BY project_id) AS n FROM files),
  g AS (SELECT project_id, file_ord % ceil(n / {size})::BIGINT AS part, sha256(string_agg(digest, '' ORDER BY file_ord)) AS digest FROM f GROUP BY ALL),
  p AS (SELECT project_id, left(sha256(project_id || chr(10) || string_agg(digest, '' ORDER BY part)), 24) AS fingerprint FROM g GROUP BY project_id)"""


@query("txt_17_fingerprint", f"WITH {{FILES}}, {_PRINTS.format(size='4096.0')} SELECT project_id, fingerprint FROM p")
def _(spark, sf):
    return uploads.fingerprints(files(spark, sf))


@query("txt_17_fingerprint_groups", f"WITH {{FILES}}, {_PRINTS.format(size='7.0')} SELECT project_id, fingerprint FROM p")
def _(spark, sf):
    return uploads.fingerprints(files(spark, sf), 7)


@query("pii_09_scrub_payload")
def _(spark, sf):
    f = files(spark, sf)
    out = privacy.scrub_payload(f, privacy.mapping_of(privacy.privacy_pass(f)), ("text",))
    return out.select("file_ord", F.md5("text").alias("digest"))


@query("pii_14_public_report", f"WITH {{FILES}}, {_SPANS} SELECT file_ord, start, left(sha256(original), 16) AS original_hash FROM s")
def _(spark, sf):
    return privacy.public_report(simple_entities(spark, sf)).select("file_ord", "start", "original_hash")


@query("pii_15_route_privacy")
def _(spark, sf):
    f = files(spark, sf)
    r = privacy.pii_report(f, simple_entities(spark, sf), NOW).withColumn("mode", F.when(F.crc32(F.col("project_id").cast("binary")) % 2 == 0, "local_only").otherwise("hybrid_safe"))
    return privacy.route_privacy(r).select("project_id", "view", "is_safe", "block_reason")


@query("pii_14_leaks", """WITH {FILES}, d AS (SELECT project_id, file_ord, text FROM files WHERE text <> ''), w AS (SELECT DISTINCT project_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]{14,}')) AS word FROM d WHERE file_ord % 3 = 0)
  SELECT DISTINCT d.project_id, file_ord FROM d JOIN w ON d.project_id = w.project_id AND contains(text, word)""")  # fmt: skip
def _(spark, sf):
    f = files(spark, sf)
    words = f.where("file_ord % 3 = 0").select("project_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]{14,}"), 0)).alias("original"))
    return privacy.leaks(f, words, "text").select("project_id", "file_ord")


@query("pii_16_safe_payload", """WITH {FILES} SELECT project_id, md5(left(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY file_ord), 4000)) AS preview, (sum(length(coalesce(text, ''))) + 2 * (count(*) - 1))::BIGINT AS total_chars, count(*) AS n_files FROM files GROUP BY project_id""")
def _(spark, sf):
    return privacy.safe_payload(files(spark, sf).withColumnRenamed("text", "redacted")).withColumn("preview", F.md5("preview"))


@query("pii_16_safe_payload_masked")
def _(spark, sf):
    f = files(spark, sf)
    return privacy.safe_payload(privacy.redact_text(f, privacy.privacy_pass(f))).select("project_id", "total_chars", "n_files")


@query("evd_14_gap_analysis", "SELECT o_custkey AS project_id, CASE WHEN count(*) < 4 THEN 'weak' ELSE 'strong' END AS gap FROM orders GROUP BY o_custkey")
def _(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("size")).withColumn("field", F.lit("tasks"))
    return evidence.gap_analysis(n).select("project_id", "gap")


@query("evd_17_source_usage")
def _(spark, sf):
    inv = classify.build_inventory(files(spark, sf)).select("project_id", "file_ord", "char_count")
    return evidence.source_usage(inv, ranked_evidence(spark, sf))


@query("fus_04_fuse_text")
def _(spark, sf):
    return fusion.fuse_text(fusion.score_candidates(candidates(spark, sf).where("field = 'tasks'")))


@query("fus_08_fuse_modules")
def _(spark, sf):
    m = blocks(spark, sf).select("project_id", F.col("block_ord").alias("item_ord"), F.concat(F.lit("module "), F.col("block_key")).alias("name"), F.col("content").alias("description"))
    return fusion.fuse_modules(m)


@query("fus_11_fused_contract")
def _(spark, sf):
    return fusion.fused_contract(fusion.fuse_single(fusion.rank_candidates(candidates(spark, sf))), ("title", "client", "tasks"))


@query("team_08_public_team", """SELECT c_nationkey AS project_id, CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 10 = 0 THEN 0 WHEN c_custkey % 5 = 1 THEN 1 ELSE 2 END AS bucket
  FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 5 = 1 OR c_custkey % 4 = 0""")  # fmt: skip
def _(spark, sf):
    key = F.col("c_custkey")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("name"), key.alias("item_ord"), key.alias("candidate_id"), F.when(key % 2 == 0, "verified").otherwise("rejected").alias("status"), F.when(key % 4 == 0, 0.9).otherwise(0.4).alias("quality"))
    members = c.where("item_ord % 10 = 0").withColumn("name", F.upper("name"))
    return people.public_team(members, c, c.where("item_ord % 5 = 1").select("project_id", "candidate_id")).select("project_id", "name", "bucket")


@query("team_09_review_summary", "SELECT o_custkey AS project_id, count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus = 'O') = 0 AS can_publish FROM orders GROUP BY o_custkey")
def _(spark, sf):
    s = F.create_map(F.lit("F"), F.lit("verified"), F.lit("O"), F.lit("needs_review"), F.lit("P"), F.lit("rejected"))
    return people.review_summary(table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), s[F.col("o_orderstatus")].alias("status"))).select("project_id", "can_publish")


@query("kg_02_grounded", """WITH b AS (SELECT conv_id AS project_id, turn AS block_ord, lower(coalesce(text, '')) AS t FROM conversations),
  w AS (SELECT project_id, block_ord, regexp_extract(t, '^[^\\x20\\x09-\\x0D]+') AS first FROM b),
  l AS (SELECT project_id, block_ord, CASE block_ord % 3 WHEN 0 THEN first || ' zzzz' WHEN 1 THEN 'zzzz qqqq ' || first || ' wwww' ELSE first END AS label FROM w),
  x AS (SELECT *, list_filter(regexp_split_to_array(label, '[^\\p{L}\\p{M}\\p{N}_]+'), lambda v: length(v) > 2) AS words FROM l),
  c AS (SELECT project_id, string_agg(t, chr(10) ORDER BY block_ord) AS corpus FROM b GROUP BY project_id)
  SELECT project_id, block_ord::VARCHAR AS slug, length(label) >= 3 AND (contains(corpus, label) OR (len(words) > 0 AND len(list_filter(words, lambda v: contains(corpus, v))) >= greatest(1, len(words) // 2))) AS grounded FROM x JOIN c USING (project_id)""")  # fmt: skip
def _(spark, sf):
    b = blocks(spark, sf)
    first = F.regexp_extract(F.lower("content"), r"^[^\x20\x09-\x0D]+", 0)
    label = F.when(F.col("block_ord") % 3 == 0, F.concat(first, F.lit(" zzzz"))).when(F.col("block_ord") % 3 == 1, F.concat(F.lit("zzzz qqqq "), first, F.lit(" wwww"))).otherwise(first)
    labels = b.select("project_id", F.col("block_ord").cast("string").alias("slug"), label.alias("label"))
    return graph.ground_labels(labels, b).select("project_id", "slug", "grounded")


@query("kg_06_graph_summary")
def _(spark, sf):
    e = entities(spark, sf)
    return graph.graph_summary(e, graph.build_relations(e, KG_RULES))


@query("sem_02_ground_metrics", "SELECT doc_id AS project_id FROM documents WHERE contains(lower(text), '555')")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("project_id"), F.lower("text").alias("corpus"))
    return graph.ground_metrics(d.select("project_id", F.lit("555 calls").alias("metric")), d).select("project_id")


@query("met_02_product_metrics", "WITH {FILES} SELECT file_ord, 'version' AS label, regexp_extract(lower(text), 'version[^0-9]{0,16}?([0-9]+([.,][0-9]+)?)', 1) AS value FROM files WHERE regexp_matches(lower(text), 'version[^0-9]{0,16}?([0-9]+([.,][0-9]+)?)')")
def _(spark, sf):
    return measure.product_metrics(files(spark, sf), ("version",)).select("file_ord", "label", "value")


@query("met_03_metric_cards", "SELECT o_custkey AS project_id, card, label, value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY source_ord, label)::INTEGER AS card FROM (SELECT o_custkey, o_orderpriority AS label, min(o_orderkey) AS source_ord, min(o_orderkey) AS value FROM orders GROUP BY 1, 2)) WHERE card <= 6")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("source_ord"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("value"))
    return measure.metric_cards(o)


from folioworks.plans import flow_plans, graph_plans, more, team_plans  # noqa: E402, F401  (register further queries)


def queries() -> dict:
    return Q


def oracle_sql() -> dict:
    return SQL


def flagship(spark, sf_dir: str):
    """Risk of every project, with the number of files in its safe text and a digest of them that needs no order."""
    f = files(spark, sf_dir)
    e = privacy.privacy_pass(f)
    safe = privacy.bundle_parts(privacy.redact_text(f, e)).groupBy("project_id").agg(F.count("*").alias("safe_files"), F.bit_xor(F.xxhash64("file_ord", "safe_text")).alias("safe_digest"))
    return privacy.pii_report(f, e, NOW).join(safe, "project_id", "left")
