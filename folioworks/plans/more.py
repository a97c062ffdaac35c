"""Further registered queries: structured documents, assembly, decisions, people and architecture graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import lexicons as lx
from folioworks.functions import text as tx
from folioworks.operators import assemble, classify, documents, evidence, graph, people, segment, topology
from folioworks.plans.registry import FIELD_RULES, KG_RULES, blocks, entities, files, joined, query, table

# what stands in this project's test tables, in place of the lexicons' defaults
SECTIONS = {"rights": ("all rights reserved.",), "apache": ("licensed under the apache license, version 2.0.",), "mit": ("released under the mit license.",)}
META = {"copyright": r"copyright", "version": r"version\s+[0-9]"}
FACTS = {"client": r"released\s+under", "timeline": r"version"}


def _section_sql(words):
    return "regexp_matches(t, '(?:^|\\n)\\s*#{0,3}\\s*(?:" + "|".join(w.replace(".", "\\.") for w in words) + ")\\s*(?:\\n|$)')"


@query("cls_01_detect_structured", f"""WITH {{FILES}}, t AS (SELECT file_ord, lower(coalesce(text, '')) AS t FROM files),
  d AS (SELECT file_ord, {" + ".join(f"({_section_sql(w)})::INT" for w in SECTIONS.values())} AS n, {" + ".join(f"regexp_matches(t, '{p}')::INT" for p in META.values())} AS m FROM t)
  SELECT file_ord, n::INTEGER AS sections, round(n::DOUBLE / 3.0::DOUBLE * 0.75::DOUBLE + m::DOUBLE / 2.0::DOUBLE * 0.25::DOUBLE, 3) AS confidence FROM d""")  # fmt: skip
def _(spark, sf):
    return documents.detect_structured(files(spark, sf), SECTIONS, META).select("file_ord", F.size("detected_sections").alias("sections"), F.col("structure_confidence").alias("confidence"))


@query("cls_02_source_type")
def _(spark, sf):
    marks = {"license": r"license", "rights": r"rights reserved", "token": r"token", "mail": r"@"}
    return documents.detect_source_type(files(spark, sf), SECTIONS, META, marks).select("file_ord", "source_type", "type_confidence", joined(F.col("signals")).alias("signals"))


_S = lx.SAMPLE_DOMAINS
_HITS = {k: "(" + " + ".join(f"(contains(t, '{w}'))::INT" for w in ws) + ")" for k, ws in _S.items()}
_BEST = "greatest(" + ", ".join(_S) + ")"


@query("cls_08_classify_profile", f"""WITH {{FILES}}, h AS (SELECT file_ord, {", ".join(f"{x} AS {k}" for k, x in _HITS.items())} FROM (SELECT file_ord, lower(coalesce(text, '')) AS t FROM files))
  SELECT file_ord, CASE WHEN {_BEST} = 0 THEN 'general' {" ".join(f"WHEN {k} = {_BEST} THEN '{k}'" for k in _S)} END AS profile, {_BEST}::INTEGER AS hits FROM h""")  # fmt: skip
def _(spark, sf):
    return classify.classify_profile(files(spark, sf), _S).select("file_ord", "profile", "hits")


def classified(spark, sf):
    return classify.classify_domain(files(spark, sf), _S)


@query("cls_09_archetypes")
def _(spark, sf):
    rules = {"open_source": ("licensing", ("mit ", "apache", "gnu")), "leaky": (None, ("token", "akia", "password")), "search": ("trends", ("rag", "llm"))}
    return classify.detect_archetypes(classified(spark, sf), rules).select("file_ord", F.explode("archetypes").alias("a")).select("file_ord", "a.key", "a.confidence")


@query("cls_10_patterns")
def _(spark, sf):
    rules = {"rag_pipeline": ("rag", "vector"), "secrets": ("token", "akia"), "legal": ("license", "copyright")}
    return classify.detect_patterns(classified(spark, sf), rules, {("legal", "licensing"): 0.08}).select("file_ord", F.explode("patterns").alias("p")).select("file_ord", "p.key", "p.confidence")


@query("cls_11_plan_sections", "SELECT o_orderkey AS project_id, generate_subscripts(plan, 1)::INTEGER - 1 AS section_ord, unnest(plan) AS section FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ['essence', 'modules', 'team'] WHEN 'O' THEN ['problem', 'architecture'] ELSE ['essence', 'metrics'] END AS plan FROM orders)")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_orderstatus").alias("primary_domain"))
    plan = {"F": ("essence", "modules", "team"), "O": ("problem", "architecture")}
    return classify.plan_sections(o, plan, ("essence", "metrics")).select("project_id", "section_ord", "section")


def _found(words, text="t"):
    return " + ".join(f"contains({text}, '{w}')::INT" for w in words)


_PROFILE = {k: f"({_found(w)})" for k, w in lx.PROFILES.items()}
_MOST = "greatest(" + ", ".join(_PROFILE) + ")"


@query("cls_08_profiles", f"""WITH {{FILES}}, h AS (SELECT file_ord, t, {", ".join(f"{x} AS {k}" for k, x in _PROFILE.items())} FROM (SELECT file_ord, lower(coalesce(text, '')) AS t FROM files))
  SELECT file_ord, CASE WHEN {_MOST} = 0 THEN 'general' {" ".join(f"WHEN {k} = {_MOST} THEN '{k}'" for k in _PROFILE)} END AS profile, round(CASE WHEN {_MOST} > 0 THEN least(0.95::DOUBLE, 0.45::DOUBLE + {_MOST}::DOUBLE / ({" + ".join(_PROFILE)})::DOUBLE * 0.5::DOUBLE) WHEN trim(t) = '' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END, 6) AS confidence FROM h""")  # fmt: skip
def _(spark, sf):
    return classify.classify_profile(files(spark, sf)).select("file_ord", "profile", F.col("profile_confidence").alias("confidence"))


@query("cls_10_default_patterns", f"""WITH {{FILES}}, t AS (SELECT file_ord, lower(coalesce(text, '')) AS t, contains(lower(coalesce(text, '')), 'rag') AS rag FROM files),
  h AS ({" UNION ALL ".join(f"SELECT file_ord, {i} AS o, '{k}' AS key, ({_found(w)}) AS hits, rag FROM t" for i, (k, w) in enumerate(lx.PATTERNS.items()))}),
  c AS (SELECT file_ord, o, key, round(CASE WHEN key = 'RAG pipeline' AND rag THEN least(0.95::DOUBLE, least(0.9::DOUBLE, 0.48::DOUBLE + 0.1::DOUBLE * hits) + 0.08::DOUBLE) ELSE least(0.9::DOUBLE, 0.48::DOUBLE + 0.1::DOUBLE * hits) END, 6) AS confidence FROM h WHERE hits > 0)
  SELECT file_ord, key, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file_ord ORDER BY confidence DESC, o) AS n FROM c) WHERE n <= 10""")  # fmt: skip
def _(spark, sf):
    f = files(spark, sf).withColumn("primary_domain", F.when(F.lower("text").contains("rag"), "rag_system").otherwise("general"))
    return classify.detect_patterns(f).select("file_ord", F.explode("patterns").alias("p")).select("file_ord", "p.key", "p.confidence")


@query("cls_09_default_archetypes", f"""WITH {{FILES}}, t AS (SELECT file_ord, lower(coalesce(text, '')) AS t, ['rag_system', 'analytics_platform', 'document_ai', 'speech_ai'][file_ord % 4 + 1] AS d, ['medical_ai', 'education_ai'][file_ord % 2 + 1] AS s FROM files),
  h AS ({" UNION ALL ".join(f"SELECT file_ord, {i} AS o, '{k}' AS key, ({_found(w)}) AS hits, d = '{n or ''}' AS own, '{n or ''}' IN ('', d, s) AS fits FROM t" for i, (k, (n, w)) in enumerate(lx.ARCHETYPES.items()))}),
  c AS (SELECT file_ord, o, key, round(CASE WHEN own THEN least(0.95::DOUBLE, least(0.92::DOUBLE, 0.5::DOUBLE + 0.12::DOUBLE * hits) + 0.1::DOUBLE) ELSE least(0.92::DOUBLE, 0.5::DOUBLE + 0.12::DOUBLE * hits) END, 6) AS confidence FROM h WHERE hits > 0 AND fits)
  SELECT file_ord, key, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file_ord ORDER BY confidence DESC, o) AS n FROM c) WHERE n <= 3""")  # fmt: skip
def _(spark, sf):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("file_ord") % len(v) + 1).cast("int"))
    f = files(spark, sf).withColumn("primary_domain", pick("rag_system", "analytics_platform", "document_ai", "speech_ai")).withColumn("secondary", F.array(pick("medical_ai", "education_ai")))
    return classify.detect_archetypes(f).select("file_ord", F.explode("archetypes").alias("a")).select("file_ord", "a.key", "a.confidence")


@query("cls_12_classify_visual")
def _(spark, sf):
    items = files(spark, sf).withColumn("image_count", (F.col("file_ord") % 3).cast("int"))
    return classify.classify_visual(items, {"team": ("@", "+1 ("), "table": ("token", "password"), "chart": ("trend", "rag")}).select("file_ord", "content_type", "confidence")


_STATE = """s AS (SELECT o_custkey AS project_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS team, bool_or(o_orderpriority = '1-URGENT') AS contract, bool_or(o_orderpriority = '2-HIGH') AS shown, bool_or(o_orderpriority = '5-LOW') AS stale,
  bool_or(o_orderstatus = 'O') AS listed FROM orders GROUP BY o_custkey)"""


@query("cls_15_verdict", f"""WITH {_STATE} SELECT project_id, CASE WHEN n = 1 AND team = 0 AND NOT contract AND NOT shown THEN 'single_file_no_team_source' WHEN n >= 2 AND listed AND team = 0 THEN 'docx_present_but_team_missing'
  WHEN (contract OR team > 0) AND NOT shown THEN 'contract_has_team_but_export_missing' WHEN stale THEN 'stale_generated_landing' WHEN n >= 2 AND team > 0 AND shown THEN 'team_pipeline_ok' ELSE 'ambiguous_inconsistent_state' END AS classification FROM s""")  # fmt: skip
def _(spark, sf):
    any_ = lambda c, v: F.bool_or(F.col(c) == v)
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(
        F.count("*").alias("source_count"), F.count_if(F.col("o_orderstatus") == "F").alias("team_structured_count"), any_("o_orderpriority", "1-URGENT").alias("contract_has_team"), any_("o_orderpriority", "2-HIGH").alias("export_has_team"),
        any_("o_orderpriority", "5-LOW").alias("landing_stale"), F.when(any_("o_orderstatus", "O"), F.array(F.lit("a.DOCX"))).otherwise(F.array(F.lit("a.pptx"))).alias("filenames"),
    )
    s = s.withColumns({"evidence_count": F.lit(0), "team_coverage": F.lit("missing"), "is_technical": F.lit(False)})
    return classify.verdict(s).select("project_id", "classification")


@query("cls_16_technical_names", "SELECT p_partkey AS project_id FROM part WHERE p_size % 4 <> 0 AND p_size % 5 > 0")
def _(spark, sf):
    name = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Smoke: "), "p_name")).otherwise(F.col("p_name"))
    return classify.user_projects(table(spark, sf, "part").select(F.col("p_partkey").alias("project_id"), name.alias("name"), (F.col("p_size") % 5).alias("n_files"))).select("project_id")


@query("cls_17_choose_parser", """WITH p AS (SELECT p_partkey AS project_id, p_size % 7 = 0 AS single, p_size % 3 AS n, p_size * 2 AS multi, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 100 END AS deck FROM part)
  SELECT project_id, CASE WHEN single THEN 'structured' WHEN n >= 2 THEN 'fusion' WHEN deck > multi THEN 'project_presentation' WHEN multi >= 70 OR (multi >= 55 AND multi >= coalesce(deck, 0)) THEN 'multi_source_assembly'
  WHEN deck IS NOT NULL THEN 'project_presentation' ELSE 'heuristic' END AS parser_mode FROM p""")  # fmt: skip
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("project_id"), (F.col("p_size") % 7 == 0).alias("single_ready_doc"), (F.col("p_size") % 3).alias("n_sources"), (F.col("p_size") * 2).alias("multi_score"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 100).alias("presentation_score"))
    return classify.choose_parser(p).select("project_id", "parser_mode")


@query("cls_18_candidate_reason", """SELECT p_partkey, CASE WHEN NOT regexp_matches(p_name, '^[a-z]+ [a-z]+$') OR list_has_any(string_split(p_name, ' '), ['red', 'ring']) THEN
    CASE WHEN list_has_any(string_split(p_name, ' '), ['red', 'ring']) THEN 'rejected: domain_stop_word' ELSE 'rejected: not_person_name' END
  WHEN p_size % 2 = 0 THEN 'accepted: valid_name_in_team_context' WHEN contains(lower(p_type), 'standard') AND length(p_type) <= 120 THEN 'accepted: valid_name_with_role' ELSE 'rejected: outside_team_context' END AS reason FROM part""")  # fmt: skip
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("role"), (F.col("p_size") % 2 == 0).alias("in_team_context"))
    return classify.candidate_reason(p, r"^[a-z]+ [a-z]+$", ("standard",), ("red", "ring")).select("p_partkey", "reason")


@query("seg_07_parse_metadata", "WITH {FILES} SELECT file_ord, nullif(trim(regexp_extract(coalesce(text, ''), '(?i)released\\s+under\\s*(.+?)(?:\\n|$)', 1)), '') AS client, nullif(trim(regexp_extract(coalesce(text, ''), '(?i)version\\s*(.+?)(?:\\n|$)', 1)), '') AS timeline FROM files")
def _(spark, sf):
    return documents.parse_metadata(files(spark, sf), FACTS).select("file_ord", "client", "timeline")


@query("seg_08_section_bullets")
def _(spark, sf):
    return files(spark, sf).select("file_ord", F.size(documents.section_bullets(F.col("text"))).alias("n"))


@query("seg_09_parse_modules")
def _(spark, sf):
    numbered = F.array_join(F.transform(tx.lines_of(F.col("text")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return documents.parse_modules(files(spark, sf).withColumn("text", numbered)).groupBy("project_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("name")).alias("chars"))


@query("txt_14_parse_response", "SELECT event_id, json_extract_string(props, '$.k') AS k, 1.0::DOUBLE AS confidence, 'note' AS warnings FROM events")
def _(spark, sf):
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ', "confidence": 3, "note": "x",}'), F.lit("\n```"))
    return documents.parse_response(table(spark, sf, "events").withColumn("text", answer), ("k",), ("items",)).select("event_id", "k", "confidence", joined(F.col("warnings"), ",").alias("warnings"))


@query("txt_15_missing_fields", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'client,team' WHEN p_size % 2 = 0 THEN 'client' WHEN p_size % 3 = 0 THEN 'team' ELSE '' END AS missing FROM part")
def _(spark, sf):
    member = F.array(F.struct(F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise(" ").alias("name"), F.lit("").alias("role"), F.lit(None).cast("string").alias("contribution")))
    p = table(spark, sf, "part").withColumns({"title": F.col("p_name"), "client": F.when(F.col("p_size") % 2 == 0, F.lit("  ")).otherwise(F.col("p_brand")), "team": F.transform(member, lambda m: F.struct(tx.strip(m["name"]).alias("name"), m["role"].alias("role"), m["contribution"].alias("contribution")))})
    out = documents.missing_fields(documents.normalize_output(p, ("title", "client"), "team"), ("title", "client"), ("team",))
    return out.select("p_partkey", joined(F.col("missing_fields"), ",").alias("missing"))


@query("txt_16_compact_context", """WITH {FILES}, p AS (SELECT project_id, file_ord, least(length(text), 3000) AS n FROM files WHERE length(text) > 0),
  q AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY project_id ORDER BY file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
  SELECT project_id, file_ord, least(n, 12000 - before)::INTEGER AS used FROM q WHERE before < 12000""")  # fmt: skip
def _(spark, sf):
    return documents.compact_context(files(spark, sf)).select("project_id", "file_ord", "used")


@query("txt_19_tech_aliases", "SELECT event_id, CASE event_type WHEN 'view' THEN 'PostgreSQL' WHEN 'click' THEN 'Qdrant' WHEN 'error' THEN 'Neo4j' WHEN 'signup' THEN 'Docker Compose' ELSE event_type END AS tech FROM events")
def _(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in {"view": "Postgres ", "click": "Qdrant Cloud", "error": "neo4j aura", "signup": "docker-compose"}.items() for x in kv])
    return table(spark, sf, "events").select("event_id", tx.canonical_tech(F.coalesce(names[F.col("event_type")], "event_type")).alias("tech"))


@query("txt_20_annotate_text", "SELECT conv_id, md5(string_agg('--- turn ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("filename", F.concat(F.lit("turn "), F.col("turn").cast("string")))
    return documents.combine_text(c, "conv_id", "turn", headers=True).select("conv_id", F.md5("text").alias("digest"))


# ---- evidence


def items(spark, sf):
    f = files(spark, sf)
    role = F.when(F.col("file_ord") % 7 == 0, "primary_project_doc").when(F.col("file_ord") % 5 == 0, "module_presentation").otherwise("unknown")
    field = F.get(F.array(F.lit("client"), F.lit("tasks"), F.lit("results")), (F.col("file_ord") % 3).cast("int"))
    return f.select("project_id", F.col("file_ord").alias("item_ord"), field.alias("field"), role.alias("source_role"), "text")


@query("evd_01_build_evidence")
def _(spark, sf):
    return evidence.build_evidence(segment.split_paragraphs(files(spark, sf))).select("evidence_id", "confidence", joined(F.col("technologies")).alias("technologies"), joined(F.col("dates")).alias("dates"))


@query("evd_06_field_labels", "WITH {FILES} SELECT file_ord, field FROM (SELECT file_ord, unnest([CASE WHEN contains(t, 'license') THEN 'title' END, CASE WHEN contains(t, 'rag') OR contains(t, 'llm') THEN 'tech_stack' END, CASE WHEN contains(t, '@') OR contains(t, '+1 (') THEN 'team' END, CASE WHEN contains(t, 'trend') THEN 'results' END]) AS field FROM (SELECT file_ord, lower(text) AS t FROM files)) WHERE field IS NOT NULL")
def _(spark, sf):
    return evidence.field_labels(files(spark, sf), FIELD_RULES).select("file_ord", "field")


@query("evd_09_assemble_scalar")
def _(spark, sf):
    forms = {"client": ((r"(?i)released under (.+)$", 0.8), (r"(?i)licensed under (.+)$", 0.75), (r"(?i)copyright (.+)$", 0.6))}
    return assemble.assemble_scalar(items(spark, sf), forms)


@query("evd_10_assemble_lists")
def _(spark, sf):
    return assemble.assemble_lists(items(spark, sf))


@query("evd_11_assemble_essence")
def _(spark, sf):
    it = items(spark, sf)
    return assemble.assemble_essence(it, it.where("source_role = 'primary_project_doc'"), ("license", "token")).select("project_id", F.md5("essence").alias("digest"))


@query("evd_13_apply_primary", "SELECT coalesce(a.o_custkey, b.o_custkey) AS project_id, coalesce(b.items, a.items)::INTEGER AS n, b.items IS NOT NULL AS from_primary FROM (SELECT o_custkey, count(*) AS items FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS items FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.o_custkey = b.o_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("project_id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("items")).withColumn("field", F.lit("tasks"))
    return assemble.apply_primary(of("F"), of("P")).select("project_id", F.size("items").alias("n"), "from_primary")


@query("evd_18_heuristic_payload")
def _(spark, sf):
    return documents.heuristic_payload(files(spark, sf)).select("file_ord", F.md5("essence").alias("digest"), F.size("tasks").alias("n_tasks"))


# ---- people


@query("team_02_role_quality", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 0.9::DOUBLE WHEN p_size % 2 = 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS quality FROM part")
def _(spark, sf):
    none = F.array().cast("array<string>")
    role, gave = F.when(F.col("p_size") % 3 > 0, F.col("p_type")).otherwise(" "), F.when(F.col("p_size") % 2 == 0, F.array("p_name")).otherwise(none)
    return table(spark, sf, "part").select("p_partkey", people.role_quality(role, gave).alias("quality"))


@query("team_05_resolve_sources")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("name"))
    n = table(spark, sf, "customer").where(F.col("c_custkey") % 2 == 0).select(F.col("c_nationkey").alias("project_id"), F.regexp_replace("c_name", "0000", "00O0").alias("name"), F.col("c_custkey").alias("file_ord"), (F.col("c_custkey") % 3 == 0).alias("is_ocr"))
    return people.resolve_sources(c, n).groupBy("project_id", "resolved").agg(F.count("*").alias("n"))


@query("team_06_verify", """WITH c AS (SELECT p_partkey, (p_partkey % 11) / 10.0::DOUBLE AS q, p_size % 5 = 0 AS mixed, p_size % 2 = 0 AS ocr, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'docx' ELSE 'ocr' END AS src, (p_partkey % 13) / 12.0::DOUBLE AS m, p_partkey % 4 > 0 AS hit, p_size % 7 > 2 AS has_role FROM part),
  r AS (SELECT *, round(m, 3) AS s FROM c) SELECT p_partkey, CASE WHEN q < 0.4::DOUBLE THEN 'name_quality_below_threshold' WHEN mixed AND q < 0.5::DOUBLE THEN 'mixed_script_noise' WHEN NOT ocr AND src = 'docx' AND q >= 0.5::DOUBLE THEN 'trusted_non_ocr_source'
  WHEN s >= 0.88::DOUBLE AND hit THEN 'ocr_matched_trusted_roster' WHEN s >= 0.75::DOUBLE AND s < 0.88::DOUBLE AND hit THEN 'ocr_weak_fuzzy_match' WHEN ocr AND q < 0.6::DOUBLE THEN 'ocr_low_quality_no_trusted_match' WHEN ocr AND NOT has_role THEN 'ocr_only_no_role_or_contributions'
  WHEN ocr THEN 'ocr_only_unverified' WHEN src = '' THEN 'unknown_source_unverified' ELSE 'unverified_probable' END AS reason FROM r""")  # fmt: skip
def _(spark, sf):
    src = F.get(F.array(F.lit(""), F.lit("docx"), F.lit("ocr")), (F.col("p_size") % 3).cast("int"))
    p = table(spark, sf, "part").select(
        "p_partkey", ((F.col("p_partkey") % 11) / 10.0).alias("quality"), (F.col("p_size") % 5 == 0).alias("mixed_script"), (F.col("p_size") % 2 == 0).alias("source_is_ocr"), src.alias("source_type"),
        ((F.col("p_partkey") % 13) / 12.0).alias("match_score"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).alias("trusted"), (F.col("p_size") % 7 > 2).alias("has_role"),
    )
    return people.verify(p).select("p_partkey", "reason")


# ---- architecture graphs


def nodes(spark, sf):
    b = blocks(spark, sf)
    labels = b.select("project_id", F.col("block_key").alias("source"), F.posexplode(tx.label_tokens(F.col("content"))).alias("k", "label"), "block_ord")
    labels = labels.select("project_id", (F.col("block_ord") * 100_000 + F.col("k")).alias("label_ord"), "label", "source", F.lit(False).alias("inferred"))
    types = (("frontend", r"\bthe|les|der\b"), ("backend", r"\band|und|des\b"), ("redis", r"\bor|oder|que\b"))
    return topology.topology_nodes(labels, b, types)


@query("top_01_nodes")
def _(spark, sf):
    return nodes(spark, sf).groupBy("project_id", "layer", "node_type").agg(F.count("*").alias("n"))


@query("top_02_edges")
def _(spark, sf):
    e = entities(spark, sf)
    return topology.topology_edges(nodes(spark, sf), graph.build_relations(e, KG_RULES)).groupBy("project_id", "relation").agg(F.count("*").alias("n"))


@query("sem_01_semantic_sections", """WITH p AS (SELECT conv_id, 0 AS o, 'essence' AS section, 0 AS b FROM conversations UNION SELECT conv_id, 1, 'problem', 1 FROM conversations UNION SELECT conv_id, 2, 'modules', 1 FROM conversations UNION SELECT conv_id, 3, 'team', 99 FROM conversations),
  j AS (SELECT p.*, trim(c.text) <> '' IS TRUE AS has, row_number() OVER (PARTITION BY p.conv_id, p.b ORDER BY p.o) AS r FROM p LEFT JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.b)
  SELECT conv_id AS project_id, o::INTEGER AS section_ord, section, NOT has AS missing FROM j WHERE r = 1 OR NOT has""")  # fmt: skip
def _(spark, sf):
    c = table(spark, sf, "conversations")
    b = c.select(F.col("conv_id").alias("project_id"), F.col("turn").cast("string").alias("block_key"), F.col("text").alias("content"), F.array().cast("array<string>").alias("bullets"))
    plan = F.array(*[F.struct(F.lit(i).alias("section_ord"), F.lit(s).alias("section"), F.lit(k).alias("block_key")) for i, (s, k) in enumerate((("essence", "0"), ("problem", "1"), ("modules", "1"), ("team", "99")))])
    p = c.select(F.col("conv_id").alias("project_id")).distinct().select("project_id", F.explode(plan).alias("p")).select("project_id", "p.*")
    return topology.semantic_sections(b, p).select("project_id", "section_ord", "section", "missing")
