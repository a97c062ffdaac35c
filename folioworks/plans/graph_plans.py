"""Registered queries of graphs, generated sections, cards and checks, with their DuckDB statements.

Customers, fifty a project, stand for entities, labels and items; blocks, links and
relations are written from them by Spark, so all of it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import text as tx
from folioworks.operators import graph, measure, topology
from folioworks.plans.registry import joined, query, table
from folioworks.sources.scratch import written

KINDS = ("project", "module", "pipeline", "technology", "llm", "database", "output", "data_source", "metric")


def sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def pick(values, at):
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def key_of():
    return F.col("c_custkey")


def customers(spark, sf):
    return table(spark, sf, "customer").withColumn("project_id", F.floor(key_of() / 50)).withColumn("rank", (key_of() % 50).cast("int"))


# ---- knowledge graph

ENTITIES = f"""e AS (SELECT c_custkey // 50 AS project_id, (c_custkey % 50)::INTEGER AS rank, c_name AS label, lower(replace(c_name, '#', '')) AS slug, {sql_list(KINDS)}[(c_custkey % 9 + 1)::INTEGER] AS type FROM customer)"""


def named_entities(spark, sf):
    key = key_of()
    return customers(spark, sf).select("project_id", "rank", F.col("c_name").alias("label"), tx.slugify(F.col("c_name")).alias("slug"), pick(KINDS, key % 9).alias("type"))


@query("kg_04_default_relations", f"""WITH {ENTITIES}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id, side ORDER BY place, rank) AS r FROM (
    SELECT e.*, s.side, list_position(s.kinds, e.type) AS place FROM e, (VALUES ('m', {sql_list(graph.MODULES)}), ('t', {sql_list(graph.TECHNOLOGIES)}), ('o', ['output']), ('d', ['data_source']), ('x', ['metric']), ('p', ['project'])) s(side, kinds)) WHERE place > 0),
  rules AS (SELECT * FROM (VALUES (0, 'm', 't', 999, 8, 'uses', 'module_uses_tech:', false), (1, 'm', 'd', 6, 999, 'consumes', 'module_consumes:', true), (2, 'm', 'o', 999, 4, 'produces', 'module_produces:', false),
    (3, 'x', 'o', 999, 3, 'validates', 'metric_validates:', false), (4, 'p', 'm', 1, 8, 'belongs_to', 'project_contains_module', false)) r(rule, s, t, ms, mt, relation, note, byt)),
  u AS (SELECT a.project_id, a.slug AS source, b.slug AS target, relation, rule, CASE WHEN byt THEN b.r ELSE a.r END AS x, CASE WHEN byt THEN a.r ELSE b.r END AS y, CASE WHEN rule = 4 THEN note ELSE note || b.label END AS evidence
    FROM rules JOIN k a ON a.side = s AND a.r <= ms JOIN k b ON b.side = t AND b.r <= mt AND b.project_id = a.project_id
    UNION ALL SELECT e.project_id, e.slug, k.slug, 'depends_on', 5, e.rank, k.r, 'pattern:p' || e.rank FROM e JOIN k ON k.project_id = e.project_id AND k.side = 't' AND k.r <= 3 WHERE e.rank IN (1, 10, 21)),
  n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rule, x, y)::INTEGER AS rel_ord FROM u)
  SELECT project_id, source, target, relation, rel_ord, CASE WHEN rule > 3 THEN 0.45::DOUBLE ELSE 0.7::DOUBLE END AS confidence, rule > 3 AS inferred, evidence FROM n WHERE rel_ord <= 240""")  # fmt: skip
def _(spark, sf):
    e = named_entities(spark, sf)
    patterns = e.where("rank in (1, 10, 21)").select("project_id", F.col("rank").alias("pattern_ord"), F.concat(F.lit("p"), F.col("rank").cast("string")).alias("pattern"), F.array(F.lit("no such module"), "label").alias("related_modules"))
    return graph.build_relations(e, patterns=patterns)


_LABEL = """CASE c_custkey % 10 WHEN 0 THEN 'Common Label' WHEN 1 THEN 'mail ' || c_custkey::VARCHAR || '@host.org' WHEN 2 THEN 'call ' || (10000000000 + c_custkey)::VARCHAR WHEN 3 THEN c_mktsegment WHEN 4 THEN c_mktsegment || ' unit ' || c_custkey::VARCHAR WHEN 5 THEN 'ab' ELSE c_name END"""


@query("kg_05_check_entities", f"""WITH e AS (SELECT c_custkey, c_custkey // 50 AS project_id, c_custkey % 50 AS rank, {_LABEL} AS label, CASE WHEN c_custkey % 3 = 0 THEN 'team_role' ELSE 'module' END AS type, round(0.3::DOUBLE + (c_custkey % 7)::DOUBLE / 10.0::DOUBLE, 6) AS confidence, c_custkey % 11 = 0 AS inferred, c_custkey % 13 > 0 AS safe FROM customer),
  c AS (SELECT c_custkey // 50 AS project_id, string_agg(lower(c_mktsegment), chr(10)) AS corpus FROM customer WHERE c_custkey % 25 = 0 GROUP BY 1),
  w AS (SELECT e.*, coalesce(c.corpus, '') AS corpus, lower(label) AS low, list_filter(regexp_split_to_array(lower(label), '\\W+'), lambda v: length(v) > 2) AS words, row_number() OVER (PARTITION BY e.project_id, lower(label) ORDER BY rank) > 1 AS again FROM e LEFT JOIN c USING (project_id)),
  g AS (SELECT *, length(low) >= 3 AND (contains(corpus, low) OR (len(words) > 0 AND len(list_filter(words, lambda v: contains(corpus, v))) >= greatest(1, len(words) // 2))) AS grounded FROM w),
  s AS (SELECT *, CASE WHEN again THEN 'duplicate' WHEN regexp_matches(label, '\\b[\\w.-]+@[\\w.-]+\\.\\w+\\b') OR regexp_matches(label, '\\b\\+?\\d[\\d\\s\\-()]{{8,}}\\d\\b') THEN 'personal' WHEN NOT inferred AND NOT grounded AND (type = 'team_role' OR confidence < 0.5::DOUBLE) THEN 'ungrounded' ELSE 'kept' END AS status FROM g)
  SELECT project_id, c_custkey, status, grounded, CASE WHEN status = 'kept' THEN concat_ws('|', CASE WHEN inferred AND confidence > 0.6::DOUBLE THEN 'inferred_but_sure' END, CASE WHEN NOT inferred AND NOT grounded THEN 'not_grounded' END, CASE WHEN NOT safe THEN 'not_pii_safe' END) ELSE '' END AS warnings FROM s""")  # fmt: skip
def _(spark, sf):
    key = key_of()
    c = customers(spark, sf)
    number = key.cast("string")
    label = F.when(key % 10 == 0, "Common Label").when(key % 10 == 1, F.concat(F.lit("mail "), number, F.lit("@host.org"))).when(key % 10 == 2, F.concat(F.lit("call "), (key + 10_000_000_000).cast("string")))
    label = label.when(key % 10 == 3, F.col("c_mktsegment")).when(key % 10 == 4, F.concat("c_mktsegment", F.lit(" unit "), number)).when(key % 10 == 5, "ab").otherwise(F.col("c_name"))
    e = c.select("project_id", "c_custkey", "rank", number.alias("slug"), label.alias("label"), F.when(key % 3 == 0, "team_role").otherwise("module").alias("type"), F.round(F.lit(0.3) + (key % 7) / 10.0, 6).alias("confidence"), (key % 11 == 0).alias("inferred"), (key % 13 > 0).alias("pii_safe"))
    b = c.where(key % 25 == 0).select("project_id", F.col("rank").alias("block_ord"), F.col("c_mktsegment").alias("content"))
    return graph.check_entities(e, b).select("project_id", "c_custkey", "status", "grounded", joined(F.col("warnings")).alias("warnings"))


@query("kg_05_orphan_modules", f"""WITH {ENTITIES}, l AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rank, slug) AS r FROM e WHERE type = 'module' AND rank % 4 > 0)
  SELECT project_id, count(*) AS n, string_agg(label, '|' ORDER BY r) FILTER (r <= 5) AS labels FROM l GROUP BY project_id HAVING count(*) > 3""")  # fmt: skip
def _(spark, sf):
    e = named_entities(spark, sf)
    r = e.where("rank % 4 = 0").select("project_id", F.col("slug").alias("source"), F.col("slug").alias("target"))
    return graph.orphan_modules(e, r).select("project_id", "n", joined(F.col("labels")).alias("labels"))


DOMAINS = ("medical_ai", "education_ai", "analytics_platform", "rag_system", "general")


@query("kg_06_summary", f"""WITH {ENTITIES}, x AS (SELECT c_custkey // 50 AS project_id, c_custkey % 50 AS rank, c_custkey FROM customer),
  p AS (SELECT DISTINCT project_id, 0.5::DOUBLE + (project_id % 4)::DOUBLE / 10.0::DOUBLE AS c FROM x), a AS (SELECT project_id, avg(0.5::DOUBLE + (c_custkey % 5)::DOUBLE / 10.0::DOUBLE) AS c FROM x WHERE rank < 3 GROUP BY 1),
  t AS (SELECT project_id, avg(0.9::DOUBLE) AS c FROM x WHERE rank < 2 AND project_id % 2 = 0 GROUP BY 1), n AS (SELECT project_id, count(*) AS n, avg(CASE WHEN type = 'module' THEN 0.82::DOUBLE ELSE 0.75::DOUBLE END) AS c FROM e GROUP BY 1),
  r AS (SELECT project_id, count(*) AS n, avg(CASE WHEN c_custkey % 2 = 0 THEN 0.7::DOUBLE ELSE 0.45::DOUBLE END) AS c FROM x WHERE c_custkey % 3 = 0 GROUP BY 1),
  j AS (SELECT project_id, p.c AS d, coalesce(a.c, 0) AS a, coalesce(t.c, 0) AS t, n.n AS n_entities, n.c AS n, coalesce(r.n, 0) AS n_relations, coalesce(r.c, 0) AS r FROM p LEFT JOIN a USING (project_id) LEFT JOIN t USING (project_id) LEFT JOIN n USING (project_id) LEFT JOIN r USING (project_id))
  SELECT project_id, n_entities, n_relations, round(d, 6) AS domain_confidence, round(a, 6) AS archetype_confidence, round(t, 6) AS pattern_confidence, round(n, 6) AS entity_confidence, round(r, 6) AS relation_confidence, round(least(0.95::DOUBLE, (d + a + t + n + r) / 5), 6) AS overall FROM j""")  # fmt: skip
def _(spark, sf):
    key = key_of()
    c, e = customers(spark, sf), named_entities(spark, sf).withColumn("confidence", F.when(F.col("type") == "module", 0.82).otherwise(0.75))
    profiles = c.select("project_id").distinct().withColumn("confidence", F.lit(0.5) + (F.col("project_id") % 4) / 10.0)
    archetypes = c.where("rank < 3").withColumn("confidence", F.lit(0.5) + (key % 5) / 10.0)
    patterns = c.where("rank < 2 and project_id % 2 = 0").withColumn("confidence", F.lit(0.9))
    relations = c.where(key % 3 == 0).withColumn("confidence", F.when(key % 2 == 0, 0.7).otherwise(0.45))
    return graph.graph_summary(e, relations, profiles, archetypes, patterns)


BLOCK_KEYS = ("tasks", "inputs", "outputs", "results", "tech_stack", "essence")
_CONTENT = "CASE (conv_id + turn) % 5 WHEN 0 THEN '' WHEN 1 THEN text || ' PII' WHEN 2 THEN 'GDPR ' || text ELSE text END"
_ADVICE = " ".join(f"WHEN '{d}' THEN {sql_list(a)}" for d, a in graph.ADVICE.items())


@query("kg_06_notes", f"""WITH b AS (SELECT conv_id AS project_id, turn, {sql_list(BLOCK_KEYS)}[(turn % 6 + 1)::INTEGER] AS k, coalesce({_CONTENT}, '') AS t, CASE WHEN (conv_id + turn) % 2 = 0 THEN [role, ' ', 'line ' || turn::VARCHAR] ELSE []::VARCHAR[] END AS bullets FROM conversations),
  f AS (SELECT *, lower(t) AS low, trim(t, ' ' || chr(9) || chr(10) || chr(13)) = '' AND len(bullets) = 0 AS empty FROM b),
  p AS (SELECT project_id, {sql_list(DOMAINS)}[(project_id % 5 + 1)::INTEGER] AS d, bool_or(contains(low, 'pii') OR contains(low, 'privacy')) AS risky, bool_or(contains(low, 'pii')) AS pii, bool_or(contains(low, 'gdpr') OR contains(low, 'hipaa') OR contains(low, 'compliance')) AS bound, bool_or(k = 'results' AND empty) AS nores,
    [{", ".join(f"CASE WHEN coalesce(arg_min(empty, turn) FILTER (k = '{k}'), true) THEN 'Contract block ''{k}'' is empty' END" for k in graph.NEEDED_BLOCKS)}] AS miss FROM f GROUP BY project_id),
  q AS (SELECT *, list_filter(miss, lambda v: v IS NOT NULL) AS missing FROM p),
  l AS (SELECT project_id, 'risk' AS kind, list_filter([CASE WHEN risky THEN '{graph.RISK_NOTE}' END, CASE WHEN d = 'medical_ai' THEN '{graph.MEDICAL_RISKS[0]}' END, CASE WHEN d = 'medical_ai' THEN '{graph.MEDICAL_RISKS[1]}' END, CASE WHEN nores THEN '{graph.NO_RESULTS}' END], lambda v: v IS NOT NULL) AS notes FROM q
    UNION ALL SELECT project_id, 'missing', missing FROM q UNION ALL SELECT project_id, 'constraint', CASE WHEN pii AND NOT bound THEN ['{graph.PRIVACY_NOTE}'] ELSE [] END FROM q
    UNION ALL SELECT project_id, 'recommendation', list_concat(CASE d {_ADVICE} ELSE [] END, CASE WHEN len(missing) > 0 THEN ['{graph.FILL_NOTE}'] ELSE [] END) FROM q
    UNION ALL SELECT project_id, 'metric', list_filter(bullets, lambda v: trim(v) <> '')[1:10] FROM (SELECT project_id, arg_min(bullets, turn) AS bullets FROM f WHERE k = 'results' GROUP BY 1))
  SELECT project_id, kind, (i - 1)::INTEGER AS note_ord, notes[i] AS note FROM (SELECT *, unnest(range(1, len(notes) + 1)) AS i FROM l)
  UNION ALL SELECT project_id, 'constraint', turn::INTEGER, left(t, 120) FROM f WHERE contains(low, 'gdpr') OR contains(low, 'hipaa') OR contains(low, 'compliance')""")  # fmt: skip
def _(spark, sf):
    c = table(spark, sf, "conversations")
    at = F.col("conv_id") + F.col("turn")
    content = F.when(at % 5 == 0, "").when(at % 5 == 1, F.concat("text", F.lit(" PII"))).when(at % 5 == 2, F.concat(F.lit("GDPR "), "text")).otherwise(F.col("text"))
    bullets = F.when(at % 2 == 0, F.array("role", F.lit(" "), F.concat(F.lit("line "), F.col("turn").cast("string")))).otherwise(F.array().cast("array<string>"))
    b = c.select(F.col("conv_id").alias("project_id"), F.col("turn").alias("block_ord"), pick(BLOCK_KEYS, F.col("turn") % 6).alias("block_key"), content.alias("content"), bullets.alias("bullets"))
    p = c.select(F.col("conv_id").alias("project_id")).distinct().withColumn("domain", pick(DOMAINS, F.col("project_id") % 5))
    return graph.graph_notes(p, b)


# ---- generated sections

_ITEMS = """b AS (SELECT c_custkey // 50 AS project_id, string_agg(lower(c_name || ' ' || c_custkey::VARCHAR || '.' || c_nationkey::VARCHAR), chr(10)) AS corpus FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1),
  i AS (SELECT c_custkey // 50 AS project_id, c_custkey, ['team', 'results', 'modules'][(c_custkey % 3 + 1)::INTEGER] AS section, CASE WHEN c_custkey % 4 < 2 THEN 'metric' ELSE 'bullet' END AS kind,
    CASE WHEN c_custkey % 4 < 2 THEN CASE c_custkey % 5 WHEN 0 THEN 'no number' WHEN 1 THEN (c_custkey * 7)::VARCHAR || ' clients' ELSE c_custkey::VARCHAR || ',' || c_nationkey::VARCHAR || '% of 9999999' END ELSE CASE c_custkey % 5 WHEN 0 THEN 'Mr Po' WHEN 1 THEN c_mktsegment || ' lead' ELSE c_name END END AS item FROM customer),
  w AS (SELECT i.*, coalesce(corpus, '') AS corpus, CASE WHEN kind = 'metric' THEN list_transform(regexp_extract_all(lower(item), '[0-9]+([.,][0-9]+)?'), lambda v: replace(v, ',', '.')) WHEN section = 'team' THEN list_filter(regexp_split_to_array(lower(item), '\\W+'), lambda v: length(v) > 3) ELSE [] END AS asked FROM i LEFT JOIN b USING (project_id)),
  v AS (SELECT *, (len(asked) = 0 AND NOT (kind = 'bullet' AND section = 'team')) OR len(list_filter(asked, lambda n: contains(corpus, n))) > 0 AS verified FROM w)"""  # fmt: skip


def section_items(spark, sf):
    key = key_of()
    c = customers(spark, sf)
    number, nation = key.cast("string"), F.col("c_nationkey").cast("string")
    metric = F.when(key % 5 == 0, "no number").when(key % 5 == 1, F.concat((key * 7).cast("string"), F.lit(" clients"))).otherwise(F.concat(number, F.lit(","), nation, F.lit("% of 9999999")))
    bullet = F.when(key % 5 == 0, "Mr Po").when(key % 5 == 1, F.concat("c_mktsegment", F.lit(" lead"))).otherwise(F.col("c_name"))
    kind = F.when(key % 4 < 2, "metric").otherwise("bullet")
    items = c.select("project_id", (key % 3).alias("section_ord"), pick(("team", "results", "modules"), key % 3).alias("section"), kind.alias("kind"), key.alias("item_ord"), F.when(key % 4 < 2, metric).otherwise(bullet).alias("item"))
    blocks = c.where(key % 2 == 0).select("project_id", F.col("rank").alias("block_ord"), F.concat("c_name", F.lit(" "), number, F.lit("."), nation).alias("content"))
    return graph.ground_items(items, blocks)


@query("sem_02_ground_items", f"WITH {_ITEMS} SELECT project_id, c_custkey AS item_ord, kind, section, item, verified FROM v")
def _(spark, sf):
    return section_items(spark, sf).select("project_id", "item_ord", "kind", "section", "item", "verified")


@query("sem_02_ground_sections", f"""WITH {_ITEMS}, n AS (SELECT project_id, section, count(*) FILTER (kind = 'metric' AND verified) AS n_metrics, count(*) FILTER (kind = 'metric' AND NOT verified) AS lost_metrics, count(*) FILTER (kind = 'bullet' AND verified) AS n_bullets, count(*) FILTER (kind = 'bullet' AND NOT verified) AS lost_bullets FROM v GROUP BY 1, 2)
  SELECT *, CASE WHEN lost_metrics > 0 THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END AS grounding, concat_ws('|', CASE WHEN lost_metrics > 0 THEN 'metrics_unverified' END, CASE WHEN section = 'team' AND n_bullets = 0 AND lost_bullets > 0 THEN 'team' END) AS missing FROM n""")  # fmt: skip
def _(spark, sf):
    return graph.ground_sections(section_items(spark, sf)).drop("section_ord").withColumn("missing", joined(F.col("missing")))


# ---- architecture graph

WORDS = ("React UI", "FastAPI core", "Redis cache", "Upload form", "Queue worker", "Landing page", "Privacy guard", "Postgres base", "Qdrant store", "Grafana view", "Kong proxy", "Plain thing")
_TYPE = " ".join(f"WHEN regexp_matches(label, '(?i){p}') THEN '{t}'" for t, p in topology.NODE_TYPES)
_LAYER = " ".join(f"WHEN node_type IN ({', '.join(repr(t) for t in ts)}) THEN '{n}'" for n, ts in topology.LAYERS.items())
_FIRST = lambda c: f"arg_min(slug, node_ord) FILTER ({c})"
_FLOW = ", ".join(f"{_FIRST(f'''regexp_matches(lower(label), '{p}')''')} AS {k}" for k, p in topology.FLOW.items())
TOPOLOGY = f"""c AS (SELECT c_custkey // 50 AS project_id, c_custkey % 50 AS rank, {sql_list(WORDS)}[(c_custkey % 50 % 12 + 1)::INTEGER] || ' ' || (c_custkey % 50 // 12)::VARCHAR AS label FROM customer),
  t AS (SELECT project_id, string_agg(lower(label), chr(10)) AS corpus FROM c WHERE rank % 4 = 0 GROUP BY 1),
  a AS (SELECT project_id, rank, label, rank % 10 = 9 AS inferred FROM c UNION ALL SELECT project_id, 1099511627776, 'Data Ingestion', true FROM c WHERE rank = 0 UNION ALL SELECT project_id, 1099511627777, 'Output Delivery', true FROM c WHERE rank = 4 AND project_id % 2 = 0),
  w AS (SELECT a.*, corpus, list_filter(regexp_split_to_array(lower(label), '\\W+'), lambda v: length(v) > 2) AS words FROM a LEFT JOIN t USING (project_id)),
  g AS (SELECT *, coalesce(contains(corpus, lower(label)) OR (len(words) > 0 AND len(list_filter(words, lambda v: contains(corpus, v))) >= greatest(1, len(words) // 2)), false) AS grounded FROM w),
  m AS (SELECT project_id, rank AS node_ord, label, lower(replace(label, ' ', '-')) AS slug, CASE WHEN grounded THEN 0.85::DOUBLE ELSE 0.45::DOUBLE END AS confidence, inferred OR NOT grounded AS inferred, CASE {_TYPE} ELSE 'generic' END AS node_type FROM g WHERE grounded OR inferred),
  n AS (SELECT *, CASE {_LAYER} ELSE 'backend' END AS layer FROM m)"""  # fmt: skip
EDGES = f"""f AS (SELECT project_id, {_FLOW}, {_FIRST("node_type = 'frontend'")} AS front, {_FIRST("node_type = 'backend'")} AS back, {_FIRST("layer = 'data'")} AS data FROM n GROUP BY 1),
  l AS (SELECT c.project_id, c.rank AS ord, c.label, lower(split_part({sql_list(WORDS)}[((c.rank + 5) % 12 + 1)::INTEGER], ' ', 1)) AS conn FROM c WHERE c.rank IN (0, 13, 24, 36)),
  x AS (SELECT project_id, 0 AS phase, ord, arg_min(s.slug, s.node_ord) AS source, any_value(t) AS target, 'link' AS relation, 0.9::DOUBLE AS confidence, false AS inferred FROM (SELECT l.*, (SELECT arg_min(n.slug, n.node_ord) FROM n WHERE n.project_id = l.project_id AND contains(lower(n.label), l.conn)) AS t FROM l) l JOIN n s USING (project_id) WHERE lower(s.label) = lower(l.label) GROUP BY 1, 2, 3
    UNION ALL SELECT project_id, 1, 0, ingestion, orchestrator, 'process', 0.8, false FROM f UNION ALL SELECT project_id, 1, 1, orchestrator, output, 'deliver', 0.8, false FROM f
    UNION ALL SELECT project_id, 1, 2, ingestion, pii, 'scan', 0.85, false FROM f WHERE orchestrator IS NOT NULL UNION ALL SELECT project_id, 1, 3, pii, orchestrator, 'safe payload', 0.85, false FROM f WHERE ingestion IS NOT NULL
    UNION ALL SELECT project_id, 2, list_position({sql_list(topology.LAYERS)}, layer), slug, lead(slug) OVER (PARTITION BY project_id, layer ORDER BY node_ord), 'layer:' || layer, 0.4, true FROM n
    UNION ALL SELECT project_id, 3, 4, front, back, 'API', 0.5, true FROM f UNION ALL SELECT project_id, 3, 5, back, data, 'persist', 0.5, true FROM f
    UNION ALL SELECT a.project_id, 4, a.rank + 1, lower(replace(a.label, ' ', '-')), lower(replace(b.label, ' ', '-')), 'uses', 0.7, a.rank % 2 = 0 FROM c a JOIN c b ON a.project_id = b.project_id AND b.rank = (a.rank * 7 + 3) % 50),
  y AS (SELECT x.*, row_number() OVER (PARTITION BY x.project_id, source, target ORDER BY phase, ord) AS r FROM x JOIN n a ON a.project_id = x.project_id AND a.slug = source JOIN n b ON b.project_id = x.project_id AND b.slug = target WHERE source <> target)"""  # fmt: skip


def architecture(spark, sf):
    c = customers(spark, sf).select("project_id", "rank", F.concat(pick(WORDS, F.col("rank") % 12), F.lit(" "), F.floor(F.col("rank") / 12).cast("string")).alias("label"))
    kind = F.when(F.col("rank") == 0, "inputs").when((F.col("rank") == 4) & (F.col("project_id") % 2 == 0), "outputs").otherwise("tasks")
    blocks = c.where("rank % 4 = 0").select("project_id", F.col("rank").alias("block_ord"), kind.alias("block_key"), F.col("label").alias("content"), F.array().cast("array<string>").alias("bullets"))
    labels = c.select("project_id", F.col("rank").cast("long").alias("label_ord"), "label", F.lit("tasks").alias("source"), (F.col("rank") % 10 == 9).alias("inferred")).unionByName(topology.pipeline_anchors(blocks))
    nodes = written(topology.topology_nodes(labels, blocks), "nodes")  # read by every kind of edge
    links = c.where("rank in (0, 13, 24, 36)").select("project_id", F.col("rank").alias("link_ord"), F.upper("label").alias("label"), F.split(pick(WORDS, (F.col("rank") + 5) % 12), " ")[0].alias("connection"))
    slug = tx.slugify(F.col("label"), 48, "node")
    ends = c.select("project_id", F.col("rank").alias("to"), slug.alias("target"))
    relations = c.select("project_id", ((F.col("rank") * 7 + 3) % 50).alias("to"), slug.alias("source"), (F.col("rank") + 1).alias("rel_ord"), F.lit("uses").alias("relation"), F.lit(0.7).alias("confidence"), (F.col("rank") % 2 == 0).alias("inferred")).join(ends, ["project_id", "to"])
    return nodes, links, relations


@query("top_01_default_nodes", f"WITH {TOPOLOGY} SELECT project_id, slug, label, node_type, layer, confidence, inferred FROM n")
def _(spark, sf):
    return architecture(spark, sf)[0].select("project_id", "slug", "label", "node_type", "layer", "confidence", "inferred")


@query("top_02_default_edges", f"WITH {TOPOLOGY}, {EDGES} SELECT project_id, source, target, relation, confidence, inferred FROM y WHERE r = 1")
def _(spark, sf):
    nodes, links, relations = architecture(spark, sf)
    return topology.topology_edges(nodes, relations, links)


@query("top_03_validate", f"""WITH {TOPOLOGY}, r AS (SELECT c_custkey // 50 AS project_id, c_custkey % 50 AS rank, (c_custkey % 50 * 7 + 3) % 50 AS other FROM customer),
  e AS (SELECT a.project_id, lower(replace(a.label, ' ', '-')) AS source, lower(replace(b.label, ' ', '-')) AS target, CASE WHEN r.rank % 3 = 0 THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM r JOIN c a ON a.project_id = r.project_id AND a.rank = r.rank JOIN c b ON b.project_id = r.project_id AND b.rank = r.other WHERE r.rank < 30),
  v AS (SELECT *, (project_id, source) IN (SELECT (project_id, slug) FROM n) AND (project_id, target) IN (SELECT (project_id, slug) FROM n) AS valid FROM e),
  k AS (SELECT project_id, count(*) AS n_nodes, count(*) FILTER (inferred) AS n_inferred FROM n GROUP BY 1), s AS (SELECT project_id, count(*) FILTER (valid) AS n_edges, count(*) FILTER (NOT valid) AS dropped, count(*) FILTER (valid AND confidence < 0.5::DOUBLE) AS n_weak_edges FROM v GROUP BY 1),
  o AS (SELECT project_id, count(*) AS n_orphans FROM n WHERE (project_id, slug) NOT IN (SELECT (project_id, source) FROM v WHERE valid UNION ALL SELECT (project_id, target) FROM v WHERE valid) GROUP BY 1),
  j AS (SELECT project_id, n_nodes, n_inferred, coalesce(n_edges, 0) AS n_edges, coalesce(dropped, 0) AS dropped, coalesce(n_weak_edges, 0) AS n_weak_edges, coalesce(n_orphans, 0) AS n_orphans FROM k LEFT JOIN s USING (project_id) LEFT JOIN o USING (project_id)),
  d AS (SELECT *, CASE WHEN n_nodes > 1 THEN n_edges::DOUBLE / (n_nodes * (n_nodes - 1))::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM j)
  SELECT * EXCLUDE (raw), round(raw, 4) AS density, concat_ws('|', CASE WHEN dropped > 0 THEN 'dropped_edges' END, CASE WHEN n_orphans > 0 AND n_nodes > 1 THEN 'orphan_nodes' END, CASE WHEN n_weak_edges > 0 THEN 'low_confidence_edges' END, CASE WHEN n_inferred > n_nodes // 2 THEN 'mostly_inferred' END, CASE WHEN raw > 0.35::DOUBLE THEN 'dense' END, CASE WHEN n_nodes > 40 THEN 'large' END) AS warnings FROM d""")  # fmt: skip
def _(spark, sf):
    nodes, _, relations = architecture(spark, sf)
    edges = relations.where("rel_ord <= 30").withColumn("confidence", F.when((F.col("rel_ord") - 1) % 3 == 0, 0.4).otherwise(0.7))
    return topology.validate_topology(nodes, edges).withColumn("warnings", joined(F.col("warnings")))


# ---- cards and checks


@query("met_03_project_cards", f"""WITH k AS (SELECT c_custkey AS project_id, [c_custkey % 3, c_custkey % 2, c_custkey % 5 // 3, 0, c_custkey % 7] AS n FROM customer),
  r AS (SELECT project_id, CASE WHEN n[i + 1] = 0 THEN 3 ELSE 2 END AS phase, 0.0::DOUBLE AS weight, i AS ord, {sql_list(label for _, label in measure.COUNT_CARDS)}[(i + 1)::INTEGER] AS label, n[i + 1]::VARCHAR AS value, CASE WHEN n[i + 1] = 0 THEN 'fallback' ELSE 'derived' END AS origin FROM (SELECT *, unnest(range(5)) AS i FROM k) WHERE n[i + 1] > 0 OR i < 4
    UNION ALL SELECT o_custkey, 0, -floor(o_totalprice), o_orderkey, o_orderpriority, floor(o_totalprice)::BIGINT::VARCHAR || '+ posts', 'extracted' FROM orders WHERE o_custkey IN (SELECT project_id FROM k) AND o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1, 0.0, o_orderkey, 'Recall', o_orderkey::VARCHAR || '%', 'extracted' FROM orders WHERE o_custkey IN (SELECT project_id FROM k) AND o_orderstatus = 'F'),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, label ORDER BY phase, weight, ord) AS x FROM r) WHERE x = 1), h AS (SELECT *, count(*) FILTER (phase < 3) OVER (PARTITION BY project_id) AS have FROM f),
  s AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY phase, weight, ord, label)::INTEGER AS card FROM h WHERE phase < 3 OR have < 4)
  SELECT project_id, card, label, value, origin FROM s WHERE card <= 6""")  # fmt: skip
def _(spark, sf):
    key = key_of()
    counts = table(spark, sf, "customer").select(key.alias("project_id"), (key % 3).alias("modules"), (key % 2).alias("team"), F.floor(key % 5 / 3).alias("stack"), F.lit(None).cast("long").alias("tasks"), (key % 7).alias("results"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("ord"), "o_orderpriority", "o_orderstatus", F.floor("o_totalprice").cast("string").alias("price"))
    extracted = o.where("o_orderstatus = 'P'").withColumns({"label": F.col("o_orderpriority"), "value": F.concat("price", F.lit("+ posts"))})
    product = o.where("o_orderstatus = 'F'").withColumns({"label": F.lit("Recall"), "value": F.concat(F.col("ord").cast("string"), F.lit("%"))})
    return measure.project_cards(counts, extracted, product)


@query("eval_03_errors", """WITH c AS (SELECT c_custkey AS p, CASE c_custkey % 5 WHEN 0 THEN 'Проект:' WHEN 1 THEN 'abc' WHEN 2 THEN '' ELSE c_name END AS title, c_mktsegment AS mode, c_custkey % 100 AS score, c_custkey % 6 = 0 AS dump, c_custkey % 17 > 0 AS known FROM customer),
  i AS (SELECT o_custkey AS p, ['stack', 'module', 'team', 'team'][(o_orderkey % 4 + 1)::INTEGER] AS kind, o_orderkey % 4 = 3 AS line, lower(o_orderpriority || ' ' || o_orderstatus) AS name FROM orders),
  n AS (SELECT p, count(*) FILTER (kind = 'module') AS nm, count(*) FILTER (kind = 'team' AND NOT line) AS nt FROM i GROUP BY 1),
  j AS (SELECT c.p, known, CASE WHEN known THEN title ELSE '' END AS title, mode, CASE WHEN known THEN score ELSE 0 END AS score, known AND dump AS dump, coalesce(nm, 0) AS nm, coalesce(nt, 0) AS nt FROM c LEFT JOIN n USING (p)),
  w AS (SELECT c.p, a.* FROM c, (VALUES ('stack', 'stack', 'HIGH', false), ('module', 'module', 'low', false), ('module', 'module', 'MEDIUM', false), ('team', 'team', 'urgent f', false), ('forbidden_team', 'team', 'specified o', true)) a(chk, kind, wanted, bad))
  SELECT p AS project_id, 'missing_contract' AS "check", '' AS wanted FROM j WHERE NOT known UNION ALL SELECT p, 'parser_mode', 'FURNITURE' FROM j WHERE known AND p % 2 = 0 AND mode <> 'FURNITURE'
  UNION ALL SELECT p, 'generic_title', '' FROM j WHERE length(title) < 4 OR title = 'Проект:' UNION ALL SELECT p, 'title', 'customer#|zzz' FROM j WHERE p % 3 = 0 AND NOT contains(lower(title), 'customer#')
  UNION ALL SELECT p, 'completeness', '30' FROM j WHERE score < 30 UNION ALL SELECT p, 'essence', '' FROM j WHERE dump AND p % 4 > 0 UNION ALL SELECT p, 'modules_count', '2' FROM j WHERE nm < 2 UNION ALL SELECT p, 'team_count', '3' FROM j WHERE nt < 3
  UNION ALL SELECT p, chk, wanted FROM w WHERE bad = EXISTS (SELECT 1 FROM i WHERE i.p = w.p AND i.kind = w.kind AND contains(i.name, lower(w.wanted)))""")  # fmt: skip
def _(spark, sf):
    key = key_of()
    c = table(spark, sf, "customer")
    title = F.when(key % 5 == 0, "Проект:").when(key % 5 == 1, "abc").when(key % 5 == 2, F.lit(None)).otherwise(F.col("c_name"))
    contracts = c.where(key % 17 > 0).select(key.alias("project_id"), title.alias("title"), F.col("c_mktsegment").alias("parser_mode"), (key % 100).alias("completeness"), F.when(key % 6 == 0, " Slide 1: all").otherwise("text").alias("essence"))
    kinds = ("stack", "module", "team", "team_line")
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), pick(kinds, F.col("o_orderkey") % 4).alias("kind"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("name"))
    words = lambda *ws: F.array(*[F.lit(w) for w in ws])
    expected = c.select(
        key.alias("project_id"), F.when(key % 2 == 0, "FURNITURE").alias("parser_mode"), F.when(key % 3 == 0, words("customer#", "zzz")).alias("title_contains"), F.lit(30).alias("min_completeness"), F.lit(2).alias("min_modules"), F.lit(3).alias("min_team"),
        words("HIGH").alias("must_have_stack"), words("low", "MEDIUM").alias("must_have_modules"), words("urgent f").alias("must_have_team"), words("specified o").alias("forbidden_team"), F.lit(None).cast("boolean").alias("reject_generic_title"), (key % 4 > 0).alias("reject_essence_slide1"),
    )
    return measure.acceptance_errors(contracts, items, expected)


@query("eval_04_consistency", """WITH o AS (SELECT o_custkey AS p, max(o_orderdate) FILTER (o_orderstatus = 'F') AS contract_at, max(o_orderdate) FILTER (o_orderstatus = 'O') AS page_at, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_team, count(*) FILTER (o_orderpriority = '2-HIGH') AS refs, count(*) AS n_sources,
    count(*) FILTER (o_orderstatus = 'P') > 0 AS page_team, count(*) FILTER (o_orderpriority = '5-LOW') > 0 AS export_team, min(o_totalprice) < 20000 AS empty FROM orders GROUP BY 1),
  s AS (SELECT c_custkey, p IS NOT NULL AS known, contract_at, page_at, coalesce(n_team, 0) AS n_team, coalesce(refs, 0) AS refs, n_sources, coalesce(page_team, false) AS page_team, coalesce(export_team, false) AS export_team, c_custkey % 2 = 0 AS docx, coalesce(empty, false) AS empty FROM customer LEFT JOIN o ON p = c_custkey),
  t AS (SELECT *, contract_at IS NOT NULL AND page_at IS NOT NULL AND (contract_at > page_at OR (n_team > 0 AND NOT page_team)) AS stale FROM s)
  SELECT c_custkey AS project_id, stale, CASE WHEN NOT known THEN 'stale_export_or_wrong_project' WHEN stale THEN 'stale_generated_landing' WHEN docx AND empty THEN 'uploaded_docx_but_extraction_missing' WHEN refs > 0 AND n_team = 0 THEN 'evidence_has_team_but_contract_missing' WHEN n_team > 0 AND page_at IS NOT NULL AND NOT page_team THEN 'contract_has_team_but_landing_missing'
    WHEN page_team AND NOT export_team THEN 'landing_has_team_but_export_missing' WHEN n_team > 0 AND NOT export_team THEN 'contract_has_team_but_export_missing' WHEN n_sources = 1 AND n_team = 0 THEN 'single_file_no_team_source' WHEN docx AND n_team = 0 THEN 'uploaded_docx_but_extraction_missing' ELSE 'OK' END AS lost_at FROM t""")  # fmt: skip
def _(spark, sf):
    key = key_of()
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    last = lambda s: F.max(F.when(status == s, F.col("o_orderdate")))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(
        last("F").alias("contract_at"), last("O").alias("page_at"), F.count_if(priority == "1-URGENT").alias("n_team"), F.count_if(priority == "2-HIGH").alias("team_refs"), F.count("*").alias("n_sources"),
        (F.count_if(status == "P") > 0).alias("page_has_team"), (F.count_if(priority == "5-LOW") > 0).alias("export_has_team"), (F.min("o_totalprice") < 20000).alias("docx_empty"), F.lit(True).alias("exists"),
    )
    s = table(spark, sf, "customer").select(key.alias("project_id"), (key % 2 == 0).alias("has_docx"), F.lit("missing").alias("team_coverage")).join(o, "project_id", "left")
    s = s.withColumn("has_contract", F.col("contract_at").isNotNull()).withColumn("has_page", F.col("page_at").isNotNull())
    return measure.consistency(s).select("project_id", "stale", "lost_at")
