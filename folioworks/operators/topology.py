"""Architecture graphs and planned sections (TOP-1 .. TOP-3, SEM-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import text as tx
from folioworks.operators.graph import ground_labels, orphans
from folioworks.operators.occurrences import occurring

# Which words make which node, first match wins, and the layer of each type; layers in order.
NODE_TYPES = (
    ("frontend", r"\breact|next\.?js|vue|angular|frontend|ui\b"), ("backend", r"\bfastapi|django|flask|express|backend|api server\b"),
    ("ai_service", r"\bopenai|llm|gpt|claude|langchain|ai service\b"), ("llm_gateway", r"\bllm gateway|model gateway|inference gateway\b"),
    ("vector_db", r"\bvector|pinecone|weaviate|qdrant|chromadb|pgvector\b"), ("postgres", r"\bpostgres|postgresql|mysql|sqlite\b"),
    ("redis", r"\bredis|memcached\b"), ("queue", r"\bqueue|kafka|rabbitmq|celery|sqs\b"), ("orchestrator", r"\borchestrat|airflow|prefect|dag\b"),
    ("worker", r"\bworker|consumer|processor\b"), ("analytics", r"\banalytics|grafana|metabase|dashboard\b"), ("api_gateway", r"\bapi gateway|kong|nginx|traefik\b"),
    ("external_api", r"\bexternal api|third.?party|webhook\b"), ("security_layer", r"\bsecurity|auth|oauth|jwt|iam\b"), ("pii_guard", r"\bpii|privacy|redact|guard\b"),
    ("monitoring", r"\bmonitor|prometheus|sentry|observability\b"), ("storage", r"\bs3|storage|blob|minio|file store\b"),
)
LAYERS = {
    "frontend": ("frontend", "api_gateway"),
    "orchestration": ("orchestrator", "worker", "queue"),
    "ai": ("ai_service", "llm_gateway"),
    "backend": ("backend", "analytics", "external_api", "generic"),
    "data": ("vector_db", "postgres", "redis", "storage"),
    "security": ("security_layer", "pii_guard"),
    "infra": ("monitoring",),
}
# Nodes that a project with such a block has in any case; confidences of nodes; longest label.
ANCHORS = (("inputs", "Data Ingestion"), ("outputs", "Output Delivery"))
GROUNDED, GUESSED, LABEL_CHARS = 0.85, 0.45, 80
# From where on a graph is called weak, dense or large.
WEAK_EDGE, DENSE, LARGE = 0.5, 0.35, 40
# Words by which the stages of a data flow are found.
FLOW = {"ingestion": "ingestion|input|upload", "orchestrator": "orchestrat|pipeline|worker|processor", "output": "output|delivery|preview|landing", "pii": "pii|privacy|guard|redact"}


def node_type(label: Column, types: tuple[tuple[str, str], ...] = NODE_TYPES) -> Column:
    """TOP-1: the first type whose words a label has, else generic."""
    out = F.lit("generic")
    for t, p in reversed(types):
        out = F.when(label.rlike("(?iU)" + p), t).otherwise(out)
    return out


def pipeline_anchors(blocks: DataFrame, after: int = 1 << 40, anchors: tuple[tuple[str, str], ...] = ANCHORS) -> DataFrame:
    """TOP-1: inferred labels behind all others (label_ord from ``after``) for projects whose block of that key has text or bullets."""
    lit = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(v).alias("v")) for i, (k, v) in enumerate(anchors)])
    full = (F.coalesce("content", F.lit("")) != "") | (F.coalesce(F.size("bullets"), F.lit(0)) > 0)
    has = blocks.where(full).select("project_id", F.explode(F.filter(lit, lambda x: x["k"] == F.col("block_key"))).alias("a")).select("project_id", "a.*").distinct()
    return has.select("project_id", (F.lit(after).cast("long") + F.col("i")).alias("label_ord"), F.col("v").alias("label"), F.col("k").alias("source"), F.lit(True).alias("inferred"))


def topology_nodes(labels: DataFrame, blocks: DataFrame, types: tuple[tuple[str, str], ...] = NODE_TYPES) -> DataFrame:
    """TOP-1: nodes of (project_id, label_ord, label, source, inferred) labels, held against the blocks (project_id, block_ord, content) of their project.

    A label, cut at 80 characters, is a node if it is grounded or inferred; one a slug,
    the first label, with all its sources in order.  Null and one-character labels are none.
    """
    rows = labels.withColumn("label", F.substring(tx.squeeze(F.col("label")), 1, LABEL_CHARS)).where(F.length("label") >= 2)
    rows = rows.withColumn("slug", tx.slugify(F.col("label"), 48, "node"))
    checked = ground_labels(rows.select("project_id", "slug", "label").distinct(), blocks)
    rows = rows.join(checked, ["project_id", "slug", "label"], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False))).where("grounded or inferred")
    once = rows.groupBy("project_id", "slug", "source").agg(F.min(F.struct("label_ord", "label", "grounded", "inferred")).alias("m"))
    sources = F.transform(F.array_sort(F.collect_list(F.struct("m.label_ord", "source"))), lambda x: x["source"])
    nodes = once.groupBy("project_id", "slug").agg(F.min("m").alias("m"), sources.alias("sources"))
    sure = F.when(F.col("m.grounded"), GROUNDED).otherwise(GUESSED)
    out = nodes.select("project_id", "slug", F.col("m.label_ord").alias("node_ord"), F.col("m.label").alias("label"), sure.alias("confidence"), (F.col("m.inferred") | ~F.col("m.grounded")).alias("inferred"), "sources")
    out = out.withColumn("node_type", node_type(F.col("label"), types))
    layer = F.create_map(*[F.lit(x) for name, ts in LAYERS.items() for t in ts for x in (t, name)])
    return out.withColumn("layer", F.coalesce(layer[F.col("node_type")], F.lit("backend")))


def explicit_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """TOP-2: (project_id, link_ord, source, target) of links (project_id, link_ord, label, connection).

    The source is the first node whose label equals the link's, but for case; the
    target the first node whose label holds the connection.  Links without either go.
    """
    low = nodes.select("project_id", "node_ord", "slug", F.lower("label").alias("low"))
    starts = low.groupBy("project_id", "low").agg(F.min_by("slug", F.struct("node_ord", "slug")).alias("source"))
    asked = links.select("project_id", "link_ord", F.lower("label").alias("low"), F.lower("connection").alias("needle"))
    found = occurring(low.select("project_id", F.col("slug").alias("file_ord"), F.col("low").alias("text")), asked.select("project_id", "needle"))
    ends = found.withColumnRenamed("file_ord", "slug").join(low.select("project_id", "slug", "node_ord"), ["project_id", "slug"])
    ends = ends.groupBy("project_id", "needle").agg(F.min_by("slug", F.struct("node_ord", "slug")).alias("target"))
    return asked.join(starts, ["project_id", "low"]).join(ends, ["project_id", "needle"]).select("project_id", "link_ord", "source", "target")


def topology_edges(nodes: DataFrame, relations: DataFrame | None = None, links: DataFrame | None = None, top: int = 60) -> DataFrame:
    """TOP-2: (project_id, source, target, relation, confidence, inferred), no loops, the first of equal ends.

    In order: the links of ``explicit_links``, the project's data flow, chains inside
    layers, links between layers, then the first ``top`` of its relations (source,
    target, relation, rel_ord, confidence, inferred) whose ends are nodes.
    """
    edge = lambda phase, at, a, b, name, conf, guess: F.struct(F.lit(phase).alias("phase"), at.cast("long").alias("at"), a.alias("source"), b.alias("target"), name.alias("relation"), conf.cast("double").alias("confidence"), guess.alias("inferred"))
    first = lambda c: F.min(F.when(c, F.struct("node_ord", "slug")))["slug"]
    label = F.lower("label")
    found = nodes.groupBy("project_id").agg(
        *[first(label.rlike(p)).alias(k) for k, p in FLOW.items()], first(F.col("node_type") == "frontend").alias("front"), first(F.col("node_type") == "backend").alias("back"), first(F.col("layer") == "data").alias("data")
    )
    safe = F.col("pii").isNotNull() & F.col("ingestion").isNotNull() & F.col("orchestrator").isNotNull()
    always = F.lit(True)
    rules = ((1, "ingestion", "orchestrator", "process", 0.8, always), (1, "orchestrator", "output", "deliver", 0.8, always), (1, "ingestion", "pii", "scan", 0.85, safe), (1, "pii", "orchestrator", "safe payload", 0.85, safe), (3, "front", "back", "API", 0.5, always), (3, "back", "data", "persist", 0.5, always))
    of = lambda k, phase, a, b, name, conf, c: F.when(c & F.col(a).isNotNull() & F.col(b).isNotNull(), edge(phase, F.lit(k), F.col(a), F.col(b), F.lit(name), F.lit(conf), F.lit(phase == 3)))
    every = found.select("project_id", F.explode(F.array_compact(F.array(*[of(k, *r) for k, r in enumerate(rules)]))).alias("e"))
    at = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    nxt = F.lead("slug").over(Window.partitionBy("project_id", "layer").orderBy("node_ord", "slug"))
    chain = nodes.withColumn("target", nxt).where("target is not null")
    every = every.unionByName(chain.select("project_id", edge(2, at, F.col("slug"), F.col("target"), F.concat(F.lit("layer:"), "layer"), F.lit(0.4), F.lit(True)).alias("e")))
    if links is not None:
        given = explicit_links(nodes, links)
        every = every.unionByName(given.select("project_id", edge(0, F.col("link_ord"), F.col("source"), F.col("target"), F.lit("link"), F.lit(0.9), F.lit(False)).alias("e")))
    if relations is not None:
        ends = nodes.select("project_id", "slug")
        r = relations.where(F.col("rel_ord") <= top).join(ends.withColumnRenamed("slug", "source"), ["project_id", "source"], "left_semi").join(ends.withColumnRenamed("slug", "target"), ["project_id", "target"], "left_semi")
        every = every.unionByName(r.select("project_id", edge(4, F.col("rel_ord"), F.col("source"), F.col("target"), F.col("relation"), F.col("confidence"), F.col("inferred")).alias("e")))
    once = every.where("e.source != e.target").groupBy("project_id", "e.source", "e.target").agg(F.min("e").alias("m"))
    return once.select("project_id", "source", "target", "m.relation", "m.confidence", "m.inferred")


def validate_topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TOP-3: by project with nodes: n_nodes, n_edges (both ends are nodes), dropped, n_orphans, n_weak_edges, n_inferred, density and warnings.

    warnings, in this order: *dropped_edges*, *orphan_nodes* (of two nodes or more),
    *low_confidence_edges*, *mostly_inferred* (more than half of the nodes, rounded
    down), *dense*, *large*.
    """
    ends = nodes.select("project_id", F.col("slug").alias("end"), F.lit(True).alias("there")).distinct()
    marked = edges
    for c in ("source", "target"):
        marked = marked.join(ends.select("project_id", F.col("end").alias(c), F.col("there").alias(f"has_{c}")), ["project_id", c], "left")
    marked = marked.withColumn("valid", F.coalesce(F.col("has_source") & F.col("has_target"), F.lit(False)))
    e = marked.groupBy("project_id").agg(F.count_if("valid").alias("n_edges"), F.count_if(~F.col("valid")).alias("dropped"), F.count_if(F.col("valid") & (F.col("confidence") < WEAK_EDGE)).alias("n_weak_edges"))
    n = nodes.groupBy("project_id").agg(F.count("*").alias("n_nodes"), F.count_if("inferred").alias("n_inferred"))
    lone = orphans(nodes.select("project_id", "slug"), marked.where("valid")).groupBy("project_id").agg(F.count("*").alias("n_orphans"))
    out = n.join(e, "project_id", "left").join(lone, "project_id", "left").fillna(0, ["n_edges", "dropped", "n_weak_edges", "n_orphans"])
    density = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)
    flags = (
        ("dropped_edges", F.col("dropped") > 0), ("orphan_nodes", (F.col("n_orphans") > 0) & (F.col("n_nodes") > 1)), ("low_confidence_edges", F.col("n_weak_edges") > 0),
        ("mostly_inferred", F.col("n_inferred") > F.floor(F.col("n_nodes") / 2)), ("dense", density > DENSE), ("large", F.col("n_nodes") > LARGE),
    )
    return out.withColumn("density", F.round(density, 4)).withColumn("warnings", F.array_compact(F.array(*[F.when(c, name) for name, c in flags])))


def semantic_sections(blocks: DataFrame, plan: DataFrame, repeat: tuple[str, ...] = ("architecture",)) -> DataFrame:
    """SEM-1: planned sections (project_id, section_ord, section, block_key) filled from blocks (project_id, block_key, content, bullets).

    A block serves one section, the first that asks for it, but for the sections in
    ``repeat``.  Sections whose block is absent or empty are returned as missing.
    """
    full = blocks.where((F.length(tx.strip(F.coalesce("content", F.lit("")))) > 0) | (F.size("bullets") > 0))
    both = plan.join(full, ["project_id", "block_key"], "left").withColumn("has", F.col("content").isNotNull() | F.col("bullets").isNotNull())
    again = F.row_number().over(Window.partitionBy("project_id", "block_key").orderBy("section_ord")) > 1
    out = both.withColumn("again", again).where(~F.col("again") | ~F.col("has") | F.col("section").isin(*repeat))
    text = F.length(F.coalesce("content", F.lit(""))) > 0
    out = out.withColumn("overall", F.when(F.col("has"), F.when(text, 0.75).otherwise(0.6))).withColumn("completeness", F.when(F.col("has"), F.when(F.size("bullets") > 0, 0.7).otherwise(0.5)))
    return out.select("project_id", "section_ord", "section", "block_key", (~F.col("has")).alias("missing"), "overall", "completeness")
