"""Default rules of the classifiers on short texts."""

from pyspark.sql import functions as F

from folioworks.operators import classify


def test_profiles(spark):
    rows = [(1, "Clinical patient dashboard"), (2, ""), (3, None), (4, "zzz"), (5, "банк и платежи")]
    got = {r.id: (r.profile, r.hits, r.profile_confidence, r.signals) for r in classify.classify_profile(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got[1] == ("medical", 2, round(0.45 + 2 / 3 * 0.5, 6), ["medical:clinical", "medical:patient", "analytics:dashboard"])
    assert got[2][:3] == got[3][:3] == ("general", 0, 0.3) and got[4] == ("general", 0, 0.4, ["no_domain_signals"]) and got[5][0] == "fintech"


def test_archetypes_need_their_domain(spark):
    df = spark.createDataFrame([("rag_system", ["medical_ai"], "Copilot with retrieval, vector search and a workflow; kpi dashboard"), ("speech_ai", [], "retrieval")], "primary_domain string, secondary array<string>, text string")
    one, two = ([(a.key, a.confidence) for a in r.archetypes] for r in classify.detect_archetypes(df).collect())
    assert one == [("RAG Knowledge Assistant", 0.84), ("AI Copilot", 0.62), ("Workflow Automation Platform", 0.62)] and two == []


def test_patterns_and_related_tasks(spark):
    df = spark.createDataFrame([("rag_system", "rag with embedding; worker", "Index of embeddings\n- vector upload, no\nreview of rags"), ("speech_ai", "live stream", None)], "primary_domain string, text string, tasks string")
    one, two = (r.patterns for r in classify.detect_patterns(df, tasks="tasks").collect())
    assert [(p.key, p.confidence) for p in one] == [("RAG pipeline", 0.76), ("async worker pipeline", 0.58), ("vector search", 0.58)]
    assert one[0].related == ["Index of embeddings", "vector upload", "review of rags"] and one[1].related == []
    assert [(p.key, p.confidence) for p in two] == [("real-time streaming", 0.74)]


def test_plans_have_layout_and_style(spark):
    df = spark.createDataFrame([("medical",), ("fintech",), (None,)], "primary_domain string")
    got = {}
    for r in classify.plan_sections(df).orderBy("section_ord").collect():
        got.setdefault(r.primary_domain, (r.layout, r.style, []))[2].append(r.section)
    assert got["medical"][:2] == ("architecture_first", "medical") and len(got["medical"][2]) == 9 and got["medical"][2][2] == "compliance"
    assert got["fintech"] == ("enterprise_overview", "enterprise", ["problem", "system", "architecture", "modules", "metrics", "stack", "team", "roadmap"]) and got[None][0] == "architecture_first"
    assert classify.plan_sections(df).where(F.col("section").isNull()).count() == 0
