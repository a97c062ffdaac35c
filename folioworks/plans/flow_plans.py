"""Registered queries that write and read tables of their own: readers, artifacts and the upload stream, all from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioworks.operators import privacy
from folioworks.plans.registry import NOW, SIMPLE_RULES, _SPANS, files, query, table
from folioworks.sources import files as src
from folioworks.sources.scratch import shared_folder
from folioworks.streaming import uploads


def folder(spark, name):
    return f"{shared_folder(spark)}/folioworks-{name}-{uuid.uuid4().hex}"


@query("src_01_read_files", "WITH {FILES} SELECT project_id, filename, file_type, (row_number() OVER (PARTITION BY project_id ORDER BY filename, file_type))::INTEGER AS file_ord, length(coalesce(text, ''))::BIGINT AS chars, 0 AS n_warnings FROM files")
def _(spark, sf):
    path = folder(spark, "records")
    files(spark, sf).select("project_id", "filename", "file_type", "text").write.parquet(path)
    return src.read_files(spark, path).select("project_id", "filename", "file_type", "file_ord", F.length("text").cast("long").alias("chars"), F.size("warnings").alias("n_warnings"))


@query("src_02_read_text_tree", "SELECT source AS project_id, sum(length(text) + 1)::BIGINT AS chars, true AS all_named FROM documents GROUP BY source")
def _(spark, sf):
    path = folder(spark, "tree")
    table(spark, sf, "documents").select("source", "text").write.option("maxRecordsPerFile", 5000).partitionBy("source").text(path)
    tree = src.read_text_tree(spark, path, None)
    return tree.groupBy("project_id").agg(F.sum(F.length("text")).cast("long").alias("chars"), (F.max("file_ord") == F.count("*")).alias("all_named"))


@query("snk_01_write_artifacts", """WITH {FILES}, n AS (SELECT project_id, count(*) AS n FROM files GROUP BY project_id)
  SELECT project_id, n, CASE WHEN n % 2 = 0 OR project_id LIKE '%1' THEN 'second' ELSE 'first' END AS run FROM n""")  # fmt: skip
def _(spark, sf):
    path = folder(spark, "artifacts")
    n = files(spark, sf).groupBy("project_id").agg(F.count("*").alias("n"))
    some = n.where((F.col("n") % 2 == 0) | F.endswith("project_id", F.lit("1")))
    src.write_artifacts(n.withColumn("run", F.lit("first")), path, "reports")
    for _ in range(2):  # the second time nothing changes
        src.write_artifacts(some.withColumn("run", F.lit("second")), path, "reports")
    return src.read_artifacts(spark, path, "reports", n)


@query("str_01_upload_stream", f"""WITH {{FILES}}, {_SPANS}, o AS (SELECT DISTINCT project_id, file_ord, original FROM s)
  SELECT f.project_id, count(o.original) AS n_placeholders, count(o.original) > 0 AS has_pii, 'ok' AS status FROM (SELECT DISTINCT project_id FROM files) f LEFT JOIN o ON f.project_id = o.project_id GROUP BY f.project_id""")  # fmt: skip
def _(spark, sf):
    source, target = folder(spark, "uploads"), folder(spark, "store")
    scan = lambda f: privacy.pii_report(f, privacy.privacy_pass(f, SIMPLE_RULES[:1], names=False, medical=False), NOW).withColumn("status", F.lit("ok"))
    f = files(spark, sf).select("project_id", "filename", "file_type", "text", F.lit(NOW).cast("timestamp").alias("uploaded_at"), (F.col("file_ord") % 2).alias("half"))
    for rows in (f.where("half = 0"), f.where("half = 1"), f.where("half = 1")):  # the last upload repeats the one before
        rows.drop("half").write.mode("append").parquet(source)
        uploads.stream_upload_pipeline(spark, source, target, f"{target}/checkpoint", NOW, scan).awaitTermination()
    return src.read_artifacts(spark, target, "reports").select("project_id", "n_placeholders", "has_pii", "status")
