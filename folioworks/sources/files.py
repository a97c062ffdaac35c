"""Reading and writing the tables (SRC-1 .. SRC-5, SNK-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.sources.scratch import written

FILES = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)
#: a file as it arrives in a stream
UPLOADS = T.StructType([*FILES.fields, T.StructField("uploaded_at", T.TimestampType())])


def numbered(df: DataFrame, order: tuple[str, ...] = ("filename", "file_type"), parts: int | None = None) -> DataFrame:
    """``df`` with file_ord, 1, 2, ... inside a project by ``order``; null counts as empty, equal files stand side by side.

    Different names are dealt out by ranges and counted there; every range is shifted by
    the counts before it.  No project is sorted in one group.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = ["project_id", *order]
    plain = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys})
    own = [f"__{c}" for c in keys]
    counts = plain.groupBy(*own).agg(F.count("*").alias("__n")).repartitionByRange(parts, *own).withColumn("__part", F.spark_partition_id())
    counts = written(counts, "names")
    first = own[0]
    sums = counts.groupBy(first, "__part").agg(F.sum("__n").alias("__sum"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__shift", before(Window.partitionBy(first).orderBy("__part"), "__sum")).drop("__sum")
    places = counts.join(sums, [first, "__part"]).withColumn("__at", F.col("__shift") + before(Window.partitionBy(first, "__part").orderBy(*own[1:]), "__n")).drop("__n", "__part", "__shift")
    inside = F.row_number().over(Window.partitionBy(*own).orderBy(*own))
    return plain.withColumn("__k", inside).join(places, own).withColumn("file_ord", (F.col("__at") + F.col("__k")).cast("int")).drop(*own, "__at", "__k")


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-1: file records with the fixed schema, defaults for missing values, and file_ord."""
    df = spark.read.schema(FILES).format(fmt).load(path)
    none = F.array().cast("array<string>")
    df = df.withColumns({"text": F.coalesce("text", F.lit("")), "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")), "warnings": F.coalesce("warnings", none), "errors": F.coalesce("errors", none)})
    return numbered(df)


def read_text_tree(spark: SparkSession, path: str, project_id: str | None = "project") -> DataFrame:
    """SRC-2: .txt and .md files of a folder tree; undecodable bytes are replaced and dropped, empty texts warned of.

    ``project_id`` None: the folder of a file is its project; of ``key=value`` the value.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").load(path)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    folder = F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -2)), "^[^=]*=", "")
    out = raw.select((folder if project_id is None else F.lit(project_id)).alias("project_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), text.alias("text"))
    warn = F.when(F.trim("text") == "", F.array(F.lit("Text file is empty"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns({"file_type": F.element_at(F.split("filename", r"\."), -1), "metadata": F.create_map(F.lit("chars_count"), F.length("text").cast("string")), "warnings": warn, "errors": F.array().cast("array<string>")})
    return numbered(out, ("filename",))


# Kinds of files by extension.
KINDS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "pptx": "pptx", "ppt": "pptx", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "gif": "image", "txt": "text", "md": "text"}


def with_file_kind(df: DataFrame, filename: str = "filename") -> DataFrame:
    """SRC-3: kind by extension; a name with "screenshot" is a screenshot."""
    ext = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return df.withColumn("kind", F.when(F.lower(filename).contains("screenshot"), "screenshot").otherwise(F.coalesce(kinds[ext], F.lit("other"))))


def corpus_snapshot_type(df: DataFrame, filename: str = "filename") -> DataFrame:
    """SRC-4: x.pptx.txt is the text of a pptx; .txt and .md are texts; other files are skipped."""
    low = F.lower(filename)
    inner = F.regexp_extract(low, r"\.(pptx|docx|pdf)\.txt$", 1)
    out = df.where(low.rlike(r"\.(txt|md)$"))
    return out.withColumn("source_name", F.when(inner != "", F.regexp_replace(filename, r"(?i)\.txt$", "")).otherwise(F.col(filename))).withColumn("source_type", F.when(inner != "", inner).otherwise("txt"))


def list_projects(projects: DataFrame, limit: int = 50, sort: str = "updated_at") -> DataFrame:
    """SRC-5: the newest projects; updated_at falls back to created_at, ties to the smaller id."""
    p = projects.withColumn("updated_at", F.coalesce("updated_at", "created_at"))
    return p.orderBy(F.desc(sort), "project_id").limit(limit)


def _bucket(project_id, buckets: int):
    return F.pmod(F.xxhash64(project_id), F.lit(buckets)).cast("int")


def write_artifacts(df: DataFrame, path: str, kind: str, buckets: int = 64, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """SNK-1: the records of a kind, by bucket of their project; a record replaces that of the same ``keys``, the others stay.

    Only buckets with new records are read and written again, each whole (a large one by
    several tasks), so writing twice leaves the same table; of equal keys in ``df`` one row stays.  A column that only
    the older records have is null in new ones, and the other way round.  Returns what
    was written.  One writer at a time.
    """
    spark, target = df.sparkSession, f"{path}/{kind}"
    new = written(df.withColumn("bucket", _bucket("project_id", buckets)).dropDuplicates([*keys]), kind)
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    merged = new
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        known = written(spark.read.option("mergeSchema", "true").parquet(target).where(F.col("bucket").isin(touched)), kind)
        merged = new.unionByName(known.join(new.select(*keys), [*keys], "left_anti"), allowMissingColumns=True)
    if touched:
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)
    return new.drop("bucket")


def read_artifacts(spark: SparkSession, path: str, kind: str, projects: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """The records of a kind; with ``projects`` (project_id) theirs, from their buckets alone."""
    found = spark.read.option("mergeSchema", "true").parquet(f"{path}/{kind}")
    if projects is None:
        return found.drop("bucket")
    asked = projects.select("project_id", _bucket("project_id", buckets).alias("bucket")).distinct()
    wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]  # ``buckets`` at most
    return found.where(F.col("bucket").isin(wanted)).join(asked.select("project_id"), "project_id", "left_semi").drop("bucket")
