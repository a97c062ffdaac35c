"""Incremental work (STR-1 .. STR-3)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from folioworks.operators import privacy
from folioworks.sources.files import UPLOADS, numbered, read_artifacts, write_artifacts
from folioworks.sources.scratch import written


def fingerprints(files: DataFrame, group: int = 4096) -> DataFrame:
    """TXT-17: one digest of names, texts and order of a project's files.

    Two levels: every file has a digest of its own; groups of about ``group`` files, by
    remainder of file_ord, have a digest of those in order, and the project one of its groups'.  No group
    holds texts.  It is stable and changes with any file, but its value is not that of
    one digest over all texts.
    """
    own = F.sha2(F.concat_ws("\n", F.col("file_ord").cast("string"), "filename", F.coalesce("text", F.lit(""))), 256)
    rows = files.select("project_id", "file_ord", own.alias("digest"))
    counts = rows.groupBy("project_id").agg(F.ceil(F.count("*") / group).alias("groups"))
    rows = rows.join(counts, "project_id").withColumn("part", F.pmod("file_ord", F.col("groups")))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "digest"))), lambda x: x["digest"]), "")
    parts = rows.groupBy("project_id", "part").agg(F.sha2(inner, 256).alias("digest"))
    outer = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "")
    return parts.groupBy("project_id").agg(F.substring(F.sha2(F.concat_ws("\n", F.col("project_id"), outer), 256), 1, 24).alias("fingerprint"))


def skip_unchanged(current: DataFrame, reports: DataFrame) -> DataFrame:
    """STR-2: projects whose content has no report yet."""
    return current.join(reports.select("project_id", "fingerprint"), ["project_id", "fingerprint"], "left_anti")


def expire_reports(reports: DataFrame, now: str, ttl_hours: int = 72) -> DataFrame:
    """STR-3: reports that are still valid at ``now``; those without an end stay."""
    end = F.coalesce("expires_at", F.col("created_at") + F.expr(f"interval {ttl_hours} hours"))
    return reports.where(F.col("created_at").isNull() | (end > F.lit(now).cast("timestamp")))


def unknown_risk(files: DataFrame, now: str, error: str) -> DataFrame:
    """The report of projects whose scan failed."""
    none = [F.lit(None).cast("boolean").alias("has_pii"), F.lit(0).cast("bigint").alias("n_placeholders"), F.lit(0).cast("bigint").alias("n_sources"), F.lit("unknown").alias("risk")]
    return files.select("project_id").distinct().select("project_id", *none, F.lit(now).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(f"prescan_failed: {error}").alias("status"))


NEWS = "project_id string, filename string, file_type string, text string, uploaded_at timestamp"


#: one entry of the state: which file, the digest of its last upload, and when that came (milliseconds)
KNOWN = np.dtype([("file", "V32"), ("digest", "V32"), ("seen", "<i8")])


def _changed(hours: float):
    """For each (project, file name) of a part: its last upload, where its content is not that of the state; an entry goes ``hours`` after the last upload."""
    keep_ms = int(hours * 3_600_000)

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = None, 0
        for rows in batches:
            seen = max(seen, int(rows.seen.max()))
            rows = rows if last is None else pd.concat([last, rows], ignore_index=True)
            last = rows.sort_values(["uploaded_at", "digest"], na_position="first", kind="stable").drop_duplicates("file", keep="last")
        known = np.frombuffer(state.get[0], KNOWN) if state.exists else np.zeros(0, KNOWN)
        known = known[known["seen"] + keep_ms > state.getCurrentWatermarkMs()]
        now = np.zeros(len(last), KNOWN)
        now["file"], now["digest"], now["seen"] = np.frombuffer(b"".join(last.file), "V32"), np.frombuffer(b"".join(last.digest), "V32"), seen
        digests = dict(zip(known["file"].tolist(), known["digest"].tolist(), strict=True))
        files = now["file"].tolist()
        fresh = [digests.get(f) != d for f, d in zip(files, now["digest"].tolist(), strict=True)]
        come = set(files)
        others = known[np.fromiter((f not in come for f in digests), bool, len(known))]
        state.update((np.concatenate([others, now]).tobytes(),))
        state.setTimeoutTimestamp(seen + keep_ms)
        if any(fresh):
            yield last.loc[fresh, ["project_id", "filename", "file_type", "text", "uploaded_at"]]

    return step


def stream_upload_pipeline(spark: SparkSession, source: str, target: str, checkpoint: str, now: str, scan: Callable[[DataFrame], DataFrame] | None = None, hours: float = 72, files_per_batch: int | None = None, parts: int = 1024):
    """STR-1: the projects of files that are new or changed are scanned again; a failing scan gives an unknown risk and stops nothing.

    Files arrive as parquet in ``source`` (``UPLOADS``).  A state in ``parts`` parts, dealt out by the
    hash of (project, file name), holds the digest of the last upload of each file, until
    ``hours`` after it: the same content again gives no row, and a batch of such files writes
    nothing.  What is new goes to
    ``target``/files; the projects it belongs to are read back from their buckets, and
    those whose fingerprint no report has are scanned.  Every write replaces records of the
    same key, so a batch that is run twice, or a file that comes back after its state has
    gone, leaves the same result.  Of two uploads of a file in one batch the later one
    counts, without a time the earliest; null names are empty.
    """
    scan = scan or (lambda files: privacy.pii_report(files, privacy.privacy_pass(files), now).withColumn("status", F.lit("ok")))

    def batch(df: DataFrame, number: int) -> None:
        new = write_artifacts(df, target, "files", keys=("project_id", "filename"))
        if new.isEmpty():
            return
        files = written(numbered(read_artifacts(spark, target, "files", new)), "project-files")
        prints = written(fingerprints(files), "fingerprints")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/reports")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            prints = written(skip_unchanged(prints, read_artifacts(spark, target, "reports", prints)), "changed")
        changed = files.join(prints.select("project_id"), "project_id", "left_semi")
        try:
            report = written(scan(changed), "report")
        except Exception as e:  # noqa: BLE001  the upload must go on
            report = unknown_risk(changed, now, type(e).__name__)
        write_artifacts(report.join(prints, "project_id").withColumn("batch", F.lit(number).cast("long")), target, "reports")

    stream = spark.readStream.schema(UPLOADS)
    stream = (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(source)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("project_id", "filename", "file_type", "text")]
    # the event time is that of arrival: nothing is late, however old a file is
    own = F.unhex(F.sha2(F.concat(F.octet_length("project_id").cast("string"), F.lit(" "), "project_id", "filename"), 256))
    stream = stream.select(*text, "uploaded_at", F.current_timestamp().alias("seen_at")).withColumns({"seen": F.unix_millis("seen_at"), "digest": F.unhex(F.sha2("text", 256)), "file": own, "part": F.pmod(F.xxhash64("project_id", "filename"), F.lit(parts))})
    stream = stream.withWatermark("seen_at", f"{int(hours * 3600)} seconds").groupBy("part").applyInPandasWithState(_changed(hours), NEWS, "known binary", "append", "EventTimeTimeout")
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
