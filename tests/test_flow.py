"""Readers, artifacts and the upload stream on small tables."""

import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F

from folioworks.operators import privacy
from folioworks.sources import files as src
from folioworks.streaming import uploads

NOW = "2024-06-01 00:00:00"


def test_numbers_inside_projects(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 8 + ["p", "q", None]), r.choice([None, "", "a", "b", "ab", "z"]) if r.random() < 0.2 else f"n{r.randint(0, 400)}", r.choice(["x", None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "project_id string, filename string, file_type string")
    for parts in (1, 9):
        got: dict = {}
        for x in src.numbered(df.repartition(3), parts=parts).collect():
            got.setdefault(x.project_id or "", []).append((x.file_ord, (x.filename or "", x.file_type or "")))
        for v in got.values():
            v.sort()
            assert [n for n, _ in v] == list(range(1, len(v) + 1)) and [k for _, k in v] == sorted(k for _, k in v)
        assert sum(map(len, got.values())) == len(rows)
    assert src.numbered(df.limit(0)).count() == 0


def test_text_tree(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "two.md").write_bytes("б\n".encode())
    (tmp_path / "a b" / "one.txt").write_bytes(b"x\xffy")
    (tmp_path / "a b" / "none.txt").write_bytes(b" ")
    (tmp_path / "a b" / "skip.bin").write_bytes(b"x")
    got = {r.filename: r for r in src.read_text_tree(spark, str(tmp_path), None).collect()}
    assert {k: (r.project_id, r.text, r.file_type, r.file_ord) for k, r in got.items()} == {"none.txt": ("a b", " ", "txt", 1), "one.txt": ("a b", "xy", "txt", 2), "two.md": ("a b", "б\n", "md", 3)}
    assert got["none.txt"].warnings == ["Text file is empty"] and got["one.txt"].warnings == []
    assert {r.project_id for r in src.read_text_tree(spark, str(tmp_path)).collect()} == {"project"}


def test_writing_twice_changes_nothing_and_touches_own_buckets_only(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(200).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("project_id"), F.col("id").alias("v"))
    src.write_artifacts(rows, path, "k", buckets=16)
    times = lambda: {p.parent.name: p.stat().st_mtime_ns for p in tmp_path.glob("k/bucket=*/*.parquet")}
    before = times()
    some = rows.where("v = 7").withColumn("v", F.lit(-7).cast("long")).withColumn("extra", F.lit("e"))
    for _ in range(2):
        src.write_artifacts(some, path, "k", buckets=16)
    after = times()
    assert len(before) == 16 and set(before) == set(after) and sum(before[b] != after[b] for b in before) == 1
    got = {r.project_id: (r.v, r.extra) for r in src.read_artifacts(spark, path, "k", buckets=16).collect()}
    assert len(got) == 200 and got["p7"] == (-7, "e") and got["p8"] == (8, None)
    one = src.read_artifacts(spark, path, "k", some, 16)
    assert [r.v for r in one.collect()] == [-7]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    src.write_artifacts(rows.limit(0), path, "k", buckets=16)
    assert src.read_artifacts(spark, path, "k", buckets=16).count() == 200


def test_stream_equals_batch_and_skips_what_it_knows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "project_id string, filename string, file_type string, text string, uploaded_at timestamp"
    scans = []

    def scan(files):
        scans.append(sorted(r.project_id for r in files.select("project_id").distinct().collect()))
        if "bad" in scans[-1]:
            raise ValueError("no")
        return privacy.pii_report(files, privacy.privacy_pass(files, names=False, medical=False), NOW).withColumn("status", F.lit("ok"))

    def upload(*rows):
        df = spark.createDataFrame([(p, f, "txt", t, None) for p, f, t in rows], schema)
        df.write.mode("append").parquet(source)
        uploads.stream_upload_pipeline(spark, source, target, f"{target}/checkpoint", NOW, scan).awaitTermination()
        return {r.project_id: (r.n_placeholders, r.n_sources, r.risk, r.status, r.batch) for r in src.read_artifacts(spark, target, "reports").collect()}

    a, b = "mail a@b.org", "mail a@b.org and c@d.org"
    first = upload(("p", "1.txt", a), ("p", "2.txt", "nothing"), ("q", "1.txt", None))
    assert {k: v[:2] for k, v in first.items()} == {"p": (1, 1), "q": (0, 0)} and scans == [["p", "q"]]
    assert upload(("p", "1.txt", a), ("q", "1.txt", None)) == first and len(scans) == 1  # the same again
    assert upload(("p", "1.txt", b))["p"][:2] == (2, 1) and scans[1:] == [["p"]]
    back = upload(("p", "1.txt", a))  # a content that was there before is a change too
    assert back["p"][:2] == (1, 1) and scans[2:] == [["p"]] and back["q"] == first["q"]
    bad = upload(("bad", "x", "t"))
    assert bad["bad"][2:4] == ("unknown", "prescan_failed: ValueError") and bad["p"] == back["p"]
    kept = src.read_artifacts(spark, target, "files").where("project_id != 'bad'")
    whole = kept.withColumn("file_ord", F.col("filename").substr(1, 1).cast("int"))
    want = {r.project_id: (r.n_placeholders, r.n_sources) for r in privacy.pii_report(whole, privacy.privacy_pass(whole, names=False, medical=False), NOW).collect()}
    assert want == {k: v[:2] for k, v in bad.items() if k != "bad"}


def test_the_state_of_uploads_is_as_many_rows_as_parts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "project_id string, filename string, file_type string, text string, uploaded_at timestamp"
    scan = lambda files: privacy.pii_report(files, privacy.privacy_pass(files, privacy.RULES[:1], names=False, medical=False), NOW).withColumn("status", F.lit("ok"))

    def upload(*rows):
        spark.createDataFrame([(p, f, "txt", t, None) for p, f, t in rows], schema).write.mode("append").parquet(source)
        q = uploads.stream_upload_pipeline(spark, source, target, f"{target}/checkpoint", NOW, scan, parts=3)
        q.awaitTermination()
        assert {p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]} <= {0, 1, 2, 3}
        return {r.project_id: (r.n_placeholders, r.batch) for r in src.read_artifacts(spark, target, "reports").collect()}

    files = [(f"p{i % 4}", f"{i}.txt", f"mail a{i}@b.org" if i % 3 else "none") for i in range(40)]
    # a project and a name that read alike when put together are different files
    files += [("p1", "1x.txt", "other@b.org"), ("p11", "x.txt", "else@b.org")]
    first = upload(*files)
    found = lambda p, rows: sum("@" in t for q, _, t in rows if q == p)
    assert {p: n for p, (n, _) in first.items()} == {p: found(p, files) for p in ("p0", "p1", "p2", "p3", "p11")}
    assert upload(*files) == first
    after = upload(*[(p, f, t) for p, f, t in files if p != "p3"], ("p3", "3.txt", "new@b.org"))
    assert {p: n for p, (n, _) in after.items() if p != "p3"} == {p: n for p, (n, _) in first.items() if p != "p3"} and after["p3"][0] == first["p3"][0] + 1
    assert {p for p in first if after[p] != first[p]} == {"p3"}


def test_a_part_knows_each_of_its_files():
    class State:
        value, timeout, hasTimedOut, mark = None, None, False, 0
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value

        def remove(self):
            self.value = None

        def setTimeoutTimestamp(self, at):  # noqa: N802
            self.timeout = at

        def getCurrentWatermarkMs(self):  # noqa: N802
            return self.mark

    state, step, hour = State(), uploads._changed(1), 3_600_000

    def come(at, *rows):
        b = lambda s: hashlib.sha256(s.encode()).digest()
        chunk = lambda rs: pd.DataFrame([("p", f, "txt", t, pd.Timestamp(u) if u else pd.NaT, at, b(t), b(f)) for f, t, u in rs], columns=["project_id", "filename", "file_type", "text", "uploaded_at", "seen", "digest", "file"])
        return sorted((r.filename, r.text) for out in step((0,), iter([chunk(rows[:1]), chunk(rows)]), state) for r in out.itertuples())

    assert come(5, ("a", "1", "2024-01-02"), ("a", "2", "2024-01-01"), ("a", "0", None), ("b", "x", None)) == [("a", "1"), ("b", "x")] and state.timeout == 5 + hour
    assert come(6, ("a", "1", None), ("b", "y", None)) == [("b", "y")] and come(7, ("b", "x", None)) == [("b", "x")] and come(8, ("c", "z", None)) == [("c", "z")]
    state.mark = 6 + hour  # a's last upload is too long ago, b's and c's are not
    assert come(9 + hour, ("a", "1", None), ("b", "x", None), ("c", "z", None)) == [("a", "1")]
    state.hasTimedOut = True
    assert list(step((0,), iter([]), state)) == [] and not state.exists
