"""Upload trees, numbered lines of split files, and checks of an index on disk."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from memlake.operators import chunks as ck
from memlake.sources import readers, writers


def test_upload_names_are_as_they_are(spark, tmp_path):
    names = ["my file.txt", "a+b.md", "50%.TXT", "sub dir/x%20y.Md", "é ü.txt", "sub dir/deep.er/z.tXt"]
    root = tmp_path / "up (1).d"
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f"text of {n}")
    (root / "no.pdf").write_bytes(b"\xff\xfe")
    (root / "txt").write_text("no extension")
    got = {r.doc_id: r.text for r in readers.read_uploads(spark, str(root)).collect()}
    assert got == {n: f"text of {n}" for n in names}
    files = readers.read_uploads(spark, f"file://{root}")
    assert {r.doc_id for r in files.select("doc_id").collect()} == set(names)


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    n = 2_000_000
    (tmp_path / "a.jsonl").write_text("".join(f"{k}\n" for k in range(1, n + 1)))
    (tmp_path / "b.jsonl").write_text("".join(f"{k}\r\n" for k in range(1, 5001)) + "5001")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("256m", "300k"):
            spark.conf.set(key, size)
            rows = readers.read_numbered_lines(spark, str(tmp_path))
            assert rows.where(F.col("line_no") != F.trim("value").cast("long")).count() == 0
            found = {r.file[-7:]: (r.n, r.hi, r.d) for r in rows.groupBy("file").agg(F.count("*").alias("n"), F.max("line_no").alias("hi"), F.count_distinct("line_no").alias("d")).collect()}
            assert found == {"a.jsonl": (n, n, n), "b.jsonl": (5001, 5001, 5001)}
        assert rows.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set(key, before)


def test_what_is_missing_on_disk_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(p, f"{p}{k}", "words and words " * 30) for p in "abcd" for k in range(3)], "project_id string, doc_id string, text string")
    chunks = ck.embed(ck.chunk(docs, 100, 10), "chunk", lambda: ck.HashEmbedder(8))
    path = str(tmp_path / "index")
    writers.rebuild_index(chunks.repartition(3, "doc_id"), path, 100, 10, 8)
    good, stale = readers.read_index(spark, path, 100, 10)
    assert good.count() == chunks.count() and stale.count() == 0
    part = sorted((tmp_path / "index" / "chunks" / "project_id=a").glob("part-*.parquet"))[0]
    part.unlink()
    (part.parent / f".{part.name}.crc").unlink()
    shutil.rmtree(tmp_path / "index" / "chunks" / "project_id=b")
    other = ck.embed(ck.chunk(docs.where("project_id = 'c'"), 100, 10), "chunk", lambda: ck.HashEmbedder(4))
    writers.overwrite_projects(other, f"{path}/chunks")
    good, stale = readers.read_index(spark, path, 100, 10)
    assert {r.project_id: r.reason for r in stale.collect()} == {"a": "rows", "b": "rows", "c": "dimension"}
    assert {r.project_id for r in good.select("project_id").distinct().collect()} == {"d"}


def test_artifact_files_keep_their_names(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one.md", "x\ny"), ("b", "two.md", "z")], "project_id string, name string, content string")
    writers.write_artifacts(docs, str(tmp_path / "out"))
    writers.write_artifacts(docs.where("project_id = 'a'").withColumn("name", F.lit("three.md")), str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out"), wholetext=True)
    assert {(r.project_id, r.name, r.value.rstrip("\n")) for r in got.collect()} == {("a", "one.md", "x\ny"), ("a", "three.md", "x\ny"), ("b", "two.md", "z")}


def test_staging_can_replace_what_it_is_read_from(spark, tmp_path):
    path = str(tmp_path / "staging")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "project_id string, day_sequence int, text string")
    writers.append_entries(rows, path)
    staged = readers.read_staged(spark, path)
    writers.overwrite_staging(writers.clear_consumed(staged, rows.where("project_id = 'a'"), True), path)
    assert [r.text for r in readers.read_staged(spark, path).collect()] == ["z"]
