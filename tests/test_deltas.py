"""An index that grows by batches: newest rows win, in batch and stream, before and after compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.sources.deltas import DeltaIndex, added

ITEM = "project_id string, item_id string, text string, vector array<double>"


def make(spark, rows):
    return spark.createDataFrame([(p, i, f"{p}{i}", v) for p, i, v in rows], ITEM)


def state(index):
    rows = index.read().collect()
    got = {(r.project_id, r.item_id): r.vector for r in rows}
    assert len(got) == len(rows)
    return got


def test_newest_row_of_an_item_wins(spark, tmp_path):
    index = DeltaIndex(spark, str(tmp_path / "i"))
    assert state(index) == {}
    index.add(make(spark, [("a", "1", [1.0]), ("a", "2", [2.0]), ("b", "1", [3.0]), ("a", "1", [0.5])]))
    index.add(make(spark, [("a", "1", [9.0]), ("a", "3", [4.0])]))
    index.add(make(spark, [("a", "1", [9.0])]))
    assert state(index) == {("a", "1"): [9.0], ("a", "2"): [2.0], ("b", "1"): [3.0], ("a", "3"): [4.0]}
    index.remove(spark.createDataFrame([("a", "2")], "project_id string, item_id string"))
    want = {("a", "1"): [9.0], ("b", "1"): [3.0], ("a", "3"): [4.0]}
    assert state(index) == want
    index.compact(spark.createDataFrame([("a",)], "project_id string"))
    assert state(index) == want and len(index.batches()) == 5
    assert len(index.vacuum()) == 3 and state(index) == want  # the first batch still holds b
    index.add(make(spark, [("a", "2", [7.0]), ("b", "1", [8.0])]))
    index.compact()
    index.vacuum()
    assert state(index) == want | {("a", "2"): [7.0], ("b", "1"): [8.0]} and len(index.batches()) == 1
    (tmp_path / "i" / f"seq={index.add(make(spark, [('z', '1', [1.0])]))}" / "_SUCCESS").unlink()
    assert ("z", "1") not in state(index)


def test_stream_equals_batch(spark, tmp_path):
    batches = [make(spark, [("a", str(k), [float(k)]) for k in range(5)]), make(spark, [("a", "1", [10.0]), ("b", "1", [11.0])]), make(spark, [("a", "1", [12.0])])]
    index, plain = DeltaIndex(spark, str(tmp_path / "stream")), DeltaIndex(spark, str(tmp_path / "batch"))
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        added(spark.readStream.schema(ITEM).parquet(str(tmp_path / "in")), index, str(tmp_path / "c")).awaitTermination()
        plain.add(batch)
    assert state(index) == state(plain) and len(index.batches()) == 3
    index.add(batches[0].withColumn("vector", F.array(F.lit(99.0))), tag="stream0")  # a repeated batch
    assert state(index) == state(plain)
