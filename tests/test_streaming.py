"""Streams give what the batch forms give."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from memlake.operators import chat
from memlake.operators import questions as qs
from memlake.operators import telemetry as tm
from memlake.sources import readers, writers
from memlake.streaming import jobs

MESSAGE = "project_id string, id long, role string, content string"


def test_roll_off_stream_equals_batch(spark, tmp_path):
    roles = ["user", "assistant", "assistant", "user", "user", "assistant", "user", "assistant", "user"]
    rows = [(p, k, r, f"{p}{k}") for p in "ab" for k, r in enumerate(roles)]
    df = spark.createDataFrame(rows, MESSAGE)
    for n, cut in enumerate(("id < 4", "id >= 4")):
        df.where(cut).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    for n in range(2):  # the second file arrives later
        stream = spark.readStream.schema(MESSAGE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in" / str(n)))
        assert stream.isStreaming
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = jobs.rolled_pairs(stream, 1).writeStream.format("memory").queryName("rolled").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.project_id, r.user_id) for r in spark.table("rolled").collect()}
    batch = chat.roll_off(df.withColumn("forget", F.lit(False)).withColumn("semantic_handle", F.lit("")), 1)
    assert got == {(r.project_id, r.id) for r in batch.where("action = 'roll' and role = 'user'").collect()}


def test_question_stream_equals_batch(spark, tmp_path):
    schema = "project_id string, line_no long, ts string, question string, topic string, resolution string"
    rows = [("p", 1, "1", "A", "t", "answer_local"), ("p", 2, "2", "B", "t", "answer_local"), ("p", 3, "3", "a", "t", "ignore"), ("q", 1, "1", "A", "t", "answer_remote")]
    df = spark.createDataFrame(rows, schema)
    out = str(tmp_path / "table")
    for n, cut in enumerate(("line_no < 3", "line_no >= 3")):
        df.where(cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.consolidated_questions(stream, out, str(tmp_path / "c")).awaitTermination()
        assert n < 2
    key = lambda d: sorted((r.project_id, r.question) for r in d.collect())
    assert key(jobs.open_questions(spark, out)) == key(qs.consolidate(df))


def test_question_table_has_buckets_and_no_folder_a_project(spark, tmp_path):
    schema = "project_id string, line_no long, ts string, question string, topic string, resolution string"
    many = [(f"{k:03}", k, "1", f"Q{k % 3}", "t", "answer_local") for k in range(600)] + [(None, 1, "1", "A", "t", "answer_local")]
    later = [("007", 9, "2", "q1", "T", "ignore"), (None, 2, "1", "B", "t", "answer_local")]
    out, files = tmp_path / "table", []
    for rows in (many, later):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.consolidated_questions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(out), str(tmp_path / "c")).awaitTermination()
        files.append({str(f) for f in out.rglob("*.parquet")})
    assert max(map(len, files)) <= jobs.QUESTION_BUCKETS + 8
    assert len(files[1] - files[0]) <= 2  # only the folders of the second batch's projects are written anew
    got = jobs.open_questions(spark, str(out))
    want = qs.consolidate(spark.createDataFrame(many + later, schema))
    assert got.columns == [*want.columns] and sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert want.where("project_id = '007'").isEmpty() and want.where("project_id is null").count() == 2


def test_index_stream_and_reload(spark, tmp_path):
    docs = spark.createDataFrame([("p", 1, "word " * 50), ("q", 2, "other text")], "project_id string, doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    jobs.appended_chunks(stream, str(tmp_path / "chunks"), str(tmp_path / "c"), 100, 10, 8).awaitTermination()
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    assert chunks.where("project_id = 'p'").count() == 3
    writers.rebuild_index(chunks, str(tmp_path / "index"), 100, 10, 8)
    good, stale = readers.read_index(spark, str(tmp_path / "index"), 100, 10)
    assert good.count() == 4 and stale.count() == 0
    good, stale = readers.read_index(spark, str(tmp_path / "index"), 600, 80)
    assert good.count() == 0 and stale.count() == 2


CALLS = "run_id string, turn_id long, invocation_id long, total_tokens long, ts timestamp, purpose string, prompt_tokens long, completion_tokens long, usage_source string, ttlt_ms long"


def run_stream(spark, tmp_path, batches, schema, job, out):
    """Feeds tables one by one through a job; returns the rows and the states' numbers of rows after each."""
    states = []
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = job(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"{out}-c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress and q.lastProgress["stateOperators"] else None)
    return spark.read.parquet(str(tmp_path / out)), states


def test_turns_come_out_once(spark, tmp_path):
    """A turn over midnight is one row; a turn without a successor comes out by its timer; repeats and late calls do not count."""
    rng = random.Random(3)
    rows, at, call = [], 1_704_060_000, 0
    for turn in range(1, 9):  # turns of up to two hours, so that several cross an hour, and one midnight
        for _ in range(rng.randint(1, 5)):
            call, at = call + 1, at + rng.randint(60, 3000)
            rows.append(("r", turn, call, rng.randint(0, 50), at, "main" if rng.random() < 0.5 else "tag", rng.choice(["provider", "estimate", "zero_fallback"])))
    rows.append(("once", 5, 900, 7, at - 40_000, "main", "provider"))
    frame = spark.createDataFrame(rows, "run_id string, turn_id long, invocation_id long, total_tokens long, s long, purpose string, usage_source string")
    calls = frame.select("run_id", "turn_id", "invocation_id", "total_tokens", F.timestamp_seconds("s").alias("ts"), "purpose", F.floor(F.col("total_tokens") / 2).alias("prompt_tokens"), F.ceil(F.col("total_tokens") / 3).alias("completion_tokens"), "usage_source", (F.col("invocation_id") % 90).alias("ttlt_ms"))
    half = len(rows) // 2
    first, second = calls.where(F.col("invocation_id") <= half).union(calls.where("run_id = 'once'")), calls.where((F.col("invocation_id") > half) & (F.col("run_id") == "r"))
    again = calls.where(F.col("invocation_id") <= 1)  # known already, and its turn is over
    end = calls.where("run_id = 'once'").withColumns({"run_id": F.lit("z"), "ts": F.timestamp_seconds(F.lit(at + 90_000))})
    got, _ = run_stream(spark, tmp_path, [first, second.union(again), end, end.withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))], CALLS, lambda c: jobs.turn_totals(c), "turns")
    got = sorted(tuple(r) for r in got.where("run_id <> 'z'").collect())
    batch = tm.turn_rollup(calls).select(*(f.split()[0] for f in jobs.TURN.split(", ")))
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) == 9


def test_state_of_runs_that_never_end_goes(spark, tmp_path):
    schema = "run_id string, arrival long, kind string, turn_id long, invocation_id long, ts timestamp"
    make = lambda hour, runs, kind: spark.range(runs).selectExpr("cast(id as string) as run_id", f"{hour} * 100000 + id as arrival", f"'{kind}' as kind", "1L as turn_id", "id as invocation_id", f"timestamp_seconds(1700000000 + 3600 * {hour}) as ts")
    job = lambda e: jobs.screened(e, idle_ms=7_200_000, keep_ms=7_200_000)
    batches = [make(0, 1000, "start"), make(4, 1, "start"), make(5, 2, "end"), make(9, 1, "turn"), make(12, 1, "turn")]
    got, states = run_stream(spark, tmp_path, batches, schema, job, "verdicts")
    assert states[0] >= 2000 and states[-1] < 20, states
    verdict = {(r.run_id, r.arrival): r.verdict for r in got.collect()}
    assert verdict[("1", 500001)] == "late"  # silent for four hours: the tombstone answers
    assert len(verdict) == 1000 + 1 + 2 + 1 + 1


def test_uploads_and_json_lines(spark, tmp_path):
    (tmp_path / "up" / "sub").mkdir(parents=True)
    (tmp_path / "up" / "a.TXT").write_text("hello")
    (tmp_path / "up" / "sub" / "b.md").write_text("x\ny")
    (tmp_path / "up" / "c.pdf").write_text("no")
    got = {r.doc_id: r.text for r in readers.read_uploads(spark, str(tmp_path / "up")).collect()}
    assert got == {"a.TXT": "hello", "sub/b.md": "x\ny"}
    (tmp_path / "log.jsonl").write_text('{"question": "a"}\n\n[1]\n{bad\n{"question": " "}\n{"question": "b"}')
    rows = qs.parse_log(readers.read_json_lines(spark, str(tmp_path / "log.jsonl"), "p")).orderBy("line_no").collect()
    assert [(r.line_no, r.question) for r in rows] == [(1, "a"), (6, "b")]
