"""Queries whose rows go through files, indexes and streams, written below the session's shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import chunks as ck
from memlake.operators import questions as qs
from memlake.operators.steps import shared_dir
from memlake.plans import inputs as i
from memlake.plans.inputs import CHUNKS, PAIRS
from memlake.plans.registry import query, table
from memlake.sources import readers, writers
from memlake.sources.deltas import DeltaIndex
from memlake.streaming import jobs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(s: SparkSession) -> str:
    return f"{shared_dir(s)}/query-{uuid.uuid4().hex}"


def _fed(s: SparkSession, *tables: DataFrame) -> tuple[DataFrame, str]:
    """A stream of tables that arrive one after the other, and a folder for what it makes."""
    folder = _folder(s)
    for n, part in enumerate(tables):
        part.write.parquet(f"{folder}/in/{n}")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream = s.readStream.schema(tables[0].schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return stream, folder


def _drained(rows: DataFrame, folder: str, mode: str) -> DataFrame:
    """What a stream has put out once all its input is read; a repeated batch replaces itself."""
    s = rows.sparkSession
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{folder}/out").select(*rows.columns)


@query("str1_roll_off_stream", f"WITH {PAIRS}, n AS (SELECT *, count(*) OVER (PARTITION BY project_id) AS all_ FROM pairs) SELECT project_id, user_id, assistant_id, user_text, assistant_text FROM n WHERE pair_no <= all_ - 2")
def str1(s, d):
    stream, folder = _fed(s, i.messages(s, d).select("project_id", "id", "role", "content"))
    return _drained(jobs.rolled_pairs(stream, 2), folder, "update")


@query("str2_question_stream", "WITH l AS (SELECT user_id AS project_id, event_id AS line_no, event_type AS q, event_id % 3 AS t, CASE WHEN event_id % 5 = 0 THEN 'ignore' ELSE 'answer_local' END AS resolution, row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY event_id DESC) AS rn FROM events) SELECT CAST(project_id AS VARCHAR) AS project_id, q AS question, CAST(t AS VARCHAR) AS topic, line_no FROM l WHERE rn = 1 AND resolution <> 'ignore'")
def str2(s, d):
    e = table(s, d, "events")
    n = F.col("event_id")
    log = e.select(F.col("user_id").cast("string").alias("project_id"), n.alias("line_no"), F.lit("1").alias("ts"), F.col("event_type").alias("question"), (n % 3).cast("string").alias("topic"), F.when(n % 5 == 0, "ignore").otherwise("answer_local").alias("resolution"))
    stream, folder = _fed(s, log)
    jobs.consolidated_questions(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return jobs.open_questions(s, f"{folder}/table").select(F.col("project_id").cast("string").alias("project_id"), "question", "topic", "line_no")


@query("str3_chunk_stream", f"WITH {CHUNKS} SELECT project_id, doc_id, chunk_index, chunk FROM chunks")
def str3(s, d):
    stream, folder = _fed(s, i.documents(s, d))
    jobs.appended_chunks(stream, f"{folder}/chunks", f"{folder}/checkpoint", 600, 80, 16).awaitTermination()
    return s.read.parquet(f"{folder}/chunks").where(F.size("vector") == 16).select(F.col("project_id").cast("string").alias("project_id"), "doc_id", "chunk_index", "chunk")


_TURNS = """t AS (SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(floor(epoch(ts)) AS BIGINT) // 18000 AS turn_id, event_id, event_type = 'view' AS main, CAST(floor(coalesce(value, 0)) AS BIGINT) AS tok FROM events)"""


@query("str4_turn_stream", f"WITH {_TURNS} SELECT run_id, turn_id, count(*) AS invocations, count(*) FILTER (WHERE main) AS main_count, CAST(coalesce(sum(tok) FILTER (WHERE main), 0) + coalesce(sum(CAST(floor(tok / 2) AS BIGINT)) FILTER (WHERE NOT main), 0) AS BIGINT) AS turn_total, arg_max(event_id % 900, event_id) FILTER (WHERE main) AS main_ttlt_ms FROM t GROUP BY ALL")
def str4(s, d):
    """Turns of five hours; one call of a run of its own, long after, lets the last turns' timers fire."""
    seconds = F.unix_timestamp("ts")
    calls = i.invocations(s, d).withColumns({"run_id": F.col("run_id").cast("string"), "turn_id": F.floor(seconds / 18000), "ts": F.col("ts").cast("timestamp")})
    last = calls.agg(F.max("ts")).first()[0]
    end = calls.orderBy("invocation_id").limit(1).withColumns({"run_id": F.lit("end"), "ts": F.lit(last) + F.expr("interval 30 days")})
    stream, folder = _fed(s, calls.unionByName(end))
    rows = _drained(jobs.turn_totals(stream), folder, "append").where("run_id <> 'end'")
    return rows.select("run_id", "turn_id", "invocations", "main_count", "turn_total", "main_ttlt_ms")


@query("vec6_index_deltas", "SELECT CAST(label AS VARCHAR) AS project_id, CAST(vec_id AS VARCHAR) AS item_id, round(CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings WHERE vec_id % 10 <> 1")
def vec6(s, d):
    """All vectors are added, a third again with the opposite sign, one project is compacted, and some are removed."""
    rows = table(s, d, "embeddings").select(F.col("label").cast("string").alias("project_id"), F.col("vec_id").cast("string").alias("item_id"), F.lit(None).cast("string").alias("text"), F.col("embedding").cast("array<double>").alias("vector"))
    index, n = DeltaIndex(s, _folder(s)), F.col("item_id").cast("long")
    index.add(rows)
    index.add(rows.where(n % 3 == 0).withColumn("vector", F.transform("vector", lambda x: -x)))
    index.compact(rows.where("project_id = '1'").select("project_id"))
    index.remove(rows.where(n % 10 == 1))
    return index.read().select("project_id", "item_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("snk1_src6_index", f"WITH {CHUNKS} SELECT project_id, count(*) AS rows, count(DISTINCT doc_id) AS documents FROM chunks GROUP BY project_id")
def snk1(s, d):
    """The index of all documents, written, checked against its manifest and read again."""
    path = _folder(s)
    writers.rebuild_index(ck.embed(ck.chunk(i.documents(s, d), 600, 80), "chunk", lambda: ck.HashEmbedder(16)), path, 600, 80, 16)
    good, _ = readers.read_index(s, path, 600, 80)
    return good.groupBy(F.col("project_id").cast("string").alias("project_id")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents"))


@query("src4_numbered_lines", "SELECT count(*) AS files_exact, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM (SELECT string_agg(text, chr(10)) AS text FROM documents WHERE text <> '' AND NOT contains(text, chr(13)))")
def src4_lines(s, d):
    """All texts in one file, read in splits of a few bytes each as the session has it: lines are numbered 1 to n."""
    path = _folder(s)
    table(s, d, "documents").where((F.col("text") != "") & ~F.contains("text", F.lit("\r"))).select("text").coalesce(1).write.text(path)
    files = readers.read_numbered_lines(s, path).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("hi"), F.count_distinct("line_no").alias("d"))
    return files.agg(F.count_if((F.col("n") == F.col("hi")) & (F.col("n") == F.col("d"))).alias("files_exact"), F.sum("n").alias("lines"))


@query("snk4_question_log", f"""WITH {PAIRS}, t AS (SELECT project_id, pair_no, user_id, assistant_id, unnest(list_filter(list_transform(regexp_extract_all(replace(assistant_text, '.', '?'), '[^.!?\\n]*\\?', 0), lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g')), lambda q: q <> '')) AS question FROM pairs),
 k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(question), '[''"`“”’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM t) SELECT project_id, key, count(*) AS n FROM (SELECT DISTINCT project_id, key FROM k) GROUP BY ALL""")
def snk4_log(s, d):
    """Questions of all pairs are tagged, appended as JSON lines, read again and consolidated: one row a key."""
    from memlake.operators import chat

    asking = i.pairs(s, d).withColumn("assistant_text", F.replace("assistant_text", F.lit("."), F.lit("?")))
    path = _folder(s)
    rows = chat.question_rows(chat.tag(asking), F.lit("2024-01-01T00:00:00Z")).withColumn("topic", F.lit(""))
    writers.append_questions(rows, path)
    lines = readers.read_numbered_lines(s, path).select(F.get_json_object("value", "$.project_id").alias("project_id"), "line_no", "value")
    found = qs.consolidate(qs.parse_log(lines))
    return found.groupBy("project_id", F.regexp_replace("key", r"\|\|$", "").alias("key")).agg(F.count(F.lit(1)).alias("n"))
