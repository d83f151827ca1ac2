"""The lake's input tables as views of the given tables, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import chat
from memlake.plans.registry import table


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows: a conversation is a project; some assistant rows are to be forgotten."""
    c = table(spark, sf_dir, "conversations")
    forget = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 5 == 0)
    return c.select(F.col("conv_id").cast("string").alias("project_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.col("text").alias("content"), forget.alias("forget"), F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 12)).alias("semantic_handle"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.pairs(messages(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a project (their source)."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), "doc_id", "text")


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: a user is a run, an hour of a user's events is a turn, a view is a main call."""
    e = table(spark, sf_dir, "events")
    tokens = F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
    return e.select(
        F.col("user_id").alias("run_id"), F.hour("ts").cast("long").alias("turn_id"), F.col("event_id").alias("invocation_id"), "ts",
        F.when(F.col("event_type") == "view", "main").otherwise(F.col("event_type")).alias("purpose"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"),
        tokens.alias("total_tokens"), F.floor(tokens / 2).cast("long").alias("prompt_tokens"), (tokens - F.floor(tokens / 2)).cast("long").alias("completion_tokens"),
        F.when(F.col("event_id") % 7 == 0, "estimate").when(tokens <= 0, "zero_fallback").otherwise("provider").alias("usage_source"), (F.col("event_id") % 900).alias("ttlt_ms"),
    )


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


MESSAGES = "messages AS (SELECT CAST(conv_id AS VARCHAR) AS project_id, conv_id * 1000 + turn AS id, role, text AS content, (role = 'assistant' AND (conv_id + turn) % 5 = 0) AS forget, CASE WHEN turn % 3 = 0 THEN substring(text, 1, 12) END AS semantic_handle FROM conversations)"
ORDERED = MESSAGES + ", ordered AS (SELECT *, row_number() OVER w AS pos, lead(role) OVER w AS nrole, lag(role) OVER w AS prole, lead(id) OVER w AS nid, lead(content) OVER w AS ntext, lead(forget) OVER w AS nforget FROM messages WINDOW w AS (PARTITION BY project_id ORDER BY id))"
PAIRS = ORDERED + ", pairs AS (SELECT project_id, pos, id AS user_id, nid AS assistant_id, content AS user_text, ntext AS assistant_text, coalesce(nforget, false) AS forget, row_number() OVER (PARTITION BY project_id ORDER BY pos) AS pair_no FROM ordered WHERE role = 'user' AND nrole = 'assistant')"
PAIR_TEXT = f"'User: ' || {strip('user_text')} || chr(10) || 'Assistant: ' || {strip('assistant_text')}"
INVOCATIONS = """inv0 AS (SELECT *, CAST(floor(coalesce(value, 0)) AS BIGINT) AS tok FROM events),
invocations AS (SELECT user_id AS run_id, CAST(hour(ts) AS BIGINT) AS turn_id, event_id AS invocation_id, ts, CASE WHEN event_type = 'view' THEN 'main' ELSE event_type END AS purpose, 'm' || (event_id % 3) AS model,
 tok AS total_tokens, CAST(floor(tok / 2) AS BIGINT) AS prompt_tokens, tok - CAST(floor(tok / 2) AS BIGINT) AS completion_tokens,
 CASE WHEN event_id % 7 = 0 THEN 'estimate' WHEN tok <= 0 THEN 'zero_fallback' ELSE 'provider' END AS usage_source, event_id % 900 AS ttlt_ms FROM inv0)"""
CHUNKS = """chunks AS (SELECT project_id, doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, chunk FROM
 (SELECT source AS project_id, doc_id, i, substring(regexp_replace(text, '\\r\\n?', chr(10), 'g'), i * 520 + 1, 600) AS chunk FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) / 520.0) AS BIGINT))) AS i))
 WHERE regexp_matches(chunk, '\\S'))"""
WORDS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
KEY = "trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[''\"`“”’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
