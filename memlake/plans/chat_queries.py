"""Queries of the chat, statistics, telemetry, question and ingest operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import chat, ingest, stats
from memlake.operators import chunks as ck
from memlake.operators import questions as qs
from memlake.operators import telemetry as tm
from memlake.plans import inputs as i
from memlake.plans.inputs import CHUNKS, INVOCATIONS, KEY, MESSAGES, ORDERED, PAIR_TEXT, PAIRS, WORDS, strip
from memlake.plans.registry import query, table
from memlake.settings import Settings
from memlake.sources import readers

W = WORDS.format


@query("src3_ordered_messages", "SELECT CAST(conv_id AS VARCHAR) AS project_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, turn) AS seq FROM conversations")
def src3(s, d):
    rows = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("project_id"), "turn", F.floor(F.col("turn") / 2).alias("created_at"), F.col("turn").alias("id"))
    return readers.read_messages(rows).select("project_id", "turn", "seq")


@query("win1_pairs", f"WITH {PAIRS} SELECT project_id, pair_no, user_id, assistant_id, forget FROM pairs")
def win1(s, d):
    return i.pairs(s, d).select("project_id", "pair_no", "user_id", "assistant_id", "forget")


@query(
    "win2_roll_off",
    f"""WITH {ORDERED}, m AS (SELECT *, coalesce(role = 'user' AND nrole = 'assistant', false) AS p FROM ordered), k AS (SELECT *, lag(p) OVER (PARTITION BY project_id ORDER BY pos) AS pp FROM m),
 g AS (SELECT *, sum(CAST(p AS INT)) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS newer FROM k),
 r AS (SELECT *, (p AND newer > 2) OR (coalesce(pp, false) AND newer + 1 > 2) AS rolls, p OR coalesce(pp, false) AS paired FROM g), l AS (SELECT *, max(CASE WHEN rolls THEN pos END) OVER (PARTITION BY project_id) AS last FROM r)
 SELECT project_id, id, CASE WHEN rolls THEN 'roll' WHEN NOT paired AND pos < last THEN 'delete' ELSE 'keep' END AS action FROM l""",
)
def win2(s, d):
    return chat.roll_off(i.messages(s, d), 2).select("project_id", "id", "action")


@query("win3_flush", f"WITH {PAIRS}, b AS (SELECT *, coalesce(count(*) FILTER (WHERE NOT forget) OVER (PARTITION BY project_id ORDER BY pair_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM pairs) SELECT project_id, pair_no, NOT forget AS staged FROM b WHERE done < 2")
def win3(s, d):
    return chat.flush(i.pairs(s, d), 2).select("project_id", "pair_no", "staged")


@query("win4_newest", f"WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY id DESC) AS age FROM messages) SELECT project_id, id, CAST(age AS INTEGER) AS age FROM r WHERE age <= 4")
def win4(s, d):
    return chat.newest(i.messages(s, d), 2, 3).select("project_id", "id", "age")


_ENTRIES = f"""entries AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY pair_no) + 7 AS day_sequence, {PAIR_TEXT} AS text FROM pairs WHERE NOT forget)"""


@query("snk3_daily_entries", f"WITH {PAIRS}, {_ENTRIES} SELECT project_id, day_sequence, text, CAST(len({W(x='text')}) AS INTEGER) AS tokens FROM entries")
def snk3(s, d):
    p = i.pairs(s, d)
    existing = p.select("project_id").distinct().withColumn("day_sequence", F.lit(7))
    staged = p.where(~F.col("forget"))  # a pair whose answer is to be forgotten is never staged
    return chat.daily_entries(staged, existing, F.lit("01-02-2024_03:04:05")).select("project_id", "day_sequence", "text", "tokens")


@query("snk4_question_rows", rf"WITH {PAIRS}, t AS (SELECT project_id, pair_no, list_filter(list_transform(regexp_extract_all(CASE WHEN pair_no % 2 = 1 THEN replace(assistant_text, '.', '?') ELSE assistant_text END, '[^.!?\n]*\?'), lambda q: {strip('q')}), lambda q: q <> '') AS qs FROM pairs) SELECT project_id, pair_no, CAST(generate_subscripts(qs, 1) AS INTEGER) AS question_index, unnest(qs) AS question FROM t")
def snk4(s, d):
    """Every second answer asks instead of telling."""
    asking = i.pairs(s, d).withColumn("assistant_text", F.when(F.col("pair_no") % 2 == 1, F.replace("assistant_text", F.lit("."), F.lit("?"))).otherwise(F.col("assistant_text")))
    return chat.question_rows(chat.tag(asking)).select("project_id", "pair_no", "question_index", "question")


@query("win14_previous_pair", f"WITH {PAIRS}, t AS (SELECT project_id, pair_no, {PAIR_TEXT} AS pair_text FROM pairs) SELECT project_id, pair_no, lag(pair_text) OVER (PARTITION BY project_id ORDER BY pair_no) AS previous_text FROM t")
def win14(s, d):
    return chat.with_previous(i.pairs(s, d)).select("project_id", "pair_no", "previous_text")


@query("win15_last_handle", f"WITH {MESSAGES} SELECT project_id, arg_max({strip('semantic_handle')}, id) AS last_handle FROM messages WHERE {strip('semantic_handle')} <> '' GROUP BY project_id")
def win15(s, d):
    return chat.last_handles(i.messages(s, d))


@query("win17_trim_edges", f"WITH {ORDERED}, e AS (SELECT *, min(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY project_id) AS lo, max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY project_id) AS hi FROM ordered) SELECT project_id, id FROM e WHERE pos BETWEEN lo AND hi")
def win17(s, d):
    return chat.trimmed_edges(i.messages(s, d)).select("project_id", "id")


@query("flt5_staging_switch", f"WITH {PAIRS}, pr AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS project_id, conv_id % 3 > 0 AS on_ FROM conversations WHERE conv_id % 2 = 0) SELECT project_id, pair_no FROM pairs LEFT JOIN pr USING (project_id) WHERE coalesce(on_, true)")
def flt5(s, d):
    projects = table(s, d, "conversations").where("conv_id % 2 = 0").select(F.col("conv_id").cast("string").alias("project_id"), (F.col("conv_id") % 3 > 0).alias("daily_rag_enabled")).distinct()
    return chat.staging_enabled(i.pairs(s, d), projects).select("project_id", "pair_no")


@query("flt6_project_names", "SELECT item_id, min(n_nationkey) AS project FROM benchmark JOIN nation ON lower(n_name) = lower((SELECT n2.n_name FROM nation n2 WHERE n2.n_nationkey = item_id % 25)) GROUP BY item_id")
def flt6(s, d):
    projects = table(s, d, "nation").select(F.col("n_nationkey").alias("project"), F.col("n_name").alias("name"))
    asked = table(s, d, "benchmark").select("item_id", (F.col("item_id") % 25).alias("k")).join(table(s, d, "nation"), F.col("k") == F.col("n_nationkey"))
    return chat.resolve_projects(asked.select("item_id", F.concat(F.lit("  "), F.upper("n_name"), F.lit(" ")).alias("name")), projects, "project").select("item_id", "project")


@query("flt7_routes", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'SYNTHESIS' ELSE 'OTHER' END AS route FROM events")
def flt7(s, d):
    n = F.col("event_id") % 4
    return table(s, d, "events").select("event_id", chat.category_route(F.when(n == 0, " direct ").when(n == 1, "Synthesis").when(n == 2, "CHITCHAT")).alias("route"))


@query("udf3_route_classifier", r"SELECT item_id, CASE WHEN regexp_matches(t, '\b(how to|steps?|configure|install)\b') THEN 'PROCEDURAL' WHEN regexp_matches(t, '\b(design|plan|trade-?offs?)\b') THEN 'SYNTHESIS' WHEN regexp_matches(t, '\b(compare|explore|why)\b') THEN 'EXPLORATORY' WHEN regexp_matches(t, '^\s*(hi|hello|thanks?)\b') THEN 'CHITCHAT' WHEN contains(t, '?') THEN 'DIRECT' ELSE 'OTHER' END AS route FROM (SELECT item_id, lower(text) AS t FROM benchmark)")
def udf3(s, d):
    return table(s, d, "benchmark").select("item_id", chat.route_of(F.col("text")).alias("route"))


@query("agg1_daily_stats", f"WITH {PAIRS}, {_ENTRIES} SELECT project_id, CAST(sum(strlen(text)) AS BIGINT) AS daily_bytes, CAST(sum(len({W(x='text')})) AS BIGINT) AS daily_tokens, count(*) AS daily_entries FROM entries GROUP BY project_id")
def agg1(s, d):
    return stats.daily_stats(snk3(s, d))


@query(
    "agg2_project_stats",
    f"""WITH {PAIRS}, a AS (SELECT project_id, count(*) AS active_pairs FROM pairs GROUP BY 1), f AS (SELECT source AS project_id, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS storage_bytes, CAST(sum(len({W(x='text')})) AS BIGINT) AS file_tokens FROM documents GROUP BY 1)
 SELECT coalesce(a.project_id, f.project_id) AS project_id, coalesce(active_pairs, 0) AS active_pairs, coalesce(file_count, 0) AS file_count, coalesce(storage_bytes, 0) AS storage_bytes, coalesce(file_tokens, 0) AS file_tokens FROM a FULL JOIN f ON a.project_id = f.project_id""",
)
def agg2(s, d):
    return stats.project_stats([stats.active_pairs(i.pairs(s, d)), agg3(s, d)])


@query("agg3_file_totals", f"SELECT source AS project_id, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS storage_bytes, CAST(sum(len({W(x='text')})) AS BIGINT) AS file_tokens FROM documents GROUP BY 1")
def agg3(s, d):
    return stats.file_totals(i.documents(s, d).select("project_id", F.octet_length("text").alias("size_bytes"), tx.count_tokens(F.col("text")).alias("token_count")))


@query("agg4_file_stats", f"WITH {CHUNKS} SELECT project_id, CAST(doc_id AS VARCHAR) AS filename, CAST(sum(len({W(x='chunk')})) AS BIGINT) AS token_count, max(chunk_index) // 3 AS page_count FROM chunks GROUP BY ALL")
def agg4(s, d):
    c = ck.chunk(i.documents(s, d), 600, 80).select("project_id", F.col("doc_id").cast("string").alias("filename"), tx.count_tokens(F.col("chunk")).alias("tokens"), F.floor(F.col("chunk_index") / 3).cast("int").alias("page_number"))
    return stats.file_stats(c)


_GAPPED = f"{CHUNKS}, g AS (SELECT * FROM chunks WHERE NOT (doc_id % 97 = 0 AND chunk_index = 1))"


@query("agg11_contiguity", f"WITH {_GAPPED}, c AS (SELECT project_id, doc_id, min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AND count(DISTINCT chunk_index) = count(*) AS ok FROM g GROUP BY ALL) SELECT project_id, bool_and(ok) AS expandable, count(*) AS documents FROM c GROUP BY project_id")
def agg11(s, d):
    c = ck.chunk(i.documents(s, d), 600, 80).where("not (doc_id % 97 = 0 and chunk_index = 1)")
    return ck.contiguous(c, "project_id", "doc_id", "chunk_index")


@query("join9_stale_projects", f"WITH {_GAPPED}, c AS (SELECT project_id, doc_id, min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AS ok FROM g GROUP BY ALL), e AS (SELECT project_id, bool_and(ok) AS ok FROM c GROUP BY 1) SELECT project_id FROM e WHERE NOT ok OR project_id = 'src3'")
def join9(s, d):
    manifest = i.documents(s, d).select("project_id").distinct().withColumn("chunk_size", F.when(F.col("project_id") == "src3", 500).otherwise(600)).withColumn("chunk_overlap", F.lit(80))
    return ck.stale_projects(manifest, 600, 80, agg11(s, d))


@query("join11_backfill", f"WITH {CHUNKS}, st AS (SELECT doc_id, CAST(sum(len({W(x='chunk')})) AS BIGINT) AS t FROM chunks WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id, coalesce(t, -1) AS token_count, CASE WHEN t IS NULL THEN 'pending' ELSE 'indexed' END AS status FROM documents LEFT JOIN st USING (doc_id)")
def join11(s, d):
    files = i.documents(s, d).select("project_id", F.col("doc_id").cast("string").alias("filename"), "doc_id", F.lit(-1).cast("long").alias("token_count"), F.lit(0).alias("page_count"), F.lit("pending").alias("status"))
    return stats.backfill(files, agg4(s, d).where("cast(filename as long) % 2 = 0")).select("doc_id", "token_count", "status")


@query("agg15_active_pairs", f"WITH {PAIRS} SELECT project_id, count(*) AS active_pairs FROM pairs GROUP BY project_id")
def agg15(s, d):
    return stats.active_pairs(i.pairs(s, d))


@query("agg18_lake_totals", "SELECT count(DISTINCT conv_id) AS projects, count(*) AS messages FROM conversations")
def agg18(s, d):
    return stats.lake_totals(i.messages(s, d))


@query("agg16_cycle_summary", "SELECT CAST(sum(turn) AS BIGINT) AS items_in, CAST(sum(turn // 2) AS BIGINT) AS items_out, count(*) FILTER (WHERE turn % 3 = 0) AS processed, count(*) FILTER (WHERE turn % 3 = 1) AS skipped, count(*) FILTER (WHERE turn % 3 = 2) AS failed, CASE WHEN count(*) FILTER (WHERE turn % 3 = 2) > 0 THEN 'partial' ELSE 'complete' END AS status FROM conversations")
def agg16(s, d):
    t = F.col("turn")
    return stats.cycle_summary(table(s, d, "conversations").select(t.alias("items_in"), F.floor(t / 2).alias("items_out"), F.when(t % 3 == 0, "done").when(t % 3 == 1, "skipped").otherwise("failed").alias("status")))


@query(
    "snk7_admission",
    """WITH f AS (SELECT source AS p, doc_id % 5 AS b, doc_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, strlen(text) AS n, CASE WHEN doc_id % 11 = 0 THEN 'extension' WHEN strlen(text) > 8000 THEN 'file_too_large' END AS r FROM documents),
 g AS (SELECT *, CASE WHEN r IS NULL THEN n ELSE 0 END AS c FROM f), h AS (SELECT *, sum(c) OVER (PARTITION BY p, b ORDER BY name ROWS UNBOUNDED PRECEDING) AS bb FROM g), j AS (SELECT *, coalesce(r, CASE WHEN bb > 20000 THEN 'batch_too_large' END) AS r2 FROM h),
 k AS (SELECT *, sum(CASE WHEN r2 IS NULL THEN n ELSE 0 END) OVER (PARTITION BY p ORDER BY b, name ROWS UNBOUNDED PRECEDING) + CASE WHEN p = 'src1' THEN 1000 ELSE 0 END AS pb FROM j) SELECT doc_id, coalesce(r2, CASE WHEN pb > 40000 THEN 'project_full' END) AS reject_reason FROM k""",
)
def snk7(s, d):
    ext = F.when(F.col("doc_id") % 11 == 0, ".pdf").otherwise(".TXT")
    files = i.documents(s, d).select("project_id", (F.col("doc_id") % 5).alias("batch_id"), "doc_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), ext).alias("filename"), F.octet_length("text").alias("size_bytes"))
    held = s.createDataFrame([("src1", 1000)], "project_id string, size_bytes long")
    limits = Settings(max_file_bytes=8000, max_batch_bytes=20000, max_project_bytes=40000)
    return ingest.admit(files, held, limits).select("doc_id", "reject_reason")


@query("src7_lookup", "SELECT a.item_id, vec_id IS NOT NULL AS found, label FROM (SELECT item_id * 20 AS item_id FROM benchmark) a LEFT JOIN embeddings ON vec_id = a.item_id")
def src7(s, d):
    ids = table(s, d, "benchmark").select((F.col("item_id") * 20).alias("item_id"))
    items = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "label", F.lit(True).alias("hit"))
    return ingest.lookup(items, ids).select("item_id", F.coalesce("hit", F.lit(False)).alias("found"), "label")


@query("snk6_clear_consumed", f"WITH {PAIRS} SELECT project_id, pair_no AS day_sequence FROM pairs WHERE pair_no > 1")
def snk6(s, d):
    from memlake.sources.writers import clear_consumed

    staging = i.pairs(s, d).select("project_id", F.col("pair_no").alias("day_sequence"))
    return clear_consumed(staging, staging.where("day_sequence = 1"), True)


@query("join13_restamp", "SELECT vec_id, 'new' AS model FROM embeddings WHERE label % 2 = 1")
def join13(s, d):
    rows = table(s, d, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, "new").otherwise("old").alias("embedding_model"))
    return ingest.restamp(rows, "new")[1].select("vec_id", F.col("embedding_model").alias("model"))


# -- telemetry ---------------------------------------------------------------------

_ROLL = f"""WITH {INVOCATIONS}, t AS (SELECT run_id, turn_id, count(*) AS invocations, count(*) FILTER (WHERE purpose = 'main') AS main_count, count(*) FILTER (WHERE purpose <> 'main') AS helper_count,
 CAST(coalesce(sum(total_tokens) FILTER (WHERE purpose = 'main'), 0) AS BIGINT) AS main_total, CAST(coalesce(sum(prompt_tokens) FILTER (WHERE purpose <> 'main'), 0) AS BIGINT) AS helper_prompt, CAST(coalesce(sum(completion_tokens) FILTER (WHERE purpose <> 'main'), 0) AS BIGINT) AS helper_completion,
 CAST(coalesce(sum(total_tokens) FILTER (WHERE usage_source = 'provider'), 0) AS BIGINT) AS provider_tokens, CAST(coalesce(sum(total_tokens) FILTER (WHERE usage_source = 'estimate'), 0) AS BIGINT) AS estimated_tokens, CAST(coalesce(sum(total_tokens) FILTER (WHERE usage_source = 'zero_fallback'), 0) AS BIGINT) AS zero_tokens,
 arg_max(ttlt_ms, invocation_id) FILTER (WHERE purpose = 'main') AS main_ttlt_ms FROM invocations GROUP BY run_id, turn_id)"""
_TURNS = _ROLL + ", turns AS (SELECT *, main_total + helper_prompt AS turn_total, CASE WHEN estimated_tokens > 0 THEN 'estimate' WHEN zero_tokens > 0 THEN 'zero_fallback' ELSE 'provider' END AS turn_usage_source FROM t)"


@query("agg6_turn_rollup", _TURNS + " SELECT * FROM turns")
def agg6(s, d):
    return tm.turn_rollup(i.invocations(s, d))


@query(
    "agg7_violations",
    _TURNS
    + """, v AS (SELECT *, turn_id % 2 = 0 AS on_, main_total AS retrieved_count, helper_prompt AS kept_count, CASE WHEN turn_id % 5 = 0 THEN -1 ELSE 0 END AS expanded_count, turn_id % 4 AS prompt_rag, main_total AS prompt_parts, provider_tokens AS context_estimate, CASE WHEN turn_id % 3 = 0 THEN 'budget_zero' ELSE 'odd' END AS why FROM turns)
 SELECT run_id, turn_id, array_to_string(list_filter([CASE WHEN main_count <> 1 THEN 'main_count' END, CASE WHEN kept_count > retrieved_count THEN 'kept_over_retrieved' END, CASE WHEN expanded_count < 0 OR retrieved_count < 0 OR kept_count < 0 THEN 'negative' END, CASE WHEN prompt_parts <> context_estimate THEN 'prompt_sum' END, CASE WHEN NOT on_ AND why = 'odd' THEN 'skip_reason' END, CASE WHEN NOT on_ AND retrieved_count + kept_count + expanded_count + prompt_rag <> 0 THEN 'rag_off_counters' END], lambda x: x IS NOT NULL), ',') AS violations FROM v""",
)
def agg7(s, d):
    t = F.col("turn_id")
    rows = agg6(s, d).withColumns({"rag_enabled": t % 2 == 0, "retrieved_count": F.col("main_total"), "kept_count": F.col("helper_prompt"), "expanded_count": F.when(t % 5 == 0, -1).otherwise(0), "prompt_rag": t % 4, "prompt_parts": F.col("main_total"), "context_estimate": F.col("provider_tokens"), "rag_skip_reason": F.when(t % 3 == 0, "budget_zero").otherwise("odd")})
    return tm.violations(rows).select("run_id", "turn_id", F.array_join("violations", ",").alias("violations"))


@query("agg8_models", f"WITH {INVOCATIONS} SELECT purpose, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM invocations GROUP BY purpose")
def agg8(s, d):
    return tm.models_by_purpose(i.invocations(s, d)).select("purpose", F.array_join("models", ",").alias("models"))


@query("agg9_run_projects", "SELECT user_id AS run_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS projects, arg_min(event_type, (ts, event_type)) AS first_project, count(DISTINCT event_type) > 1 AS multi_project FROM events GROUP BY user_id")
def agg9(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("project_id"), "ts")
    return tm.run_projects(rows).withColumn("projects", F.array_join("projects", ","))


@query("agg10_completeness", "SELECT event_id, CASE WHEN value IS NOT NULL AND props IS NOT NULL AND value > 10 THEN 'full' ELSE 'partial' END AS completeness, array_to_string(list_filter([CASE WHEN value IS NULL OR value <= 10 THEN 'tokens' END, CASE WHEN props IS NULL THEN 'latency' END], lambda x: x IS NOT NULL), ',') AS missing FROM events")
def agg10(s, d):
    rows = table(s, d, "events").select("event_id", F.when(F.col("value") > 10, F.col("value")).alias("tokens"), F.col("props").alias("latency"))
    return tm.completeness(rows, ["tokens", "latency"]).select("event_id", "completeness", F.array_join("missing_fields", ",").alias("missing"))


@query("join10_scores", "SELECT doc_id AS case_id, lang AS system, quality AS overall_score FROM documents LEFT JOIN labels USING (doc_id)")
def join10(s, d):
    results = table(s, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("system"))
    return tm.with_scores(results, table(s, d, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("overall_score")))


@query("win18_monotone", "WITH a AS (SELECT user_id AS run_id, event_id AS arrival, (event_id * 7919) % 1000 AS turn_id FROM events), m AS (SELECT *, max(turn_id) OVER (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a) SELECT run_id, arrival, turn_id FROM m WHERE top IS NULL OR turn_id > top")
def win18(s, d):
    return tm.monotone_turns(table(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("arrival"), (F.col("event_id") * 7919 % 1000).alias("turn_id")))


@query("win19_cumulative", _TURNS + " SELECT run_id, turn_id, CAST(sum(turn_total) OVER (PARTITION BY run_id ORDER BY turn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_turn_total FROM turns")
def win19(s, d):
    return tm.cumulative(agg6(s, d), ["turn_total"]).select("run_id", "turn_id", "cum_turn_total")


@query("str6_volumes", f"WITH {INVOCATIONS} SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M') AS w, purpose, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM invocations GROUP BY ALL")
def str6(s, d):
    return tm.volumes(i.invocations(s, d)).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("w"), "purpose", "calls", "tokens")


@query("str6_sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM a) SELECT user_id AS run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS calls FROM b GROUP BY user_id, n")
def sessions(s, d):
    return tm.sessions(table(s, d, "events").select(F.col("user_id").alias("run_id"), "ts")).withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


_CALLS = "calls AS (SELECT user_id AS run_id, event_id AS arrival, CASE event_id % 5 WHEN 0 THEN 'turn' WHEN 1 THEN 'start' WHEN 4 THEN CASE WHEN event_id % 97 = 4 THEN 'run_end' ELSE 'end' END ELSE 'end' END AS kind, event_id * 31 % 17 AS turn_id, event_id // 5 % 3 AS invocation_id FROM events)"


@query(
    "str5_screen_calls",
    f"""WITH {_CALLS}, m AS (SELECT *, max(CASE WHEN kind = 'turn' THEN turn_id END) OVER b AS top, coalesce(bool_or(kind = 'run_end') OVER b, false) AS over, coalesce(bool_or(kind = 'start') OVER c, false) AS began, coalesce(max(CASE WHEN kind = 'end' THEN arrival END) OVER c > min(CASE WHEN kind = 'start' THEN arrival END) OVER c, false) AS ended FROM calls
 WINDOW b AS (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY run_id, invocation_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT run_id, arrival, CASE WHEN over THEN 'late' WHEN kind = 'turn' AND turn_id = top THEN 'repeated' WHEN kind = 'turn' AND turn_id < top THEN 'decreasing' WHEN (kind = 'start' AND began) OR (kind = 'end' AND ended) THEN 'repeated' WHEN kind = 'end' AND NOT began THEN 'unknown' ELSE 'accepted' END AS verdict FROM m""",
)
def str5(s, d):
    n = F.col("event_id")
    kind = F.when(n % 5 == 0, "turn").when(n % 5 == 1, "start").when(n % 97 == 4, F.when(n % 5 == 4, "run_end").otherwise("end")).otherwise("end")
    calls = table(s, d, "events").select(F.col("user_id").alias("run_id"), n.alias("arrival"), kind.alias("kind"), (n * 31 % 17).alias("turn_id"), (F.floor(n / 5) % 3).alias("invocation_id"))
    return tm.screen_calls(calls).select("run_id", "arrival", "verdict")


# -- questions and ideas -----------------------------------------------------------

_LOG = f"log AS (SELECT CAST(conv_id % 7 AS VARCHAR) AS project_id, turn AS line_no0, conv_id * 100 + turn AS line_no, lpad(CAST(turn AS VARCHAR), 3, '0') AS ts, text AS question, role AS topic, CASE turn % 3 WHEN 0 THEN 'ignore' WHEN 1 THEN 'answer_local' ELSE 'ANSWER_REMOTE' END AS resolution FROM conversations)"


def _log(s, d):
    t = F.col("turn")
    return table(s, d, "conversations").select(
        (F.col("conv_id") % 7).cast("string").alias("project_id"), (F.col("conv_id") * 100 + t).alias("line_no"), F.lpad(t.cast("string"), 3, "0").alias("ts"), F.col("text").alias("question"), F.col("role").alias("topic"),
        F.when(t % 3 == 0, "ignore").when(t % 3 == 1, "answer_local").otherwise("ANSWER_REMOTE").alias("resolution"),
    )


@query("win13_consolidate", f"WITH {_LOG}, k AS (SELECT *, {KEY.format(x='question')} || '||' || {KEY.format(x='topic')} AS key FROM log WHERE {strip('question')} <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY ts DESC, line_no DESC) AS rn FROM k) SELECT project_id, key, line_no, lower(resolution) AS resolution FROM r WHERE rn = 1 AND lower(resolution) <> 'ignore'")
def win13(s, d):
    return qs.consolidate(_log(s, d)).select("project_id", "key", "line_no", "resolution")


@query("flt9_clean_questions", f"WITH {_LOG} SELECT line_no, {strip('question')} AS question, CASE WHEN line_no % 2 = 0 THEN lower(resolution) ELSE 'ignore' END AS resolution FROM log WHERE {strip('question')} <> ''")
def flt9(s, d):
    q = F.array(F.struct("question", "topic", F.when(F.col("line_no") % 2 == 0, F.col("resolution")).otherwise("weird").alias("resolution")), F.struct(F.lit(" ").alias("question"), F.col("topic"), F.col("resolution")))
    return _log(s, d).select("line_no", F.explode(tx.clean_questions(q)).alias("q")).select("line_no", "q.question", "q.resolution")


_Q = "q AS (SELECT CAST(item_id % 3 AS VARCHAR) AS project_id, item_id AS question_no, text AS question, CASE WHEN item_id % 2 = 0 THEN 'answer_local' ELSE 'answer_remote' END AS resolution FROM benchmark)"
_IDEAS = "ideas AS (SELECT CAST(item_id % 3 AS VARCHAR) AS project_id, item_id AS idea_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN substring(text, 5, 60) WHEN 2 THEN '\"' || text || '\" AND more' ELSE 'nothing like it ' || item_id END AS origin_text FROM benchmark)"
_MATCH = f"""WITH {_Q}, {_IDEAS}, a AS (SELECT project_id, idea_id, {KEY.format(x='origin_text')} AS ka FROM ideas), b AS (SELECT project_id, question_no, resolution, {KEY.format(x='question')} AS kb FROM q),
 m AS (SELECT a.project_id, idea_id, question_no, resolution, ka = kb AS exact FROM a JOIN b ON a.project_id = b.project_id AND ka <> '' AND kb <> '' AND (ka = kb OR (length(ka) >= 24 AND contains(ka, kb)) OR (length(kb) >= 24 AND contains(kb, ka))))"""


def _questions(s, d):
    n = F.col("item_id")
    return table(s, d, "benchmark").select((n % 3).cast("string").alias("project_id"), n.alias("question_no"), F.col("text").alias("question"), F.when(n % 2 == 0, "answer_local").otherwise("answer_remote").alias("resolution"), (n % 2 == 1).alias("used_remote_research"))


def _ideas(s, d):
    n = F.col("item_id")
    origin = F.when(n % 4 == 0, F.col("text")).when(n % 4 == 1, F.substring("text", 5, 60)).when(n % 4 == 2, F.concat(F.lit('"'), F.col("text"), F.lit('" AND more'))).otherwise(F.concat(F.lit("nothing like it "), n.cast("string")))
    return table(s, d, "benchmark").select((n % 3).cast("string").alias("project_id"), n.alias("idea_id"), origin.alias("origin_text"))


@query("join5_attach_resolution", _MATCH + ", r AS (SELECT *, row_number() OVER (PARTITION BY project_id, idea_id ORDER BY exact DESC, CASE WHEN exact THEN -question_no ELSE question_no END) AS rn FROM m) SELECT ideas.project_id, ideas.idea_id, r.resolution AS source_resolution FROM ideas LEFT JOIN r ON r.project_id = ideas.project_id AND r.idea_id = ideas.idea_id AND rn = 1")
def join5(s, d):
    return qs.attach_resolution(_ideas(s, d), _questions(s, d)).select("project_id", "idea_id", "source_resolution")


@query("join6_known_only", _MATCH + " SELECT DISTINCT project_id, idea_id FROM m")
def join6(s, d):
    return qs.known_only(_ideas(s, d), _questions(s, d)).select("project_id", "idea_id")


@query("join7_bridge")
def join7(s, d):
    return qs.bridge(_ideas(s, d), _questions(s, d))


@query("join7_bridged_ideas")
def join7_ideas(s, d):
    ideas = _ideas(s, d)
    rows = qs.bridged_ideas(ideas, qs.bridge(ideas, _questions(s, d)))
    return rows.withColumn("recommended_research", F.array_join("recommended_research", "|"))


@query("agg20_bridge_counts")
def agg20(s, d):
    return qs.bridge_counts(join7(s, d))


_REC = "rec AS (SELECT user_id, event_id, unnest([event_type, upper(event_type), 'x' || event_id % 5]) AS topic, unnest([0, 1, 2]) AS k FROM events)"


@query("agg17_research_topics", f"WITH {_REC}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(topic) ORDER BY event_id, k) AS rn FROM rec) SELECT CAST(user_id AS VARCHAR) AS project_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id, k) AS INTEGER) AS topic_no, topic FROM f WHERE rn = 1")
def agg17(s, d):
    items = table(s, d, "events").select(F.col("user_id").cast("string").alias("project_id"), F.col("event_id").alias("idea_id"), F.array("event_type", F.upper("event_type"), F.concat(F.lit("x"), (F.col("event_id") % 5).cast("string"))).alias("recommended_research"))
    return qs.research_topics(items)


@query("mem11_memory_pairs", "SELECT CAST(item_id AS VARCHAR) AS idea_id, 'q' || item_id AS user_text, text AS assistant_text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT CAST(item_id AS VARCHAR), 't' || k, 'sum' FROM benchmark, (VALUES (1), (2)) v(k) WHERE item_id % 2 = 1")
def mem11(s, d):
    n = F.col("item_id")
    r = lambda k: F.struct(F.lit(f"t{k}").alias("research_topic"), F.lit("sum").alias("research_summary"))
    blank = F.struct(F.lit(" ").alias("research_topic"), F.lit("x").alias("research_summary"))
    items = table(s, d, "benchmark").select(F.lit("p").alias("project_id"), n.cast("string").alias("idea_id"), F.when(n % 2 == 1, "answer_remote").otherwise("answer_local").alias("source_resolution"), F.array(r(1), blank, r(2)).alias("research"), F.concat(F.lit("q"), n.cast("string")).alias("origin_text"), F.col("text").alias("assistant_response"))
    return qs.memory_pairs(items).select("idea_id", "user_text", "assistant_text")


@query("flt10_validate_ideas", "SELECT item_id AS idea, CASE WHEN item_id % 5 = 0 THEN 'missing agent' WHEN item_id % 5 = 1 THEN 'origin_type' WHEN item_id % 5 = 2 THEN 'priority' END AS reject_reason FROM benchmark")
def flt10(s, d):
    n = F.col("item_id")
    meta = F.struct(F.when(n % 5 == 2, "zero").otherwise("2").alias("priority"), F.lit(0.5).alias("confidence"), F.lit("t").alias("theme"))
    rows = table(s, d, "benchmark").select(n.alias("idea"), n.cast("string").alias("id"), F.when(n % 5 == 0, " ").otherwise("a").alias("agent"), F.lit("t").alias("timestamp"), F.col("text").alias("origin_text"), F.when(n % 5 == 1, "Other").otherwise("Open Question").alias("origin_type"), F.lit("r").alias("assistant_response"), F.lit("c").alias("context_link"), meta.alias("metadata"))
    return qs.validate_ideas(rows).select("idea", "reject_reason")


@query("src4_json_lines", "SELECT item_id AS line_no, text AS question FROM benchmark WHERE item_id % 4 = 0 AND trim(text) <> ''")
def src4(s, d):
    n = F.col("item_id")
    good = F.to_json(F.struct(F.col("text").alias("question"), F.lit("t").alias("topic")))
    value = F.when(n % 4 == 0, good).when(n % 4 == 1, "").when(n % 4 == 2, "[1, 2]").otherwise("{broken")
    return qs.parse_log(table(s, d, "benchmark").select(F.lit("p").alias("project_id"), n.alias("line_no"), value.alias("value"))).select("line_no", "question")
