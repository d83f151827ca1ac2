"""Queries of the smaller projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import artifacts as ar
from memlake.operators import chat
from memlake.operators import chunks as ck
from memlake.operators import cleanup as cl
from memlake.operators import ingest
from memlake.operators import questions as qs
from memlake.operators import retrieval as rt
from memlake.plans import inputs as i
from memlake.plans.inputs import MESSAGES, PAIRS, WORDS
from memlake.plans.registry import query, table
from memlake.plans.retrieval_queries import _HITS, _hits

W = WORDS.format


@query("prj1_canonical", "SELECT vec_id AS item, coalesce(CASE WHEN vec_id % 2 = 0 THEN 's' || vec_id END, 'd' || label) AS source_document_id, coalesce(CASE WHEN vec_id % 3 = 0 THEN label END, CAST(vec_id AS INTEGER)) AS chunk_index FROM embeddings")
def prj1(s, d):
    v = F.col("vec_id")
    rows = table(s, d, "embeddings").select(v.alias("item"), F.when(v % 2 == 0, F.concat(F.lit("s"), v.cast("string"))).alias("source_document_id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("doc_id"), F.when(v % 3 == 0, F.col("label")).alias("chunk_index"), v.cast("int").alias("chunk_seq"))
    return rt.canonical(rows)


@query("prj3_response_json", "SELECT CASE WHEN vec_id % 2 = 0 THEN '{\"id\":' || vec_id || '}' ELSE '{\"id\":' || vec_id || ',\"label\":' || label || '}' END AS response FROM embeddings")
def prj3(s, d):
    return rt.response_json(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 1, F.col("label")).alias("label")))


@query("ord4_best_hit", f"WITH {_HITS} SELECT query_id, arg_max(doc_id * 1000 + chunk_index, (score, -hit_rank)) AS item_id, max(score) AS score FROM hits WHERE source = 'ltm' GROUP BY query_id")
def ord4(s, d):
    return rt.best_hit(_hits(s, d)[0].where("source = 'ltm'").withColumn("item_id", F.col("doc_id") * 1000 + F.col("chunk_index")))


@query("agg5_source_scores", f"WITH {_HITS} SELECT query_id, count(*) FILTER (WHERE source = 'daily') AS daily_hits, count(*) FILTER (WHERE source = 'ltm') AS ltm_hits, round(coalesce(avg(score) FILTER (WHERE source = 'daily'), 0), 6) AS daily_mean, round(coalesce(avg(score) FILTER (WHERE source = 'ltm'), 0), 6) AS ltm_mean FROM hits GROUP BY query_id")
def agg5(s, d):
    rows = rt.source_scores(_hits(s, d)[0])
    return rows.withColumn("daily_mean", F.round("daily_mean", 6)).withColumn("ltm_mean", F.round("ltm_mean", 6))


@query("flt4_forget", f"WITH {PAIRS} SELECT project_id, pair_no FROM pairs WHERE NOT forget")
def flt4(s, d):
    return chat.unforgotten(i.pairs(s, d)).select("project_id", "pair_no")


@query("flt8_public_tags", "SELECT event_id, 'type=' || event_type AS tags FROM events")
def flt8(s, d):
    tags = F.create_map(F.lit("type"), F.col("event_type"), F.lit("_raw"), F.col("event_id").cast("string"))
    public = tx.public_tags(tags)
    return table(s, d, "events").select("event_id", F.array_join(F.transform(F.map_entries(public), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("tags"))


def _items(s, d):
    n = F.col("item_id")
    entry = F.struct(F.lit("t").alias("research_topic"), F.when(n % 3 == 0, F.lit(" ")).otherwise(F.col("text")).alias("research_summary"))
    return table(s, d, "benchmark").select(F.lit("p").alias("project_id"), n.alias("idea_id"), F.when(n % 2 == 0, "answer_remote").otherwise("answer_local").alias("source_resolution"), F.array(entry).alias("research"), (F.char_length("text") % 4 == 0).alias("remember"))


@query("flt11_without_research", "SELECT item_id AS idea_id, NOT (item_id % 2 = 0 AND (item_id % 3 = 0 OR trim(text) = '')) AS kept FROM benchmark")
def flt11(s, d):
    keep, drop = qs.without_research(_items(s, d))
    return keep.select("idea_id", F.lit(True).alias("kept")).unionByName(drop.select("idea_id", F.lit(False).alias("kept")))


@query("flt12_remembered", "SELECT item_id AS idea_id FROM benchmark WHERE length(text) % 4 = 0")
def flt12(s, d):
    return qs.remembered(_items(s, d)).select("idea_id")


@query("flt13_with_text", r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'e' || doc_id ELSE text END AS to_embed FROM documents WHERE doc_id % 5 > 0 AND (doc_id % 3 = 0 OR regexp_matches(text, '\S'))")
def flt13(s, d):
    n = F.col("doc_id")
    rows = table(s, d, "documents").select(n, F.when(n % 5 == 0, F.lit("  ")).when(n % 3 == 0, F.concat(F.lit("e"), n.cast("string"))).otherwise("").alias("embed_text"), "text")
    return ck.with_text(rows).select("doc_id", "to_embed")


@query("flt14_has_content", rf"SELECT doc_id, doc_id % 2 = 1 AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S') AND NOT regexp_matches(x, '^\s*==='))) > 0 AS full_ FROM documents")
def flt14(s, d):
    """Every line of the texts of even ids becomes a heading."""
    body = F.concat(F.lit("=== HEAD\n \n=== TAIL\n"), F.when(F.col("doc_id") % 2 == 1, F.col("text")).otherwise(F.regexp_replace("text", "(?m)^", "=== ")))
    return table(s, d, "documents").select("doc_id", tx.has_content(body).alias("full_"))


@query("set2_prefix_rules", "SELECT rule, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS at FROM (SELECT event_type AS rule, min((user_id, event_id)) AS f FROM events GROUP BY event_type)")
def set2(s, d):
    """Each user's kinds of events are a rule list."""
    return cl.merge_rules(table(s, d, "events").select(F.col("user_id").alias("list_no"), F.col("event_id").alias("nth"), F.col("event_type").alias("rule")))


@query("set3_pending", "SELECT item_id AS idea_id, length(text) % 4 = 0 AS fresh FROM benchmark")
def set3(s, d):
    rows = _items(s, d)
    return qs.pending(rows.where("not remember").withColumn("fresh", F.lit(False)), rows.where("remember").withColumn("fresh", F.lit(True))).select("idea_id", "fresh")


@query("set6_origin_ids", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a,b' ELSE 'a,' || user_id || ',b' END AS ids FROM events")
def set6(s, d):
    second = F.when(F.col("event_id") % 2 == 0, F.lit(" a ")).otherwise(F.col("user_id").cast("string"))
    return table(s, d, "events").select("event_id", F.array_join(qs.origin_ids(F.lit("a"), second, F.array(F.lit("b"), F.lit(" "), F.lit("a"))), ",").alias("ids"))


@query("scl16_hash_payload", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'kind=' || event_type || chr(10) || 'user=' || user_id ELSE 'user=' || user_id END AS payload FROM events")
def scl16(s, d):
    return table(s, d, "events").select("event_id", tx.hash_payload({"user": F.col("user_id"), "kind": F.when(F.col("event_id") % 2 == 0, F.col("event_type"))}).alias("payload"))


_LF = r"regexp_replace(text, '\r\n?', chr(10), 'g')"


@query("scl25_section_topics", "SELECT doc_id, 'Intro|' || source || CASE WHEN lang = source THEN '' ELSE '|' || lang END AS topics, text AS body FROM documents")
def scl25(s, d):
    body = F.concat(F.lit("=== TOPIC: Intro ===\n"), "text", F.lit("\n#topics: "), "source", F.lit(", "), "lang", F.lit(", Intro\n"))
    tail = tx.strip_open_questions(F.concat("text", F.lit("\n=== OPEN QUESTIONS ===\n"), F.col("source")))
    return table(s, d, "documents").select("doc_id", F.array_join(tx.section_topics(body), "|").alias("topics"), tail.alias("body"))


@query("mem1_headers", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'title: t' || chr(10) || '---' || chr(10) || {_LF} ELSE '---' || chr(10) || 'title: p' || doc_id || chr(10) || '---' || chr(10) || chr(10) || '# Memory 01-02-2024' || chr(10) || chr(10) || {_LF} || chr(10) END AS content FROM documents")
def mem1(s, d):
    old = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\ntitle: t\n---\n"), "text")).otherwise(F.concat(F.lit("=== BEGIN DAILY MEMORY: 01/02/2024 ===\n"), "text", F.lit("\n=== END DAILY MEMORY: 01/02/2024 ===\n")))
    return table(s, d, "documents").select("doc_id", ar.ensure_header(ar.normalize_wrappers(old), F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("content"))


@query("mem2_headings", rf"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '## Own' || chr(10) || text WHEN regexp_matches(text, '(?m)^##\s+.+$') THEN text ELSE '## Chat Pair: h' || doc_id || chr(10) || chr(10) || text END AS entry, {_LF} || CASE WHEN suffix({_LF}, chr(10)) THEN chr(10) ELSE chr(10) || chr(10) END || '<!-- begin memory_id=x' AS marked FROM documents")
def mem2(s, d):
    entry = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## Own\n"), "text")).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", ar.ensure_heading(entry, F.lit("chat_pair"), F.concat(F.lit("h"), F.col("doc_id").cast("string"))).alias("entry"), ar.blank_before_markers(F.concat("text", F.lit("\n<!-- begin memory_id=x"))).alias("marked"))


@query("snk8_delete_file", "SELECT doc_id FROM documents WHERE doc_id % 10 > 0")
def snk8(s, d):
    rows = i.documents(s, d).select("doc_id")
    return ingest.without(rows, rows.where("doc_id % 10 = 0"), ["doc_id"])


@query("agg19_research_plan", "SELECT event_id AS idea_id, topic FROM (SELECT event_id, unnest([event_type, 'x']) AS topic FROM events)")
def agg19(s, d):
    rows = table(s, d, "events").select(F.col("user_id").cast("string").alias("project_id"), F.col("event_id").alias("idea_id"), F.array("event_type", F.lit(" "), F.lit("x")).alias("recommended_research"))
    return qs.research_plan(rows).select("idea_id", "topic")


@query("win5_day_sequence", f"WITH {PAIRS} SELECT project_id, pair_no, row_number() OVER (PARTITION BY project_id ORDER BY pair_no) + 7 AS day_sequence FROM pairs")
def win5(s, d):
    p = i.pairs(s, d)
    existing = p.select("project_id").distinct().withColumn("day_sequence", F.lit(7))
    entries = chat.daily_entries(p, existing, F.lit("01-02-2024_03:04:05"))
    return entries.select("project_id", (F.col("day_sequence") - 7).cast("long").alias("pair_no"), "day_sequence")


@query("udf5_token_counter", f"WITH {MESSAGES} SELECT project_id, CAST(sum(len({W(x='content')})) AS BIGINT) AS tokens FROM messages GROUP BY project_id")
def udf5(s, d):
    return i.messages(s, d).groupBy("project_id").agg(F.sum(tx.count_tokens(F.col("content"))).alias("tokens"))
