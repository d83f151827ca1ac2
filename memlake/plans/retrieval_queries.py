"""Queries of the retrieval and artifact operators, and the composed plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.functions import vectors as vx
from memlake.operators import artifacts as ar
from memlake.operators import chat
from memlake.operators import chunks as ck
from memlake.operators import retrieval as rt
from memlake.operators import stats
from memlake.operators.steps import cut
from memlake.plans import cycle
from memlake.plans import inputs as i
from memlake.plans.inputs import CHUNKS, PAIR_TEXT, PAIRS, WORDS, strip
from memlake.plans.registry import query, table
from memlake.settings import ROUTE_POLICY, Settings, policy_rows, route_policy

_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_VECTORS = f"vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / {_NORM}) AS v FROM embeddings)"
_IP = "round(list_sum(list_transform(list_zip(q.v, i.v), lambda p: p[1] * p[2])), 9)"


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", vx.normalize(F.col("embedding")).alias("vector"))


def _asked(s, d):
    """Every vector whose id is divisible by 100, as a query against all vectors."""
    return _vectors(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("qvec"), "label")


def _top(by):
    return f"WITH {_VECTORS}, h AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, {_IP} AS ip FROM vectors q JOIN vectors i ON {by} WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ip DESC, item_id) AS n FROM h) SELECT query_id, item_id, CAST(n AS INTEGER) AS hit_rank, round(ip, 5) AS ip FROM r WHERE n <= 6"


@query("vec5_top_k", _top("q.label = i.label"))
def vec5(s, d):
    """Within the query's own label, as within a project."""
    hits = rt.top_k(_asked(s, d), _vectors(s, d).withColumnRenamed("vec_id", "item_id"), 6, by="label")
    return hits.select("query_id", "item_id", "hit_rank", F.round("ip", 5).alias("ip"))


@query("vec5_top_k_scan", _top("true"))
def vec5_scan(s, d):
    hits = rt.top_k(_asked(s, d), _vectors(s, d).withColumnRenamed("vec_id", "item_id"), 6)
    return hits.select("query_id", "item_id", "hit_rank", F.round("ip", 5).alias("ip"))


_POLICY = "policy AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {m}::DOUBLE, {k}, {sc}::DOUBLE, {b}, {a})" for r, m, k, sc, b, a in ROUTE_POLICY) + ") p(route, retrieval_multiplier, max_keep, min_score, expansion_before, expansion_after))"
_ROUTE = "CASE item_id % 7 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'PROCEDURAL' WHEN 2 THEN 'EXPLORATORY' WHEN 3 THEN 'SYNTHESIS' WHEN 4 THEN 'CHITCHAT' ELSE 'OTHER' END"


def _routed(s, d):
    n = F.col("item_id") % 7
    raw = F.when(n == 0, "direct").when(n == 1, " Procedural").when(n == 2, "EXPLORATORY").when(n == 3, "SYNTHESIS").when(n == 4, "CHITCHAT").when(n == 5, "unheard of")
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", raw.alias("route"))
    return rt.with_policy(q, route_policy(s), Settings().base_top_k)


@query("join4_policy", f"WITH {_POLICY} SELECT item_id AS query_id, route AS policy_route, max_keep, min_score, CAST(greatest(0, ceil(6 * retrieval_multiplier)) AS INTEGER) AS per_source_k FROM benchmark JOIN policy ON route = {_ROUTE}")
def join4(s, d):
    return _routed(s, d).select("query_id", "policy_route", "max_keep", "min_score", "per_source_k")


@query("flt3_retrievable", f"WITH {_POLICY} SELECT item_id AS query_id FROM benchmark JOIN policy ON route = {_ROUTE} WHERE retrieval_multiplier > 0 AND max_keep > 0")
def flt3(s, d):
    return rt.retrievable(_routed(s, d)).select("query_id")


# Hits of a search of two sources among all vectors; a vector stands for a chunk of a document.
_VROUTE = "CASE vec_id // 100 % 5 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'PROCEDURAL' WHEN 2 THEN 'EXPLORATORY' WHEN 3 THEN 'SYNTHESIS' ELSE 'OTHER' END"
_HITS = f"""{CHUNKS}, {_POLICY}, {_VECTORS}, q AS (SELECT vec_id AS query_id, v, CAST(greatest(0, ceil(6 * retrieval_multiplier)) AS INTEGER) AS per_source_k, p.* FROM vectors JOIN policy p ON route = {_VROUTE} WHERE vec_id % 100 = 0),
 h0 AS (SELECT query_id, CASE WHEN label % 4 = 0 THEN 'daily' ELSE 'ltm' END AS source, vec_id, {_IP} AS ip, per_source_k, min_score, max_keep, expansion_before, expansion_after FROM vectors i, q),
 h1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY ip DESC, vec_id) AS hit_rank FROM h0),
 hits AS (SELECT query_id, source, vec_id // 4 AS doc_id, CAST(vec_id % 4 AS INTEGER) AS chunk_index, coalesce((SELECT c.chunk FROM chunks c WHERE c.doc_id = vec_id // 4 AND c.chunk_index = vec_id % 4), 'v' || vec_id) AS chunk, round((greatest(-1, least(1, 2 * ip)) + 1) / 2, 2) AS score, hit_rank, min_score, max_keep, expansion_before, expansion_after FROM h1 WHERE hit_rank <= per_source_k),
 ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE source WHEN 'daily' THEN 0 ELSE 1 END, hit_rank, doc_id, chunk_index) - 1 AS pos FROM hits),
 gated AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS rn0 FROM ord WHERE score > min_score),
 bon AS (SELECT *, CASE WHEN lag(doc_id) OVER w = doc_id AND abs(chunk_index - lag(chunk_index) OVER w) = 1 THEN 1 ELSE 0 END AS bonus FROM gated WINDOW w AS (PARTITION BY query_id ORDER BY pos)),
 sel AS (SELECT * FROM (SELECT *, coalesce(sum(bonus) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earned FROM bon) WHERE rn0 - earned < max_keep),
 tier AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS k FROM sel),
 bud AS (SELECT *, CAST(CASE WHEN i < ceil(k / 3) THEN expansion_before WHEN i < ceil(2 * k / 3) THEN ceil(expansion_before / 2) ELSE least(1, expansion_before) END AS INTEGER) AS before_n, CAST(CASE WHEN i < ceil(k / 3) THEN expansion_after WHEN i < ceil(2 * k / 3) THEN ceil(expansion_after / 2) ELSE least(1, expansion_after) END AS INTEGER) AS after_n FROM tier),
 want AS (SELECT bud.*, unnest(range(chunk_index - before_n, chunk_index + after_n + 1)) AS idx FROM bud),
 expd AS (SELECT w.*, CASE WHEN w.idx = w.chunk_index THEN w.chunk ELSE c.chunk END AS n_text FROM want w LEFT JOIN chunks c ON c.doc_id = w.doc_id AND c.chunk_index = w.idx WHERE c.chunk IS NOT NULL OR w.idx = w.chunk_index),
 ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, idx ORDER BY pos, idx) AS cp FROM expd) WHERE cp = 1),
 dord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fp, idx, pos) - 1 AS ordn FROM (SELECT *, min(pos) OVER (PARTITION BY query_id, doc_id) AS fp FROM ded))"""


def _hits(s, d):
    n = F.floor(F.col("query_id") / 100) % 5
    route = F.when(n == 0, "DIRECT").when(n == 1, "procedural").when(n == 2, "EXPLORATORY").when(n == 3, "SYNTHESIS")
    q = rt.retrievable(rt.with_policy(_asked(s, d).withColumn("route", route), route_policy(s), Settings().base_top_k))
    v, daily = _vectors(s, d).withColumnRenamed("vec_id", "item_id"), F.col("label") % 4 == 0
    search = lambda cond, name: rt.top_k(q, v.where(cond), 15).withColumn("source", F.lit(name))
    hits = search(daily, "daily").unionByName(search(~daily, "ltm")).join(q.select("query_id", "per_source_k", "min_score", "max_keep", "expansion_before", "expansion_after"), "query_id").where(F.col("hit_rank") <= F.col("per_source_k"))
    item = F.col("item_id")
    rows = cut(hits.withColumns({"doc_id": F.floor(item / 4), "chunk_index": (item % 4).cast("int"), "score": F.round(vx.cosine_to_01(2 * F.col("ip")), 2)}))
    # Only documents with a hit are cut into chunks: for the hits' own texts and their neighbours'.
    near = cut(ck.chunk(i.documents(s, d).join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), 600, 80))
    own = near.select("doc_id", "chunk_index", "chunk")
    return rows.join(own, ["doc_id", "chunk_index"], "left").withColumn("chunk", F.coalesce("chunk", F.concat(F.lit("v"), item.cast("string")))), near


def _kept(s, d):
    hits, c = _hits(s, d)
    return rt.tiers(rt.select_with_bonus(rt.score_gate(rt.order_hits(hits)))), c


@query("flt1_score_gate", f"WITH {_HITS} SELECT query_id, doc_id, chunk_index, score FROM hits WHERE score > min_score")
def flt1(s, d):
    return rt.score_gate(_hits(s, d)[0]).select("query_id", "doc_id", "chunk_index", "score")


@query("flt2_threshold_or_best", f"WITH {_HITS}, t AS (SELECT *, score >= 0.98 AS passed, max(CASE WHEN score >= 0.98 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS anyp, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_rank) AS rn FROM hits WHERE source = 'ltm') SELECT query_id, doc_id, chunk_index FROM t WHERE passed OR (anyp = 0 AND rn = 1)")
def flt2(s, d):
    return rt.threshold_or_best(_hits(s, d)[0].where("source = 'ltm'"), 0.98).select("query_id", "doc_id", "chunk_index")


@query("ord1_order_hits", f"WITH {_HITS} SELECT query_id, source, doc_id, chunk_index, pos FROM ord")
def ord1(s, d):
    return rt.order_hits(_hits(s, d)[0]).select("query_id", "source", "doc_id", "chunk_index", "pos")


@query("win7_selection", f"WITH {_HITS} SELECT query_id, doc_id, chunk_index, rn0 FROM sel")
def win7(s, d):
    return rt.select_with_bonus(rt.score_gate(rt.order_hits(_hits(s, d)[0]))).select("query_id", "doc_id", "chunk_index", "rn0")


@query("win8_tiers", f"WITH {_HITS} SELECT query_id, pos, before_n, after_n FROM bud")
def win8(s, d):
    return _kept(s, d)[0].select("query_id", "pos", "before_n", "after_n")


@query("join2_expansion", f"WITH {_HITS} SELECT query_id, pos, doc_id, CAST(idx AS INTEGER) AS idx, n_text FROM expd")
def join2(s, d):
    kept, c = _kept(s, d)
    return rt.expand(kept, c).select("query_id", "pos", "doc_id", "idx", F.coalesce("n_text", "chunk").alias("n_text"))


@query("join3_neighbours", f"WITH {CHUNKS} SELECT doc_id, chunk_index, lag(chunk_index) OVER w AS prev_item, lead(chunk_index) OVER w AS next_item FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def join3(s, d):
    c = ck.chunk(i.documents(s, d), 600, 80)
    return ck.neighbours(c, ["doc_id"], "chunk_index", "chunk_index").select("doc_id", "chunk_index", "prev_item", "next_item")


@query("win9_dedupe", f"WITH {_HITS} SELECT query_id, doc_id, CAST(idx AS INTEGER) AS idx, pos FROM ded")
def win9(s, d):
    kept, c = _kept(s, d)
    return rt.dedupe(rt.expand(kept, c)).select("query_id", "doc_id", "idx", "pos")


@query("agg12_dedupe_audit", f"WITH {_HITS} SELECT query_id, count(*) AS input_rows, count(DISTINCT (doc_id, idx)) AS unique_rows, CAST(0 AS BIGINT) AS sparse_rows, count(*) - count(DISTINCT (doc_id, idx)) AS duplicate_rows FROM expd GROUP BY query_id")
def agg12(s, d):
    kept, c = _kept(s, d)
    return rt.dedupe_audit(rt.expand(kept, c))


@query("win10_document_order", f"WITH {_HITS} SELECT query_id, doc_id, CAST(idx AS INTEGER) AS idx, ordn AS ord FROM dord")
def win10(s, d):
    kept, c = _kept(s, d)
    return rt.order_documents(rt.dedupe(rt.expand(kept, c))).select("query_id", "doc_id", "idx", "ord")


@query("win11_trim_overlap", rf"""WITH RECURSIVE {CHUNKS}, b AS (SELECT doc_id, chunk_index, chunk AS t, 0 AS cut, right(chunk, 80) AS tail FROM chunks WHERE chunk_index = 0
 UNION ALL SELECT doc_id, chunk_index, t, cut, right(t, CAST(least(length(t) - cut, 80) AS INTEGER)) FROM (SELECT doc_id, chunk_index, t, CASE WHEN k < length(t) THEN k ELSE 0 END AS cut FROM (SELECT c.doc_id, c.chunk_index, c.chunk AS t, coalesce(list_max(list_filter(range(1, 81), lambda n: n <= length(b.tail) AND n <= length(c.chunk) AND right(b.tail, CAST(n AS INTEGER)) = left(c.chunk, CAST(n AS INTEGER)))), 0) AS k FROM b JOIN chunks c ON c.doc_id = b.doc_id AND c.chunk_index = b.chunk_index + 1)))
 SELECT doc_id, chunk_index AS ord, substring(t, CAST(cut + 1 AS INTEGER)) AS chunk FROM b""")
def win11(s, d):
    """Neighbouring windows of all documents; a short last window may go on in what the one before left of it."""
    c = ck.chunk(i.documents(s, d), 600, 80)
    rows = c.select(F.col("doc_id").alias("query_id"), "doc_id", F.col("chunk_index").alias("ord"), "chunk")
    return rt.trim_overlap(rows, 80, "chunk").select("doc_id", "ord", "chunk")


@query(
    "win12_collapse",
    f"WITH {_HITS}, b AS (SELECT *, CASE WHEN lag(doc_id) OVER w = doc_id AND lag(source) OVER w = source AND lag(idx) OVER w + 1 = idx THEN 0 ELSE 1 END AS cut FROM dord WINDOW w AS (PARTITION BY query_id ORDER BY ordn)), g AS (SELECT *, sum(cut) OVER (PARTITION BY query_id ORDER BY ordn ROWS UNBOUNDED PRECEDING) AS island FROM b) SELECT query_id, CAST(island AS INTEGER) AS snippet_number, arg_min(source, ordn) AS source, arg_min(score, ordn) AS score, arg_min(doc_id, ordn) AS doc_id, CASE WHEN count(*) > 1 THEN min(idx) || '..' || max(idx) ELSE CAST(min(idx) AS VARCHAR) END AS chunk_range, count(*) AS members, string_agg(n_text, '' ORDER BY ordn) AS text FROM g GROUP BY query_id, island",
)
def win12(s, d):
    kept, c = _kept(s, d)
    rows = rt.expand(kept, c).withColumn("n_text", F.coalesce("n_text", "chunk")).drop("chunk")
    return rt.collapse(rt.order_documents(rt.dedupe(rows)), "n_text")


_FLAT = "trim(replace(replace(text, chr(10), ' '), ',', ';'))"


@query("prj2_header_fields", f"SELECT doc_id, ', memory_id=m' || doc_id || ', source_document_id=' || source || CASE WHEN {_FLAT} <> '' THEN ', semantic_handle=' || {_FLAT} ELSE '' END AS fields FROM documents")
def prj2(s, d):
    return table(s, d, "documents").select("doc_id", rt.header_fields({"memory_id": F.concat(F.lit("m"), F.col("doc_id").cast("string")), "source_document_id": F.col("source"), "artifact_path": F.lit(None).cast("string"), "entry_type": F.lit(" "), "semantic_handle": F.col("text")}).alias("fields"))


@query("set1_join1_daily_enrichment", "SELECT e.vec_id AS item_id, 'daily' AS source, d.lang AS entry_type FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id AND d.doc_id % 2 = 0 WHERE e.label < 5 UNION ALL SELECT vec_id, 'ltm', NULL FROM embeddings WHERE label >= 5 OR label IS NULL")
def set1(s, d):
    """A join miss keeps the hit, without metadata."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    entries = table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("entry_type"))
    return rt.two_sources(e.where("label < 5").drop("label"), e.where("label >= 5 or label is null").drop("label"), entries)


@query("mem12_merged_retrieval")
def mem12(s, d):
    return cycle.retrieve(s, i.documents(s, d), table(s, d, "benchmark"), i.pairs(s, d)).select("query_id", "snippet_number", "source", F.round("score", 6).alias("score"), "doc_id", "chunk_range", "text")


@query("mem9_context_block")
def mem9(s, d):
    return rt.context_block(mem12(s, d))


@query("mem10_parse_context")
def mem10(s, d):
    return rt.parse_context(mem9(s, d).select("query_id", "context")).drop("more")


@query("mem13_topic_context")
def mem13(s, d):
    """Every text's words are section titles and topics; one job answers all topics of all texts."""
    w = tx.words(F.col("text"))
    summary = F.concat(F.lit("=== TOPIC: "), F.array_join(F.slice(w, 1, 6), " "), F.lit(" ===\n#topics: "), F.array_join(F.slice(w, 7, 3), " "), F.lit(", "), F.array_join(F.slice(w, 10, 100), " "), F.lit("\n"))
    texts = table(s, d, "benchmark").select("item_id", summary.alias("text"))
    return cycle.topic_context(s, texts, i.documents(s, d), i.pairs(s, d))


# -- artifacts: documents rendered from the pairs, then parsed back -----------------------


def _entries(s, d):
    p = i.pairs(s, d)
    mid = F.concat(F.lit("mem_20240102_030405_"), F.substring(F.md5(F.concat("project_id", F.lit(":"), F.col("pair_no").cast("string"))), 1, 8))
    block = ar.metadata_block([("entry_type", F.lit("chat_pair")), ("current_scope", F.lit("daily")), ("pair", F.col("pair_no").cast("string")), ("none", F.lit(None).cast("string"))], [("topics", F.array(F.lit("a"), F.col("project_id")))])
    return p.select("project_id", "pair_no", mid.alias("memory_id"), "user_text", "assistant_text", ar.render_entry(mid, F.lit("chat_pair"), F.lit("h"), block, F.col("user_text"), F.col("assistant_text")).alias("block"))


def _artifacts(s, d):
    docs = ar.export(_entries(s, d), ["project_id"], "pair_no", "block")
    return docs.select("project_id", F.concat(F.lit("---\ntitle: memory\n---\n\nfree text\n"), "content", F.when(F.col("project_id").cast("long") % 3 == 0, "<!-- begin memory_id=mem_1 -->\n").otherwise("tail\n")).alias("content"))


_MID = "'mem_20240102_030405_' || substring(md5(project_id || ':' || pair_no), 1, 8)"


@query("snk5_export", f"WITH {PAIRS} SELECT project_id, count(*) AS entries FROM pairs GROUP BY project_id")
def snk5(s, d):
    return _artifacts(s, d).select("project_id", F.size(F.regexp_extract_all("content", F.lit(r"(?m)^<!-- begin memory_id=mem_2"), F.lit(0))).cast("long").alias("entries"))


@query("scl20_render_entry", f"WITH {PAIRS} SELECT project_id, pair_no, '<!-- begin memory_id=' || {_MID} || ' -->' || chr(10) || '## Chat Pair: h' || chr(10) || chr(10) || '### Metadata' || chr(10) || chr(10) || '```yaml' || chr(10) || 'entry_type: chat_pair' || chr(10) || 'current_scope: daily' || chr(10) || 'pair: ' || pair_no || chr(10) || 'topics:' || chr(10) || '  - a' || chr(10) || '  - ' || project_id || chr(10) || '```' || chr(10) || chr(10) || '### User Message' || chr(10) || {strip('user_text')} || chr(10) || chr(10) || '### Assistant Message' || chr(10) || {strip('assistant_text')} || chr(10) || chr(10) || '<!-- end memory_id=' || {_MID} || ' -->' || chr(10) || chr(10) AS block FROM pairs")
def scl20(s, d):
    return _entries(s, d).select("project_id", "pair_no", "block")


@query("mem3_entries", f"WITH {PAIRS} SELECT project_id, {_MID} AS memory_id, {_MID} AS end_id, CAST(1 AS INTEGER) AS copy FROM pairs")
def mem3(s, d):
    return ar.entries(_artifacts(s, d), ["project_id"], "content").select("project_id", "memory_id", "end_id", "copy")


@query("mem4_warnings", f"WITH {PAIRS} SELECT DISTINCT project_id, 'invalid_begin' AS kind, 'mem_1' AS memory_id FROM pairs WHERE CAST(project_id AS BIGINT) % 3 = 0")
def mem4(s, d):
    return ar.warnings(_artifacts(s, d), ["project_id"], "content").select("project_id", "kind", "memory_id")


@query("mem5_metadata", f"WITH {PAIRS} SELECT project_id, {_MID} AS memory_id, unnest(['entry_type', 'current_scope', 'pair', 'topics']) AS key, unnest(['chat_pair', 'daily', CAST(pair_no AS VARCHAR), 'a|' || project_id]) AS vals, unnest([false, false, false, true]) AS list FROM pairs")
def mem5(s, d):
    found = ar.entries(_artifacts(s, d), ["project_id"], "content")
    return ar.metadata(found, ["project_id", "memory_id"]).select("project_id", "memory_id", "key", F.array_join("values", "|").alias("vals"), "list")


@query("mem5_warnings", r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))), ' ') AS x, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS i FROM documents WHERE doc_id % 5 <> 0)
 SELECT doc_id, CAST(4 + i AS INTEGER) AS line, CASE WHEN instr(x, ':') = 0 THEN 'no_colon' ELSE 'empty_key' END AS kind FROM l WHERE x <> '' AND NOT starts_with(x, '- ') AND (instr(x, ':') = 0 OR trim(split_part(x, ':', 1), ' ') = '')
 UNION ALL SELECT doc_id, CAST(2 AS INTEGER), CASE WHEN doc_id % 5 = 0 THEN 'fence' ELSE 'open_fence' END FROM documents WHERE doc_id % 5 < 2""")
def mem5_warnings(s, d):
    """Every line of a text is a metadata line; some blocks have another fence, some none at the end."""
    n = F.col("doc_id") % 5
    block = F.concat(F.when(n == 0, "```json\n").otherwise("```yaml\n"), "text", F.when(n == 1, "").otherwise("\n```"))
    rows = table(s, d, "documents").select("doc_id", F.concat(F.lit("## head\n### Metadata\n\n"), block).alias("text"))
    return ar.metadata_warnings(rows, ["doc_id"])


@query("mem6_rescope", f"WITH {PAIRS} SELECT project_id, count(*) AS moved, 0::BIGINT AS stayed, true AS message_kept FROM pairs GROUP BY project_id")
def mem6(s, d):
    """Metadata lines move; a line of the same words outside the entries stays."""
    docs = _artifacts(s, d).withColumn("content", F.concat("content", F.lit("\ncurrent_scope: daily outside\n")))
    new = ar.rescope(F.col("content"))
    times = lambda p: F.size(F.regexp_extract_all(new, F.lit(p), F.lit(0))).cast("long")
    return docs.select("project_id", times(r"(?m)^current_scope: ltm$").alias("moved"), times(r"(?m)^current_scope: daily$").alias("stayed"), F.contains(new, F.lit("current_scope: daily outside")).alias("message_kept"))


_BODY = f"'## Chat Pair: h' || chr(10) || chr(10) || '### Metadata' || chr(10) || chr(10) || '```yaml' || chr(10) || 'entry_type: chat_pair' || chr(10) || 'current_scope: daily' || chr(10) || 'pair: ' || pair_no || chr(10) || 'topics:' || chr(10) || '  - a' || chr(10) || '  - ' || project_id || chr(10) || '```' || chr(10) || chr(10) || '### User Message' || chr(10) || {strip('user_text')} || chr(10) || chr(10) || '### Assistant Message' || chr(10) || {strip('assistant_text')} || chr(10)"


@query("mem7_region_chunks", f"WITH {PAIRS}, e AS (SELECT project_id, {_MID} AS memory_id, pair_no, {_BODY} AS body FROM pairs), w AS (SELECT project_id, memory_id, pair_no, i, substring(body, CAST(i * 520 + 1 AS INTEGER), 600) AS chunk FROM e, LATERAL (SELECT unnest(range(0, CAST(ceil(length(body) / 520.0) AS BIGINT))) AS i)) SELECT project_id, memory_id, CAST(row_number() OVER (PARTITION BY project_id, memory_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, chunk, 'f' || project_id AS filename, CAST(pair_no AS VARCHAR) AS pair, 'daily' AS scope FROM w WHERE regexp_matches(chunk, '\\S')")
def mem7(s, d):
    found = ar.entries(_artifacts(s, d), ["project_id"], "content").where("copy = 1")
    regions = ar.with_metadata(found, ["project_id", "memory_id"]).withColumns({"filename": F.concat(F.lit("f"), "project_id"), "doc_id": F.col("memory_id")})
    rows = ar.regions_to_chunks(regions, 600, 80)
    return rows.select("project_id", "memory_id", "chunk_index", "chunk", F.col("fields")["filename"].alias("filename"), F.col("fields")["pair"].alias("pair"), F.col("fields")["current_scope"].alias("scope"))


@query("mem8_rebuild_text", f"WITH {CHUNKS} SELECT doc_id, string_agg(chunk, chr(10) ORDER BY chunk_index) AS text FROM chunks GROUP BY doc_id")
def mem8(s, d):
    return ck.rebuild_text(ck.chunk(i.documents(s, d), 600, 80), ["doc_id"])


@query("set4_unbounded", f"WITH {PAIRS}, p AS (SELECT DISTINCT project_id FROM pairs) SELECT project_id, unnest(['head', CASE WHEN CAST(project_id AS BIGINT) % 3 = 0 THEN 'mark' ELSE 'tail' END]) AS part FROM p")
def set4(s, d):
    r = ar.unbounded(_artifacts(s, d), ["project_id"], "content")
    return r.select("project_id", F.when(F.contains("region", F.lit("free text")), "head").when(F.contains("region", F.lit("tail")), "tail").otherwise("mark").alias("part"))


@query("set5_distinct_entries", "WITH a AS (SELECT user_id AS query_id, event_id AS snippet_number, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS memory_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, memory_id ORDER BY snippet_number) AS n FROM a) SELECT query_id, snippet_number, memory_id FROM r WHERE memory_id IS NULL OR n = 1")
def set5(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("snippet_number"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("memory_id"))
    return ar.distinct_entries(rows)


@query("agg14_bounded_counts", "SELECT user_id AS query_id, count(*) FILTER (WHERE event_id % 3 <> 0) AS bounded, count(*) FILTER (WHERE event_id % 3 = 0) AS unbounded FROM events GROUP BY user_id")
def agg14(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("query_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("memory_id"))
    return ar.bounded_counts(rows)


def _expanded(s, d):
    """Snippets of which some have a path that climbs, some another path in their document's id, and some an unknown entry."""
    found = ar.entries(_artifacts(s, d), ["project_id"], "content").select(F.col("project_id").alias("artifact_path"), "memory_id", "text")
    docs = i.documents(s, d).select("doc_id", "text")
    n, own = F.col("pair_no"), F.col("project_id")
    snippets = _entries(s, d).select(
        "pair_no", "project_id", F.when(n % 3 == 0, F.concat(F.lit("../"), own)).otherwise(own).alias("artifact_path"), F.concat(F.when(n % 4 == 0, F.concat(F.lit("other/"), own)).otherwise(own), F.lit("::memory_id=x")).alias("source_document_id"),
        F.when(n % 2 == 1, F.col("memory_id")).otherwise("missing").alias("memory_id"), (own.cast("long") * 7).alias("doc_id"), F.lit("own").alias("text"),
    )
    return ar.expand_entries(snippets, found, docs)


_METHOD = "CASE WHEN pair_no % 2 = 1 THEN CASE WHEN pair_no % 3 = 0 THEN 'source_document' ELSE 'artifact' END WHEN CAST(project_id AS BIGINT) * 7 IN (SELECT doc_id FROM documents WHERE text <> '') THEN 'chunks' ELSE 'original' END"


@query("join8_entry_expansion", f"WITH {PAIRS} SELECT project_id, pair_no, {_METHOD} AS method, CASE WHEN pair_no % 2 = 1 THEN NULL WHEN pair_no % 4 = 0 THEN 'artifact_unknown' ELSE 'entry_not_found' END AS reason, CASE WHEN pair_no % 4 = 0 AND pair_no % 3 > 0 THEN 'path_mismatch' END AS warning FROM pairs")
def join8(s, d):
    return _expanded(s, d).select("project_id", "pair_no", "method", "reason", "warning")


_LENGTH = "CASE WHEN method IN ('artifact', 'source_document') THEN NULL WHEN method = 'original' THEN 3 ELSE (SELECT length(text) FROM documents t WHERE t.doc_id = m.doc_id) END"


@query("agg13_expansion_summary", f"WITH {PAIRS}, m AS (SELECT {_METHOD} AS method, CAST(project_id AS BIGINT) * 7 AS doc_id FROM pairs) SELECT CASE WHEN method IN ('chunks', 'original') THEN 'fallback' ELSE 'expanded' END AS status, method, count(*) AS n, count(*) FILTER (WHERE {_LENGTH} > 2000) AS truncated FROM m WHERE method IN ('chunks', 'original') GROUP BY ALL")
def agg13(s, d):
    rows = _expanded(s, d).where("status = 'fallback'").withColumn("truncated", F.char_length("expanded") > 2000)
    return stats.expansion_summary(rows)


@query("ord6_size_bounded")
def ord6(s, d):
    rows = table(s, d, "documents").select("doc_id", "text")
    return ar.size_bounded(rows, "text", 1000).select("doc_id", "truncated", F.char_length("text").alias("n_chars"), F.char_length(F.to_json(F.struct("doc_id", "text"))).alias("json_chars"))


@query("snk5_names", "SELECT event_id, event_type || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS name FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)")
def snk5_names(s, d):
    rows = table(s, d, "events").select("user_id", "event_id", F.concat("event_type", F.lit(".md")).alias("name"))
    return ar.without_collisions(rows, ["user_id"], "name", "event_id").select("event_id", "name")


@query("src8_policy_rows", "SELECT upper(n_name) AS route, n_nationkey / 10.0 AS retrieval_multiplier, CAST(n_nationkey AS INTEGER) AS max_keep, CASE WHEN n_nationkey % 4 = 1 THEN 'min_score missing' WHEN n_nationkey % 4 = 2 THEN 'expansion_after below 0' WHEN n_nationkey % 4 = 3 THEN 'min_score above 1' END AS problem FROM nation")
def src8(s, d):
    n = F.col("n_nationkey")
    score = F.when(n % 4 == 1, F.lit(None)).when(n % 4 == 3, 1.5).otherwise(0.5)
    value = F.to_json(F.struct((n / 10).alias("retrieval_multiplier"), n.alias("max_keep"), score.alias("min_score"), F.struct(n.alias("max_before"), F.when(n % 4 == 2, -1).otherwise(2).alias("max_after")).alias("expansion")))
    return policy_rows(table(s, d, "nation").select(F.col("n_name").alias("route"), value.alias("value"))).select("route", "retrieval_multiplier", "max_keep", "problem")
