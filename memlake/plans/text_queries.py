"""Queries of the scalar, date, vector and cleanup operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import dates as dt
from memlake.functions import text as tx
from memlake.functions import vectors as vx
from memlake.operators import chunks as ck
from memlake.operators import cleanup as cl
from memlake.plans import inputs as i
from memlake.plans.inputs import CHUNKS, KEY, PAIR_TEXT, PAIRS, WORDS, strip
from memlake.plans.registry import query, table

W = WORDS.format


@query("scl1_normalize_lf", r"SELECT doc_id, regexp_replace(replace(text, '. ', '.' || chr(13) || chr(10)), '\r\n?', chr(10), 'g') AS body FROM documents")
def scl1(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", tx.normalize_lf(F.replace("text", F.lit(". "), F.lit(".\r\n"))).alias("body"))


@query("scl2_chunk_windows", f"WITH {CHUNKS} SELECT doc_id, chunk_index, chunk FROM chunks")
def scl2(s, d):
    return ck.chunk(i.documents(s, d), 600, 80).select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk")


@query("scl3_count_tokens", f"SELECT doc_id, CAST(len({W(x='text')}) AS INTEGER) AS tokens FROM documents")
def scl3(s, d):
    return table(s, d, "documents").select("doc_id", tx.count_tokens(F.col("text")).alias("tokens"))


@query("scl4_split_pair", rf"WITH {PAIRS}, c AS (SELECT project_id, pair_no, regexp_replace({PAIR_TEXT}, '\r\n?', chr(10), 'g') AS t FROM pairs), p AS (SELECT *, instr(t, chr(10) || 'Assistant:') AS spot FROM c) SELECT project_id, pair_no, {strip(r"regexp_replace(left(t, CAST(spot - 1 AS INTEGER)), '^([\s\S]*?)User:([\s\S]*)$', '\1\2')")} AS u, {strip("substring(t, CAST(spot + 11 AS INTEGER))")} AS a FROM p")
def scl4(s, d):
    cut = tx.split_pair(tx.compose_pair(F.col("user_text"), F.col("assistant_text")))
    return i.pairs(s, d).select("project_id", "pair_no", cut.alias("s")).select("project_id", "pair_no", F.col("s.user").alias("u"), F.col("s.assistant").alias("a"))


@query("scl5_pair_text", f"WITH {PAIRS} SELECT project_id, pair_no, {PAIR_TEXT} AS pair_text FROM pairs")
def scl5(s, d):
    return i.pairs(s, d).select("project_id", "pair_no", tx.compose_pair(F.col("user_text"), F.col("assistant_text")).alias("pair_text"))


@query("scl6_snake_case", "SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS v FROM documents")
def scl6(s, d):
    return table(s, d, "documents").select("doc_id", tx.snake_case(F.col("text")).alias("v"))


@query("scl7_topics", f"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda t: {strip('t')}), lambda t: t <> ''), '|') AS topics FROM documents")
def scl7(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(tx.topics_list(F.col("text")), "|").alias("topics"))


@query("scl8_labels", "SELECT event_id, upper(substring(event_type, 1, 1)) || lower(substring(event_type, 2)) || ' Event' AS label, '## ' || upper(substring(event_type, 1, 1)) || lower(substring(event_type, 2)) || ' Event: h' || user_id AS heading FROM events")
def scl8(s, d):
    kind = F.concat("event_type", F.lit("_event"))
    return table(s, d, "events").select("event_id", tx.title_label(kind).alias("label"), tx.entry_heading(kind, F.concat(F.lit("h"), F.col("user_id").cast("string"))).alias("heading"))


@query("scl9_question_key", f"SELECT item_id, {KEY.format(x='text')} || '||' || {KEY.format(x='text')} AS k FROM benchmark")
def scl9(s, d):
    return table(s, d, "benchmark").select("item_id", tx.question_key(F.col("text"), F.col("text")).alias("k"))


@query("scl10_prefix_norm", r"SELECT doc_id, regexp_replace(trim(regexp_replace(translate(lower(text), '’‘', ''''''), '\s+', ' ', 'g')), '[.!?]+$', '') AS v FROM documents")
def scl10(s, d):
    return table(s, d, "documents").select("doc_id", tx.prefix_norm(F.col("text")).alias("v"))


@query(
    "scl11_middle_cut",
    """WITH a AS (SELECT doc_id, text, length(text) AS n FROM documents), b AS (SELECT *, n - n * 40 // 100 AS keep FROM a),
 c AS (SELECT *, keep // 2 AS l0, keep - keep // 2 AS r0 FROM b), e AS (SELECT *, CASE WHEN l0 < 100 OR r0 < 100 THEN 100 ELSE l0 END AS l, CASE WHEN l0 < 100 OR r0 < 100 THEN 100 ELSE r0 END AS r FROM c)
 SELECT doc_id, CASE WHEN n <= 500 OR l + r >= n THEN text ELSE substring(text, 1, l) || chr(10) || '...[text left out]...' || chr(10) || substring(text, n - r + 1, r) END AS v FROM e""",
)
def scl11(s, d):
    return table(s, d, "documents").select("doc_id", tx.middle_cut(F.col("text"), 40, 500).alias("v"))


@query("scl12_contextual_turn", f"SELECT doc_id, CASE WHEN {strip('text')} <> '' THEN {strip('text')} || ' ' ELSE '' END || 'Context: ' || lang || '. Type: ' || source AS v FROM documents")
def scl12(s, d):
    tags = F.to_json(F.struct(F.col("lang").alias("semantic_handle"), F.lit(" ").alias("intent"), F.col("source").alias("type")))
    return table(s, d, "documents").select("doc_id", tx.contextual_turn(F.col("text"), tags).alias("v"))


@query("scl15_timestamps", "SELECT event_id, strftime(ts, '%m-%d-%Y_%H:%M:%S') AS local_ts, strftime(ts, '%Y%m%d_%H%M%S') AS a, strftime(ts, '%Y%m%d_%H%M%S') AS b, strftime(ts, '%m-%d-%Y') AS memory_date, strftime(ts, '%m-%d-%Y') AS dashed FROM events")
def scl15(s, d):
    now = F.lit("2000-01-01 00:00:00").cast("timestamp")
    iso, slash = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "MM/dd/yyyy HH:mm:ss")
    return table(s, d, "events").select("event_id", dt.local_from_iso(iso, now).alias("local_ts"), dt.compact(iso, now).alias("a"), dt.compact(slash, now).alias("b"), dt.memory_date(slash, now).alias("memory_date"), dt.dashed(F.date_format("ts", "MM/dd/yyyy")).alias("dashed"))


_PAYLOAD = "'assistant_text=' || regexp_replace(assistant_text, '\\r\\n?', chr(10), 'g') || chr(10) || 'entry_type=chat_pair' || chr(10) || 'project_id=' || project_id || chr(10) || 'source=chat' || chr(10) || 'timestamp=01-02-2024_03:04:05' || chr(10) || 'user_text=' || regexp_replace(user_text, '\\r\\n?', chr(10), 'g')"


@query("scl17_memory_id", f"WITH {PAIRS} SELECT project_id, pair_no, 'mem_20240102_030405_' || substring(sha256({_PAYLOAD}), 1, 8) AS memory_id FROM pairs")
def scl17(s, d):
    ts = F.lit("01-02-2024_03:04:05")
    payload = tx.hash_payload({"project_id": F.col("project_id"), "timestamp": ts, "source": F.lit("chat"), "entry_type": F.lit("chat_pair"), "user_text": F.col("user_text"), "assistant_text": F.col("assistant_text"), "route": F.lit(None).cast("string")})
    return i.pairs(s, d).select("project_id", "pair_no", tx.memory_id(dt.compact(ts, F.lit("2000-01-01").cast("timestamp")), payload).alias("memory_id"))


@query("scl19_chunk_id", f"WITH {CHUNKS} SELECT doc_id || '::chunk=' || chunk_index AS item_id FROM chunks")
def scl19(s, d):
    return ck.chunk(i.documents(s, d), 600, 80).select(tx.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("item_id"))


@query("scl21_capitalize", r"SELECT doc_id, '  ' || upper(substring(x, 1, 1)) || substring(x, 2) AS v FROM (SELECT doc_id, regexp_replace(lower(text), '^\s+', '') AS x FROM documents)")
def scl21(s, d):
    blank = r"[\t\n\f\r ]"  # what \s is in SQL
    return table(s, d, "documents").select("doc_id", tx.capitalize_first(F.concat(F.lit("  "), F.regexp_replace(tx.lower_each(F.col("text")), f"^{blank}+", "")), blank).alias("v"))


@query("scl22_resolution", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'answer_local' WHEN event_id % 4 = 1 THEN 'ignore' ELSE '' END AS v FROM events")
def scl22(s, d):
    raw = F.when(F.col("event_id") % 4 == 0, " Answer_Local ").when(F.col("event_id") % 4 == 1, "IGNORE").when(F.col("event_id") % 4 == 2, "other")
    return table(s, d, "events").select("event_id", tx.resolution(raw).alias("v"))


@query(
    "scl23_previous_turn",
    f"""WITH {PAIRS}, b AS (SELECT project_id, pair_no, lag({strip('user_text')}) OVER w AS u, lag({strip('assistant_text')}) OVER w AS a, lag(pair_no) OVER w AS had FROM pairs WINDOW w AS (PARTITION BY project_id ORDER BY pair_no)),
 c AS (SELECT *, length(a) AS n, (length(a) - length(a) * 50 // 100) // 2 AS h, (length(a) - length(a) * 50 // 100) - (length(a) - length(a) * 50 // 100) // 2 AS g FROM b WHERE had IS NOT NULL), d AS (SELECT *, CASE WHEN h < 100 OR g < 100 THEN 100 ELSE h END AS l, CASE WHEN h < 100 OR g < 100 THEN 100 ELSE g END AS r FROM c)
 SELECT project_id, pair_no, 'PREVIOUS TURN' || CASE WHEN u <> '' THEN chr(10) || 'User: ' || u ELSE '' END || CASE WHEN a <> '' THEN chr(10) || 'Assistant: ' || CASE WHEN n <= 1000 OR l + r >= n THEN a ELSE left(a, CAST(l AS INTEGER)) || chr(10) || '...[text left out]...' || chr(10) || substring(a, CAST(n - r + 1 AS INTEGER), CAST(r AS INTEGER)) END ELSE '' END AS block FROM d""",
)
def scl23(s, d):
    from memlake.operators import chat

    rows = chat.with_previous(i.pairs(s, d)).where("previous_text is not null")
    return rows.select("project_id", "pair_no", tx.previous_turn_block(F.col("previous_text"), 50, 1000).alias("block"))


@query("scl24_question_answers", f"WITH {PAIRS} SELECT project_id, string_agg('Q: ' || {strip('user_text')} || chr(10) || 'A: ' || {strip('assistant_text')}, chr(10) || chr(10) ORDER BY pair_no) AS block FROM pairs WHERE {strip('user_text')} <> '' GROUP BY project_id")
def scl24(s, d):
    rows = i.pairs(s, d).where(tx.strip(F.col("user_text")) != "").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("pair_no", F.col("user_text").alias("question"), F.col("assistant_text").alias("answer")))).alias("r"))
    return rows.select("project_id", tx.question_answers(F.col("r")).alias("block"))


@query("scl27_28_usage_latency", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'provider' WHEN event_id % 5 = 1 THEN (CASE WHEN event_id % 3 > 0 THEN 'estimate' ELSE 'zero_fallback' END) WHEN event_id % 5 = 2 THEN 'provider' ELSE (CASE WHEN event_id % 3 > 0 THEN 'estimate' ELSE 'zero_fallback' END) END AS usage_source, CASE WHEN event_id % 2 = 0 THEN event_id % 100 ELSE 1500 END AS ttlt FROM events")
def scl27(s, d):
    e, n = table(s, d, "events"), F.col("event_id")
    given = F.when(n % 5 == 0, "provider").when(n % 5 == 1, "strange")
    start = F.col("ts").cast("timestamp")
    end = start + F.expr("interval 1500 milliseconds")
    return e.select("event_id", tx.usage_source(given, n % 5 != 2, n % 3).alias("usage_source"), dt.latency_ms(F.when(n % 2 == 0, n % 100).otherwise(F.lit(-1)), start, end).alias("ttlt"))


@query("scl30_safe_path", r"SELECT page_id, CASE WHEN page_id % 3 = 2 AND NOT regexp_matches(p, '(^|/)\.\.(/|$)') THEN 'docs/' || p END AS p FROM (SELECT page_id, rtrim(replace(regexp_extract(url, '^[^/]*//[^/]*/(.*)$', 1), '\', '/')) AS p FROM pages)")
def scl30(s, d):
    n, path = F.col("page_id") % 3, F.regexp_extract("url", "^[^/]*//[^/]*/(.*)$", 1)
    raw = F.when(n == 0, F.concat(F.lit("/"), path)).when(n == 1, F.concat(F.lit("a/../"), path)).otherwise(F.concat(F.lit("docs\\"), path))
    return table(s, d, "pages").select("page_id", tx.safe_relative(raw).alias("p"))


@query("ord5_trim_tokens", f"SELECT doc_id, array_to_string(({W(x='text')})[1:50], ' ') AS v FROM documents")
def ord5(s, d):
    return table(s, d, "documents").select("doc_id", tx.trim_to_tokens(F.col("text"), 50).alias("v"))


@query("ord7_compact_list", f"WITH w AS (SELECT doc_id, unnest({W(x='text')}) AS w, generate_subscripts({W(x='text')}, 1) AS spot FROM documents), f AS (SELECT doc_id, lower(w) AS k, arg_min(w, spot) AS w, min(spot) AS spot FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS n FROM f) SELECT doc_id, string_agg(w, ',' ORDER BY n) AS kinds FROM r WHERE n <= 2 GROUP BY doc_id")
def ord7(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(tx.compact_list(tx.words(F.col("text"))), ",").alias("kinds")).where("kinds <> ''")


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query("vec1_normalize", f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / {_NORM}, 6) AS total, round(CAST(embedding[1] AS DOUBLE) / {_NORM}, 6) AS head FROM embeddings")
def vec1(s, d):
    v = table(s, d, "embeddings").select("vec_id", vx.normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("head"))


_PLACES = "SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings"


@query("vec2_cosine01", f"SELECT vec_id, CAST(place AS INTEGER) AS place, round((greatest(-1.0, least(1.0, CAST(e AS DOUBLE) * 3)) + 1) / 2, 6) AS v FROM ({_PLACES})")
def vec2(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "e")).select("vec_id", "place", F.round(vx.cosine_to_01(F.col("e").cast("double") * 3), 6).alias("v"))


@query("vec3_l2_cosine", f"SELECT vec_id, CAST(place AS INTEGER) AS place, round(CASE WHEN x >= 0 THEN greatest(greatest(0.0, least(1.0, 1 - x * x / 2)), greatest(0.0, least(1.0, 1 - x / 2))) ELSE 0.0 END, 6) AS v FROM (SELECT vec_id, place, CAST(e AS DOUBLE) * 4 AS x FROM ({_PLACES}))")
def vec3(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "e")).select("vec_id", "place", F.round(vx.cosine_from_l2(F.col("e").cast("double") * 4), 6).alias("v"))


@query(
    "vec4_hash_embed",
    f"""WITH w AS (SELECT doc_id, unnest({W(x='lower(text)')}) AS w FROM documents), c AS (SELECT doc_id, ('0x' || substring(md5(w), 1, 8))::BIGINT % 64 AS p, count(*) AS n FROM w GROUP BY ALL),
 t AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM c GROUP BY doc_id) SELECT doc_id, round(coalesce(sum(n / len * (p + 1)), 0), 6) AS weighted, CAST(count(p) AS INTEGER) AS places FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) GROUP BY doc_id""",
)
def vec4(s, d):
    rows = ck.embed(table(s, d, "documents").select("doc_id", "text"), "text", lambda: ck.HashEmbedder(64)).drop("text")
    weighted = F.aggregate(F.transform("vector", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.round(weighted, 6).alias("weighted"), F.size(F.filter("vector", lambda x: x > 0)).alias("places"))


@query("vec4_hash_embed_columns", f"""WITH w AS (SELECT item_id, unnest({W(x='lower(text)')}) AS w FROM benchmark), c AS (SELECT item_id, ('0x' || substring(md5(w), 1, 8))::BIGINT % 64 AS p, count(*) AS n FROM w GROUP BY ALL),
 t AS (SELECT item_id, sqrt(sum(n * n)) AS len FROM c GROUP BY item_id) SELECT item_id, round(sum(n / len * (p + 1)), 6) AS weighted FROM c JOIN t USING (item_id) GROUP BY item_id""")
def vec4c(s, d):
    rows = table(s, d, "benchmark").select("item_id", vx.hash_embed(F.col("text"), 64).alias("v"))
    return rows.select("item_id", F.round(F.aggregate(F.transform("v", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("weighted"))


@query(
    "vec7_token_batches",
    f"""WITH RECURSIVE t AS (SELECT source AS project_id, doc_id, CAST(len({W(x='text')}) AS INTEGER) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
 b AS (SELECT project_id, doc_id, tokens, n, 0::BIGINT AS batch_id, tokens::BIGINT AS used FROM t WHERE n = 1 UNION ALL
 SELECT t.project_id, t.doc_id, t.tokens, t.n, CASE WHEN used + t.tokens > 2000 AND used > 0 THEN batch_id + 1 ELSE batch_id END, CASE WHEN used + t.tokens > 2000 AND used > 0 THEN t.tokens ELSE used + t.tokens END FROM b JOIN t ON t.project_id = b.project_id AND t.n = b.n + 1) SELECT project_id, doc_id, tokens, batch_id FROM b""",
)
def vec7(s, d):
    rows = i.documents(s, d).select("project_id", "doc_id", tx.count_tokens(F.col("text")).alias("tokens"))
    return ck.token_batches(rows, ["project_id"], ["doc_id"], "tokens", 2000)


_FILLER = "CASE doc_id % 4 WHEN 0 THEN 'Great question! Sure, here it is. ' WHEN 1 THEN 'Certainly. ' ELSE '' END || text"


_FRONT = "(sure|certainly|great question|of course|absolutely|happy to help|thanks for asking)"


def _front_step(name: str, of: str) -> str:
    """One more leading sentence that begins with a rule, if something is left behind it."""
    head = rf"regexp_extract(body, '^\s*[^\s][\s\S]*?[.!?](\s+|$)')"
    norm = r"regexp_replace(trim(regexp_replace(translate(lower(trim(h)), '’‘', chr(39) || chr(39)), '\s+', ' ', 'g')), '[.!?]+$', '')"
    goes = rf"go AND h <> '' AND NOT regexp_matches(h, '^\s*```') AND regexp_matches({norm}, '^{_FRONT}') AND regexp_matches(substring(body, length(h) + 1), '\S')"
    return rf"{name} AS (SELECT doc_id, CASE WHEN g THEN substring(body, length(h) + 1) ELSE body END AS body, removed + CAST(g AS INTEGER) AS removed, g AS go FROM (SELECT *, coalesce({goes}, false) AS g FROM (SELECT *, {head} AS h FROM {of})))"


@query("txt1_trim_front", f"WITH s0 AS (SELECT doc_id, {_FILLER} AS body, 0 AS removed, true AS go FROM documents), {_front_step('s1', 's0')}, {_front_step('s2', 's1')}, {_front_step('s3', 's2')} SELECT doc_id, body, CAST(removed AS INTEGER) AS removed FROM s3")
def txt1(s, d):
    filler = F.when(F.col("doc_id") % 4 == 0, "Great question! Sure, here it is. ").when(F.col("doc_id") % 4 == 1, "Certainly. ").otherwise("")
    rows = cl.trim_front(table(s, d, "documents").select("doc_id", F.concat(filler, "text").alias("body")), "body")
    return rows.select("doc_id", "body", F.size("front_prefixes").alias("removed"))


_PARAGRAPHS = r"regexp_replace(regexp_replace(text, '\n[ \t]*\n\s*', chr(10) || chr(10), 'g'), '\s+$', '')"


@query("txt2_trim_end", rf"SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN text WHEN regexp_matches(text, '\S') THEN {_PARAGRAPHS} ELSE text || chr(10) || chr(10) || 'Let me know if this helps.' END AS body, CASE WHEN doc_id % 2 = 0 AND regexp_matches(text, '\S') THEN 'let me know if' END AS end_prefix, doc_id % 2 = 0 AND NOT regexp_matches(text, '\S') AS end_blocked FROM documents")
def txt2(s, d):
    t = table(s, d, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n\nLet me know if this helps.").otherwise("")).alias("body"))
    return cl.trim_end(t, "body").select("doc_id", "body", "end_prefix", "end_blocked")


@query("txt3_whitespace", rf"WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, '. ', '.   '), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t\r]+$', ''), '(\S)[ \t]{{2,}}', '\1 ', 'g')) AS ls FROM documents) SELECT doc_id, {strip("regexp_replace(array_to_string(ls, chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} AS body FROM l")
def txt3(s, d):
    t = table(s, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".   ")).alias("body"))
    return t.select("doc_id", cl.compact_whitespace(F.col("body")).alias("body"))


_SENT = rf"list_filter(string_split(regexp_replace({strip('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\S'))"


@query("txt4_sentences", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS chars FROM (SELECT doc_id, {_SENT} AS s FROM documents) WHERE len(s) > 0")
def txt4(s, d):
    rows = cl.sentences(table(s, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(F.char_length("sentence")).cast("long").alias("chars"))


@query("txt5_protected", rf"WITH s AS (SELECT doc_id, unnest({_SENT}) AS x FROM documents) SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches(x, '[0-9]|[A-Za-z](_|\.[A-Za-z]| *\()')) AS BIGINT) AS n FROM s GROUP BY doc_id")
def txt5(s, d):
    rows = cl.sentences(table(s, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count_if(cl.protected(F.col("sentence"))).alias("n"))


@query("txt6_similar_sentences")
def txt6(s, d):
    rows = cl.similar_sentences(table(s, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if("dropped").alias("dropped"))


@query("txt8_saved_tokens", f"WITH a AS (SELECT source, {_FILLER} AS b, text AS t FROM documents) SELECT source, CAST(sum(len({W(x='b')})) AS BIGINT) AS tokens_before, CAST(sum(len({W(x='t')})) AS BIGINT) AS tokens_after, CAST(count(*) FILTER (WHERE b <> t) AS BIGINT) AS changed, CAST(0 AS BIGINT) AS too_long FROM a GROUP BY source")
def txt8(s, d):
    filler = F.when(F.col("doc_id") % 4 == 0, "Great question! Sure, here it is. ").when(F.col("doc_id") % 4 == 1, "Certainly. ").otherwise("")
    rows = table(s, d, "documents").select("source", F.concat(filler, "text").alias("before"), F.col("text").alias("after"))
    return cl.saved_tokens(rows, "source", "before", "after", most=2_000_000)


@query("scl13_14_tagger_json", f"SELECT doc_id, lang AS topics, 'ask' AS intent, '' AS type, lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS semantic_handle, CASE WHEN {strip('text')} <> '' THEN {strip('text')} END AS question, CASE WHEN {strip('text')} <> '' THEN source END AS topic, CASE WHEN {strip('text')} <> '' THEN 'ignore' END AS resolution FROM documents")
def scl13(s, d):
    from memlake.operators import ingest

    noisy = F.concat(F.lit("Answer: "), F.to_json(F.struct(F.col("lang").alias("topics"), F.lit("ask").alias("intent"), F.col("text").alias("semantic_handle"), F.array(F.struct(F.col("text").alias("question"), F.col("source").alias("topic"), F.lit("x").alias("resolution"))).alias("questions"))), F.lit(" trailing }"))
    rows = ingest.balanced_json(table(s, d, "documents").select("doc_id", noisy.alias("raw")), "raw").drop("raw")
    return ingest.tagger_fields(rows).drop("json").withColumn("q", F.get("questions", F.lit(0))).select("doc_id", "topics", "intent", "type", "semantic_handle", "q.question", "q.topic", "q.resolution")



@query("txt7_prune")
def txt7(s, d):
    """Fillers at both ends go; the other stages are off."""
    n = F.col("doc_id") % 4
    filler = F.when(n == 0, "Great question! Sure, here it is. ").when(n == 1, "Certainly. ").otherwise("")
    t = table(s, d, "documents").select("doc_id", F.concat(filler, "text", F.when(n % 2 == 0, "\n\nLet me know if this helps.").otherwise("")).alias("body"))
    rows = cl.prune(t, "body", cl.Pruning(whitespace=False, similarity=False))
    return rows.select("doc_id", "body", "result.changed", "result.trimmed_side", F.col("result.front_units_removed").alias("removed"), F.coalesce("result.end_span_removed.stop", F.lit(0)).alias("stop"))


@query("txt7_prune_all")
def txt7_all(s, d):
    rows = cl.prune(table(s, d, "documents").select("doc_id", F.col("text").alias("body")), "body")
    return rows.select("doc_id", "body", "result.changed", "result.trimmed_side")
