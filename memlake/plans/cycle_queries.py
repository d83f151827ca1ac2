"""Queries of the consolidation cycle: its outcome, and what a lake holds after two cycles over the same chat."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memlake.operators import artifacts as ar
from memlake.operators import chat
from memlake.operators.steps import shared_dir
from memlake.plans import cycle
from memlake.plans import inputs as i
from memlake.plans.inputs import ORDERED, PAIR_TEXT, PAIRS, WORDS, strip
from memlake.plans.registry import query
from memlake.settings import Settings
from memlake.sources.lake import Lake

_LEFT = """st AS (SELECT *, CAST(role = 'user' AND nrole = 'assistant' AND NOT coalesce(nforget, false) AS INTEGER) AS staged FROM ordered),
 wn AS (SELECT *, coalesce(sum(staged) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, lag(staged) OVER (PARTITION BY project_id ORDER BY pos) AS own FROM st),
 gone AS (SELECT *, CASE WHEN role = 'assistant' AND prole = 'user' THEN before - own < 3 ELSE before < 3 AND nid IS NOT NULL END AS goes FROM wn)"""


@query(
    "mem14_cycle",
    f"""WITH {PAIRS}, {_LEFT}, b AS (SELECT *, coalesce(count(*) FILTER (WHERE NOT forget) OVER (PARTITION BY project_id ORDER BY pair_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM pairs), f AS (SELECT * FROM b WHERE done < 3), t AS (SELECT *, {PAIR_TEXT} AS text FROM f WHERE NOT forget)
 SELECT m.project_id, m.n AS items_in, coalesce(f.n, 0) AS flushed, coalesce(e.n, 0) AS items_out, coalesce(e.tokens, 0) AS tokens, coalesce(l.n, 0) AS left, CASE WHEN coalesce(e.n, 0) > 0 THEN 'done' ELSE 'skipped' END AS status
 FROM (SELECT project_id, count(*) AS n FROM messages GROUP BY 1) m LEFT JOIN (SELECT project_id, count(*) AS n FROM f GROUP BY 1) f USING (project_id) LEFT JOIN (SELECT project_id, count(*) AS n FROM gone WHERE NOT goes GROUP BY 1) l USING (project_id) LEFT JOIN (SELECT project_id, count(*) AS n, CAST(sum(len({WORDS.format(x='text')})) AS BIGINT) AS tokens FROM t GROUP BY 1) e USING (project_id)""",
)
def mem14(s, d):
    return cycle.consolidate(s, i.messages(s, d), Settings()).outcome.drop("chunks", "questions")


def _two_cycles(s, d) -> Lake:
    """A new lake after two cycles of one pair each over the same, whole chat table."""
    lake, few = Lake(s, f"{shared_dir(s)}/lake-{uuid.uuid4().hex}"), Settings(pair_limit=1)
    for when in ("01-02-2024_03:04:05", "01-03-2024_03:04:05"):
        cycle.run_cycle(s, lake, i.messages(s, d), few, timestamp=when)
    return lake


_LF = lambda x: f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
_HANDLE = "lower(regexp_replace(regexp_replace(array_to_string(topics[1:2], ' '), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
#: The first two pairs that are not to be forgotten of each project, one a cycle, with their tags, ids and rendered bodies.
_STAGED = rf"""{PAIRS}, u AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pair_no) AS nth FROM pairs WHERE NOT forget),
 e AS (SELECT *, CASE nth WHEN 1 THEN '01-02-2024_03:04:05' ELSE '01-03-2024_03:04:05' END AS ts, CASE nth WHEN 1 THEN '20240102_030405' ELSE '20240103_030405' END AS stamp FROM u WHERE nth <= 2),
 said AS (SELECT project_id, pair_no, term, count(*) AS tf FROM (SELECT project_id, pair_no, unnest(regexp_extract_all(lower(user_text || ' ' || assistant_text), '\p{{L}}{{4,}}')) AS term FROM e) GROUP BY ALL),
 tags AS (SELECT project_id, pair_no, (list(term ORDER BY tf DESC, term))[1:3] AS topics FROM said GROUP BY ALL),
 x AS (SELECT e.*, topics, coalesce({_HANDLE}, '') AS handle, 'mem_' || stamp || '_' || substring(sha256('assistant_text=' || {_LF('assistant_text')} || chr(10) || 'entry_type=chat_pair' || chr(10) || 'project_id=' || project_id || chr(10) || 'source=chat' || chr(10) || 'timestamp=' || ts || chr(10) || 'user_text=' || {_LF('user_text')}), 1, 8) AS memory_id FROM e LEFT JOIN tags USING (project_id, pair_no)),
 staged AS (SELECT *, '## Chat Pair' || CASE WHEN handle = '' THEN '' ELSE ': ' || handle END || chr(10) || chr(10) || '### Metadata' || chr(10) || chr(10) || '```yaml' || chr(10) || 'entry_type: chat_pair' || chr(10) || 'current_scope: ltm' || chr(10) || 'day_sequence: 1' || chr(10)
  || CASE WHEN topics IS NULL THEN '' ELSE 'topics:' || chr(10) || array_to_string(list_transform(topics, lambda t: '  - ' || t || chr(10)), '') END || '```' || chr(10) || chr(10) || '### User Message' || chr(10) || {strip(_LF('user_text'))} || chr(10) || chr(10) || '### Assistant Message' || chr(10) || {strip(_LF('assistant_text'))} || chr(10) AS body FROM x)"""


@query("mem14_entries", f"WITH {_STAGED} SELECT project_id, memory_id, body AS text, project_id || '_' || replace(ts, ':', '-') || '.md' AS name FROM staged")
def mem14_entries(s, d):
    """Entries of all artifacts after two cycles: both cycles' are there."""
    found = ar.entries(_two_cycles(s, d).read("artifacts"), ["project_id", "name"], "content")
    return found.select("project_id", "memory_id", "text", "name")


@query("mem14_chunks", f"WITH {_STAGED}, w AS (SELECT project_id, memory_id, n, substring(body, CAST(n * 520 + 1 AS INTEGER), 600) AS chunk FROM staged, LATERAL (SELECT unnest(range(0, CAST(ceil(length(body) / 520.0) AS BIGINT))) AS n)) SELECT project_id, memory_id, CAST(row_number() OVER (PARTITION BY project_id, memory_id ORDER BY n) - 1 AS INTEGER) AS chunk_index, chunk FROM w WHERE regexp_matches(chunk, '\\S')")
def mem14_chunks(s, d):
    """Chunk rows of the sound indexes after two cycles."""
    return _two_cycles(s, d).index(600, 80)[0].select("project_id", "memory_id", "chunk_index", "chunk")


@query("mem14_consumed", f"WITH {ORDERED}, {_LEFT} SELECT project_id, id FROM gone WHERE goes")
def mem14_consumed(s, d):
    """Messages that a flush of three pairs takes away."""
    return chat.consumed(i.messages(s, d), 3)


@query(
    "udf4_tagger",
    rf"""WITH {PAIRS}, said AS (SELECT project_id, pair_no, term, count(*) AS tf FROM (SELECT project_id, pair_no, unnest(regexp_extract_all(lower(user_text || ' ' || assistant_text), '\p{{L}}{{4,}}')) AS term FROM pairs) GROUP BY ALL),
 spread AS (SELECT project_id, term, count(*) AS df FROM said GROUP BY ALL), n AS (SELECT project_id, count(*) AS n FROM pairs GROUP BY ALL),
 w AS (SELECT project_id, pair_no, term, round(tf * (ln((n + 1) / (df + 1)) + 1), 9) AS weight FROM said JOIN spread USING (project_id, term) JOIN n USING (project_id)),
 tags AS (SELECT project_id, pair_no, (list(term ORDER BY weight DESC, term))[1:3] AS topics FROM w GROUP BY ALL)
 SELECT project_id, pair_no, coalesce(array_to_string(topics, '|'), '') AS topics, coalesce({_HANDLE}, '') AS semantic_handle FROM pairs LEFT JOIN tags USING (project_id, pair_no)""",
)
def udf4(s, d):
    return chat.tag(i.pairs(s, d)).select("project_id", "pair_no", F.array_join("topics", "|").alias("topics"), "semantic_handle")
