"""The operators applied to the given tables, as the result contracts ask.

Each query gets its rows through its operator and derives digest columns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm import alignment, bpe_codec, conversations, html_extract, language_id, media, packing, quality, secret_scan, simhash, sstable, token_counts, warc
from memlake.llm.storage import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = sstable.write_sstables(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)

    def digest(ids: np.ndarray) -> tuple[int, int]:
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return sstable.read_sstables(manifest, digest, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), prefix="prefix", at="words")
    tokens = token_counts.tokens_of("prefix")
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = _table(spark, sf_dir, "documents").select("doc_id", "text"), media.storing()
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Files are written and read back in one Python stage: they never cross to the JVM.
        for batch in store(batches):
            rows = []
            for data in batch.column("media"):
                data = data.as_py()
                video = media.Video(data)
                payload, shots = video.payload(), video.shots()
                feature = f"frames={len(video.avi.frames)};clips={len(shots)};starts={','.join(str(a * video.avi.frame_us // 1000) for a, _, _ in shots)}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-media.UNIT :]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.mapInArrow(digest, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.verdicts(docs).select("doc_id", *(f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the versions at paths; the ledger is new, so every blob is unseen once.  The method adds no kinds: all spans are base ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scan.BlobLedger(spark, scratch(spark, "secret-ledger"))
    ledger.scan(docs)
    number = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = secret_scan.joined(F.col("findings"))
    return ledger.findings(docs).select("doc_id", *(number(r.kind) for r in secret_scan.RULES), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, one kind for each of five remainders of a checksum; ``copies`` says how often a row stands."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    body = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(text("role"))
    return rows.select("conv_id", "turn", role.alias("role"), body.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(damaged(_table(spark, sf_dir, "conversations")), copies="copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sstable": op1_sstable,
        "op2_bpe_codec": op2_bpe_codec,
        "op3_media": op3_media,
        "op4_language_id": op4_language_id,
        "op5_html": op5_html,
        "op6_quality": op6_quality,
        "op7_simhash": op7_simhash,
        "op8_token_counts": op8_token_counts,
        "op9_warc": op9_warc,
        "op10_packing": op10_packing,
        "op11_secret_scan": op11_secret_scan,
        "op12_token_alignment": op12_token_alignment,
        "op13_conversation_repair": op13_conversation_repair,
    }


def _width(v: str) -> str:
    """Width of the sketch bucket of a whole number."""
    return f"(1::BIGINT << greatest(0, length(bin({v})) - 9))"


def _summary(by: str) -> str:
    """Edges of the quartiles and usual rates of merged sketches for groups of n_shown columns, in SQL."""
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}metric, n, a, b, b + {_width("b")} AS b_end, c + {_width("c")} AS c_end, coalesce(n_shown * rate // n, 0) AS usual FROM (SELECT {keys}metric, max(total)::BIGINT AS n, max(n_shown)::BIGINT AS n_shown, min(CASE WHEN bucket > 0 AND upto_shown * 4 >= n_shown THEN bucket END) AS rate, min(CASE WHEN upto * 4 >= total THEN bucket END) AS a, min(CASE WHEN upto * 4 >= total * 2 THEN bucket END) AS b, min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS c
 FROM (SELECT {keys}metric, bucket, sum(n) OVER o AS upto, sum(shown) OVER o AS upto_shown, sum(n) OVER p AS total, sum(shown) OVER p AS n_shown FROM (SELECT {keys}metric, bucket, sum(n) AS n, sum(CASE WHEN bucket > 0 THEN n ELSE 0 END) AS shown FROM sketch GROUP BY {keys}metric, bucket) WINDOW p AS (PARTITION BY {keys}metric), o AS (PARTITION BY {keys}metric ORDER BY bucket)) GROUP BY {keys}metric)"""


def _drawn(own: str, wider: str) -> str:
    return ", ".join(f"({own}.n * {own}.{c} + 100 * {wider}.{c}) // ({own}.n + 100) AS {c}" for c in ("a", "b", "b_end", "c_end", "usual"))


QUALITY_SQL = rf"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
 win AS (SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
 again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
 cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
 f AS (SELECT l.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM l LEFT JOIN cov USING (doc_id)),
 m AS (SELECT lang, source, unnest(['word_length', 'symbols', 'dup_lines']) AS metric, unnest([word_chars * 1000 // n_words, n_symbols * 100000 // n_words, n_dup_lines * 100000 // n_words]) AS v FROM f WHERE n_words >= 10),
 sketch AS (SELECT lang, source, metric, v - v % {_width("v")} AS bucket, count(*) AS n FROM m GROUP BY ALL),
 g AS ({_summary("lang, source")}), gl AS ({_summary("lang")}), ga AS ({_summary("")}),
 l2 AS (SELECT gl.lang, gl.metric, {_drawn("gl", "ga")} FROM gl JOIN ga ON gl.metric = ga.metric),
 g2 AS (SELECT g.lang, g.source, g.metric, {_drawn("g", "l2")} FROM g JOIN l2 ON g.lang IS NOT DISTINCT FROM l2.lang AND g.metric = l2.metric),
 t AS (SELECT lang, source, max(CASE WHEN metric = 'word_length' THEN b - 16 * (b_end - a) END) AS wl, max(CASE WHEN metric = 'word_length' THEN b + 16 * (c_end - b) END) AS wh, max(CASE WHEN metric = 'symbols' THEN usual END) AS su, max(CASE WHEN metric = 'dup_lines' THEN usual END) AS du FROM g2 GROUP BY lang, source)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(word_chars * 1000 // n_words BETWEEN wl AND wh AND n_symbols * 100000 <= 4 * (su * n_words + 100000) AND n_dup_lines * 100000 <= 4 * (du * n_words + 100000), true) AS kept
 FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source"""

def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SECRETS = {
    "assign": ("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("(AKIA[A-Z0-9]+)", 0, 20),
    "hex": ("([0-9a-f]+)", 0, 24),
}
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {nth} AS nth, list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(text, '{p}', 0), lambda x: length(x)) AS sizes, list_transform(regexp_extract_all(text, '{p}', {group}), lambda x: length(x) >= {least}) AS good FROM d"
    for nth, (kind, (p, group, least)) in enumerate(_SECRETS.items())
)
SECRETS_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({_MATCHES}),
 e AS (SELECT doc_id, kind, nth, i, gaps[i] AS gap, sizes[i] AS size, good[i] AS good FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM m)),
 s AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM e),
 k AS (SELECT doc_id, kind, nth, stop - size AS start, stop FROM s WHERE good),
 g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans FROM k GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

WARC_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
 b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
 SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(5), lambda k: CAST(substring(bits, CAST(i * 5 + k + 1 AS INTEGER), 1) AS INTEGER) * (16 >> k))) AS INTEGER) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force."""
    return {"op6_quality": QUALITY_SQL, "op9_warc": WARC_SQL, "op11_secret_scan": SECRETS_SQL}
