"""Retrieval for a table of queries at once.

Each query has a bounded number of hits after the top-k, so the windows that follow
(by query) are over small groups; the only large step is the similarity search, which
multiplies blocks of queries with blocks of items and moves k rows a query and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from memlake.functions import text as tx

#: Queries, and bytes of their vectors, that may be sent to all tasks at once; more are dealt over a grid of blocks.
SENT_QUERIES, SENT_BYTES = 8192, 32 << 20
#: Most queries and items of a block of the grid, bytes of the vectors of one, and queries and items of one product of matrices.
QUERY_BLOCK, ITEM_BLOCK, BLOCK_BYTES, PRODUCT = 8192, 65_536, 64 << 20, (1024, 2048)
HEADER_KEYS = ("memory_id", "source_document_id", "artifact_path", "entry_type", "source_agent", "source_scope", "current_scope", "semantic_handle")


def with_policy(queries: DataFrame, policy: DataFrame, base_top_k: int, route: str = "route") -> DataFrame:
    """Policy of each query's route (unknown: OTHER) and k for each source."""
    names = policy.select(F.col("route").alias("known_route"))
    keyed = queries.join(F.broadcast(names), F.upper(F.trim(F.col(route))) == F.col("known_route"), "left").withColumn("policy_route", F.coalesce("known_route", F.lit("OTHER"))).drop("known_route")
    return keyed.join(F.broadcast(policy.withColumnRenamed("route", "policy_route")), "policy_route").withColumn("per_source_k", per_source_k(base_top_k))


def per_source_k(base: int) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.lit(base) * F.col("retrieval_multiplier"))).cast("int")


def retrievable(queries: DataFrame) -> DataFrame:
    """Queries whose policy asks for anything; the rest never reaches the scan."""
    return queries.where("per_source_k > 0 and max_keep > 0")


class _Best:
    """The k best items of each query so far: rounded score down, then smallest item.

    Queries and items are multiplied label by label, so no pair of two labels is formed.
    """

    def __init__(self, matrix: np.ndarray, keys: list | None, k: int):
        self.matrix, self.k = matrix, k
        self.scores = np.full((len(matrix), k), -np.inf)
        self.items = np.empty((len(matrix), k), object)
        self._places: dict = {}
        for at, key in enumerate(keys or ()):
            self._places.setdefault(key, []).append(at)
        self._places = {key: np.array(at) for key, at in self._places.items()} if keys is not None else {None: np.arange(len(matrix))}

    def add(self, items: list, vectors: np.ndarray, keys: list | None) -> None:
        if keys is None:
            return self._add(self._places[None], items, vectors)
        mine: dict = {}
        for at, key in enumerate(keys):
            if key in self._places:
                mine.setdefault(key, []).append(at)
        for key, at in mine.items():
            self._add(self._places[key], [items[i] for i in at], vectors[at])

    def _add(self, places: np.ndarray, items: list, vectors: np.ndarray) -> None:
        order = sorted(range(len(items)), key=items.__getitem__)
        items, vectors = np.array([items[i] for i in order], object), vectors[order]
        n = min(self.k, len(items))
        for at in range(0, len(places), PRODUCT[0]):
            rows = places[at : at + PRODUCT[0]]
            score = np.round(self.matrix[rows] @ vectors.T, 9)
            least = np.partition(score, len(items) - n, axis=1)[:, len(items) - n, None]
            above, tied = score > least, score == least
            take = above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= n - above.sum(axis=1, keepdims=True)))
            columns = np.nonzero(take)[1].reshape(len(score), n)
            score = np.take_along_axis(score, columns, axis=1)
            for q in np.flatnonzero(score.max(axis=1) >= self.scores[rows].min(axis=1)):
                row = rows[q]
                both = [*zip(-self.scores[row], self.items[row], strict=True), *zip(-score[q], items[columns[q]], strict=True)]
                best = sorted(x for x in both if x[0] < np.inf)[: self.k]
                self.scores[row, : len(best)] = [-x for x, _ in best]
                self.items[row, : len(best)] = [x for _, x in best]

    def rows(self, ids: list) -> tuple[list, list, list]:
        q, k = np.nonzero(self.scores > -np.inf)
        return [ids[i] for i in q], self.items[q, k].tolist(), self.scores[q, k].tolist()


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dims)


def vector_fault(vector: Column, dims: int) -> Column:
    """Why a vector cannot be searched: ``null``, ``length`` or ``value`` (a place that is null, NaN or infinite); null if it can."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNull(), "null").when(F.size(vector) != dims, "length").when(~F.coalesce(good, F.lit(False)), "value")


def vector_faults(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """Rows (fault, n): how many rows a search of ``dims`` places leaves out, and why."""
    found = rows.select(vector_fault(F.col(vector).cast("array<double>"), dims).alias("fault"))
    return found.where("fault is not null").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def top_k(queries: DataFrame, items: DataFrame, k: int, by: str | None = None, dims: int | None = None) -> DataFrame:
    """Exact inner-product top-k: rows (query_id, item_id, ip, hit_rank), ip rounded to nine places.

    ``queries`` has query_id and qvec, ``items`` item_id and vector; with ``by`` only
    items with the same value of that column count.  Queries are sent to all tasks only
    while there are at most ``SENT_QUERIES`` of ``SENT_BYTES``; beyond that queries and items
    meet in a grid of blocks of bounded bytes.  Ties go to the smallest item.  Vectors
    have ``dims`` places, by default as most queries have; :func:`vector_faults` counts those
    that are left out: nulls, other lengths, and vectors with a null, NaN or infinite place.
    """
    columns = lambda df, key, vector: df.select(key, F.col(vector).cast("array<double>").alias(vector), *([F.col(by).alias("key")] if by else []))
    queries, items = columns(queries, "query_id", "qvec"), columns(items, "item_id", "vector")
    if dims is None:
        dims = queries.agg(F.mode(F.size("qvec"), deterministic=True)).first()[0] or 0
    queries, items = queries.where(vector_fault(F.col("qvec"), dims).isNull()), items.where(vector_fault(F.col("vector"), dims).isNull())
    schema = T.StructType([queries.schema["query_id"], items.schema["item_id"], T.StructField("ip", T.DoubleType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    wide = max(1, 8 * dims)
    most = min(SENT_QUERIES, max(1, SENT_BYTES // wide))
    keys_of = lambda part: part.column("key").to_pylist() if by else None
    sent = queries.limit(most + 1).toArrow()  # at most SENT_QUERIES rows and SENT_BYTES
    if sent.num_rows <= most:
        ids, keys = sent.column("query_id").to_pylist(), keys_of(sent)
        matrix = _vectors(sent.column("qvec").combine_chunks(), dims)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(matrix, keys, k)
            for batch in batches if ids else ():
                for at in range(0, batch.num_rows, PRODUCT[1]):
                    part = batch.slice(at, PRODUCT[1])
                    best.add(part.column("item_id").to_pylist(), _vectors(part.column("vector"), dims), keys_of(part))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(best.rows(ids), arrow, strict=True)], schema=arrow)

        found = items.mapInArrow(scan, schema)
    else:
        q_block, i_block = (max(1, min(n, BLOCK_BYTES // wide)) for n in (QUERY_BLOCK, ITEM_BLOCK))
        across, high = -(-items.count() // i_block) or 1, -(-queries.count() // q_block)
        cell = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = queries.select("*", cell("query_id", high).cast("int").alias("y"), every(across).alias("x"))
        right = items.select("*", cell("item_id", across).cast("int").alias("x"), every(high).alias("y"))

        def meet(q: pa.Table, rows: pa.Table) -> pa.Table:
            if not q.num_rows or not rows.num_rows:
                return arrow.empty_table()
            best = _Best(_vectors(q.column("qvec").combine_chunks(), dims), keys_of(q), k)
            for at in range(0, rows.num_rows, PRODUCT[1]):
                part = rows.slice(at, PRODUCT[1])
                best.add(part.column("item_id").to_pylist(), _vectors(part.column("vector").combine_chunks(), dims), keys_of(part))
            return pa.table([pa.array(c, f.type) for c, f in zip(best.rows(q.column("query_id").to_pylist()), arrow, strict=True)], schema=arrow)

        found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ip"), "item_id"))
    return found.withColumn("hit_rank", rank).where(F.col("hit_rank") <= k)


def two_sources(daily: DataFrame, ltm: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits of both sources in one table, the daily ones with their entries' columns; a hit without an entry stays."""
    return daily.withColumn("source", F.lit("daily")).join(entries, "item_id", "left").unionByName(ltm.withColumn("source", F.lit("ltm")), allowMissingColumns=True)


def canonical(hits: DataFrame) -> DataFrame:
    """Hits with one document and one index column, whichever of the older names they came with."""
    have = lambda *names: F.coalesce(*(F.col(n) for n in names if n in hits.columns))
    old = [c for c in ("source_document_id", "doc_id", "chunk_index", "chunk_seq") if c in hits.columns]
    rest = [c for c in hits.columns if c not in old]
    return hits.select(*rest, have("source_document_id", "doc_id").alias("source_document_id"), have("chunk_index", "chunk_seq").cast("int").alias("chunk_index"))


def best_hit(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """The single best hit of each query."""
    return hits.groupBy(query).agg(F.max_by("item_id", F.struct("score", -F.col("hit_rank"))).alias("item_id"), F.max("score").alias("score"))


def response_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row, null fields left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("response"))


def source_scores(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits and mean score of each source of a query; 0.0 where a source has none."""
    part = lambda s: F.coalesce(F.avg(F.when(F.col("source") == s, F.col("score"))), F.lit(0.0))
    return hits.groupBy(query).agg(F.count_if(F.col("source") == "daily").alias("daily_hits"), F.count_if(F.col("source") == "ltm").alias("ltm_hits"), part("daily").alias("daily_mean"), part("ltm").alias("ltm_mean"))


def score_gate(hits: DataFrame) -> DataFrame:
    """Strictly above the policy's score; a missing score counts as 0."""
    return hits.where(F.coalesce("score", F.lit(0.0)) > F.col("min_score"))


def threshold_or_best(hits: DataFrame, threshold: float, query: str = "query_id") -> DataFrame:
    """At or above the threshold, else the query's best hit alone."""
    whole = Window.partitionBy(query)
    passed = F.coalesce(F.col("score") >= threshold, F.lit(False))
    ranked = hits.withColumn("passed", passed).withColumn("any_passed", F.max(passed).over(whole)).withColumn("rn", F.row_number().over(whole.orderBy(F.desc("score"), "hit_rank")))
    return ranked.where(F.col("passed") | (~F.col("any_passed") & (F.col("rn") == 1))).drop("any_passed", "rn")


def order_hits(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Position of each hit of a query: score down, daily before long-term, then arrival."""
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), F.when(F.col("source") == "daily", 0).otherwise(1), "hit_rank", "item_id")) - 1)


def select_with_bonus(ordered: DataFrame, query: str = "query_id") -> DataFrame:
    """Keep ``max_keep`` gated hits and one more for each kept direct neighbour of the hit before.

    Closed form of the sequential rule: row r (from 0) stays if r minus the bonuses
    earned strictly before it is below the limit.
    """
    w = Window.partitionBy(query).orderBy("pos")
    rows = ordered.withColumn("rn0", F.row_number().over(w) - 1)
    bonus = F.coalesce((F.lag("doc_id").over(w) == F.col("doc_id")) & (F.abs(F.col("chunk_index") - F.lag("chunk_index").over(w)) == 1), F.lit(False)).cast("int")
    rows = rows.withColumn("bonus", bonus)
    earned = F.coalesce(F.sum("bonus").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("earned", earned).where(F.col("rn0") - F.col("earned") < F.col("max_keep")).drop("earned")


def tiers(kept: DataFrame, query: str = "query_id") -> DataFrame:
    """Neighbours to fetch: full for the first third, half rounded up for the second, at most one for the last."""
    k = F.count(F.lit(1)).over(Window.partitionBy(query))
    i = F.row_number().over(Window.partitionBy(query).orderBy("pos")) - 1
    rows = kept.withColumn("k", k).withColumn("i", i)
    budget = lambda c: F.when(F.col("i") < F.ceil(F.col("k") / 3), F.col(c)).when(F.col("i") < F.ceil(2 * F.col("k") / 3), F.ceil(F.col(c) / 2)).otherwise(F.least(F.lit(1), F.col(c))).cast("int")
    return rows.withColumn("before_n", budget("expansion_before")).withColumn("after_n", budget("expansion_after")).drop("i", "k")


def expand(kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks c-before .. c+after of each hit's document by an equi join; the centre always stays.

    The centre's text is the hit's own (``n_text`` is null there), so only neighbours
    are joined, inner, and the few wanted rows may be the broadcast side.
    """
    want = kept.withColumn("idx", F.explode(F.sequence(F.col("chunk_index") - F.col("before_n"), F.col("chunk_index") + F.col("after_n"))))
    near = chunks.select(F.col("doc_id").alias("n_doc"), F.col("chunk_index").alias("n_idx"), F.col("chunk").alias("n_text"))
    centre = want.where("idx = chunk_index").withColumn("n_text", F.lit(None).cast("string"))
    others = want.where("idx <> chunk_index").join(near, (F.col("doc_id") == F.col("n_doc")) & (F.col("idx") == F.col("n_idx"))).drop("n_doc", "n_idx")
    return centre.unionByName(others)


def dedupe(expanded: DataFrame, query: str = "query_id") -> DataFrame:
    """First row of each (document, index) of a query; rows without a key all stay."""
    keyed = F.col("doc_id").isNotNull() & F.col("idx").isNotNull()
    w = Window.partitionBy(query, "doc_id", "idx", F.when(~keyed, F.monotonically_increasing_id())).orderBy("pos", "idx")
    return expanded.withColumn("copy", F.row_number().over(w)).where("copy = 1").drop("copy")


def dedupe_audit(expanded: DataFrame, query: str = "query_id") -> DataFrame:
    """Rows in, distinct keys, duplicates and rows without key of each query."""
    keyed = F.col("doc_id").isNotNull() & F.col("idx").isNotNull()
    counts = expanded.groupBy(query).agg(F.count(F.lit(1)).alias("input_rows"), F.count_distinct(F.when(keyed, F.struct("doc_id", "idx"))).alias("unique_rows"), F.count_if(~keyed).alias("sparse_rows"))
    return counts.withColumn("duplicate_rows", F.col("input_rows") - F.col("unique_rows") - F.col("sparse_rows"))


def order_documents(rows: DataFrame, query: str = "query_id") -> DataFrame:
    """``ord`` of each row: documents by first appearance, then index; rows without document last."""
    first = F.min("pos").over(Window.partitionBy(query, "doc_id"))
    rows = rows.withColumn("first_pos", F.when(F.col("doc_id").isNull(), F.lit(2_000_000_000)).otherwise(first))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(query).orderBy("first_pos", "idx", "pos")) - 1).drop("first_pos")


def _overlap(left: Column, right: Column, most: int) -> Column:
    """Length of the longest end of ``left`` that begins ``right``, if it does not empty it."""
    n = F.least(F.lit(most), F.char_length(left), F.char_length(right))
    sizes = F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda k: F.substring(left, F.char_length(left) - k + 1, k) == F.substring(right, F.lit(1), k))
    longest = F.coalesce(F.get(fits, F.lit(0)), F.lit(0))
    return F.when(longest < F.char_length(right), longest).otherwise(0)


def trim_overlap(rows: DataFrame, most: int, text: str, query: str = "query_id") -> DataFrame:
    """Drop from each row what repeats the end of the (already trimmed) row before of the same document.

    Runs of rows of one document are decided one after the other; only the lengths to
    cut and the last ``most`` characters are carried on.
    """
    if most <= 0:
        return rows
    w = Window.partitionBy(query).orderBy("ord")
    same = F.coalesce(F.lag("doc_id").over(w) == F.col("doc_id"), F.lit(False))
    others = [c for c in rows.columns if c not in (query, "ord", text)]
    cells = F.array_sort(F.collect_list(F.struct("ord", F.col(text).alias("t"), F.struct(*others).alias("rest"))))
    runs = rows.withColumn("run", F.sum((~same).cast("int")).over(w)).groupBy(query, "run").agg(cells.alias("cells"))

    def step(done: Column, cell: Column) -> Column:
        n, cut = F.char_length(cell["t"]), _overlap(done["tail"], cell["t"], most)
        left = F.least(n - cut, F.lit(most))
        return F.struct(F.concat(done["cuts"], F.array(cut)).alias("cuts"), F.substring(cell["t"], n - left + 1, left).alias("tail"))

    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit("").alias("tail"))
    out = runs.withColumn("cuts", F.aggregate("cells", start, step)["cuts"]).select(query, F.posexplode("cells").alias("at", "c"), "cuts")
    trimmed = F.expr("substring(c.t, cuts[at] + 1)")
    return out.select(query, "c.ord", trimmed.alias(text), "c.rest.*")


def collapse(rows: DataFrame, text: str, query: str = "query_id") -> DataFrame:
    """Runs of one document and source with consecutive indexes become one snippet."""
    w = Window.partitionBy(query).orderBy("ord")
    joins = (F.lag("doc_id").over(w) == F.col("doc_id")) & (F.lag("source").over(w) == F.col("source")) & (F.lag("idx").over(w) + 1 == F.col("idx"))
    rows = rows.withColumn("island", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w))
    groups = rows.groupBy(query, "island").agg(
        F.min_by("doc_id", "ord").alias("doc_id"), F.min_by("source", "ord").alias("source"), F.min_by("score", "ord").alias("score"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count(F.lit(1)).alias("members"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(text).alias("t")))), lambda s: s["t"]), "").alias("text"),
    )
    label = F.when(F.col("members") > 1, F.concat(F.col("lo").cast("string"), F.lit(".."), F.col("hi").cast("string"))).otherwise(F.col("lo").cast("string"))
    return groups.select(query, F.col("island").cast("int").alias("snippet_number"), "source", "score", "doc_id", label.alias("chunk_range"), "members", "text")


def header_fields(row: dict[str, Column]) -> Column:
    """``, key=value`` for the identity keys that are present, in fixed order."""
    shown = lambda k: F.trim(F.replace(F.replace(row[k].cast("string"), F.lit("\n"), F.lit(" ")), F.lit(","), F.lit(";")))
    return F.concat(F.lit(""), *(F.coalesce(F.when(shown(k) != "", F.concat(F.lit(f", {k}="), shown(k))), F.lit("")) for k in HEADER_KEYS if k in row))


def context_block(snippets: DataFrame, query: str = "query_id") -> DataFrame:
    """The numbered context text of each query, its tokens, and texts and scores of each source.

    Identity columns of ``HEADER_KEYS`` that the snippets have are shown in the headers.
    """
    ids = {k: F.col(k) for k in HEADER_KEYS if k in snippets.columns} | ({"source_document_id": F.col("doc_id").cast("string")} if "source_document_id" not in snippets.columns else {})
    head = F.format_string("Snippet %d (source=%s, cos=%.4f, score=%.4f, chunk_index=%s", "snippet_number", "source", 2 * F.col("score") - 1, "score", "chunk_range")
    # A rule in a text that would be read as the start of a snippet gets a backslash more.
    safe = F.regexp_replace("text", r"(\n\n\\*)---\n(?=Snippet )", "$1\\\\---\n")
    rows = snippets.select(query, "snippet_number", "source", "score", "text", F.concat(head, header_fields(ids), F.lit(")\n"), safe).alias("piece"), tx.count_tokens(F.col("text")).alias("tokens"))
    daily = F.col("source") == "daily"
    listed = lambda cond, c: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("snippet_number", c)))), lambda s: s[c])
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("score"))), F.lit(0.0))
    return rows.groupBy(query).agg(
        F.concat(F.lit("Context:\n---\n"), F.array_join(listed(F.lit(True), "piece"), "\n\n---\n")).alias("context"),
        F.sum("tokens").alias("tokens"), F.count_if(daily).alias("daily_snippets"), F.count_if(~daily).alias("ltm_snippets"), mean(daily).alias("daily_score"), mean(~daily).alias("ltm_score"),
        listed(daily, "score").alias("daily_scores"), listed(~daily, "score").alias("ltm_scores"), listed(daily, "text").alias("daily_texts"), listed(~daily, "text").alias("ltm_texts"),
    )


def parse_context(blocks: DataFrame, query: str = "query_id", context: str = "context") -> DataFrame:
    """Snippet rows back from stored context blocks: header fields, chunk span, memory ids and text.

    Blocks are cut only at rules in front of a snippet header, so texts may hold rules.
    """
    body = F.regexp_replace(F.col(context), r"^Context:\n---\n", "")
    parts = blocks.where(F.col(context) != "").select(query, F.posexplode(F.split(body, r"\n\n---\n(?=Snippet \d+ \([^\n]*\)\n)")).alias("at", "part"))
    head = F.regexp_extract("part", r"^Snippet (\d+) \(([^\n]*)\)\n", 2)
    rows = parts.where(head != "").withColumn("fields", F.str_to_map(head, F.lit(", "), F.lit("=")))
    value = lambda k: F.nullif(F.trim(F.try_element_at("fields", F.lit(k))), F.lit(""))
    span = F.split(value("chunk_index"), r"\.\.")
    text = F.regexp_replace(F.regexp_extract("part", r"^[^\n]*\n([\s\S]*)$", 1), r"(\n\n\\*)\\---\n(?=Snippet )", "$1---\n")
    return rows.select(
        query, F.regexp_extract("part", r"^Snippet (\d+)", 1).cast("int").alias("snippet_number"), value("source").alias("source"), value("score").try_cast("double").alias("score"), value("chunk_index").alias("chunk_range"),
        F.get(span, F.lit(0)).try_cast("int").alias("chunk_from"), F.get(span, F.size(span) - 1).try_cast("int").alias("chunk_to"), value("source_document_id").alias("source_document_id"),
        F.array_compact(F.array(value("memory_id"))).alias("memory_ids"), F.map_filter("fields", lambda k, _: ~k.isin("source", "cos", "score", "chunk_index", "source_document_id", "memory_id")).alias("more"), text.alias("text"),
    )


def merged(hits: DataFrame, chunks: DataFrame, overlap: int, text: str = "n_text") -> DataFrame:
    """Order, gate, select, tier, expand, dedupe, order, trim and collapse: snippets of every query."""
    kept = tiers(select_with_bonus(score_gate(order_hits(hits))))
    rows = expand(kept, chunks)
    rows = rows.withColumn(text, F.coalesce(text, "chunk")).drop("chunk")
    return collapse(trim_overlap(order_documents(dedupe(rows)), overlap, text), text)
