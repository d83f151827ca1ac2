"""Text documents that hold bounded memory entries: render, parse, check, rescope, rebuild."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as tx


@dataclass(frozen=True)
class Markers:
    """Text of the marker lines around an entry and of its metadata block."""

    begin: str = "<!-- begin memory_id="
    end: str = "<!-- end memory_id="
    close: str = " -->"
    heading: str = "### Metadata"

    @property
    def strict_id(self) -> str:
        return r"(mem_\d{8}_\d{6}_[0-9a-f]{4,8})"

    def line(self, start: str, strict: bool = True) -> str:
        return "^" + start.replace("!", "\\!") + (self.strict_id if strict else r"([^ ]+)") + self.close + r"\s*$"


DEFAULT = Markers()


def metadata_block(fields: list[tuple[str, Column]], lists: list[tuple[str, Column]] = (), markers: Markers = DEFAULT) -> Column:
    """Fenced ``key: value`` lines, nulls left out; lists as ``- item`` lines."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), F.trim(F.replace(v.cast("string"), F.lit("\n"), F.lit(" "))))
    rows = [line(k, v) for k, v in fields]
    rows += [F.when(v.isNotNull(), F.array_join(F.concat(F.array(F.lit(f"{k}:")), F.transform(v, lambda x: F.concat(F.lit("  - "), x))), "\n")) for k, v in lists]
    return F.array_join(F.array_compact(F.array(F.lit(f"{markers.heading}\n\n```yaml"), *rows, F.lit("```"))), "\n")


def render_entry(memory_id: Column, entry_type: Column, handle: Column, block: Column, user: Column, assistant: Column, markers: Markers = DEFAULT) -> Column:
    """A whole bounded entry with heading, metadata and both messages."""
    return F.concat(
        F.lit(markers.begin), memory_id, F.lit(markers.close + "\n"), tx.entry_heading(entry_type, handle), F.lit("\n\n"), block,
        F.lit("\n\n### User Message\n"), tx.strip(tx.normalize_lf(user)), F.lit("\n\n### Assistant Message\n"), tx.strip(tx.normalize_lf(assistant)),
        F.lit(f"\n\n{markers.end}"), memory_id, F.lit(markers.close + "\n\n"),
    )


def export(entries: DataFrame, by: list[str], order: str, block: str) -> DataFrame:
    """One document a group: its blocks in order."""
    return entries.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, block))), lambda s: s[block]), "").alias("content"))


def artifact_name(title: Column, timestamp: Column) -> Column:
    """File name of a cycle's artifact: no colons, ends in ``.md``."""
    return F.concat(tx.snake_case(title), F.lit("_"), F.replace(timestamp, F.lit(":"), F.lit("-")), F.lit(".md"))


def without_collisions(names: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """Names of which the second and later of a group get ``-2``, ``-3``, ... before the extension."""
    nth = F.row_number().over(Window.partitionBy(*by, name).orderBy(order))
    stem, end = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return names.withColumn("_nth", nth).withColumn(name, F.when(F.col("_nth") > 1, F.concat(stem, F.lit("-"), F.col("_nth").cast("string"), end)).otherwise(F.col(name))).drop("_nth")


def ensure_header(text: Column, title: Column) -> Column:
    """Text with front matter; what has it already stays as it is."""
    return F.when(F.startswith(text, F.lit("---\n")), text).otherwise(F.concat(F.lit("---\ntitle: "), title, F.lit("\n---\n\n"), text))


def blank_before_markers(text: Column, markers: Markers = DEFAULT) -> Column:
    """A blank line before each begin marker that is not at the start."""
    return F.regexp_replace(tx.normalize_lf(text), r"(?<!\n\n)(?<!\A)(?=" + markers.begin.replace("!", "\\!") + ")", "\n")


def normalize_wrappers(text: Column) -> Column:
    """Old ``=== BEGIN/END kind MEMORY: mm/dd/yyyy ===`` lines: the first becomes a header line, the rest go."""
    found = F.regexp_extract(text, r"(?m)^=== BEGIN (DAILY|DREAM) MEMORY:\s*(\d{2}/\d{2}/\d{4}) ===", 2)
    plain = F.regexp_replace(tx.normalize_lf(text), r"(?m)^=== (?:BEGIN|END) (?:DAILY|DREAM) MEMORY:\s*\d{2}/\d{2}/\d{4} ===[ \t]*\n?", "")
    return F.when(found == "", tx.normalize_lf(text)).otherwise(F.concat(F.lit("# Memory "), F.replace(found, F.lit("/"), F.lit("-")), F.lit("\n\n"), plain))


def ensure_heading(entry: Column, entry_type: Column, handle: Column) -> Column:
    """An entry's text with a heading in front if none of its lines is one."""
    return F.when(entry.rlike(r"(?m)^##\s+.+$"), entry).otherwise(F.concat(tx.entry_heading(entry_type, handle), F.lit("\n\n"), entry))


def lines(docs: DataFrame, by: list[str], content: str, markers: Markers = DEFAULT) -> DataFrame:
    """Lines with number, offset and marker ids."""
    rows = docs.select(*by, F.posexplode(F.split(tx.normalize_lf(F.col(content)), "\n")).alias("line_no", "line"))
    w = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    found = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    return (
        rows.withColumn("offset", F.coalesce(F.sum(F.char_length("line") + 1).over(w), F.lit(0)))
        .withColumn("begin_id", found(markers.line(markers.begin))).withColumn("end_id", found(markers.line(markers.end)))
        .withColumn("loose_begin", found(markers.line(markers.begin, False))).withColumn("loose_end", found(markers.line(markers.end, False)))
    )


def segments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Group of each line: the number of end lines strictly before it, with the group's first begin and its end."""
    w = Window.partitionBy(*by).orderBy("line_no")
    rows = rows.withColumn("grp", F.coalesce(F.count("end_id").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = Window.partitionBy(*by, "grp")
    return rows.withColumn("first_begin", F.min(F.when(F.col("begin_id").isNotNull(), F.col("line_no"))).over(g)).withColumn("end_line", F.max(F.when(F.col("end_id").isNotNull(), F.col("line_no"))).over(g))


def entries(docs: DataFrame, by: list[str], content: str, markers: Markers = DEFAULT) -> DataFrame:
    """One row for each closed entry: id, end id, body, line and character span, copy number in its document.

    Well-formed entries have ``end_id = memory_id`` and ``copy = 1``.
    """
    rows = segments(lines(docs, by, content, markers), by).where("first_begin is not null and end_line is not null and line_no between first_begin and end_line")
    body = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    found = rows.groupBy(*by, "grp").agg(
        F.min_by("begin_id", "line_no").alias("memory_id"), F.max_by("end_id", "line_no").alias("end_id"), (F.min("line_no") + 1).alias("start_line"), (F.max("line_no") + 1).alias("end_line"),
        F.min("offset").alias("start_offset"), F.max(F.col("offset") + F.char_length("line") + 1).alias("end_offset"), body.alias("b"),
    )
    found = found.withColumn("text", F.array_join(F.transform(F.slice("b", 2, F.greatest(F.lit(0), F.size("b") - 2)), lambda s: s["line"]), "\n")).drop("b", "grp")
    copy = F.row_number().over(Window.partitionBy(*by, "memory_id").orderBy("start_line"))
    return found.withColumn("copy", F.when(F.col("end_id") == F.col("memory_id"), copy))


def warnings(docs: DataFrame, by: list[str], content: str, markers: Markers = DEFAULT) -> DataFrame:
    """Structural warnings (kind, line, id) of each document; none means valid."""
    rows = segments(lines(docs, by, content, markers), by)
    inside = F.col("first_begin").isNotNull() & (F.col("line_no") > F.col("first_begin")) & F.col("end_line").isNotNull()
    outside = rows.where(~inside)
    kind = (
        F.when(F.col("begin_id").isNull() & F.col("loose_begin").isNotNull(), "invalid_begin")
        .when(F.col("end_id").isNotNull() & F.col("first_begin").isNull(), "end_without_begin")
        .when(F.col("end_id").isNull() & F.col("loose_end").isNotNull(), "invalid_end")
        .when(F.col("begin_id").isNotNull() & F.col("end_line").isNull() & (F.col("line_no") == F.col("first_begin")), "begin_without_end")
    )
    loose = outside.withColumn("kind", kind).where("kind is not null").select(*by, "kind", (F.col("line_no") + 1).alias("line"), F.coalesce("begin_id", "end_id", "loose_begin", "loose_end").alias("memory_id"))
    found = entries(docs, by, content, markers)
    mismatched = found.where("end_id <> memory_id").select(*by, F.lit("mismatched_end").alias("kind"), F.col("end_line").alias("line"), "memory_id")
    double = found.where("copy > 1").select(*by, F.lit("duplicate").alias("kind"), F.col("start_line").alias("line"), "memory_id")
    return loose.unionByName(mismatched).unionByName(double)


def _metadata_lines(text: Column, markers: Markers) -> Column:
    """Struct of an entry's metadata block: its lines, the line of its heading, and whether the fence opens and closes."""
    lines = F.transform(F.split(tx.normalize_lf(text), "\n"), lambda x: F.trim(x))

    def read(x: Column) -> Column:
        head = F.array_position(x, markers.heading)
        opens = (F.get(x, head) == "") & (F.get(x, head + 1) == "```yaml")
        rest = F.slice(x, head + 3, F.greatest(F.lit(0), F.size(x) - head - 2).cast("int"))
        end = F.array_position(rest, "```")
        body = F.slice(rest, 1, F.when(end > 0, end - 1).otherwise(F.size(rest)).cast("int"))
        none = F.array().cast("array<string>")
        return F.struct(F.when((head > 0) & F.coalesce(opens, F.lit(False)), body).otherwise(none).alias("lines"), head.alias("head"), F.coalesce(opens, F.lit(False)).alias("opens"), (end > 0).alias("closes"))

    return tx.once(lines, read)


def _read_line(line: Column) -> Column:
    """Struct (item, key, value) of a metadata line; ``item`` is the text behind a dash."""
    return F.struct(F.when(F.startswith(line, F.lit("- ")), F.trim(F.substring(line, F.lit(3), F.char_length(line)))).alias("item"), F.when(F.contains(line, F.lit(":")), F.trim(F.regexp_extract(line, r"^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))


def metadata_map(text: Column, markers: Markers = DEFAULT) -> Column:
    """Map of key to struct (list, flag, values): scalars are lists of one, ``flag`` is set for true and false.

    Lines ``- item`` belong to the key of the bare ``key:`` line that they follow; a later
    key of the same name wins; lines that say nothing are skipped (see :func:`metadata_warnings`).
    """
    rows = F.transform(F.filter(_metadata_lines(text, markers)["lines"], lambda x: x != ""), _read_line)

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done["rows"], -1)
        joins = r["item"].isNotNull() & done["open"]
        longer = F.concat(F.slice(done["rows"], 1, F.size(done["rows"]) - 1), F.array(F.struct(last["key"].alias("key"), F.concat(last["values"], F.array(r["item"])).alias("values"), F.lit(True).alias("list"))))
        good = F.coalesce(r["key"] != "", F.lit(False))
        bare = r["value"] == ""
        more = F.concat(done["rows"], F.array(F.struct(r["key"].alias("key"), F.when(bare, F.array().cast("array<string>")).otherwise(F.array(r["value"])).alias("values"), bare.alias("list"))))
        return F.struct(F.when(joins, longer).when(good, more).otherwise(done["rows"]).alias("rows"), (joins | (good & bare)).alias("open"))

    none = F.array().cast("array<struct<key:string,values:array<string>,list:boolean>>")
    found = F.aggregate(rows, F.struct(none.alias("rows"), F.lit(False).alias("open")), step)["rows"]
    flag = lambda x: F.when(~x["list"] & F.lower(F.get(x["values"], F.lit(0))).isin("true", "false"), F.lower(F.get(x["values"], F.lit(0))) == "true")
    value = lambda x: F.struct(x["list"].alias("list"), flag(x).alias("flag"), F.when(flag(x).isNotNull(), F.array(F.lower(F.get(x["values"], F.lit(0))))).otherwise(x["values"]).alias("values"))
    newest = lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["key"]), F.map_from_arrays(F.array(x["key"]), F.array(value(x))))
    return F.aggregate(found, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<list:boolean,flag:boolean,values:array<string>>>")), newest)


def metadata(found: DataFrame, by: list[str], text: str = "text", markers: Markers = DEFAULT) -> DataFrame:
    """Rows (key, list, flag, values) of each entry's metadata block."""
    return found.select(*by, F.explode(metadata_map(F.col(text), markers)).alias("key", "v")).select(*by, "key", "v.*")


def metadata_warnings(found: DataFrame, by: list[str], text: str = "text", markers: Markers = DEFAULT) -> DataFrame:
    """Rows (line, kind) of what is wrong with the metadata blocks: fences, lines without a colon, empty keys."""
    block = _metadata_lines(F.col(text), markers)

    def judge(x: Column, i: Column) -> Column:
        r = _read_line(x)
        return F.struct((block["head"] + 3 + i).cast("int").alias("line"), F.when(x == "", None).when(r["key"].isNull() & r["item"].isNull(), "no_colon").when(r["item"].isNull() & (r["key"] == ""), "empty_key").alias("kind"))

    own = F.transform(block["lines"], judge)
    fence = F.when((block["head"] > 0) & ~block["opens"], "fence").when((block["head"] > 0) & ~block["closes"], "open_fence")
    every = F.concat(own, F.array(F.struct(block["head"].cast("int").alias("line"), fence.alias("kind"))))
    return found.select(*by, F.explode(every).alias("w")).select(*by, "w.line", "w.kind").where("kind is not null")


def with_metadata(found: DataFrame, keep: list[str], text: str = "text", markers: Markers = DEFAULT) -> DataFrame:
    """Entries with their scalar metadata as a map ``meta`` of texts; lists are joined by commas."""
    flat = F.transform_values(metadata_map(F.col(text), markers), lambda _, v: F.array_join(v["values"], ","))
    return found.select(*keep, F.col(text).alias("text"), flat.alias("meta"))


def rescope(text: Column, scope: str = "ltm", markers: Markers = DEFAULT) -> Column:
    """``current_scope`` lines of the metadata blocks of bounded entries set to ``scope``; the same words elsewhere stay."""
    begin = markers.begin.replace("!", "\\!") + r"mem_\d{8}_\d{6}_[0-9a-f]{4,8}" + markers.close
    head = rf"({begin}[ \t]*\n(?:(?!<!--)[\s\S])*?{markers.heading}\n[ \t]*\n```yaml\n(?:(?!```)[^\n]*\n)*?)current_scope:[ \t]*\S+[ \t]*(?=\n)"
    return F.regexp_replace(tx.normalize_lf(text), head, f"$1current_scope: {scope}")


def unbounded(docs: DataFrame, by: list[str], content: str, markers: Markers = DEFAULT) -> DataFrame:
    """Regions of text outside the bounded entries, in order, blank ones left out."""
    rows = lines(docs, by, content, markers)
    spans = entries(docs, by, content, markers).where("copy is not null").select(*by, F.explode(F.sequence(F.col("start_line") - 1, F.col("end_line") - 1)).alias("line_no"))
    free = rows.join(spans, [*by, "line_no"], "left_anti")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(*by).orderBy("line_no"))
    regions = free.withColumn("island", island).groupBy(*by, "island").agg((F.min("line_no") + 1).alias("start_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("region"))
    return regions.where(F.col("region").rlike(r"\S")).drop("island")


#: Fields of a chunk that an entry's metadata never overrides.
IDENTITY = ("filename", "doc_id", "source_document_id")


def regions_to_chunks(regions: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Chunk rows of entries or regions, numbered after blank windows are dropped.

    With a map column ``meta``, each chunk gets the map ``fields``: its own identity and
    numbers, overridden by the metadata except in ``IDENTITY``.
    """
    rows = regions.select(*(c for c in regions.columns if c != text), F.posexplode(tx.windows(F.col(text), size, overlap)).alias("chunk_index", "chunk"))
    if "meta" not in regions.columns:
        return rows
    own = [c for c in ("project_id", "filename", "doc_id", "source_document_id", "memory_id") if c in regions.columns]
    pairs = [x for c in own for x in (F.lit(c), F.col(c).cast("string"))] + ([] if "source_document_id" in own else [F.lit("source_document_id"), F.col("doc_id").cast("string")])
    index = F.col("chunk_index").cast("string")
    fields = F.create_map(*pairs, F.lit("chunk_index"), index, F.lit("chunk_seq"), index)
    kept = F.map_filter("meta", lambda k, _: ~k.isin(*IDENTITY))
    return rows.withColumn("fields", F.map_concat(F.map_filter(fields, lambda k, _: ~F.map_contains_key(kept, k)), kept)).drop("meta")


def expand_entries(snippets: DataFrame, found: DataFrame, rebuilt: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Whole entry of each snippet by an ordered fallback of keyed lookups.

    First the entry by (artifact_path, memory_id), then by the path in
    ``source_document_id`` (what stands in front of ``::memory_id=``), then the document
    rebuilt from its chunks, then the snippet's own text.  Paths that are absolute or climb
    are no paths.  Adds ``expanded``, ``status`` (expanded, fallback, failed), ``method``
    (artifact, source_document, chunks, original), ``reason`` (why no entry was found: path_unusable,
    artifact_unknown, entry_not_found) and ``warning`` (path_mismatch where both paths are
    there and differ).  ``found`` has (artifact_path, memory_id, text), ``rebuilt`` has
    (doc_id, text), ``paths`` the artifact_path of every file, by default of those with entries.
    """
    if "source_document_id" not in snippets.columns:
        snippets = snippets.withColumn("source_document_id", F.lit(None).cast("string"))
    entry = found.groupBy("artifact_path", "memory_id").agg(F.min("text").alias("text"))
    files = (paths if paths is not None else found).select("artifact_path").distinct()
    behind = F.nullif(tx.strip(F.get(F.split("source_document_id", "::memory_id="), F.lit(0))), F.lit(""))
    rows = snippets.withColumns({"_own": tx.safe_relative(F.col("artifact_path")), "_source": tx.safe_relative(behind)})
    for path, text, known in (("_own", "_own_text", "_own_known"), ("_source", "_source_text", "_source_known")):
        rows = rows.join(entry.select(F.col("artifact_path").alias(path), "memory_id", F.col("text").alias(text)), [path, "memory_id"], "left")
        rows = rows.join(files.select(F.col("artifact_path").alias(path), F.lit(True).alias(known)), path, "left")
    rows = rows.join(rebuilt.select("doc_id", F.col("text").alias("_doc_text")), "doc_id", "left")
    miss = lambda path, known: F.when(F.col(path).isNull(), "path_unusable").when(F.col(known).isNull(), "artifact_unknown").otherwise("entry_not_found")
    method = F.when(F.col("_own_text").isNotNull(), "artifact").when(F.col("_source_text").isNotNull(), "source_document").when(F.coalesce("_doc_text", F.lit("")) != "", "chunks").otherwise("original")
    expanded = F.coalesce(tx.strip(F.col("_own_text")), tx.strip(F.col("_source_text")), F.nullif("_doc_text", F.lit("")), "text", F.lit(""))
    rows = rows.withColumns({"method": method, "expanded": expanded})
    status = F.when(F.col("method").isin("artifact", "source_document"), "expanded").when(F.col("expanded") != "", "fallback").otherwise("failed")
    second = F.col("_source").isNotNull() & ~F.col("_source").eqNullSafe(F.col("_own"))
    reason = F.when(~F.col("method").isin("artifact", "source_document"), F.when(second, miss("_source", "_source_known")).otherwise(miss("_own", "_own_known")))
    rows = rows.withColumns({"status": status, "reason": reason, "warning": F.when(F.col("_own") != F.col("_source"), "path_mismatch")})
    return rows.select(*snippets.columns, "method", "status", "expanded", "reason", "warning")


def size_bounded(rows: DataFrame, text: str, most: int, notice: str = "\n[truncated]") -> DataFrame:
    """Longest prefix of a text for which the row with the notice serialises within ``most`` characters.

    Every escape takes at least as many characters as it stands for, so one pass by
    prefix sums of escaped lengths finds the cut.
    """
    over = F.char_length(F.to_json(F.struct(*rows.columns)))
    base = over - F.char_length(F.to_json(F.struct(F.col(text)))) + F.char_length(F.to_json(F.struct(F.lit("").alias(text)))) + len(notice) + notice.count("\n")
    width = lambda c: F.when(c.isin('"', "\\", "\n", "\r", "\t", "\b", "\f"), 2).when(F.ascii(c) < 32, 6).otherwise(1)
    cut = F.aggregate(F.split(F.col(text), ""), F.struct(F.lit(0).alias("n"), base.alias("used")), lambda a, c: F.when(a["used"] + width(c) <= most, F.struct((a["n"] + 1).alias("n"), (a["used"] + width(c)).alias("used"))).otherwise(F.struct(a["n"].alias("n"), F.lit(2_000_000_000).alias("used"))), lambda a: a["n"])
    rows = rows.withColumn("truncated", over > most)
    return rows.withColumn(text, F.when(F.col("truncated"), F.concat(F.substring(F.col(text), F.lit(1), cut), F.lit(notice))).otherwise(F.col(text)))


def distinct_entries(snippets: DataFrame, query: str = "query_id") -> DataFrame:
    """First snippet of each memory id of a query; those without an id all pass."""
    nth = F.row_number().over(Window.partitionBy(query, "memory_id").orderBy("snippet_number"))
    return snippets.withColumn("nth", nth).where("memory_id is null or nth = 1").drop("nth")


def bounded_counts(snippets: DataFrame, query: str = "query_id") -> DataFrame:
    return snippets.groupBy(query).agg(F.count_if(F.col("memory_id").isNotNull()).alias("bounded"), F.count_if(F.col("memory_id").isNull()).alias("unbounded"))
