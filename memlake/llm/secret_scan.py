"""Secret scans over an incremental ledger of blobs.

Every version of every text is addressed by its content (a blob).  The ledger has one row
for each blob and rule version that was ever scanned, with the spans found.  A scan reads
the versions given, drops repeated blobs before they are shuffled, leaves out the pairs
of blob and rule version that the ledger already has, and adds a batch of rows for the
rest.  Findings are joined back to all versions and paths by blob, without their texts.

Everything here is DataFrame functions.  Offsets of matches come from the lengths of what
stands between them: a text split at a pattern has the gaps, and running sums over gaps
and matches of one blob, which are where the blob's text was, need no shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.storage import fresh, materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, the group that has a least length, and the version of all that."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: The base rules.  Matches are leftmost and do not overlap, and one that is too short still uses up its text;
#: for runs of a character class a least length in the pattern comes to the same.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

_LEDGER = "blob binary, kind string, version int, spans array<struct<start:long,end:long>>"


def address(text: Column) -> Column:
    """Content address of a text; a null is an empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _matches(text: Column, rule: Rule) -> Column:
    """Gap in front of each match, its length, and whether it counts, in code points."""
    p = F.lit(rule.pattern)
    found, checked = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.char_length(g).cast("long"))
    lengths = F.transform(found, lambda m: F.char_length(m).cast("long"))
    good = F.transform(checked, lambda m: F.char_length(m) >= rule.least)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), lengths.alias("length"), good.alias("good"))
    none = F.array().cast("array<struct<gap:bigint,length:bigint,good:boolean>>")
    return F.when(text.rlike(rule.pattern), zipped).otherwise(none)


def spans_of(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (blob, kind, version, spans) of blobs (blob, text, todo); ``todo`` names the rule versions to scan.

    ``blobs`` is partitioned by blob already; nothing is shuffled again.
    """
    wanted = lambda r: F.array_contains("todo", f"{r.kind}:{r.version}")
    scans = F.array(*(F.when(wanted(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _matches(F.col("text"), r).alias("found"))) for r in rules))
    pairs = blobs.select("blob", F.explode(F.array_compact(scans)).alias("s")).select("blob", "s.kind", "s.version", "s.found")
    rows = pairs.select("blob", "kind", "version", F.posexplode_outer("found").alias("at", "m"))
    upto = F.sum(F.col("m.gap") + F.col("m.length")).over(Window.partitionBy("blob", "kind", "version").orderBy("at"))
    rows = rows.withColumn("end", upto)
    span = F.when(F.col("m.good"), F.struct((F.col("end") - F.col("m.length")).alias("start"), F.col("end").alias("end")))
    return rows.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


class BlobLedger:
    """A ledger in a folder that the driver and all executors reach; each scan adds a batch folder.

    A batch counts once Spark has committed it, so a scan that fails leaves the ledger as
    it was and can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    def batches(self) -> list[str]:
        """Folders of the committed batches."""
        root = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        files = root.getFileSystem(self._spark._jsc.hadoopConfiguration())
        marks = files.globStatus(self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/*/_SUCCESS"))
        return sorted(m.getPath().getParent().toString() for m in marks or ())

    def rows(self) -> DataFrame:
        """Scanned pairs (blob, kind, version, spans); a pair that two scans did at once stands once."""
        found = self.batches()
        rows = self._spark.read.schema(_LEDGER).parquet(*found) if found else self._spark.createDataFrame([], _LEDGER)
        return rows.dropDuplicates(["blob", "kind", "version"]) if len(found) > 1 else rows

    def unseen(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Blobs (blob, text, todo) of the versions with the rule versions that never scanned them; none fully scanned."""
        own = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        blobs = own.groupBy("blob").agg(F.first("text").alias("text"))
        names = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
        if not self.batches():
            return blobs.withColumn("todo", names)
        seen = self.rows().groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("seen"))
        todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)

    def scan(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> str:
        """Scan what no scan has seen; returns the new batch's folder."""
        folder = f"{self._path}/batch-{uuid.uuid4().hex}"
        spans_of(self.unseen(versions, text, rules), rules).write.parquet(folder)
        return folder

    def findings(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "findings") -> DataFrame:
        """The versions without their texts and with an array of structs (start, kind, end), by start and then kind as listed.

        A version whose blob has no finding gets an empty array, one that was never scanned
        null.  Null and empty texts are one blob; very long texts are scanned whole; of equal
        matches (ties) of two kinds both stand; repeated rows get equal findings; an empty
        table stays empty.  Other columns keep their names and values; one named ``out`` is replaced.
        """
        order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
        current = reduce(lambda a, b: a | b, ((F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules))
        each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("nth"), F.col("kind").alias("kind"), s["end"].alias("end")))
        listed = F.transform(F.array_sort(F.flatten(F.collect_list(each))), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
        blob, key = fresh(versions, "blob", "ledger_blob")
        # Written before it is joined: Spark splits a hot blob's versions only where nothing but shuffles stand in front of the join.
        found = materialize(self.rows().where(current).groupBy(F.col("blob").alias(key)).agg(listed.alias(out)), "secret-findings")
        rest = [c for c in versions.columns if c not in (text, out)]
        rows = versions.select(*rest, address(F.col(text)).alias(blob))
        return rows.join(found, F.col(blob) == F.col(key), "left").select(*rest, out)


def joined(findings: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
