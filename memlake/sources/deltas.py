"""An index that grows by batches: delta rows with a sequence, the newest row of an item wins.

Every batch is a folder of its own and counts once Spark has committed it.  A row with a
null vector removes its item.  Compaction of some projects writes what they hold now as
one more batch that also says so; older rows of those projects no longer count, and
folders in which nothing counts any more can be removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "project_id string, item_id string, text string, vector array<double>, compacts boolean"


class DeltaIndex:
    """Vectors of items (project_id, item_id, text, vector) below ``path``; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of the committed batches, oldest first."""
        found = self._files().globStatus(self._path(f"{self.path}/seq=*/_SUCCESS"))
        return sorted(s.getPath().getParent().getName().removeprefix("seq=") for s in found or ())

    def add(self, rows: DataFrame, tag: str | None = None, compacts: bool = False) -> str:
        """Add or replace items; a batch of a tag that is there already is not added again.

        Of rows of one item within a batch, the one with the greatest vector stays.
        """
        known, tag = self.batches(), tag or uuid.uuid4().hex[:8]
        if (same := next((b for b in known if b.split("-", 1)[1] == tag), None)) is not None:
            return same
        name = f"s{int(known[-1][1:9]) + 1 if known else 1:08d}-{tag}"
        one = rows.groupBy("project_id", "item_id").agg(F.max(F.struct("vector", "text")).alias("v"))
        one = one.select("project_id", "item_id", "v.text", F.col("v.vector").cast("array<double>").alias("vector"), F.lit(compacts).alias("compacts"))
        one.sortWithinPartitions("project_id", "item_id").write.mode("overwrite").parquet(f"{self.path}/seq={name}")
        return name

    def remove(self, items: DataFrame) -> str:
        """Remove items (project_id, item_id)."""
        return self.add(items.select("project_id", "item_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<double>").alias("vector")))

    def rows(self) -> DataFrame:
        """All rows of all batches, with ``seq``."""
        known = self.batches()
        if not known:
            return self.spark.createDataFrame([], f"{SCHEMA}, seq string")
        return self.spark.read.schema(f"{SCHEMA}, seq string").option("basePath", self.path).parquet(*(f"{self.path}/seq={b}" for b in known))

    def read(self) -> DataFrame:
        """Items as they are now."""
        rows = self.rows()
        # A row a project that was ever compacted.
        base = rows.where("compacts").groupBy("project_id").agg(F.max("seq").alias("base"))
        counts = rows.join(base, "project_id", "left").where("base is null or seq >= base")
        newest = counts.groupBy("project_id", "item_id").agg(F.max_by(F.struct("text", "vector"), "seq").alias("v"))
        return newest.select("project_id", "item_id", "v.text", "v.vector").where("vector is not null")

    def compact(self, projects: DataFrame | None = None) -> str:
        """Write the present items of some or all projects as one batch that replaces what they had.

        A project that has no item left is not in it; its removals go on counting.
        """
        now = self.read()
        return self.add(now.join(projects.select("project_id").distinct(), "project_id", "left_semi") if projects is not None else now, compacts=True)

    def vacuum(self) -> list[str]:
        """Remove the folders of which no row counts any more."""
        rows = self.rows()
        base = rows.where("compacts").groupBy("project_id").agg(F.max("seq").alias("base"))
        used = {r.seq for r in rows.join(base, "project_id", "left").where("base is null or seq >= base").select("seq").distinct().collect()}  # a name a batch
        gone = [b for b in self.batches() if b not in used]
        for b in gone:
            self._files().delete(self._path(f"{self.path}/seq={b}"), True)
        return gone


def added(stream: DataFrame, index: DeltaIndex, checkpoint: str) -> StreamingQuery:
    """A stream of items added batch by batch; a batch that is repeated after a failure is added once."""
    return stream.writeStream.foreachBatch(lambda batch, number: index.add(batch, tag=f"stream{number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
