"""Tables of all projects in one folder, published by version.

A cycle writes everything it makes under a new version and names it last, by one pointer
row a project.  Readers only see what pointers name, so a cycle that ends anywhere before
that leaves the state of before, and can be repeated.  Three kinds of tables:

* additive (``artifacts``, ``uploads``, ``log``, ``consumed``): a project has the rows of all its versions;
* state (``staging``, ``questions``): a project has the rows of its newest version;
* index (``chunks``, ``manifest``): a project has the rows of its newest *published* version.

Cycles run one after the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADDITIVE, STATE, INDEX = ("artifacts", "uploads", "log", "consumed"), ("staging", "questions"), ("chunks", "manifest")
SCHEMAS = {
    "artifacts": "project_id string, name string, content string",
    "uploads": "project_id string, doc_id string, text string",
    "log": "project_id string, line_no long, ts string, source string, user_message_id long, assistant_message_id long, pair_id string, user_message string, namespace string, semantic_handle string, question_index int, question string, topic string, resolution string",
    "consumed": "project_id string, id long",
    "staging": "project_id string, day_sequence int, memory_id string, text string, tokens int, topics array<string>, intent string, semantic_handle string",
    "questions": "project_id string, line_no long, ts string, question string, topic string, resolution string, key string",
    "chunks": "project_id string, filename string, doc_id string, memory_id string, chunk_index int, chunk string, fields map<string,string>, vector array<double>, origin string",
    "manifest": "project_id string, rows long, documents long, chunk_size int, chunk_overlap int, index_dim int, score_mode string",
}
POINTERS = "project_id string, published boolean"


class Lake:
    """The tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, pattern: str) -> list[str]:
        found = self._files().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}"))
        return sorted(s.getPath().toString() for s in found or ())

    def versions(self) -> list[str]:
        """Versions whose pointers are committed, oldest first: one name a cycle."""
        return sorted(p.rsplit("/", 2)[1].removeprefix("version=") for p in self._folders("pointers/version=*/_SUCCESS"))

    def new_version(self) -> str:
        known = self.versions()
        return f"v{int(known[-1][1:9]) + 1 if known else 1:08d}-{uuid.uuid4().hex[:8]}"

    def write(self, name: str, version: str, rows: DataFrame) -> None:
        """One table of a version; rows of a project stand together in its files."""
        if name == "pointers":
            rows = rows.select("project_id", "published")
        else:
            have = {f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema}
            rows = rows.select(*(c for c in rows.columns if c in have))
        rows.sortWithinPartitions("project_id").write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

    def _table(self, name: str, versions: list[str]) -> DataFrame:
        schema = POINTERS if name == "pointers" else SCHEMAS[name]
        root = f"{self.path}/{name}"
        there = {f.rsplit("=", 1)[1] for f in self._folders(f"{name}/version=*")}  # old ones may have been removed
        versions = [v for v in versions if v in there]
        if not versions:
            return self.spark.createDataFrame([], f"{schema}, version string")
        return self.spark.read.schema(f"{schema}, version string").option("basePath", root).parquet(*(f"{root}/version={v}" for v in versions))

    def written(self, name: str, version: str) -> DataFrame:
        """A table of one version, published or not."""
        return self._table(name, [version])

    def uploads(self) -> DataFrame:
        """Uploaded files (project_id, doc_id, text), the newest of each id."""
        rows = self.read("uploads")
        newest = rows.groupBy("project_id", "doc_id").agg(F.max("version").alias("version"))
        return rows.join(newest, ["project_id", "doc_id", "version"], "left_semi").drop("version")

    def pointers(self) -> DataFrame:
        """Rows (project_id, published, version) of all cycles."""
        return self._table("pointers", self.versions())

    def read(self, name: str) -> DataFrame:
        """Rows of a table that the pointers name, with their version."""
        known = self.pointers().where("published") if name in (*INDEX, "artifacts", "uploads") else self.pointers()
        if name in ADDITIVE:
            named = known.select("project_id", "version")
        else:
            named = known.groupBy("project_id").agg(F.max("version").alias("version"))
        return self._table(name, self.versions()).join(named, ["project_id", "version"], "left_semi")

    def index(self, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
        """Chunks of the projects whose index is sound, and (project_id, reason) of those to rebuild."""
        chunks = self.read("chunks")
        checked = check_index(chunks, self.read("manifest"), size, overlap)
        return chunks.join(checked.where("reason is null").select("project_id"), "project_id", "left_semi"), checked.where("reason is not null")

    def publish(self, version: str, pointers: DataFrame) -> None:
        """The last write of a cycle: from here on its version counts."""
        self.write("pointers", version, pointers)

    def vacuum(self) -> list[str]:
        """Remove folders that no pointer names any more: leftovers of failed cycles, and states and indexes that newer ones replaced."""
        gone, committed = [], set(self.versions())
        # At most one version a project is current; the list is as long as there are cycles.
        current: dict[str, set[str]] = {}
        for name in (*STATE, *INDEX):
            known = self.pointers().where("published") if name in INDEX else self.pointers()
            current[name] = {r.version for r in known.groupBy("project_id").agg(F.max("version").alias("version")).select("version").distinct().collect()}
        for name in (*ADDITIVE, *STATE, *INDEX):
            for folder in self._folders(f"{name}/version=*"):
                if folder.rsplit("=", 1)[1] not in current.get(name, committed):
                    self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
                    gone.append(folder)
        return gone


def check_index(chunks: DataFrame, manifest: DataFrame, size: int, overlap: int) -> DataFrame:
    """Rows (project_id, reason) of the manifest's projects: why an index must be rebuilt, null if it is sound.

    What is on disk is summed up once a document and once a project: rows and documents
    must be as many as the manifest says, all vectors of its dimension and finite, and each
    document numbered from 0 without a gap.
    """
    vector = F.size("vector")
    documents = chunks.groupBy("project_id", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"), F.count_distinct("chunk_index").alias("d"), F.min(vector).alias("least"), F.max(vector).alias("most"),
        F.coalesce(F.bool_and(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))), F.lit(False)).alias("finite"),
    )
    whole = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))
    found = documents.groupBy("project_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("have"), F.min("least").alias("least"), F.max("most").alias("most"), F.bool_and("finite").alias("finite"), F.bool_and(whole).alias("whole"))
    rows = manifest.join(found, "project_id", "left")
    reason = (
        F.when((F.col("chunk_size") != size) | (F.col("chunk_overlap") != overlap), "settings").when(F.coalesce("n", F.lit(0)) != F.col("rows"), "rows").when(F.col("have") != F.col("documents"), "documents")
        .when((F.col("least") != F.col("index_dim")) | (F.col("most") != F.col("index_dim")), "dimension").when(~F.col("finite"), "vectors").when(~F.col("whole"), "gap")
    )
    return rows.select("project_id", reason.alias("reason"))


def manifest_of(chunks: DataFrame, size: int, overlap: int, dims: int) -> DataFrame:
    """What an index of these chunks must hold."""
    rows = chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents"))
    return rows.withColumns({"chunk_size": F.lit(size), "chunk_overlap": F.lit(overlap), "index_dim": F.lit(dims), "score_mode": F.lit("cosine01")})


