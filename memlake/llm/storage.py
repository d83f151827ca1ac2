"""Places that the driver and every executor can reach.

Files and cut points of the operators live under the session's checkpoint folder
(``spark.checkpoint.dir`` or ``setCheckpointDir``).  A temporary folder of this machine
takes its place only in sessions with a local master; elsewhere a missing setting is
an error, since other machines could not read what is written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to a Python worker, which bounds what both sides hold.
BATCH_BYTES = 8 << 20

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder as a URI or path, without a trailing slash."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = context.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="memlake-")
        base = _OWN[app]
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unique folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``materialize`` whose tables are removed at the end; what is returned must be written apart before."""
    folder = scratch(spark, name)

    def keep(df: DataFrame, table: str) -> DataFrame:
        path = f"{folder}/{table}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to send no batch much larger than ``BATCH_BYTES`` to Python.

    The setting must hold when the frame runs, so it stays; one given with a unit or a smaller one is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).lower().rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI, usable on any executor."""
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
