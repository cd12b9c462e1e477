"""Step tables of an iterative job.

An iterative fit must cut its lineage, and the cut has to survive lost executors.
Every step is therefore written as a parquet table below the shared folder the
session names in ``spark.checkpoint.dir`` and read back from there.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"  # past it a task sorts the rest of its rows
_LOCAL_ROOTS: dict[str, str] = {}  # application id -> temporary folder of a local session


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for step tables.

    Where ``spark.checkpoint.dir`` is unset a local session gets a fresh temporary
    folder; on a cluster that would be lost with its machine, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tallymix-")
    return _LOCAL_ROOTS[app]


class Workspace:
    """Writes step tables and forgets them when a later step replaces them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/tallymix-{uuid.uuid4().hex[:12]}"
        self._count = 0
        self._known: dict[int, tuple[DataFrame, str, str | None]] = {}

    def path(self, name: str) -> str:
        """A folder of the workspace that nothing else uses."""
        self._count += 1
        return f"{self.root}/{self._count:05d}-{name}"

    def put(self, df: DataFrame, name: str, bucket_by: list[str] | None = None, buckets: int = 1,
            folders_by: str | None = None) -> DataFrame:
        """Write ``df`` and return a frame that reads the written table.

        ``bucket_by`` keeps the rows hash-partitioned on disk, so that later joins
        on those columns move only the other side. ``folders_by`` gives each value of a
        column its own folder, so that a condition on it reads no others.
        """
        path = self.path(name)
        if bucket_by:
            table = f"tallymix_{uuid.uuid4().hex}"
            # open writers by bucket instead of sorting the rows by bucket: a task of a table laid out by its key has one
            before = self.spark.conf.get(_WRITERS)
            self.spark.conf.set(_WRITERS, "8")
            try:
                (
                    df.write.mode("error")
                    .format("parquet")
                    .option("path", path)
                    .bucketBy(buckets, *bucket_by)
                    .saveAsTable(table)
                )
            finally:
                self.spark.conf.set(_WRITERS, before)
            out = self.spark.table(table)
        else:
            table = None
            df.write.mode("error").parquet(path, partitionBy=folders_by)
            out = self.spark.read.schema(df.schema).parquet(path)
        self._known[id(out)] = (out, path, table)
        return out

    def release(self, *frames: DataFrame | None) -> None:
        """Delete step tables that nothing will read again."""
        for df in frames:
            if df is None or id(df) not in self._known:
                continue
            _, path, table = self._known.pop(id(df))
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
