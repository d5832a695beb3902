"""Cutting lineage through the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset and all runs in one process a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables written under the shared folder and read again; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0

    def _write(self, write) -> str:
        path = f"{self.root}/{self.n}"
        self.n += 1
        had = self.spark.conf.get(TIDY, "false")
        self.spark.conf.set(TIDY, "true")  # the table replaces the shuffle files that it was made from
        try:
            write(path)
        finally:
            self.spark.conf.set(TIDY, had)
        return path

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = self._write(df.write.option("compression", codec).parquet)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def save_by(self, df: DataFrame, key: str, parts: int, dealt: bool = False) -> DataFrame:
        """Saved in ``parts`` buckets by a column, so that grouping and joining by it reads the table without a shuffle.

        dealt: the rows already lie in that many parts by the column.

        The catalogue is asked for the buckets only; its entry is gone before this returns, the files stay.
        """
        name = f"scratch_{uuid.uuid4().hex}"
        out = (df if dealt else df.repartition(parts, key)).write.bucketBy(parts, key).sortBy(key).option("compression", "zstd")
        path = self._write(lambda path: out.option("path", path).saveAsTable(name))
        found = self.spark.table(name)
        self.spark.sql(f"drop table {name}")
        found.scratch_path = path
        return found

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t.scratch_path)

    def drop_since(self, mark: int, *keep: DataFrame) -> None:
        """Drops what was saved since ``mark`` (an earlier ``n``), but for tables that are still read."""
        kept = {t.scratch_path for t in keep}
        for i in range(mark, self.n):
            if (path := f"{self.root}/{i}") not in kept:
                self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
