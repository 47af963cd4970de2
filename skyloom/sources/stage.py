"""Tables that the turns of an iteration write: lineage ends in them, and lost executors cost no turns again."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all run in one process."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _own[0]


class Stage:
    """Writes tables to a folder of its own; drop() takes one away that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/skyloom-{uuid.uuid4().hex}"
        self.written: list[str] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{len(self.written)}"
        self.written.append(path)
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def keep_last(self, n: int) -> None:
        """Drop all but the first n and the last table."""
        for path in self.written[n:-1]:
            self.drop(path)


@contextlib.contextmanager
def stage(spark: SparkSession) -> Iterator[Stage]:
    """Tables written inside go at the end."""
    found = Stage(spark)
    try:
        yield found
    finally:
        found.drop(found.at)
