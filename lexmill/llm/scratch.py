"""Durable intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``.  Nothing is
kept on one executor only, so a lost executor costs the tasks it was running
and no more.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset and everything runs in one process."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: folders of operator calls that are not removed yet
_live: list[str] = []


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that operators made inside, at its end: what came of them must be written by then."""
    before = set(_live)
    yield
    for root in [r for r in _live if r not in before]:
        fs, at = _folder(spark, root)
        fs.delete(at, True)
        _live.remove(root)


class Scratch:
    """Tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        _live.append(self.root)
        # what nobody removes before goes when the driver ends
        fs, at = _folder(spark, self.root)
        fs.deleteOnExit(at)

    def table(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write ``df`` once and read it back; the schema is carried over, not inferred."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.partitionBy(*partition_by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later plan reads."""
        fs, at = _folder(self.spark, df._scratch_path)
        fs.delete(at, True)
