"""Tables written once in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: a reading task with more rows than this is worth dealing out where cores would idle
SPREAD_ROWS = 4096


def folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``, for one writer; what is there goes when the driver ends.

    Where that folder is unset a temporary one serves, in one process only.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a folder of its own and read back."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` as read from files, dealt out by ``key`` where a few row groups hold most rows and would leave cores idle.

    A row group is read by one task, however large it is.  Only footers are read to find out.
    """
    parallel = df.sparkSession.sparkContext.defaultParallelism
    held = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    if not held or max(held) <= max(SPREAD_ROWS, 2 * sum(held) / parallel):
        return df
    return df.repartition(max(3 * parallel, -(-sum(held) // SPREAD_ROWS)), key)
