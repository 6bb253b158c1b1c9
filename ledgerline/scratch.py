"""Tables that a job writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the session's ``spark.checkpoint.dir``; it goes when the application ends.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("root")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN["root"] = tempfile.mkdtemp(prefix="ledgerline-")
    path = f"{root.rstrip('/')}/ledgerline/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are shuffled and none is broadcast.

    Spark takes a table for as large as its compressed files, less the columns that aren't read, so it would send many million rows through the driver.
    """
    return df.hint("merge")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read again: what costs much is worked out once, and its lineage ends."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
