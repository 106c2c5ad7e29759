"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset, a local folder in local mode; on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        root = tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/docweave-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: it is computed once, and lost executors don't lose it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def release(_final: bool = False) -> None:
    """Deletes the scratch tables written so far. Call it only when no frame that reads them is still to run."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            if not _final:
                raise


atexit.register(release, True)
