"""Cutting a plan that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one if Spark runs on this machine alone,
    else an error: executors would not see each other's files."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="tracewright-")
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder, so that steps that read it several times don't multiply
    its plan, read only the columns and rows they need, and a lost executor costs nothing."""
    path = f"{shared_root(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
