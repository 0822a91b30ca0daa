"""Materialised tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
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


#: Spark deletes an execution's shuffle files when it ends, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise_halves(df: DataFrame, first: Column, name: str, tidy: bool = False) -> tuple[DataFrame, DataFrame]:
    """As materialise(), in one pass to two tables: the rows for which first holds, and the rest. Each can be discarded."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _write(df.withColumn("_half", F.when(first, 0).otherwise(1)), path, tidy, "_half")
    halves = []
    for k in range(2):
        # a half without rows has no folder
        exists = _folder_exists(spark, f"{path}/_half={k}")
        out = spark.read.schema(df.schema).parquet(f"{path}/_half={k}") if exists else spark.createDataFrame([], df.schema)
        if exists:
            out._tracewright_path = f"{path}/_half={k}"  # type: ignore[attr-defined]
        halves.append(out)
    return halves[0], halves[1]


def _folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _write(df: DataFrame, path: str, tidy: bool, *folders: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(_TIDY)
    conf.set(_TIDY, str(tidy or before == "true").lower())
    try:
        df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    finally:
        conf.set(_TIDY, before)


def materialise(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there and a lost executor costs nothing.
    tidy: the shuffle files that were needed for it go at once."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _write(df, path, tidy)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewright_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by materialise()."""
    path = getattr(df, "_tracewright_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fold(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
