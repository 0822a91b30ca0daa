"""Instruction traces as text: lines numbered over all splits, and the format recognised."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTED, BANG = "quoted", "bang"
#: Lines that are looked at to recognise the format.
SNIFF_LINES = 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq (0-based, dense, blank lines included), raw (without a carriage return at its end), of one file of any size.

    Splits are numbered apart, then shifted by the counts of the splits before them: no global sort. Bytes that are not
    UTF-8 appear as \\xNN."""
    text = spark.read.option("lineSep", "\n").text(path)
    raw = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_order"))
    raw = raw.withColumn("_index", F.row_number().over(W.partitionBy("_file", "_at").orderBy("_order")) - 1)
    counts = raw.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("_file", "_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_file", "_at", "_base")
    clean = F.when(F.is_valid_utf8("value"), F.regexp_replace("value", r"\r$", "")).otherwise(_escaped()(F.col("value").cast("binary")))
    return raw.join(base, ["_file", "_at"]).select((F.col("_base") + F.col("_index")).cast("long").alias("seq"), clean.alias("raw"))


def _escaped():
    @F.arrow_udf("string")
    def escape(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.removesuffix(b"\r").decode("utf-8", "backslashreplace") for x in data.to_pylist()], pa.string())

    return escape


def detect_format(lines: DataFrame) -> str:
    """QUOTED for lines like `[hh:mm:ss ...`, BANG for `[module] 0x..!0x..`, by the first telling line of the first twenty."""
    told = F.when(F.col("raw").rlike(r"^\[\d\d:"), QUOTED).when(F.col("raw").rlike(r"^\[[^!]*!"), BANG)
    got = lines.where(F.col("seq") < SNIFF_LINES).agg(F.min_by(told, F.when(told.isNotNull(), F.col("seq"))).alias("f")).first()
    return got["f"] or QUOTED


