"""Following traces that are still being written: an extension, batch results stay the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.parsing import split_line
from tracewright.operators.search import Query


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of raw, file and arrived: the lines of files that appear in a folder."""
    text = spark.readStream.option("lineSep", "\n").text(folder)
    return text.select(F.regexp_replace("value", r"\r$", "").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"))


def alerts(lines: DataFrame, query: Query) -> DataFrame:
    """The lines of a stream that a search matches; stateless."""
    return lines.where(query.matches(F.col("raw")))


def mnemonic_counts(lines: DataFrame, fmt: str, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Instructions by mnemonic and window of arrival; lines later than `late` are not counted."""
    keyed = lines.withWatermark("arrived", late).withColumns({"seq": F.lit(None).cast("long")})
    asm = split_line(keyed, fmt, "arrived").where("asm IS NOT NULL")
    return asm.groupBy(F.window("arrived", window), F.lower(F.regexp_extract("asm", r"^(\S+)", 1)).alias("mnemonic")).agg(F.count(F.lit(1)).alias("n"))
