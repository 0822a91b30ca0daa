"""A training corpus from documents: toxic documents go, repeated passages go, one document of each near-duplicate group
stays, sources are mixed to target weights, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept. All but the last return the columns of
documents. Between stages docs are written as Parquet to the shared folder and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import linededup, mixing, packing, simhash, toxicity
from tracewright.llm.queries import table, tokenizer_path
from tracewright.llm.shared import fold, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, *but: str) -> tuple:
    """The columns of documents, in a struct so that no operator's own columns clash with them."""
    return (F.struct(*[docs[c] for c in COLUMNS if c not in but]).alias("_document"),)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model predicts toxic; it learns from the folds that its query learns from. Null and
    empty texts are scored as any other; rows alike go or stay together; an empty table, or one without labels, loses
    nothing; columns that documents does not have are dropped here and by the next stages."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, model, keep=_kept(docs)).where("predicted = 0").select("_document.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; every document stays, if need be with an empty text, and n_chars is counted anew. Null texts
    stay null; rows with one id count as one document; rows without an id come last; an empty table gives no rows."""
    cut = linededup.remove_repeats(docs, keep=_kept(docs, "text"), per_run=True)
    return cut.select("_document.doc_id", "text", "_document.lang", "_document.source", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("_document.n_chars")).alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group keeps one document: that with the smallest id (one without an id only if none has one), of rows with
    that id the one whose text has the least hash, of rows equal in both the least by their other columns. Null and empty
    texts are near duplicates of each other; a document near no other stays; an empty table gives no rows."""
    text = F.xxhash64("text")
    found = simhash.near_duplicates(docs, keep=(text.alias("_text"),))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_text")).alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first._text").alias("_text"))
    named = docs.select(*COLUMNS).withColumn("_hash", text)
    lasting = named.join(first, named["doc_id"].eqNullSafe(first["_id"]) & (named["_hash"] == first["_text"]), "left_semi")
    once = lasting.groupBy("doc_id", "_hash").agg(F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("_rest"))
    return once.select("doc_id", "_rest.*").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, to the nearest whole number; documents without words, null texts
    among them, stay once. A null source is a source; rows alike are each taken for themselves; an empty table gives no
    rows."""
    mixed = mixing.mix(docs, keep=_kept(docs))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1)).cast("int")
    return mixed.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select("_document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with the digests of their token ids. A null text is an empty one, whose only token
    is its end; repeated rows are packed each for itself; an empty table gives no rows."""
    pieces = packing.pack_documents(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hashed fingerprints, boosted trees and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain
#: version of its stages.
ORACLE_SQL = None
