"""The ten operators and the pipeline as queries over the tables of a folder, with oracle SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import embeddings, gif, langid, linededup, mixing, packing, quality, simhash, suffixtree, toxicity
from tracewright.llm.shared import fold


#: Rows that Spark hands to Python at once; its own 10,000 of long texts take much memory on both sides.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("bits")).alias("fingerprint"), "component_id")


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = gif.gif_payloads(gif.texts_to_gif(table(spark, sf_dir, "documents")))
    n = F.length("payload")
    feature = F.concat_ws(";", F.concat_ws(",", F.col("colour_histogram").cast("array<string>")), F.col("n_frames").cast("string"), F.col("duration_ms").cast("string"))
    return read.select(
        "doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "n_frames",
    )


def op5_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 5) == 1
    found = suffixtree.score(table(spark, sf_dir, "documents"), ~held, keep=(held.alias("held_out"),))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "class_score", "root_score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, model, keep=((fold("doc_id", 5) == 0).alias("held_out"),)).select("doc_id", "held_out", "score", "predicted")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1).select(F.col("doc_id").alias("id"), "text", "lang"))
    return langid.identify(docs, model, keep=((fold("doc_id", 3) == 1).alias("held_out"),)).select("doc_id", "held_out", "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(table(spark, sf_dir, "documents"), per_run=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return quality.score(docs, model, keep=((fold("doc_id", 3) == 1).alias("held_out"),)).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_embeddings": op2_embeddings,
    "op3_simhash": op3_simhash,
    "op4_gif": op4_gif,
    "op5_suffixtree": op5_suffixtree,
    "op6_toxicity": op6_toxicity,
    "op7_langid": op7_langid,
    "op8_mixing": op8_mixing,
    "op9_linededup": op9_linededup,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {"op8_mixing": mixing.mix_sql()}
