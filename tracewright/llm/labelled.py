"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import materialise


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, documents: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, y of about `documents` labelled documents at most, one row a doc_id, written to the shared folder.

    learn says which rows of labels may be learned from. The sample is those ids whose hash is below the share that is
    needed, so it is spread over all rows. Several labels of an id are averaged (a tie is 1), several texts give the
    least; null labels and ids without a document are left out."""
    one = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    one = materialise(one, "labels")
    many = one.count()
    if many > documents:
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(documents / many * (1 << 32)))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # the sample's ids are bounded by `documents`, so they may be broadcast
    found = texts.join(F.broadcast(one), "doc_id")
    return materialise(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "labelled")
