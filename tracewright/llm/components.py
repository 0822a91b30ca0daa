"""Connected components of a link table, by hooking to the smallest neighbour and contracting. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import discard, materialise


def _flatten(parents: DataFrame) -> DataFrame:
    """node, root from node, parent: pointers are doubled until each leads to a node that is its own parent."""
    while True:
        up = parents.select(F.col("node").alias("_mid"), F.col("parent").alias("_up"))
        doubled = materialise(parents.join(up, parents["parent"] == up["_mid"]).select("node", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("_moved")), "cc-pointers")
        moved = doubled.where("_moved").limit(1).count()
        discard(parents)
        parents = doubled.drop("_moved")
        parents._tracewright_path = doubled._tracewright_path
        if not moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """links: a, b (same type; order and repeats don't matter). node, root for every linked node: root is the smallest
    node of its component. Links to null and to oneself are ignored; no links, no rows.

    A round: each node takes its smallest neighbour if that is smaller, pointers are flattened, links are replaced by
    those between roots. A component's links fall at least by half a round. Every table of a round is written to the
    shared folder; nothing is collected. Joins on a node with very many links are left to adaptive execution to split."""
    pair = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(pair, "cc-links")
    known: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        parents = materialise(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent")), "cc-parents")
        roots = _flatten(parents)
        left = roots.select(F.col("node").alias("a"), F.col("parent").alias("_ra"))
        right = roots.select(F.col("node").alias("b"), F.col("parent").alias("_rb"))
        fewer = materialise(edges.join(left, "a").join(right, "b").where("_ra <> _rb").select(F.greatest("_ra", "_rb").alias("a"), F.least("_ra", "_rb").alias("b")).distinct(), "cc-links")
        discard(edges)
        edges = fewer
        if known is None:
            known = roots
        else:
            step = roots.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
            renewed = materialise(known.join(step, known["parent"] == step["_node"], "left").select("node", F.coalesce("_parent", "parent").alias("parent")), "cc-roots")
            discard(known)
            discard(roots)
            known = renewed
    if known is None:
        known = edges.select(F.col("a").alias("node"), F.col("b").alias("parent"))
    return known.withColumnRenamed("parent", "root")
