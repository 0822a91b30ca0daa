"""Quality: nearest-neighbour voting among labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.labelled import labelled_sample
from tracewright.llm.textops import slices, words

#: Labelled documents that vote, about.
SAMPLE_DOCUMENTS = 4_000
#: Buckets of words, of the signs at words' ends, and of words' shapes; dimensions of the latent space.
WORD_BUCKETS, SIGN_BUCKETS, SHAPE_BUCKETS = 3072, 512, 64
BUCKETS = WORD_BUCKETS + SIGN_BUCKETS + SHAPE_BUCKETS
RANK = 64
NEIGHBOURS, SHARPNESS = 25, 8
#: Documents of a block.
BLOCK = 512


def _hash(strings: pa.Array, buckets: int) -> np.ndarray:
    return (pd.util.hash_array(strings.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int64)


def terms(dictionary: pa.Array) -> np.ndarray:
    """int64[3, words]: each word's buckets for its letters, its signs, and its shape."""
    folded = pc.utf8_lower(dictionary)
    core = pc.replace_substring_regex(folded, r"[^\p{L}\p{N}]+", "")
    signs = pc.replace_substring_regex(dictionary, r"[\p{L}\p{N}]+", "a")

    def has(pattern: str) -> np.ndarray:
        return pc.match_substring_regex(dictionary, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    size = np.minimum(np.log2(pc.utf8_length(dictionary).to_numpy(zero_copy_only=False).astype(float) + 1).astype(np.int64), 3)
    shape = has(r"\p{Lu}") + 2 * has(r"\p{Ll}") + 4 * has(r"\p{N}") + 8 * has(r"[^\p{L}\p{N}]$") + 16 * size
    return np.stack([_hash(core, WORD_BUCKETS), WORD_BUCKETS + _hash(signs, SIGN_BUCKETS), WORD_BUCKETS + SIGN_BUCKETS + shape])


def blocks(texts: pa.Array) -> Iterator[np.ndarray]:
    """float32[rows, BUCKETS] of term shares, damped by a logarithm, for runs of BLOCK texts."""
    w = words(texts, lower=False)
    t = terms(w.dictionary) if len(w.dictionary) else np.zeros((3, 0), np.int64)
    for a in range(0, len(texts), BLOCK):
        b = min(len(texts), a + BLOCK)
        offsets = w.offsets[a : b + 1]
        codes = w.codes[offsets[0] : offsets[-1]]
        n = np.diff(offsets)
        rows = np.repeat(np.arange(b - a), n)
        count = sum(np.bincount(rows * BUCKETS + t[k][codes], minlength=(b - a) * BUCKETS) for k in range(3)) if len(codes) else np.zeros((b - a) * BUCKETS)
        yield np.log1p(count.reshape(b - a, BUCKETS).astype(np.float32) * (256 / np.maximum(n, 1))[:, None].astype(np.float32))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class QualityModel:
    """basis: float32[BUCKETS, rank], inverse document frequencies included; vectors: the labelled documents; y: labels."""

    basis: np.ndarray
    vectors: np.ndarray
    y: np.ndarray
    prior: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        return unit(x @ self.basis)

    def vote(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Labels of the nearest vectors weighted by a power of their cosines; the prior counts as one faint neighbour."""
        if not len(self.y):
            return np.full(len(x), self.prior)
        cosines = self.embed(x) @ self.vectors.T
        k = min(neighbours, len(self.y))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        return ((weight * self.y[near]).sum(axis=1) + 1e-3 * self.prior) / (weight.sum(axis=1) + 1e-3)


def latent_basis(x: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of idf-weighted rows by randomised subspace iteration, as a map from term shares."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    a = unit(x * idf)
    q = np.random.default_rng(seed).standard_normal((len(x), min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(a @ (a.T @ q))
    _, _, v = np.linalg.svd(q.T @ a, full_matrices=False)
    return (idf[:, None] * v[:rank].T).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_documents: int = SAMPLE_DOCUMENTS) -> QualityModel:
    """labels: doc_id, quality; learn: the rows of labels that may be learned from. The driver gets the sample's sparse
    term counts, which sample_documents bounds. Without labels every score is 0.5."""
    sample = labelled_sample(docs, labels, "quality", learn, sample_documents)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            places, values = [], []
            for x in blocks(part.column("text")):
                for r in x:
                    at = np.flatnonzero(r)
                    places.append(at.astype(np.int32))
                    values.append(r[at])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["doc_id", "y", "at", "v"])

    got = sample.select("doc_id", "y", "text").mapInArrow(rows, "doc_id long, y int, at array<int>, v array<float>").toPandas().sort_values("doc_id")
    x = np.zeros((len(got), BUCKETS), np.float32)
    for k, (at, v) in enumerate(zip(got["at"], got["v"], strict=True)):
        x[k, at] = v
    y = got["y"].to_numpy(float)
    if not len(y):
        return QualityModel(np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    basis = latent_basis(x)
    return QualityModel(basis, unit(x @ basis).astype(np.float32), y, float(y.mean()))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1, higher: quality 1 likelier), predicted (1 from 0.5 on), and the columns of keep.

    Every whole text is compared with all labelled vectors, in blocks. Null and empty texts, near to none, score as the
    labels' mean; repeated rows score alike; a null id stays null; an empty table gives no rows; other columns are
    ignored."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *keep)
    held = docs.sparkSession.sparkContext.broadcast(model)  # sample_documents x RANK and BUCKETS x RANK floats
    extra = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            s = np.concatenate([held.value.vote(x) for x in blocks(part.column("text"))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *part.columns[2:]], names=["doc_id", "score", "predicted", *part.schema.names[2:]])

    return rows.mapInArrow(run, ", ".join(["doc_id long, score double, predicted int", *extra]))
