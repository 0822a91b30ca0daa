"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.textops import slices, sum_rows, words

#: n-grams of 1 to GRAMS code points inside a word and the blanks around it, hashed to 2^BITS buckets.
GRAMS, BITS = 4, 15
SMOOTHING = 0.5
#: Documents that the model is fitted on, about; chosen by a hash of the id among the rows it may learn from.
SAMPLE_DOCUMENTS = 30_000
UNKNOWN = "und"


def ngrams(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and the number of the word that each belongs to."""
    text = " " + " ".join(dictionary.to_numpy(zero_copy_only=False).tolist()) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = points == 32
    word = np.cumsum(blank) - 1  # a blank belongs to the word after it
    hashes, buckets, owners = np.zeros(len(points), np.uint32), [], []
    inner = np.zeros(len(points), bool)  # has a blank after the first place
    for n in range(1, GRAMS + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        hashes = (hashes[:m] + points[n - 1 : n - 1 + m] + np.uint32(n)) * np.uint32(0x9E3779B1)
        hashes ^= hashes >> np.uint32(15)
        good = ~inner[:m] & ~(blank[:m] if n == 1 else np.zeros(m, bool))
        if n == 2:
            good &= ~(blank[:m] & blank[1 : 1 + m])
        at = np.flatnonzero(good)
        buckets.append((hashes[at] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
        owners.append(word[at])
        inner = inner[:m] | (blank[n - 1 : n - 1 + m] if n > 1 else np.zeros(m, bool))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


@dataclass
class LanguageModel:
    """log_probability: float32[buckets, languages]; prior: float64[languages]."""

    languages: list[str]
    prior: np.ndarray
    log_probability: np.ndarray


def fit(rows: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> LanguageModel:
    """rows: id, text, lang, those to learn from. Counts are made by the tasks; the driver gets languages x buckets."""
    rows = rows.where(F.col("lang").isNotNull())
    many = rows.count()
    if many > sample_documents:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < int(sample_documents / many * (1 << 32)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            w = words(pc.utf8_lower(pc.fill_null(part.column("text"), "")))
            if not len(w.dictionary):
                continue
            buckets, owners = ngrams(w.dictionary)
            langs = part.column("lang").dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            of_token = code[w.rows()]
            for k, name in enumerate(names):
                weight = np.bincount(w.codes[of_token == k], minlength=len(w.dictionary))
                totals.setdefault(name, np.zeros(1 << BITS))
                totals[name] += np.bincount(buckets, weight[owners], 1 << BITS)
        for name, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(t[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(docs)
    table = np.full((1 << BITS, len(languages)), SMOOTHING)
    place = {name: k for k, name in enumerate(languages)}
    np.add.at(table, (counts["bucket"].to_numpy(np.int64), counts["lang"].map(place).to_numpy(np.int64)), counts["n"].to_numpy(np.float64))
    prior = np.log(np.array([docs[x] for x in languages], float) / max(1, sum(docs.values()))) if languages else np.zeros(0)
    return LanguageModel(languages, prior, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (the predicted language's posterior), and the columns of keep.

    Every whole text is scored: a distinct word's n-grams are summed once, its documents add its sums. Null texts, texts
    without a letter, and all texts under a model without languages get `und` and 0. Repeated rows score alike; a null
    id stays null; an empty table gives no rows; other columns are ignored."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *keep)
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^BITS floats
    extra = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part in slices(batches, "text"):
            w = words(pc.utf8_lower(pc.fill_null(part.column("text"), "")))
            n = part.num_rows
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if len(w.dictionary) and m.languages:
                buckets, owners = ngrams(w.dictionary)
                by_word = np.stack([np.bincount(owners, m.log_probability[buckets, k], len(w.dictionary)) for k in range(len(m.languages))], axis=1)
                letters = pc.match_substring_regex(w.dictionary, r"\p{L}").to_numpy(zero_copy_only=False)
                total = np.stack([np.bincount(w.rows(), by_word[w.codes, k], n) for k in range(len(m.languages))], axis=1) + m.prior
                told = np.bincount(w.rows(), letters[w.codes], n) > 0
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names[told], score[told] = np.array(m.languages, object)[best[told]], share[told]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), *part.columns[2:]], names=["doc_id", "lang_pred", "score", *part.schema.names[2:]])

    return rows.mapInArrow(run, ", ".join(["doc_id long, lang_pred string, score double", *extra]))
