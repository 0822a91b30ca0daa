"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.labelled import labelled_sample
from tracewright.llm.shared import materialise
from tracewright.llm.textops import slices, words

#: Labelled documents that the model is fitted on, about.
SAMPLE_DOCUMENTS = 12_000
#: Terms of the learned lexicon at most, and candidates that the driver ranks. A term is a word, or a stem: the first
#: letters of words, written with a star.
LEXICON_TERMS, CANDIDATES = 200, 5000
STEMS = (4, 5, 6)
#: Toxic documents that a term needs.
LEAST_DOCUMENTS = 3
#: Parts of the sample for the calibration; least hashes of a text's words that copies share.
FOLDS, SKETCHES = 4, 3
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Words to each side of a lexicon word in which second-person words count as near.
REACH = 4
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros"]
#: Signs that stand for letters in obfuscated words.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
FEATURES = ["lexicon", "lexicon_log", "lexicon_kinds", "obfuscated_lexicon", "obfuscated", "second_person", "second_person_near", "capitals", "capital_words", "punctuation", "exclamations", "word_length", "words_log"]
_ENDS = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def plain(word: str) -> str:
    """An obfuscated word's letters: look-alike signs replaced, other signs dropped, runs of a letter cut to one."""
    return re.sub(r"(.)\1+", r"\1", "".join(c for c in word.lower().translate(LOOKALIKES) if c.isalpha()))


def cores(dictionary: pa.Array) -> pa.Array:
    """Words in lower case without signs at their ends."""
    return pc.replace_substring_regex(pc.utf8_lower(dictionary), _ENDS, "")


def features(texts: pa.Array, lexicon: list[str]) -> np.ndarray:
    """float64[rows, FEATURES]; an empty text has zeros."""
    n = len(texts)
    w = words(texts, lower=False)
    out = np.zeros((n, len(FEATURES)))
    if not len(w.dictionary):
        return out
    d = w.dictionary
    core = cores(d)
    kind = core.type
    hits = pc.is_in(core, pa.array(lexicon, kind)).to_numpy(zero_copy_only=False)
    stems = [x[:-1] for x in lexicon if x.endswith("*")]
    for k in STEMS:
        if own := [x for x in stems if len(x) == k]:
            hits = hits | pc.is_in(pc.utf8_slice_codeunits(core, 0, k), pa.array(own, kind)).to_numpy(zero_copy_only=False)
    second = pc.is_in(core, pa.array(SECOND_PERSON, kind)).to_numpy(zero_copy_only=False)
    mixed = pc.match_substring_regex(d, r"\p{L}[^\p{L}\s]+\p{L}|^[@$]\p{L}").to_numpy(zero_copy_only=False)
    hidden = np.zeros(len(d), bool)
    squeezed, cut = {plain(x) for x in lexicon if not x.endswith("*")}, tuple({plain(x) for x in stems})
    suspects = np.flatnonzero(mixed & ~hits)
    if lexicon and len(suspects):
        hidden[suspects] = [(p := plain(x)) in squeezed or p.startswith(cut) for x in d.take(pa.array(suspects)).to_pylist()]
    length = pc.utf8_length(d).to_numpy(zero_copy_only=False).astype(float)
    capitals = pc.count_substring_regex(d, r"\p{Lu}").to_numpy(zero_copy_only=False).astype(float)
    letters = pc.count_substring_regex(d, r"\p{L}").to_numpy(zero_copy_only=False).astype(float)
    signs = pc.count_substring_regex(d, r"[^\p{L}\p{N}]").to_numpy(zero_copy_only=False).astype(float)
    shouts = pc.count_substring(d, "!").to_numpy(zero_copy_only=False).astype(float)
    rows, codes = w.rows(), w.codes

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, x[codes], n)

    count = np.maximum(w.counts, 1)
    hit, you = (hits | hidden)[codes], second[codes]
    before = np.concatenate([[0], np.cumsum(you)])
    at = np.flatnonzero(hit)
    lo = np.maximum(at - REACH, w.offsets[rows[at]])
    hi = np.minimum(at + REACH + 1, w.offsets[rows[at] + 1])
    near = np.bincount(rows[at], before[hi] - before[lo], n)
    found = total((hits | hidden).astype(float))
    pairs = np.unique(rows[at] * np.int64(len(d)) + codes[at])
    chars = np.maximum(total(length), 1)
    columns = [
        100 * total(hits.astype(float)) / count, np.log1p(found), np.bincount(pairs // len(d), minlength=n).astype(float), 100 * total(hidden.astype(float)) / count, 100 * total(mixed.astype(float)) / count,
        100 * total(second.astype(float)) / count, near / np.maximum(found, 1), total(capitals) / np.maximum(total(letters), 1), 100 * total(((letters > 1) & (capitals == letters)).astype(float)) / count,
        total(signs) / chars, 100 * total(shouts) / count, total(length) / count, np.log1p(w.counts),
    ]
    return np.stack(columns, axis=1)


# --- trees ----------------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees: a node's children are 2i + 1 and 2i + 2; feature -1 passes all rows to the left."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                own = f[at]
                at = 2 * at + 1 + ((own >= 0) & (x[rows, own] > t[at]))
            out += leaf[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins of the features."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    for j in range(m):  # a feature that is nearly always zero still gets a cut above zero
        above = x[:, j][x[:, j] > (cuts[j][-1] if len(cuts[j]) else -np.inf)]
        if len(above) and above.min() < above.max():
            cuts[j] = np.unique(np.append(cuts[j], (above.min() + (cuts[j][-1] if len(cuts[j]) else above.min())) / 2))
        elif len(above) and len(cuts[j]) and above.min() > cuts[j][-1]:
            cuts[j] = np.append(cuts[j], (above.min() + cuts[j][-1]) / 2)
        cuts[j] = cuts[j] if len(cuts[j]) else np.zeros(1)
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1)
    width = max(len(c) for c in cuts) + 1
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    inner = (1 << depth) - 1
    out = Trees(base, np.full((trees, inner), -1), np.zeros((trees, inner)), np.zeros((trees, inner + 1)))
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            own = at - first
            gain, best_j, best_c = np.zeros(many), np.full(many, -1), np.zeros(many, np.int64)
            for j in range(m):
                cell = own * width + code[:, j]
                gs = np.cumsum(np.bincount(cell, g, many * width).reshape(many, width), axis=1)
                hs = np.cumsum(np.bincount(cell, h, many * width).reshape(many, width), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                s = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                s[(hs < 1e-2) | (ht - hs < 1e-2)] = 0
                s = s[:, : len(cuts[j])]
                c = s.argmax(axis=1)
                better = s[np.arange(many), c] > gain + 1e-9
                gain = np.where(better, s[np.arange(many), c], gain)
                best_j, best_c = np.where(better, j, best_j), np.where(better, c, best_c)
            for q in range(many):
                if best_j[q] >= 0:
                    out.feature[k, first + q] = best_j[q]
                    out.threshold[k, first + q] = cuts[best_j[q]][best_c[q]]
            f = out.feature[k, at]
            at = 2 * at + 1 + ((f >= 0) & (x[np.arange(n), f] > out.threshold[k, at]))
        leaf = at - inner
        out.leaf[k] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += out.leaf[k][leaf]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a non-decreasing map from margin to the share of ones."""
    order = np.argsort(margin, kind="stable")
    grid, inverse = np.unique(margin[order], return_inverse=True)
    weight, total = np.bincount(inverse).astype(float), np.bincount(inverse, y[order])
    blocks: list[list[float]] = []
    for x, a, b in zip(grid, total, weight, strict=True):
        blocks.append([a, b, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a2, b2, _, high = blocks.pop()
            blocks[-1][0] += a2
            blocks[-1][1] += b2
            blocks[-1][3] = high
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return xs, ys


@dataclass
class ToxicityModel:
    lexicon: list[str] = field(default_factory=list)
    trees: Trees | None = None
    xs: np.ndarray = field(default_factory=lambda: np.zeros(1))
    ys: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), float(self.ys[0]))
        return np.clip(np.interp(self.trees.margin(features(texts, self.lexicon)), self.xs, self.ys), 0, 1)


def _rank_lexicon(found: list[tuple[str, float]], most: int) -> list[str]:
    """The best terms; of a stem and what begins with it, the better."""
    chosen: list[str] = []
    for term, _ in found:
        bare = term.rstrip("*")
        covered = any(c.endswith("*") and bare.startswith(c[:-1]) for c in chosen)
        covers = term.endswith("*") and any(c.rstrip("*").startswith(bare) for c in chosen)
        if not covered and not covers:
            chosen.append(term)
        if len(chosen) == most:
            break
    return chosen


def sketched(sample: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Adds sketch, a hash of the SKETCHES least word hashes of the text, on which copies and nearly all near copies agree,
    and fold, which follows from it."""
    split = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    least = [F.array_min(F.transform(split, lambda w, k=k: F.xxhash64(w, F.lit(k)))) for k in range(SKETCHES)]
    return sample.withColumn("sketch", F.xxhash64(*least)).withColumn("fold", F.pmod(F.col("sketch"), F.lit(folds)).cast("int"))


def learn_lexicons(sample: DataFrame, most: int = LEXICON_TERMS, folds: int = FOLDS) -> list[list[str]]:
    """folds + 1 lexicons: number k is learned without the documents of fold k, the last one from all.

    A lexicon has the words and stems whose share of toxic documents has the highest log-likelihood ratio, above what the
    best of so many terms would reach by chance. sample: y, doc_id, text, sketch, fold; texts of one sketch, copies and near
    copies, count once. Counts are made by the tasks, a row for each term and fold; the
    driver gets CANDIDATES terms for each lexicon."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = words(part.column("text"), lower=False)
            if not len(w.dictionary):
                continue
            core = cores(w.dictionary)
            size = pc.utf8_length(core).to_numpy(zero_copy_only=False)
            y, of = part.column("y").to_numpy(zero_copy_only=False), part.column("fold").to_numpy(zero_copy_only=False)
            rows = w.rows()
            for k in (0, *STEMS):
                term = pc.binary_join_element_wise(pc.utf8_slice_codeunits(core, 0, k), pa.scalar("*", core.type), pa.scalar("", core.type)) if k else core
                term = term.dictionary_encode()
                codes = term.indices.to_numpy(zero_copy_only=False)[w.codes]
                counted = (size > k)[w.codes]  # a stem stands for longer words than itself
                m = len(term.dictionary)
                seen = np.unique(rows[counted] * np.int64(m) + codes[counted])
                cell = of[seen // m] * np.int64(m) + seen % m
                ones, alls = np.bincount(cell, y[seen // m], m * folds).astype(np.int64), np.bincount(cell, minlength=m * folds)
                at = np.flatnonzero(alls)
                yield pa.RecordBatch.from_arrays([term.dictionary.cast(pa.string()).take(pa.array(at % m)), pa.array((at // m).astype(np.int32)), pa.array(ones[at]), pa.array(alls[at])], names=["term", "fold", "ones", "alls"])

    distinct = materialise(sample.groupBy("sketch", "fold", "y").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("y", "d.text", "fold"), "toxic-distinct")
    ones, alls = np.zeros(folds), np.zeros(folds)
    for r in distinct.groupBy("fold").agg(F.sum("y").alias("ones"), F.count("*").alias("alls")).collect():
        ones[r["fold"]], alls[r["fold"]] = r["ones"], r["alls"]
    totals = [(float(ones.sum() - (ones[k] if k < folds else 0)), float(alls.sum() - (alls[k] if k < folds else 0))) for k in range(folds + 1)]
    if all(not 0 < a < n for a, n in totals):
        return [[] for _ in totals]
    cells = distinct.select("text", "y", "fold").mapInArrow(count, "term string, fold int, ones long, alls long")
    # a term's counts without fold k: k from 0 to folds, the last without none
    spread = cells.withColumn("k", F.explode(F.expr(f"filter(sequence(0, {folds}), k -> k <> fold)")))
    by_term = spread.where("term <> ''").groupBy("k", "term").agg(F.sum("ones").alias("a"), F.sum("alls").alias("n"))
    table = F.create_map(*[F.lit(x) for k, (a, n) in enumerate(totals) for x in (k, n and a / n)])
    share = table[F.col("k")]
    a, n, rest = F.col("a"), F.col("n"), F.col("n") - F.col("a")
    ratio = 2 * (a * F.log(a / (n * share)) + F.when(rest > 0, rest * F.log(rest / (n * (1 - share)))).otherwise(0.0))
    known = materialise(by_term.where((a >= LEAST_DOCUMENTS) & (share > 0) & (share < 1) & (a > n * share)).withColumn("ratio", ratio), "toxic-terms")
    many = {r["k"]: r["count"] for r in known.groupBy("k").count().collect()}
    floor = F.create_map(*[F.lit(x) for k in range(folds + 1) for x in (k, float(2 * np.log(max(2, many.get(k, 0)))))])
    place = F.row_number().over(W.partitionBy("k").orderBy(F.desc("ratio"), F.length("term").desc(), "term"))
    best = known.where(F.col("ratio") >= floor[F.col("k")]).withColumn("place", place).where(F.col("place") <= CANDIDATES)
    got: list[list[tuple[str, float]]] = [[] for _ in totals]
    for r in best.select("k", "term", "ratio", "place").collect():
        got[r["k"]].append((r["place"], r["term"], r["ratio"]))
    return [_rank_lexicon([(t, x) for _, t, x in sorted(g)], most) for g in got]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_documents: int = SAMPLE_DOCUMENTS) -> ToxicityModel:
    """labels: doc_id, toxic; learn: the rows of labels that may be learned from. Lexicon and trees are learned on a bounded
    sample. For the calibration each of FOLDS parts of it is scored by a lexicon and trees that were learned without it;
    copies are in the same part. Without labels, or with labels all alike, the model gives their mean (0
    without)."""
    sample = materialise(sketched(labelled_sample(docs, labels, "toxic", learn, sample_documents)), "toxic-sample")
    lexicons = learn_lexicons(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own = features(part.column("text"), lexicons[-1])
            fold = part.column("fold").to_numpy(zero_copy_only=False)
            # the features that the models of the other folds see, and for each fold's model all rows' features
            each = [features(part.column("text"), x) for x in lexicons[:-1]]
            x = np.concatenate([*each, own], axis=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(fold), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "fold", "x"])

    got = sample.select("doc_id", "y", "fold", "text").mapInArrow(rows, "doc_id long, y int, fold int, x array<double>").toPandas().sort_values("doc_id")
    y = got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(ys=np.array([y.mean() if len(y) else 0.0]))
    of = got["fold"].to_numpy()
    x = np.stack(got["x"].to_numpy()).reshape(len(y), FOLDS + 1, len(FEATURES))
    margin = np.full(len(y), np.nan)
    for k in range(FOLDS):
        own = of == k
        if own.any() and not own.all() and 0 < y[~own].mean() < 1:
            margin[own] = boost(x[~own, k], y[~own]).margin(x[own, k])
    model = boost(x[:, FOLDS], y)
    seen = ~np.isnan(margin)
    xs, ys = isotonic(margin[seen], y[seen]) if seen.any() else (np.zeros(1), np.array([y.mean()]))
    return ToxicityModel(lexicons[-1], model, xs, ys)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier), predicted (1 from 0.5 on), and the columns of keep, for whole texts.

    Null texts are scored as empty ones; repeated rows score alike; a null id stays null; an empty table gives no rows;
    other columns are ignored."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *keep)
    held = docs.sparkSession.sparkContext.broadcast(model)  # some hundred words and TREES small trees
    extra = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            s = held.value.score(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *part.columns[2:]], names=["doc_id", "score", "predicted", *part.schema.names[2:]])

    return rows.mapInArrow(run, ", ".join(["doc_id long, score double, predicted int", *extra]))
