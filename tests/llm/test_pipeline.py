"""The pipeline's stages at the smallest size and on a small fixture, the run against a plain version of its stages."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import mixing, toxicity
from tracewright.llm.queries import tokenizer_path
from tracewright.llm.shared import materialise

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns, name
        sizes[name] = (before.count(), docs.count())
        if name != "line_dedup":  # texts are whole
            assert docs.join(before.select("doc_id", F.col("text").alias("t")), "doc_id").where("NOT (text <=> t)").count() == 0
    toxic = spark.read.parquet(f"{SF}/labels.parquet")
    assert sizes["toxicity"][1] >= 0.8 * sizes["toxicity"][0] and toxic.count()
    assert sizes["line_dedup"][0] == sizes["line_dedup"][1]
    assert sizes["simhash_near_dedup"][1] <= sizes["simhash_near_dedup"][0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(last["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    full = last.groupby("sequence_id")["length"].sum()
    assert ((full & (full - 1)) == 0).all() and full.max() <= 4096


# --- a plain version of every stage -----------------------------------------------------------------------------------


def plain_toxicity(spark, rows, folder):
    """The model is the operator's; features are counted word by word and trees walked row by row."""
    frame = spark.createDataFrame(rows, COLUMNS)
    from tracewright.llm.shared import fold

    model = toxicity.fit(frame, spark.read.parquet(f"{folder}/labels.parquet"), fold("doc_id", 5) != 0)
    if model.trees is None:
        return [r for r in rows if model.ys[0] < 0.5]
    import pyarrow as pa

    def score(text):
        x = toxicity.features(pa.array([text or ""]), model.lexicon)[0]
        margin, inner = model.trees.base, model.trees.feature.shape[1]
        for f, t, leaf in zip(model.trees.feature, model.trees.threshold, model.trees.leaf, strict=True):
            k = 0
            while k < inner:
                k = 2 * k + (2 if f[k] >= 0 and x[f[k]] > t[k] else 1)
            margin += leaf[k - inner]
        return min(1, max(0, np.interp(margin, model.xs, model.ys)))

    return [r for r in rows if score(r[1]) < 0.5]


def pieces_of(text):
    """Lists of word numbers: the pieces of a text whose lines all have fewer than ten words."""
    out, n = [], 0
    for line in (text or "").split("\n"):
        piece = []
        for w in WORD.findall(line):
            piece.append((n, w))
            n += 1
            if w[-1] in ".!?":
                out.append(piece)
                piece = []
        if piece:
            out.append(piece)
    return out


def plain_lines(rows):
    first = {}
    for k, r in enumerate(rows):
        p = pieces_of(r[1])
        for a in range(len(p) - 2):
            window = tuple(tuple(w for _, w in x) for x in p[a : a + 3])
            if r[0] is not None:
                first[window] = min(first.get(window, r[0]), r[0])
    out = []
    for r in rows:
        p, seen, gone = pieces_of(r[1]), set(), [False] * len(pieces_of(r[1]))
        for a in range(len(p) - 2):
            window = tuple(tuple(w for _, w in x) for x in p[a : a + 3])
            owner = first.get(window)
            if window in seen or owner is not None and (r[0] is None or r[0] > owner):
                gone[a] = gone[a + 1] = gone[a + 2] = True
            seen.add(window)
        cut, a = set(), 0
        while a < len(p):
            b = a
            while b < len(p) and gone[b] == gone[a]:
                b += 1
            if gone[a] and sum(len(x) for x in p[a:b]) >= 10:
                cut |= {n for x in p[a:b] for n, _ in x}
            a = b
        if not cut:
            out.append(r)
            continue
        kept, held = [], []
        spans = [m.span() for m in WORD.finditer(r[1])]
        for n, span in enumerate(spans):
            if n not in cut:
                held.append(span)
            elif held:
                kept.append(r[1][held[0][0] : held[-1][1]])
                held = []
        if held:
            kept.append(r[1][held[0][0] : held[-1][1]])
        text = "\n".join(kept)
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def spark_hash(spark, texts):
    return [r["h"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.xxhash64("t").alias("h")).orderBy("k").collect()]


def plain_near(spark, rows):
    f = [plain_fingerprint(r[1]) for r in rows]
    h = spark_hash(spark, [r[1] for r in rows])
    left, out = set(range(len(rows))), []
    while left:
        queue = [left.pop()]
        group = set(queue)
        while queue:
            u = queue.pop()
            new = {v for v in left if (f[u] ^ f[v]).bit_count() <= 3}
            left -= new
            group |= new
            queue += new
        out.append(min((rows[k] for k in group), key=lambda r: (r[0] is None, r[0] or 0, h[rows.index(r)], [x or "" for x in r[2:4]])))
    return out


def plain_pack(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return {r[0]: np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4") for r in rows}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Lines of under ten words, so that the plain version needs no cuts by content."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdegiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 9))) + rng.choice(["", ".", "!"])
    shared = [line() for _ in range(8)]
    rows, labels = [], []
    for k in range(150):
        lines = [line() for _ in range(rng.randrange(4, 40))]
        toxic = k % 5 == 2
        if toxic:
            for i in range(0, len(lines), 3):
                lines[i] += " you stupid idiot."
        if k % 4 == 0:
            lines[2:2] = shared[: rng.randrange(3, 9)]
        rows.append((k, "\n".join(lines), "en", f"s{k % 4}" if k % 9 else None, 1))
        labels.append((k, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 5 != 2]
    rows += [(200 + k, clean[7 + k][1], "de", "s1", 2) for k in range(5)]  # copies
    rows += [(210, clean[20][1] + " more", "en", "s2", 3), (220, None, None, None, None), (221, "", "en", "s0", 0), (222, " \n\t", "en", "s0", 0)]
    rows += [(None, clean[21][1], "en", "s1", 4), (None, line() + "\n" + line(), "en", "s1", 4), (9, line() + "\n" + line(), "en", "s0", 5)]
    rows += [(230, "\n".join(line() for _ in range(3000)), "en", "s3", 6)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS + ", bits string, _text int").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def key(r):
    return tuple((x is None, x or 0) if k in (0, 4) else (x is None, x or "") for k, x in enumerate(r))


def test_run_is_the_plain_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    got = {}
    for name in ("toxicity", "line_dedup", "simhash_near_dedup", "mixing"):
        docs = materialise(stages[name](spark, docs, path), f"test-{name}")
        got[name] = sorted((tuple(r) for r in docs.collect()), key=key)
    want = plain_toxicity(spark, rows, path)
    assert got["toxicity"] == sorted(want, key=key)
    held_out_toxic = {k for k in range(2, 150, 5)}
    assert not {r[0] for r in want} & held_out_toxic and len(want) == len(rows) - len(held_out_toxic)
    want = plain_lines(want)
    assert got["line_dedup"] == sorted(want, key=key)
    assert sum(len(r[1] or "") for r in want) < sum(len(r[1] or "") for r in rows if r[0] not in held_out_toxic)
    want = plain_near(spark, want)
    assert got["simhash_near_dedup"] == sorted(want, key=key)
    # mixing is held to its SQL elsewhere; here: every document as often as its share of words says
    mixed = mixing.mix(spark.createDataFrame(want, COLUMNS)).toPandas()
    times = collections.Counter()
    for r in mixed.itertuples():
        times[None if np.isnan(r.doc_id) else int(r.doc_id)] += int(r.taken / r.size + 0.5) if r.size else 1
    found = collections.Counter(r[0] for r in got["mixing"])
    assert {k: v for k, v in times.items() if v} == dict(found)
    tokens = plain_pack(got["mixing"])
    # run() as a whole
    pieces = corpus_pipeline.run(spark, path).toPandas()
    for doc, own in pieces.groupby(pieces["doc_id"].fillna(-1)):
        if doc in (-1, 9):  # ids of several texts
            continue
        ids = tokens[int(doc)]
        assert set(own["doc_tokens"]) == {len(ids)}
        n = found[int(doc)]
        assert int(own["length"].sum()) == n * len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = int(s["length"].sum())
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and total <= 4096 and total & (total - 1) == 0


def test_stages_on_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
