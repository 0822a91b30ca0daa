"""The ten operators on small tables: brute force, round trips, held-out accuracy, and odd rows."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import embeddings, gif, langid, linededup, mixing, packing, quality, simhash, suffixtree, toxicity
from tracewright.llm.components import components
from tracewright.llm.queries import op5_suffixtree, op9_linededup, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, offset string, label string"


def text(rng, n):
    return " ".join(rng.choice("the of and to in is was for on that with stone river light paper window".split()) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(k, text(rng, rng.randrange(1, 400)), ("en", "de")[k % 2], f"s{k % 3}" if k % 7 else None, 0, "x", "y") for k in range(60)]
    out += [(100, out[3][1], "en", "s0", 0, "x", "y"), (101, out[3][1] + " end", "en", "s1", 0, "x", "y"), (102, None, None, None, None, None, None), (103, "", "en", "s0", 0, "x", "y"), (None, "no id here", None, "s1", 0, "x", "y"), (5, out[5][1], "en", "s2", 0, "x", "y"), (104, "long " * 30_000, "en", "s0", 0, "x", "y"), (105, " \t\n ", "en", "s0", 0, "x", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), group_sequences=4).toPandas()
    by = collections.defaultdict(list)
    for r in got.itertuples():
        by[None if pd.isna(r.doc_id) else int(r.doc_id)].append(r)
    for doc, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by[doc], key=lambda r: r.start)
        assert {r.doc_tokens for r in own} == {len(ids)}
        covered = np.concatenate([np.frombuffer(r.tokens, "<u4") for r in own])
        assert covered.tolist() == np.tile(ids, len(covered) // len(ids)).tolist() if doc != 5 else len(covered) == 2 * len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()
        assert (n := int(s.length.sum())) <= 4096 and n & (n - 1) == 0
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def brute_links(vs, cosine=0.93):
    """Per row: number of links and the smallest id that links lead to, by comparing all pairs."""
    good = [i for i, (k, v, lab) in enumerate(vs) if k is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    x = {i: np.float32(vs[i][1]).astype(float) for i in good}
    near = {i: [j for j in good if j != i and vs[i][2] == vs[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= cosine] for i in good}
    out = [(vs[i][0], 0, vs[i][0]) for i in range(len(vs))]
    for i in good:
        seen, queue = {i}, [i]
        while queue:
            for j in near[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        out[i] = (vs[i][0], len(near[i]), min(vs[j][0] for j in seen))
    return sorted((k is None, k or 0, n, c or 0, k == c or k is None) for k, n, c in out)


def linked_rows(df, **given):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embeddings.near_duplicates(df, **given).collect())


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    vs = [(k, (base[k % 40] + 0.15 * rng.standard_normal(16)).tolist(), k % 4 // 2) for k in range(200)]
    vs += [(300, vs[0][1], vs[0][2]), (301, None, 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, vs[0][1], None), (305, [1.0] * 8, 0), (306, [], 0), (307, [None] * 16, 0)]
    # the same id with another label, with another vector, and once more; no id
    vs += [(1, vs[2][1], 1), (1, vs[5][1], 0), (2, vs[2][1], vs[2][2]), (None, vs[0][1], vs[0][2])]
    df = spark.createDataFrame([(*r, 7, "x", 0.5, 9) for r in vs], "vec_id long, embedding array<double>, label int, g long, t string, factor double, many long").repartition(3)
    assert linked_rows(df) == brute_links(vs)
    assert embeddings.near_duplicates(df.limit(0)).columns == ["vec_id", "n_links", "component_id", "kept"] and not linked_rows(df.limit(0))


@pytest.mark.parametrize("dim", [16, 100])
def test_embeddings_in_several_tables_and_tiles(spark, dim):
    """Buckets of random projections, large ones in tiles, one label with a hot group of near copies."""
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((60, dim))
    x = base[rng.integers(0, 60, 500)] + rng.choice([0.05, 0.2, 0.3], (500, 1)) * rng.standard_normal((500, dim))
    x[::3] = base[0] + 0.01 * rng.standard_normal((167, dim))
    vs = [(k, v.astype(np.float32).tolist(), k % 7 // 5) for k, v in enumerate(x)]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>, label int").repartition(3)
    assert embeddings.table_count(4) > 5
    got = linked_rows(df, bucket=24, largest=32, miss=1e-6)
    assert got == brute_links(vs)
    few = linked_rows(df, bucket=24, largest=32)
    assert sum(r[2] for r in few) >= 0.995 * sum(r[2] for r in got)


def test_embedding_estimates_and_tables():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64))
    x[150:] = x[:150] + 0.3 * rng.standard_normal((150, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes = embeddings.encode(unit)
    assert codes.signs.shape == (300, 1) and codes.levels.shape == (300, 4, 1)
    truth = unit @ unit.T
    estimate, error = embeddings.estimates(codes, codes)
    off = ~np.eye(300, dtype=bool)
    # unbiased, and wrong by about as much as is said
    assert abs((estimate - truth)[off].mean()) < 0.01
    assert 0.5 < ((estimate - truth) / error)[off].std() < 1.2
    may = embeddings.undecided(codes)
    near = embeddings.linked(unit, may)
    assert (near == ((truth >= 0.93) & off)).all()
    assert may.sum() < 0.02 * 300 * 299 / 2  # the codes decide nearly all pairs
    bits, n = embeddings.tables(100_000)
    keys = embeddings.bucket_keys(unit, bits, n)
    a, b = np.nonzero(near)
    assert (keys[a] == keys[b]).any(axis=1).mean() > 0.99


def test_simhash(docs, rows, empty):
    def fp(t):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    marks = {(r[0], fp(r[1])) for r in rows}
    parent = {m: m for m in marks}
    group = {m: {n for n in marks if (m[1] ^ n[1]).bit_count() <= 3} for m in marks}
    for m in marks:
        todo, seen = [m], {m}
        while todo:
            for n in group[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        ids = [n[0] for n in seen if n[0] is not None]
        parent[m] = min(ids) if ids else None
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        key = (r["doc_id"], r["bits"] & (1 << 64) - 1)
        assert key in marks and r["component_id"] == parent[key]
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_tiles_equal_whole_buckets(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 300:
        x = rng.choice(sorted(values))
        values.add(x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "bits long")
    sizes = {most: components(simhash.close_links(df, most=most)).groupBy("root").count().select("count").toPandas()["count"].sort_values().tolist() for most in (16, 2048)}
    assert sizes[16] == sizes[2048]


def test_gif(docs, empty):
    rng = random.Random(4)
    for n in (64, 64 * 47, 64 * 48, 64 * 49, 64 * 500):
        for alphabet in (1, 2, 256):
            data = bytes(rng.randrange(alphabet) for _ in range(n))
            stored = gif.store_payloads([data])[0]
            assert b"".join(f.indices.tobytes() for f in gif.decode_gif(stored)) == data
            head = gif.read_gif(stored)[2][0]
            assert gif.lzw_decode(head.stream, 8, head.width * head.height) == data[: head.width * head.height]
    for broken in (b"", b"GIF89a", stored[:-1], stored[:900], b"\x89PNG"):
        assert isinstance(gif.decode_gifs([broken])[0], gif.GifError)
    # a 2 x 1 screen: red and green, then a transparent frame over it that is disposed of, then blue on the left
    palette = np.zeros((256, 3), np.uint8)
    palette[1], palette[2], palette[3] = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    part = lambda data, w, disposal, transparent: gif.Coded(0, 0, w, 1, palette, False, 50, disposal, transparent, 8, gif.lzw_encode_many([data])[0])
    coded = [part(b"\1\2", 2, 1, -1), part(b"\3\0", 2, 3, 0), part(b"\3", 1, 1, -1)]
    shown = [f.rgb[0].tolist() for f in gif.compose(2, 1, coded, gif.lzw_decode_many([(c.stream, c.size, c.width) for c in coded]))]
    assert shown == [[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [0, 255, 0]], [[0, 0, 255], [0, 255, 0]]]
    got = gif.gif_payloads(gif.texts_to_gif(docs)).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id").collect()
    assert got and all(bytes(r["payload"]) == gif.pad(r["t"].encode()) for r in got)
    assert gif.gif_frames(gif.texts_to_gif(empty)).count() == 0


def plain_tree(texts, learn, depth=suffixtree.DEPTH):
    """log10 of each text by the tree of tokens, unseen words as one symbol: counts in dictionaries, one token at a time."""
    seqs = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), "</s>"] for t in texts]
    c = collections.Counter(w for s, x in zip(seqs, learn, strict=True) if x for w in s)
    n = sum(c.values()) - c["<s>"]
    unknown = (sum(v == 1 for k, v in c.items() if k not in ("<s>", "</s>")) + 0.5) / (n + 1)
    symbol = lambda w: w if c[w] >= 2 else None
    follow = collections.defaultdict(collections.Counter)
    for s, x in zip(seqs, learn, strict=True):
        for i in range(1, len(s) if x else 0):
            for d in range(1, min(depth, i) + 1):
                if all(c[w] >= 2 for w in s[i - d : i]):
                    follow[tuple(s[i - d : i])][symbol(s[i])] += 1
    root = lambda w: (1 - unknown) * c[w] / n if w is not None and c[w] else unknown

    def p(context, w):
        if not context:
            return root(w)
        f, below = follow[context], p(context[1:], w)
        if sum(f.values()) < 2 or not state(context):
            return below
        return (f[w] + len(f) * below) / (sum(f.values()) + len(f))

    known = {}

    def state(context):
        if context not in known:
            f = follow[context]
            t, kinds = sum(f.values()), len(f)
            gain = 0.0
            for w, k in f.items():
                lnq = float(np.float16(np.log(p(context[1:], w))))
                others = kinds - (k == 1)
                gain += k * (math.log(max((k - 1 + others * math.exp(lnq)) / (t - 1 + others), 1e-300)) - lnq)
            known[context] = gain >= suffixtree.DIVERGENCE
        return known[context]

    out = []
    for s in seqs:
        total = 0.0
        for i in range(1, len(s)):
            context = ()
            while len(context) < min(depth, i) and c[s[i - len(context) - 1]] >= 2 and (not context or sum(follow[s[i - len(context) - 1], *context].values()) >= 2):
                context = (s[i - len(context) - 1], *context)
            # a word met once has a probability of its own, but no occurrence left to learn from
            once = c[s[i]] == 1
            total += math.log10(p(context, s[i] if c[s[i]] else None) if not once else plain_once(context, s[i], p, follow, state, root))
        out.append(total)
    return out


def plain_once(context, w, p, follow, state, root):
    if not context:
        return root(w)
    below = plain_once(context[1:], w, p, follow, state, root)
    f = follow[context]
    return len(f) * below / (sum(f.values()) + len(f)) if sum(f.values()) >= 2 and state(context) else below


def plain_spelling(words_, new):
    """log10 of the spelling of each new word by a tree over the bytes of words_."""
    deep = suffixtree.SPELL_DEPTH
    follow = collections.defaultdict(collections.Counter)
    for w in words_:
        s = ["^", *w.encode(), "$"]
        for i in range(1, len(s)):
            for d in range(min(deep, i) + 1):
                follow[tuple(s[i - d : i])][s[i]] += 1

    def p(context, x):
        f = follow.get(context, {})
        t = sum(f.values())
        if not context:
            return (f.get(x, 0) + 0.5) / (t + 0.5 * suffixtree.ALPHABET)
        below = p(context[1:], x)
        if t and sum(k * math.log(k / t / p(context[1:], y)) for y, k in f.items()) >= suffixtree.SPELL_DIVERGENCE:
            return (f.get(x, 0) + below) / (t + 1)
        return below

    out = {}
    for w in new:
        s = ["^", *w.encode(), "$"]
        out[w] = sum(math.log10(p(tuple(s[max(0, i - deep) : i]), s[i])) for i in range(1, len(s)))
    return out


def test_suffix_tree(spark, docs, rows, empty):
    learn = F.col("lang").eqNullSafe("en")
    texts, taught = [r[1] for r in rows], [r[2] == "en" for r in rows]
    texts = [t if t is None or k % 3 else t + f" Odd{k} word{k % 5}" for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, lang, "x", 1) for k, (t, lang) in enumerate(zip(texts, ["en" if x else "de" for x in taught], strict=True))], "doc_id long, text string, lang string, block string, seq int").repartition(3)
    want = plain_tree(texts, taught)
    tokens = [[w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    c = collections.Counter(w for s, x in zip(tokens, taught, strict=True) if x for w in s)
    spelled = plain_spelling(list(c), {w for s in tokens for w in s} - set(c))
    n_all, v, ends = sum(c.values()) + sum(taught), len(c) + 1, sum(taught)
    for size in (1 << 20, 500):  # one range, and many with contexts that are split
        got = {r["doc_id"]: r for r in suffixtree.score(df, learn, keep=(F.col("block"),), transitions=size).collect()}
        assert len(got) == len(texts)
        for k, s in enumerate(tokens):
            assert got[k]["n_tokens"] == len(s) + 1 and got[k]["n_known"] == sum(w in c for w in s) + 1 and got[k]["train_tokens"] == n_all and got[k]["block"] == "x"
            base = sum(math.log10((c[w] + 0.5) / (n_all + 0.5 * (v + 1))) for w in s) + math.log10((ends + 0.5) / (n_all + 0.5 * (v + 1)))
            assert got[k]["base_score"] == pytest.approx(base, rel=1e-9)
            assert got[k]["class_score"] == pytest.approx(want[k], rel=1e-6, abs=1e-6)
            assert got[k]["score"] == pytest.approx(want[k] + sum(spelled.get(w, 0) for w in s), rel=1e-6, abs=1e-6)
    assert len(suffixtree.score(docs, learn).collect()) == len(rows)
    assert suffixtree.score(empty, learn).count() == 0
    nothing = suffixtree.score(df.limit(5), F.lit(False)).toPandas()
    assert (nothing["n_known"] == 0).all() and np.isfinite(nothing["score"]).all()


def test_suffix_tree_packs_words(spark, monkeypatch):
    """A block sends a row to each range of words, not one for each word; the ranges count as a dictionary does."""
    rng = random.Random(21)
    texts = [" ".join(f"W{rng.randrange(400)}\u00e9" for _ in range(60)) for _ in range(80)] + [None, " "]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    monkeypatch.setattr(suffixtree, "BLOCK_BYTES", 4000)
    blocks = suffixtree.blocks_of_documents(df, "doc_id", "text", F.col("doc_id") % 2 == 0, (), 3).cache()
    sent = blocks.where("part IS NOT NULL")
    assert 3 < sent.count() == sent.select("block", "part").distinct().count() <= 3 * blocks.select("block").distinct().count()
    c = collections.Counter({w.lower(): 0 for t in texts for w in (t or "").split()})
    c.update(w.lower() for t in texts[::2] for w in (t or "").split())
    got = suffixtree.count_words(sent, 3).collect()
    words = {r["word"]: r for r in got if r["part"] is None}
    assert {w: r["c"] for w, r in words.items()} == c and len({r["w"] for r in words.values()}) == len(c) == sum(r["part"] is None for r in got)
    assert sum(r["part"] is not None for r in got) == sent.count()
    blocks.unpersist()
    learn = F.col("doc_id") % 2 == 0
    one, many = ({r["doc_id"]: r for r in suffixtree.score(df, learn, word_range=size).collect()} for size in (1 << 24, 1000))
    want = plain_tree(texts, [k % 2 == 0 for k in range(len(texts))])
    for k in range(len(texts)):
        assert many[k]["class_score"] == pytest.approx(want[k], rel=1e-6) and many[k]["score"] == pytest.approx(one[k]["score"], rel=1e-9)
        assert (many[k]["n_known"], many[k]["base_score"]) == (one[k]["n_known"], pytest.approx(one[k]["base_score"], rel=1e-12))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_suffix_tree_beats_its_root(spark):
    """On held-out documents, with unseen words as one symbol for both."""
    got = op5_suffixtree(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("class_score") / F.sum("n_tokens"), F.sum("root_score") / F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.15


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    out, labels = [], []
    for k in range(400):
        t = text(rng, rng.randrange(20, 80))
        toxic, poor = k % 4 == 0, k % 3 == 0
        w = t.split()
        if toxic:
            w[len(w) // 2 : len(w) // 2] = ["you", rng.choice(["zorgish", "blatted", "zorgling", "BLATTED"])]
        if poor:
            w = [x + "%%%" for x in w]
        out.append((k, " ".join(w)))
        labels.append((k, int(not poor), int(toxic)))
    return spark.createDataFrame([*out, (900, None), (None, "x"), (901, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(judged, module, label):
    docs, labels = judged
    learn = F.col("doc_id") % 3 != 1
    got = module.score(docs, module.fit(docs, labels, learn)).join(labels.where(f"{label} IS NOT NULL"), "doc_id").where("doc_id % 3 = 1").toPandas()
    assert (got["predicted"] == got[label]).mean() > 0.95
    every = module.score(docs, module.fit(docs, labels.limit(0), learn)).toPandas()
    assert len(every) == 403 and every["score"].between(0, 1).all()
    assert module.score(docs.limit(0), module.fit(docs.limit(0), labels, learn)).count() == 0


def test_obfuscated_words():
    assert toxicity.plain("i.d1-0t") == "idiot" and toxicity.plain("$cuuum") == "scum"


def test_langid(spark):
    words = {"de": "und die der das nicht schaft ung über", "fr": "le la les des que eau avec être", "en": "the and that with thing ing of to"}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(20)), lang) for k, lang in enumerate(["de", "fr", "en"] * 40)]
    df = spark.createDataFrame([*rows, (900, None, "de"), (901, "12 %% 3", "fr"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 1 OR doc_id < 60").select(F.col("doc_id").alias("id"), "text", "lang"))
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902))
    nothing = langid.fit(df.limit(0).select(F.col("doc_id").alias("id"), "text", "lang"))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).toPandas()
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left, w = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * left / w for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]} - capped
        if not over:
            break
        capped |= over
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    for s, part in got.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert part["source_size"].iloc[0] == sizes[s] and math.isclose(part["target"].iloc[0], target[s], rel_tol=1e-9)
        assert abs(part["taken"].sum() - target[s]) <= 64 * 4
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    assert mixing.mix(empty).count() == 0


def test_sainte_lague(spark):
    rng = random.Random(2)
    for n, seats in ((1, 5), (7, 3), (12, 400)):
        shares = [rng.randrange(0, 1000) for _ in range(n)]
        shares[0] = 17
        df = spark.createDataFrame([(1, k, s, seats) for k, s in enumerate(shares)], "g int, k int, share long, seats long")
        got = {r["k"]: r["quota"] for r in mixing.sainte_lague(df, ["g"], "share", "seats", [F.col("k")]).collect()}
        want = [0] * n
        for _ in range(seats):
            want[max(range(n), key=lambda i: (shares[i] / (2 * want[i] + 1), -i))] += 1
        assert [got[k] for k in range(n)] == want


def test_line_dedup(spark, empty):
    rng = random.Random(8)
    passage = "\n".join(text(rng, 9) for _ in range(6))
    texts = [text(rng, 40) + "\n" + passage, "Other words here\n" + passage + "\n" + text(rng, 30), "\n".join([passage, passage]), "short", None, "", " \n \n"]
    df = spark.createDataFrame([*enumerate(texts), (None, passage)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.remove_repeats(df).collect()}
    assert len(got) == len(texts) + 1
    assert got[0]["removed_words"] == 0 and got[0]["text"] == texts[0]
    assert passage not in got[1]["text"] and "Other words here" in got[1]["text"]
    assert got[3]["text"] == "short" and got[4]["text"] is None and got[5]["text"] == ""
    seen = set()
    for k, t in [*enumerate(texts), (None, passage)]:  # by ids, the null one last
        lines = []
        for physical in (t or "").split("\n"):
            cur = []
            for w in physical.split():
                cur.append(w)
                if len(cur) == 10 or w[-1] in ".!?":
                    lines.append(tuple(cur))
                    cur = []
            lines += [tuple(cur)] if cur else []
        covered, own = set(), set()
        for j in range(len(lines) - 2):
            window = tuple(lines[j : j + 3])
            if sum(map(len, window)) >= 10:
                covered |= {j, j + 1, j + 2} if window in seen | own else set()
                own.add(window)
        seen |= own
        assert (got[k]["n_lines"], got[k]["removed_lines"], got[k]["removed_words"]) == (len(lines), len(covered), sum(len(lines[j]) for j in covered))
        assert (got[k]["text"] or "").split() == [w for j, x in enumerate(lines) if j not in covered for w in x]
    assert got[1]["removed_words"] > 30 and got[2]["removed_words"] > 80
    assert linededup.remove_repeats(empty).count() == 0


def test_line_dedup_at_any_offset(spark):
    rng = random.Random(11)
    running = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    passage = running(60)
    texts = [f"{running(40 + k)} {passage} {running(40)}" for k in range(11)]
    got = {r["doc_id"]: r for r in linededup.remove_repeats(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got[0]["removed_words"] == 0 and got[0]["text"] == texts[0]
    for k in range(1, 11):  # all but less than a line at both ends, and nothing else
        (span,) = got[k]["spans"]
        assert 40 + k <= span["first_word"] < 50 + k and 90 + k < span["first_word"] + span["n_words"] <= 100 + k
        assert got[k]["removed_words"] == span["n_words"]


def test_line_dedup_of_short_lines(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = "\n".join(" ".join(word() for _ in range(3)) for _ in range(20))
    short = "\n".join(" ".join(word() for _ in range(3)) for _ in range(3))  # nine words in all
    texts = [f"{word()} {word()}\n{x}\n{word()} {word()}" for x in (passage, passage, short, short)]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op9_linededup(spark, str(tmp_path)).collect()}
    assert [got[k]["removed_words"] for k in range(4)] == [0, 60, 0, 0]
    assert got[1]["text"].split() == texts[1].split()[:2] + texts[1].split()[-2:]


def test_line_dedup_in_few_steps(spark, monkeypatch):
    """Repeats within documents are found by one sort of numbers, words are cut by their bytes, and the windows that nobody
    repeats pass the join unsorted."""
    rng = random.Random(13)
    doc = np.sort(np.array([rng.randrange(20) for _ in range(500)]))
    code = np.array([rng.randrange(30) for _ in range(500)])
    pairs = list(zip(doc.tolist(), code.tolist(), strict=True))
    assert linededup._again(doc, code).tolist() == [x in pairs[:k] for k, x in enumerate(pairs)]
    assert linededup._again(doc[:0], code[:0]).tolist() == []
    for _ in range(200):
        t = "".join(rng.choices(" \t\n\x0b\x1c\u00a0\u2003ab\u00e9\U0001f600", k=60))
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        runs = [(k, min(2, len(spans) - k)) for k in range(rng.randrange(3), len(spans), 4)]
        kept = [t[a:b].strip() for a, b in zip([0, *(spans[k + n - 1][1] for k, n in runs)], [*(spans[k][0] for k, _ in runs), len(t)], strict=True)]
        assert linededup.cut(t, np.array([k for k, _ in runs], int), np.array([n for _, n in runs], int)) == "\n".join(x for x in kept if x)
    plans = {}
    kept_as = linededup.materialise
    monkeypatch.setattr(linededup, "materialise", lambda df, name, **x: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), kept_as(df, name, **x))[1])
    passage = text(rng, 60)
    df = spark.createDataFrame([(k, f"{text(rng, 20)}\n{passage}") for k in range(6)], "doc_id long, text string")
    assert [r["removed_words"] >= 50 for r in linededup.remove_repeats(df, per_run=True).orderBy("doc_id").collect()] == [False] + [True] * 5
    assert "ShuffledHashJoin" in plans["line-repeats"] and "SortMergeJoin" not in plans["line-repeats"]


def test_line_dedup_words_by_bytes(spark, monkeypatch):
    """Words are found and hashed by their bytes, never made into strings, and each by all of its bytes."""
    def no_strings(*_):
        raise AssertionError("words made into strings")

    monkeypatch.setattr("pyarrow.compute.ascii_split_whitespace", no_strings)
    rng = random.Random(14)
    for _ in range(100):
        texts = [rng.choice([None, "", "".join(rng.choices(" \t\n\x0b\x1c\x00\u00a0ab.\u00e9\U0001f600", k=60))]) for _ in range(5)]
        for part, own in ((pa.array(texts), texts), (pa.array(texts).slice(1, 3), texts[1:4])):
            found = linededup.Words(part)
            plain = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in own]
            assert found.counts.tolist() == [len(x) for x in plain]
            assert [found.data[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)] == [w for x in plain for w in x]
            assert linededup.Lines(part).doc.tolist() == [k for k, x in enumerate(plain) for _ in x]
    distinct = [w for n in range(1, 90) for w in ("a" * n, "a" * n + "\x00", *("a" * k + "b" + "a" * (n - k) for k in range(n)))]
    hashes = linededup.Words(pa.array([" ".join(distinct), "\n".join(distinct)])).hashes()
    assert hashes[: len(distinct)].tolist() == hashes[len(distinct) :].tolist() and len(set(hashes.tolist())) == len(set(distinct))
    for _ in range(100):
        key, fixed = np.array(rng.sample(range(1, 10_000), 50), np.uint64), np.array([rng.random() < 0.05 for _ in range(50)])
        starts = [k for k in range(50 - linededup.WRAP + 1) if not fixed[k : k + linededup.WRAP].any()]
        assert set(np.flatnonzero(linededup._local(key, fixed)).tolist()) == {k + int(key[k : k + linededup.WRAP].argmin()) for k in starts}
    # control characters are parts of words like any other
    passages = ["\n".join(f"{' '.join(f'w{k}{c}{j}' for j in range(9))}." for k in range(5)) for c in "\x01\x02"]
    controls = [" ".join([c] * 60) for c in "\x01\x02"]
    df = spark.createDataFrame([*enumerate([*passages, *controls, passages[0]])], "doc_id long, text string")
    got = {r["doc_id"]: r["removed_words"] for r in linededup.remove_repeats(df, per_run=True).collect()}
    assert [got[k] for k in (0, 1, 4)] == [0, 0, 45] and got[2] == got[3]


def test_line_dedup_of_many_short_documents(spark):
    """Documents times windows of a slice are beyond 32 bits."""
    rng = random.Random(15)
    letters = [chr(k) for k in range(0x21, 0x7F) if chr(k) not in ".!?"]
    texts = ["\n".join(rng.choices(letters, k=100)) for _ in range(10_000)]
    for k in range(100, 10_000, 100):
        texts[k] = texts[k - 1][:100] + texts[k][100:]
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "10000")
    try:
        docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in linededup.remove_repeats(docs, per_run=True).collect()}
    finally:
        spark.conf.set(rows, before)
    seen = set()
    for k, t in enumerate(texts):
        words, own, gone = t.split(), set(), [False] * 100
        for j in range(98):
            window = tuple(words[j : j + 3])
            if window in seen or window in own:
                gone[j : j + 3] = [True] * 3
            own.add(window)
        seen |= own
        runs = [m.span() for m in re.finditer("1{10,}", "".join("01"[x] for x in gone))]
        assert got[k] == [(a, b - a) for a, b in runs]


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
