"""Language-model scoring by a probabilistic suffix tree.

The symbols are tokens: words in lower case (A-Z), each as the learning documents have it, and a text's end. A context is
the one to DEPTH tokens before a token, within the text (its start counts as one). A context that the learning documents
have twice or more is a state of the tree if its own distribution, each occurrence judged by the others (leaving one
out), gives them DIVERGENCE nats (at least) more than the distribution of the longest state among its suffixes. A state's
distribution is its counts smoothed by that one, by as much as it has different successors (Witten and Bell). A token's
probability is that of the longest suffix that is a state; the root is the unigram model.

Words that the learning documents lack are one symbol, whose occurrences while learning are the words met once (Good and
Turing); its probability is shared out by a second suffix tree, over the bytes of the distinct words, that spells them.

Nothing is collected or broadcast but sums. Documents are handled in blocks. A block sends its words to ranges of a hash
of the word, and what it counts of contexts to ranges of a hash of the context, packed, one row for a block and range; a
range adds up and answers each block in the order of its question. A context with so many occurrences that it would fill a range is split by the next symbol and
its sums are added up after. How often a context occurs is known before: its count as a transition of the level above."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.shared import discard, materialise, materialise_halves
from tracewright.llm.textops import gathered, release_memory, words

#: Tokens of a context at most; nats by which it must diverge.
DEPTH, DIVERGENCE = 2, 0.0
#: Symbols of a context of the spelling tree at most; nats by which it must diverge; weights of the parent's and of the uniform distribution.
SPELL_DEPTH, SPELL_DIVERGENCE, SMOOTHING, ROOT_SMOOTHING = 7, 2.0, 1.0, 0.5
START, STOP, ALPHABET = 256, 257, 257
_BITS = 9
#: Bytes of text of a block of documents, and for each range of words; words of a block of words; transitions of a range of contexts, about.
BLOCK_BYTES, WORD_RANGE = 8 << 20, 16 << 20
WORD_BLOCK, WORD_BLOCK_BYTES = 262_144, 4 << 20
RANGE = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers byte by byte of each (all lowest first), compressed."""
    x = np.ascontiguousarray(x)
    return _PACK.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"")


def _unsqueeze(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(_UNPACK.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _distinct(x: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers (of so many bits) in order, a place of each, and for each place which it has."""
    low = len(x).bit_length()
    if bits + low < 64:  # with its place in its lowest bits, a number is sorted by itself
        ordered = x << low
        ordered |= np.arange(len(x))
        ordered.sort()
        order = (ordered & ((1 << low) - 1)).astype(np.int32)
        ordered >>= low
    else:
        order = np.argsort(x).astype(np.int32)
        ordered = x[order]
    fresh = np.ones(len(x), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    code = np.empty(len(x), np.int32)
    code[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return ordered[fresh], order[fresh], code


def _packed_words(dictionary: pa.Array, cuts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The runs of words between cuts: their bytes, and their lengths in bytes."""
    offsets = np.frombuffer(dictionary.buffers()[1], np.int64)[dictionary.offset : dictionary.offset + len(dictionary) + 1]
    data = memoryview(dictionary.buffers()[2] or b"")
    lengths = np.diff(offsets).astype("<u4")
    return [_PACK.compress(data[offsets[a] : offsets[b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [_squeeze(lengths[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


# --- documents and words ----------------------------------------------------------------------------------------------


def blocks_of_documents(docs: DataFrame, id_col: str, text_col: str, learn: Column, keep: tuple[Column, ...], ranges: int) -> DataFrame:
    """Rows of documents (block, doc_id, learn, n_words, seq: its words' numbers, and the columns of keep) and, for each range
    of words that a block has some of, a row (block, part, words and sizes: packed, train: how often the block's learning
    documents have each, ids: steps between their numbers in the block)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), learn.alias("_learn"), F.struct(F.lit(0).alias("_"), *keep).alias("_keep"))
    kept = rows.schema["_keep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for part in gathered(batches, "text", BLOCK_BYTES):
            w = words(part.column("text"))
            n, m = part.num_rows, len(w.dictionary)
            of_word = (pd.util.hash_array(w.dictionary.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(ranges)).astype(np.int64) if m else np.zeros(0, np.int64)
            order = np.argsort(of_word, kind="stable")
            learn_row = part.column("_learn").to_numpy(zero_copy_only=False)
            train = np.bincount(w.codes, learn_row[w.rows()].astype(np.float64), m).astype("<u4")[order]
            parts, first = np.unique(of_word[order], return_index=True)
            cuts = np.append(first, m)
            packed, sizes = _packed_words(w.dictionary.take(pa.array(order)).cast(pa.large_string()), cuts) if m else ([], [])
            runs = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            trains, ids = [_squeeze(train[x]) for x in runs], [_squeeze(np.diff(order[x], prepend=0).astype("<u4")) for x in runs]
            seq = pa.array([_squeeze(w.codes[a:b].astype("<i4")) for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)], pa.binary())
            doc = {"doc_id": part.column("doc_id"), "learn": part.column("_learn"), "n_words": pa.array(w.counts), "seq": seq, "_keep": part.column("_keep")}
            word = {"part": pa.array(parts), "words": pa.array(packed, pa.binary()), "sizes": pa.array(sizes, pa.binary()), "train": pa.array(trains, pa.binary()), "ids": pa.array(ids, pa.binary())}
            fields = {"block": pa.int64(), "part": pa.int64(), "words": pa.binary(), "sizes": pa.binary(), "train": pa.binary(), "ids": pa.binary(), "doc_id": pa.int64(), "learn": pa.bool_(), "n_words": pa.int64(), "seq": pa.binary(), "_keep": part.column("_keep").type}
            for given, size in ((doc, n), (word, len(parts))):
                if size:
                    columns = [pa.array(np.full(size, serial)) if f == "block" else given.get(f, pa.nulls(size, t)) for f, t in fields.items()]
                    yield pa.RecordBatch.from_arrays(columns, names=list(fields))
            serial += 1

    return rows.mapInArrow(run, f"block long, part long, words binary, sizes binary, train binary, ids binary, doc_id long, learn boolean, n_words long, seq binary, _keep {kept}")


def count_words(vocabulary: DataFrame, ranges: int) -> DataFrame:
    """vocabulary: block, part, words, sizes, train, ids. Rows of distinct words (word, w: its number, by whose remainder its
    range is known, c: how often the learning documents have it) and a row for each block and range (block, part, ids, h:
    its words' numbers, n: their counts)."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        sizes = [_unsqueeze(x, "<u4") for x in rows.column("sizes").to_pylist()]
        data = b"".join(_unsqueeze(x, "u1").tobytes() for x in rows.column("words").to_pylist())
        train = np.concatenate([_unsqueeze(x, "<u4") for x in rows.column("train").to_pylist()])
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]), dtype=np.int64)
        found = pa.LargeStringArray.from_buffers(len(train), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        code = found.indices.to_numpy()
        m, n = len(found.dictionary), rows.num_rows
        c = np.bincount(code, train.astype(np.float64), m).astype(np.int64)
        w = part + np.arange(m) * ranges
        at = np.cumsum([0, *map(len, sizes)])
        own = [code[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        fields = {"word": pa.string(), "w": pa.int64(), "c": pa.int64(), "block": pa.int64(), "part": pa.int64(), "ids": pa.binary(), "h": pa.binary(), "n": pa.binary()}
        told = {"word": found.dictionary.cast(pa.string()), "w": pa.array(w), "c": pa.array(c)}
        answer = {x: rows.column(x).combine_chunks() for x in ("block", "part", "ids")} | {"h": pa.array([_squeeze(w[x]) for x in own], pa.binary()), "n": pa.array([_squeeze(c[x]) for x in own], pa.binary())}
        return pa.concat_tables([pa.table({f: given.get(f, pa.nulls(size, t)) for f, t in fields.items()}) for given, size in ((told, m), (answer, n))])

    return vocabulary.select("block", "part", "words", "sizes", "train", "ids").groupBy("part").applyInArrow(run, "word string, w long, c long, block long, part long, ids binary, h binary, n binary")


# --- spelling ---------------------------------------------------------------------------------------------------------


def _spelled(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all symbols of all words in order: context, symbol, and the words' offsets. The newest symbol of a context has
    its lowest bits; a symbol is stored plus one, so zero is no symbol."""
    data = dictionary.cast(pa.large_binary()).to_pylist()
    sizes = np.array([len(x) for x in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.full(int(offsets[-1]), STOP, np.int64)
    is_byte = np.ones(len(symbols), bool)
    is_byte[offsets[1:] - 1] = False
    symbols[is_byte] = flat
    place = np.arange(len(symbols)) - np.repeat(offsets[:-1], sizes + 1)
    context = np.zeros(len(symbols), np.int64)
    for back in range(1, SPELL_DEPTH + 1):
        before = np.zeros(len(symbols), np.int64)
        before[back:] = symbols[:-back] + 1
        before = np.where(place >= back, before, np.where(place == back - 1, START + 1, 0))
        context |= before << (_BITS * (back - 1))
    return context, symbols, offsets


def blocks_of_words(counted: DataFrame) -> DataFrame:
    """counted: word, w, c. Rows of transitions (block, context, symbol, id, n: distinct words learned from that make it, asked:
    words to be spelled do), and for words that were not learned from (c = 0) rows (block, w, ids: the numbers of its
    transitions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        names = ["block", "w", "ids", "context", "symbol", "id", "n", "asked"]
        for batch in gathered(batches, "word", WORD_BLOCK_BYTES):
            for a in range(0, batch.num_rows, WORD_BLOCK):
                part = batch.slice(a, WORD_BLOCK)
                new = part.column("c").to_numpy(zero_copy_only=False) == 0
                context, symbol, offsets = _spelled(part.column("word"))
                _, _, code = _distinct(context)
                key = code.astype(np.int64)
                key <<= _BITS
                key |= symbol
                _, first, code = _distinct(key, len(key).bit_length() + _BITS)
                context, symbol = context[first], symbol[first].astype(np.int32)
                del key
                of_new = np.repeat(new, np.diff(offsets))
                m = len(first)
                kinds, asked = np.bincount(code[~of_new], minlength=m).astype(np.int64), np.bincount(code[of_new], minlength=m) > 0
                code = code.astype("<i4")
                at = np.flatnonzero(new)
                ids = pa.array([code[offsets[k] : offsets[k + 1]].tobytes() for k in at], pa.binary())
                n = len(at)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, serial)), part.column("w").take(pa.array(at)), ids, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, serial)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(context), pa.array(symbol), pa.array(np.arange(m, dtype=np.int32)), pa.array(kinds), pa.array(asked)], names=names)
                serial += 1

    return counted.mapInArrow(run, "block long, w long, ids binary, context long, symbol int, id int, n long, asked boolean")


def spelling_tree(transitions: DataFrame) -> DataFrame:
    """transitions: context (SPELL_DEPTH symbols), symbol, n. context, symbol, p, state (the context whose distribution gives
    p: the longest suffix that passed the divergence test).

    From the root down, a context's counts are compared with what its parent would give; it is a state if they diverge by
    SPELL_DIVERGENCE nats or more, and then its distribution is its counts smoothed by its parent's."""
    levels, longer = {}, transitions
    for d in range(SPELL_DEPTH, -1, -1):  # shorter contexts are added up from the next longer ones
        own = longer.select(F.col("context").bitwiseAND((1 << (_BITS * d)) - 1).alias("context"), "symbol", "n")
        levels[d] = longer = materialise(own.groupBy("context", "symbol").agg(F.sum("n").alias("n")), "pst-transitions", tidy=True)

    total = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    known = levels[0].select("context", "symbol", ((F.col("n") + ROOT_SMOOTHING) / (total + ROOT_SMOOTHING * ALPHABET)).alias("p"), F.lit(0).cast("long").alias("state"))
    for d in range(1, SPELL_DEPTH + 1):
        parent = F.col("context").bitwiseAND((1 << (_BITS * (d - 1))) - 1)
        above = known.select(F.col("context").alias("_parent"), F.col("symbol").alias("_symbol"), F.col("p").alias("_p"), F.col("state").alias("_state"))
        own = levels[d].withColumn("_of", parent).join(above, (F.col("_of") == F.col("_parent")) & (F.col("symbol") == F.col("_symbol")))
        one = W.partitionBy("context")  # a row for each symbol of the alphabet at most
        gain = F.sum(F.when(F.col("n") > 0, F.col("n") * (F.log("n") - F.log("_p"))).otherwise(0.0)).over(one)
        own = own.withColumn("_total", F.sum("n").over(one)).withColumn("_gain", gain)
        # the sum of n ln(n / total / p) over a context's symbols
        diverges = F.when(F.col("_total") > 0, F.col("_gain") - F.col("_total") * F.log("_total")).otherwise(0.0) >= SPELL_DIVERGENCE
        is_state = diverges & (F.col("context") != F.col("_of"))  # a context that begins its word has no longer form
        p = F.when(is_state, (F.col("n") + SMOOTHING * F.col("_p")) / (F.col("_total") + SMOOTHING)).otherwise(F.col("_p"))
        fresh = materialise(own.select("context", "symbol", p.alias("p"), F.when(is_state, F.col("context")).otherwise(F.col("_state")).alias("state")), "pst-states", tidy=True)
        discard(known)
        discard(levels[d])
        known = fresh
    discard(levels[0])
    return known


def spell(counted: DataFrame) -> DataFrame:
    """counted: word, w, c. w, lp (log10 of the probability of its spelling) of the words with c = 0."""
    blocks = materialise(blocks_of_words(counted), "pst-words", tidy=True)
    transitions = blocks.where("w IS NULL")
    states = spelling_tree(transitions.select("context", "symbol", "n"))
    back = transitions.where("asked").select("block", "context", "symbol", "id").join(states, ["context", "symbol"]).select(F.col("block").alias("_block"), "id", F.log10("p").alias("lp"))

    def give(spelt: pa.Table, known: pa.Table) -> pa.Table:
        ids = spelt.column("ids").to_pylist()
        flat, owner = np.frombuffer(b"".join(ids), "<i4"), np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
        lp = np.zeros(int(flat.max(initial=-1)) + 1)
        at = known.column("id").to_numpy()
        lp[at] = known.column("lp").to_numpy()
        return pa.table({"w": spelt.column("w"), "lp": np.bincount(owner, lp[flat], spelt.num_rows)})

    out = materialise(blocks.where("w IS NOT NULL").select("block", "w", "ids").groupBy("block").cogroup(back.groupBy("_block")).applyInArrow(give, "w long, lp double"), "pst-spelled", tidy=True)
    discard(blocks)
    discard(states)
    return out


# --- the tree of tokens -----------------------------------------------------------------------------------------------


class Model:
    """What holds for all blocks: the counts' sums, and ranges of contexts at a level."""

    def __init__(self, n_all: int, v: int, once: int, ends: int, positions: int, depth: int, divergence: float, transitions: int):
        self.n_all, self.v, self.ends = n_all, v, ends
        self.unknown = (once + 0.5) / (n_all + 1)
        self.ranges, self.transitions = max(1, -(-positions // transitions)), transitions
        self.depth, self.divergence = depth, divergence

    def pieces(self, total: np.ndarray) -> np.ndarray:
        """Into how many pieces a context is split by its next symbol."""
        return np.where(total * 4 >= self.transitions, np.minimum(-(-total * 4 // self.transitions), self.ranges), 1) if self.ranges > 1 else np.ones(len(total), np.int64)

    def range_of(self, context: np.ndarray, symbol: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        piece = (symbol >> np.uint64(32)) % pieces.astype(np.uint64)
        return (_mix(context + piece * _M) % np.uint64(self.ranges)).astype(np.int64)


class Level:
    """The distinct transitions of a block at one length of contexts, sorted by context and symbol. symbol: its number in the block; first: a place of each."""

    def __init__(self, block: Block, context: np.ndarray, hashes: np.ndarray, total: np.ndarray, at: np.ndarray, model: Model):
        """context: numbers of contexts (of the places at) into hashes and total."""
        shift = len(block.hash).bit_length()
        unique, self.first, of_place = _distinct(context.astype(np.int64) << shift | block.symbol[at], len(hashes).bit_length() + shift)
        self.of_place = of_place
        self.at = at
        owner, self.symbol = unique >> shift, unique & ((1 << shift) - 1)
        self.head = np.ones(len(unique), bool)  # the first transition of each context
        self.head[1:] = owner[1:] != owner[:-1]
        self.owner = np.cumsum(self.head) - 1
        ids = owner[self.head]
        self.hash, self.total = hashes[ids], total[ids]
        self.pieces = model.pieces(self.total)
        self.block = block
        part = model.range_of(self.hash, np.zeros(1, np.uint64), np.ones(1, np.int64))[self.owner]
        split = np.flatnonzero(self.pieces[self.owner] > 1)
        part[split] = model.range_of(self.hash[self.owner[split]], block.hash[self.symbol[split]], self.pieces[self.owner[split]])
        if model.ranges <= 1 << 16:
            part = part.astype(np.uint16)  # sorted by digits
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.diff(part, prepend=part[:1]) != 0)
        starts = np.concatenate([np.zeros(min(1, len(part)), np.int64), starts])
        self.parts = part[starts].astype(np.int64)
        self.slices = [order[a:b] for a, b in zip(starts.tolist(), np.append(starts, len(part))[1:].tolist(), strict=True)]

    def questions(self, block_id: int) -> dict[str, list]:
        out: dict[str, list] = {x: [] for x in ("block", "part", "ctx", "many", "total", "sym", "n", "lnq")}
        number, taught = self.block.number[self.symbol], self.of_place[self.block.learn[self.at]]
        n, lnq = np.bincount(taught, minlength=len(self.owner)).astype("<u4"), np.log(self.block.q[self.at[self.first]]).astype("<f2")
        for part, own in zip(self.parts.tolist(), self.slices, strict=True):
            owner = self.owner[own]
            head = np.ones(len(own), bool)
            head[1:] = owner[1:] != owner[:-1]
            c = owner[head]
            many = np.diff(np.append(np.flatnonzero(head), len(own)))
            row = (block_id, part, self.hash[c].tobytes(), _squeeze(many.astype("<u4")), _squeeze(self.total[c].astype("<i8")), _squeeze(number[own]), _squeeze(n[own]), _squeeze(lnq[own]))
            for x, y in zip(out, row, strict=True):
                out[x].append(y)
        return out

    def answers(self, given: list[dict], divergence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each transition its count, and of its context the successors and whether it is a state."""
        n = np.zeros(len(self.owner))
        kinds, state = np.zeros(len(self.hash)), np.zeros(len(self.hash), bool)
        place = {p: k for k, p in enumerate(self.parts.tolist())}
        split = np.flatnonzero(self.pieces > 1)
        hot = dict(zip(self.hash[split].view(np.int64).tolist(), split.tolist(), strict=True))
        for r in given:
            if r["part"] is not None:
                own = self.slices[place[r["part"]]]
                n[own] = _unsqueeze(r["n"], "<u4")
                owner = self.owner[own]
                head = np.ones(len(own), bool)
                head[1:] = owner[1:] != owner[:-1]
                c = owner[head]
                whole = self.pieces[c] == 1
                c = c[whole]
                kinds[c] = _unsqueeze(r["kinds"], "<u4")[whole]
                state[c] = _unsqueeze(r["state"], "?")[whole]
            else:
                kinds[hot[r["hot"]]], state[hot[r["hot"]]] = r["kinds_sum"], r["gain_sum"] >= divergence
        return n, kinds[self.owner], state[self.owner]


class Block:
    """Places: for each document its start, its words and its end. symbol and word: numbers into hash; the last three are the
    start, the end, and words met once or never, which are one symbol."""

    def __init__(self, docs: pa.Table, vocabulary: list[dict], model: Model):
        h, c = _joined(vocabulary, "h", "<u8"), _joined(vocabulary, "c", "<i8")
        m, n = len(h), docs.num_rows
        seqs = [_unsqueeze(x, "<i4") for x in docs.column("seq").to_pylist()]
        counts = np.array([len(x) for x in seqs], np.int64)
        starts = np.cumsum(counts + 2) - (counts + 2)
        total = int((counts + 2).sum())
        self.doc = np.repeat(np.arange(n, dtype=np.int32), counts + 2)
        word = np.empty(total, np.int32)
        is_word = np.ones(total, bool)
        is_word[starts] = is_word[starts + counts + 1] = False
        word[is_word] = np.concatenate([np.zeros(0, np.int32), *seqs])
        word[starts], word[starts + counts + 1] = m, m + 1
        number = np.concatenate([h + np.uint64(4), np.arange(1, 4, dtype=np.uint64)])
        self.number, self.hash = number.astype("<u4"), _mix(number * _M)
        count = np.concatenate([c, [model.ends, model.ends, 0]])
        self.word, self.is_start, self.counts, self.n_docs = word, np.zeros(total, bool), counts, n
        self.is_start[starts] = True
        self.count = count[word]
        rare = self.count < 2
        self.symbol = np.where(rare, np.int32(m + 2), word)
        self.learn = docs.column("learn").to_numpy(zero_copy_only=False)[self.doc] & ~self.is_start
        # probabilities of the token itself, and of its symbol
        self.p = np.where(self.count > 0, (1 - model.unknown) * self.count / max(model.n_all, 1), model.unknown)
        self.q = np.where(rare, model.unknown, self.p)
        self._at = np.flatnonzero(~self.is_start)
        self._ids, self._hash, self._total = word[self._at - 1], self.hash, count
        self._alive = count[word[self._at - 1]] >= 2
        self.model = model

    def next_level(self) -> Level:
        """Contexts one token longer, of the places where the shorter one's count is two or more."""
        at = self._at[self._alive]
        return Level(self, self._ids[self._alive], self._hash, self._total, at, self.model)

    def learn_level(self, level: Level, given: list[dict], last: bool = False) -> None:
        """Takes up the answers; after the last level no other can be asked for."""
        n, kinds, state = level.answers(given, self.model.divergence)
        below = level.total[level.owner] + kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            share, rest = np.where(state, n / below, 0.0), np.where(state, kinds / below, 1.0)
        e, at = level.of_place, level.at
        own, rest = share[e], rest[e]
        self.p[at] = np.where(self.count[at] == 1, 0.0, own) + rest * self.p[at]
        self.q[at] = own + rest * self.q[at]
        if last:
            return
        # a transition is the context of the place after it; one that ends in a rare word is none
        entry = np.full(len(self.word), -1, np.int32)
        entry[at] = e
        places = np.flatnonzero(~self.is_start)
        before = entry[places - 1]
        alive = (before >= 0) & (self.count[places - 1] >= 2)
        self._at, self._ids, self._total = places, before, n.astype(np.int64)
        self._hash = _mix(level.hash[level.owner] * _M + self.hash[level.symbol])
        self._alive = alive
        self._alive[alive] = n[before[alive]] >= 2


_QUESTION = "block long, part long, ctx binary, many binary, total binary, sym binary, n binary, lnq binary"
_ANSWER = "block long, part long, level int, n binary, kinds binary, state binary, hot long, kinds_sum double, gain_sum double, ids binary, h binary, c binary, lp binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def _table(schema: str, size: int, **given) -> pa.Table:
    """Columns that are given, the others null."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({f: given[f] if isinstance(given.get(f), pa.Array) else pa.array(given[f], _TYPES[t]) if f in given else pa.nulls(size, _TYPES[t]) for f, t in fields})


def _joined(vocabulary: list[dict], column: str, kind: str) -> np.ndarray:
    """A column of a block's words, by their numbers in the block."""
    out = np.zeros(sum(len(r["at"]) for r in vocabulary), kind)
    for r in vocabulary:
        out[r["at"]] = _unsqueeze(r[column], kind)
    return out


def _block_of(rows: pa.Table, given: pa.Table, model: Model) -> tuple[Block, dict]:
    """The block, its words' rows, and the answers by level."""
    by_level: dict[int | None, list[dict]] = {}
    for r in given.to_pylist():
        by_level.setdefault(r["level"], []).append(r)
    vocabulary = by_level.pop(None, [])
    for r in vocabulary:
        r["at"] = np.cumsum(_unsqueeze(r["ids"], "<u4"), dtype=np.int64)
    return Block(rows, vocabulary, model), {"words": vocabulary, "by_level": by_level}


def _ask(texts: DataFrame, answers: DataFrame, model: Model, depth: int) -> DataFrame:
    def run(rows: pa.Table, given: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(_QUESTION, 0)
        block, known = _block_of(rows, given, model)
        for d in range(1, depth):
            block.learn_level(block.next_level(), known["by_level"].get(d, []))
        out = block.next_level().questions(rows.column("block")[0].as_py())
        del block, known
        release_memory()
        return _table(_QUESTION, len(out["block"]), **out)

    return texts.select("block", "learn", "seq").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _QUESTION)


def _add_up(questions: DataFrame, model: Model, depth: int) -> DataFrame:
    """For each range the counts of its transitions, and of each context its successors and its gain: the nats by which it
    gives its occurrences more than its parent does, each left out in turn."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        ctx = [np.frombuffer(x, "<u8") for x in rows.column("ctx").to_pylist()]
        many = [_unsqueeze(x, "<u4").astype(np.int64) for x in rows.column("many").to_pylist()]
        total = np.concatenate([_unsqueeze(x, "<i8") for x in rows.column("total").to_pylist()])
        sym = np.concatenate([_unsqueeze(x, "<u4") for x in rows.column("sym").to_pylist()]).astype(np.int64)
        n = np.concatenate([_unsqueeze(x, "<u4") for x in rows.column("n").to_pylist()]).astype(np.float64)
        lnq = np.concatenate([_unsqueeze(x, "<f2") for x in rows.column("lnq").to_pylist()]).astype(np.float64)
        distinct, first, code = _distinct(np.concatenate(ctx))
        total = total[first].astype(np.float64)
        key = (np.repeat(code.astype(np.int64), np.concatenate(many)) << 32) | sym
        unique, at, entry = _distinct(key)
        added = np.bincount(entry, n, len(unique))
        owner = unique >> 32
        kinds = np.bincount(owner, added > 0, len(distinct))
        pieces = model.pieces(total.astype(np.int64)).astype(np.float64)
        # of a split context this piece has about its share of the successors
        successors = (kinds * pieces)[owner] - (added == 1)
        t = total[owner]
        q = np.exp(lnq[at])
        with np.errstate(divide="ignore", invalid="ignore"):
            left = (added - 1 + successors * q) / (t - 1 + successors)
            term = np.where(added > 0, added * (np.log(np.maximum(left, 1e-300)) - lnq[at]), 0.0)
        gain = np.bincount(owner, term, len(distinct))
        c_at, e_at = np.cumsum([0, *map(len, ctx)]), np.cumsum([0, *(int(x.sum()) for x in many)])
        codes = [code[a:b] for a, b in zip(c_at[:-1], c_at[1:], strict=True)]
        counts = [added[entry[a:b]].astype("<u4") for a, b in zip(e_at[:-1], e_at[1:], strict=True)]
        blocks, state = rows.column("block").to_pylist(), gain >= model.divergence
        out = [_table(_ANSWER, len(ctx), block=blocks, part=[part] * len(ctx), level=[depth] * len(ctx), n=list(map(_squeeze, counts)), kinds=[_squeeze(kinds[x].astype("<u4")) for x in codes], state=[_squeeze(state[x]) for x in codes])]
        # split contexts: this piece's sums, and which blocks ask for them
        split = np.flatnonzero(pieces > 1)
        if len(split):
            out.append(_table(_ANSWER, len(split), hot=distinct[split].view(np.int64), kinds_sum=kinds[split], gain_sum=gain[split]))
            for block, own in zip(blocks, codes, strict=True):
                own = distinct[own[pieces[own] > 1]].view(np.int64)
                out.append(_table(_ANSWER, len(own), block=[block] * len(own), hot=own))
        return pa.concat_tables(out)

    return questions.groupBy("part").applyInArrow(run, _ANSWER)


def _vocabularies(known: DataFrame, spelled: DataFrame, ranges: int) -> DataFrame:
    """known: block, part, ids, h (the words' numbers in the corpus), n (their counts); spelled: w, lp. The rows of known with the
    spelling of each word that has one, in the schema of answers."""

    def run(rows: pa.Table, spelt: pa.Table) -> pa.Table:
        at = spelt.column("w").to_numpy() // ranges
        h = [_unsqueeze(x, "<i8") // ranges for x in rows.column("h").to_pylist()]
        lp = np.zeros(1 + max([at.max(initial=0), *(x.max(initial=0) for x in h)]))
        lp[at] = spelt.column("lp").to_numpy()
        column = lambda x: rows.column(x).combine_chunks()
        return _table(_ANSWER, rows.num_rows, block=column("block"), part=column("part"), ids=column("ids"), h=column("h"), c=column("n"), lp=[_squeeze(lp[x]) for x in h])

    return known.groupBy("part").cogroup(spelled.select((F.col("w") % ranges).alias("_part"), "w", "lp").groupBy("_part")).applyInArrow(run, _ANSWER)


def score(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = (),
    depth: int = DEPTH, divergence: float = DIVERGENCE, transitions: int = RANGE, word_range: int = WORD_RANGE,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (log10 of the unigram model), score (log10 of the tree's), class_score
    and root_score (the tree's, and its root's, with words that the learning documents lack as one symbol, not spelled),
    and the columns of keep. learn: the rows to learn from; a null counts as false.

    Tokens are words in lower case (A-Z) and one end. A null text is the empty one, whose only token is its end; repeated
    rows count and score each for itself; a null id stays null; an empty table gives no rows; other columns are ignored."""
    total = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string"))).alias("n")).first()["n"] or 0
    ranges = max(1, -(-total // word_range))
    parts = blocks_of_documents(docs, id_col, text_col, F.coalesce(learn, F.lit(False)), keep, ranges)
    texts, vocabulary = materialise_halves(parts, F.col("part").isNull(), "pst-documents")
    counted, known = materialise_halves(count_words(vocabulary, ranges), F.col("part").isNull(), "pst-counts", tidy=True)
    discard(vocabulary)
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    size = texts.agg(F.count(F.when(F.col("learn"), 1)).alias("ends"), F.coalesce(F.sum(F.col("n_words") + 1), F.lit(0)).alias("n")).first()
    ends = size["ends"]
    model = Model(sums["n"] + ends, sums["v"] + (ends > 0), sums["once"], ends, size["n"], depth, divergence, transitions)
    spelled = spell(counted.select("word", "w", "c"))
    answers = materialise(_vocabularies(known.select("block", "part", "ids", "h", "n"), spelled, ranges), "pst-vocabularies", tidy=True)
    for used in (counted, spelled, known):
        discard(used)
    for d in range(1, depth + 1):
        got = materialise(_add_up(_ask(texts, answers, model, d), model, d), "pst-answers", tidy=True)
        # split contexts: the sums of their pieces go to the blocks that asked
        whole = got.where("block IS NULL").groupBy("hot").agg(F.sum("kinds_sum").alias("kinds_sum"), F.sum("gain_sum").alias("gain_sum"))
        told = got.where("block IS NOT NULL AND part IS NULL").select("block", "hot").distinct().join(whole, "hot")
        told = told.withColumns({"part": F.lit(None).cast("long"), "level": F.lit(d)} | {x: F.lit(None).cast("binary") for x in ("n", "kinds", "state", "ids", "h", "c", "lp")})
        answers = answers.unionByName(got.where("part IS NOT NULL")).unionByName(told.select(*answers.columns))
    below = model.n_all + 0.5 * (model.v + 1)

    def give(rows: pa.Table, given: pa.Table) -> pa.Table:
        block, held = _block_of(rows, given, model)
        root = block.p.copy()
        for d in range(1, depth + 1):
            block.learn_level(block.next_level(), held["by_level"].get(d, []), last=d == depth)
        lp = np.append(_joined(held["words"], "lp", "<f8"), [0.0, 0.0])
        at = ~block.is_start
        doc, n = block.doc[at], block.n_docs
        total = lambda x: np.bincount(doc, x, n)
        count = block.count[at]
        spelling = total(np.where(count > 0, 0.0, lp[block.word[at]]))
        in_class = total(np.log10(block.p[at]))
        columns = {
            "doc_id": rows.column("doc_id"), "n_tokens": block.counts + 1, "n_known": total(count > 0).astype(np.int64), "train_tokens": np.full(n, model.n_all), "base_score": total(np.log10((count + 0.5) / below)),
            "score": in_class + spelling, "class_score": in_class, "root_score": total(np.log10(root[at])), "_keep": rows.column("_keep"),
        }
        out = pa.table(columns)
        del block, held
        release_memory()
        return out

    kept = texts.schema["_keep"].dataType
    own = texts.select("block", "doc_id", "learn", "seq", "_keep")
    out = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(give, f"doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, class_score double, root_score double, _keep {kept.simpleString()}")
    return out.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "class_score", "root_score", *[f"_keep.`{f}`" for f in kept.names[1:]])
