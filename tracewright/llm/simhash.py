"""SimHash near-duplicates: bit-sliced comparison of 64-bit fingerprints within buckets that cover every close pair."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.components import components
from tracewright.llm.shared import materialise
from tracewright.llm.textops import slices

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints are cut into PARTS runs of bits; a pair within RADIUS agrees in PARTS - RADIUS of them.
PARTS = 6
#: Buckets up to this size are compared whole by the task that meets them; larger ones are cut into tiles.
BUCKET = 2048
#: Buckets up to this size are compared together, pair by pair.
SMALL = 48
BLOCK_PAIRS = 1 << 14


# --- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprints of UTF-8 texts: a bit is 1 if it is set in over half the shingles' XXH64 values."""
    import xxhash

    hash64 = xxhash.xxh64_intdigest
    values: list[int] = []
    sizes = []
    for text in texts:
        w = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
        if len(w) >= shingle:
            grams = map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False))
        else:
            grams = [b" ".join(w)] if w else []
        before = len(values)
        values += [hash64(g, seed) for g in grams]
        sizes.append(len(values) - before)
    n = np.array(sizes, np.int64)
    out = np.zeros(len(n), np.uint64)
    if values:
        bits = np.unpackbits(np.array(values, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(n)
        ends = np.cumsum(n)
        counts = np.add.reduceat(bits, (ends - n)[full], axis=0, dtype=np.int32)
        majority = (2 * counts > n[full, None]).astype(np.uint8)
        out[full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long) of whole texts, and the columns of keep."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"), *keep)
    extra = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            f = fingerprints(part.column("text").to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(f.view(np.int64)), *part.columns[2:]], names=["doc_id", "bits", *part.schema.names[2:]])

    return rows.mapInArrow(run, ", ".join(["doc_id long, bits long", *extra]))


# --- bit-sliced comparison ------------------------------------------------------------------------------------------


def planes(values: np.ndarray) -> np.ndarray:
    """uint64[64, words]: plane b holds bit b of all values, 64 of them a word; the last word is filled up with zeros."""
    n = len(values)
    bits = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)


class Counter:
    """Bit-sliced saturating counters of differing bits: carry-save adders over planes, with a mask of those past the radius."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.sums = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(shape, np.uint64)

    def add(self, plane: np.ndarray) -> None:
        carry = plane
        for k, s in enumerate(self.sums):
            carry, self.sums[k] = s & carry, s ^ carry
        self.over |= carry

    def within(self) -> np.ndarray:
        """Bits of counters at the radius or below."""
        more, equal = self.over.copy(), ~self.over
        for k in reversed(range(len(self.sums))):
            if self.radius >> k & 1:
                equal &= self.sums[k]
            else:
                more |= equal & self.sums[k]
                equal &= ~self.sums[k]
        # what fell below the radius at some bit is neither more nor equal
        return ~more

    def keep(self, rows: np.ndarray) -> None:
        self.sums = [s[rows] for s in self.sums]
        self.over = self.over[rows]


def near_matrix(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """uint64[n, words]: bit j of row i is set if values i and j differ in at most radius bits. Planes in which all
    values agree are skipped; a row is abandoned once all its counters are past the radius."""
    n = len(values)
    p = planes(values)
    tail = np.zeros(p.shape[1], np.uint64)
    if n % 64:
        tail[-1] = ~np.uint64((1 << (n % 64)) - 1)
    out = np.zeros((n, p.shape[1]), np.uint64)
    varying = np.bitwise_or.reduce(values ^ values[0])
    order = [b for b in range(64) if int(varying) >> b & 1]
    for a in range(0, n, 256):
        rows = np.arange(a, min(n, a + 256))
        count = Counter((len(rows), p.shape[1]), radius)
        count.over |= tail
        for k, b in enumerate(order):
            own = (values[rows] >> np.uint64(b) & np.uint64(1)).astype(bool)
            count.add(np.where(own[:, None], ~p[b], p[b]))
            if k % 8 == 7:
                alive = ~(count.over == ~np.uint64(0)).all(axis=1)
                if not alive.all():
                    rows = rows[alive]
                    count.keep(alive)
                    if not len(rows):
                        break
        if len(rows):
            out[rows] = count.within()
    return out


def near_pairs(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For which of the given pairs x[i], y[i] differ in at most radius bits; blocks all past the radius are abandoned."""
    out = np.zeros(len(x), bool)
    for a in range(0, len(x), BLOCK_PAIRS):
        d = x[a : a + BLOCK_PAIRS] ^ y[a : a + BLOCK_PAIRS]
        p = planes(d)
        count = Counter(p.shape[1:], radius)
        for b in range(64):
            count.add(p[b])
            if b % 8 == 7 and (count.over == ~np.uint64(0)).all():
                break
        out[a : a + len(d)] = np.unpackbits(count.within().view(np.uint8), bitorder="little")[: len(d)].astype(bool)
    return out


def forest(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same values as all links within radius do, one fewer than the values of each component."""
    near = near_matrix(values, radius)
    n = len(values)
    fresh = np.zeros(near.shape[1] * 64, bool)
    fresh[:n] = True
    fresh = np.packbits(fresh, bitorder="little").view(np.uint64)
    seen = np.zeros(n, bool)
    a, b = [], []
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        fresh[start >> 6] &= ~np.uint64(1 << (start & 63))
        queue = [start]
        while queue:
            u = queue.pop()
            new = near[u] & fresh
            if new.any():
                at = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
                fresh &= ~new
                seen[at] = True
                queue += at.tolist()
                a.append(np.full(len(at), u))
                b.append(at)
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return values[np.concatenate(a)], values[np.concatenate(b)]


# --- buckets --------------------------------------------------------------------------------------------------------


def masks(parts: int = PARTS, radius: int = RADIUS) -> list[int]:
    """Bit masks such that two fingerprints within radius agree under one at least: any parts - radius of the runs."""
    cuts = [round(64 * k / parts) for k in range(parts + 1)]
    runs = [sum(1 << b for b in range(a, z)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(c) for c in combinations(runs, parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(keys: list[np.ndarray], bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links inside the runs of equal keys of sorted rows."""
    change = np.zeros(len(bits), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, len(bits)))
    left, right = [], []
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    if len(small):
        end = np.zeros(len(bits), np.int64)
        spans = np.repeat(starts[small] + sizes[small], sizes[small])
        rows = np.concatenate([np.arange(s, s + z) for s, z in zip(starts[small].tolist(), sizes[small].tolist(), strict=True)])
        end[rows] = spans
        for offset in range(1, int(sizes[small].max())):
            rows = rows[rows + offset < end[rows]]
            x, y = bits[rows], bits[rows + offset]
            near = near_pairs(x, y, radius)
            left.append(x[near])
            right.append(y[near])
    for k in np.flatnonzero(sizes > SMALL).tolist():
        a, b = forest(bits[starts[k] : starts[k] + sizes[k]], radius)
        left.append(a)
        right.append(b)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _bucket_links(rows: DataFrame, keys: list[str], radius: int, most: int | None) -> DataFrame:
    """rows: keys, bits; equal keys in one partition and sorted. Links a, b (with keys null), and, for buckets above
    most, their rows unchanged (with b null)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "a long, b long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "a", "b"]
        types = [pa.int32() if kinds[k] == "int" else pa.int64() for k in keys]
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        passing: tuple | None = None  # key of a bucket that is passed on

        def links(k: list[np.ndarray], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(bits) > 1:
                a, b = _compare(k, bits, radius)
                if len(a):
                    nulls = [pa.nulls(len(a), t) for t in types]
                    yield pa.RecordBatch.from_arrays([*nulls, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

        def passed(k: list[np.ndarray], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(bits):
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(k, types, strict=True)), pa.array(bits.view(np.int64)), pa.nulls(len(bits), pa.int64())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            k = [batch.column(x).to_numpy(zero_copy_only=False) for x in keys]
            bits = batch.column("bits").to_numpy().view(np.uint64)
            if passing is not None:
                same = np.logical_and.reduce([x == v for x, v in zip(k, passing, strict=True)])
                n = len(same) if same.all() else int(same.argmin())
                yield from passed([x[:n] for x in k], bits[:n])
                k, bits = [x[n:] for x in k], bits[n:]
                if not len(bits):
                    continue
                passing = None
            held.append((k, bits))
            k = [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)]
            bits = np.concatenate([h[1] for h in held])
            last = np.logical_and.reduce([x == x[-1] for x in k])
            cut = len(bits) - int(last[::-1].argmin()) if not last.all() else 0  # the last bucket may go on
            done, open_ = ([x[:cut] for x in k], bits[:cut]), ([x[cut:] for x in k], bits[cut:])
            held = [open_]
            if cut:
                yield from _split(done, most, links, passed)
            if most is not None and len(open_[1]) > most:
                passing = tuple(x[0] for x in open_[0])
                yield from passed(*open_)
                held = []
        if held:
            k = [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)]
            yield from _split((k, np.concatenate([h[1] for h in held])), most, links, passed)

    return rows.mapInArrow(run, schema)


def _split(rows, most, links, passed):
    """Small buckets to links, large ones to passed."""
    k, bits = rows
    if not len(bits):
        return
    if most is not None:
        change = np.ones(len(bits), bool)
        change[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in k])
        sizes = np.diff(np.append(np.flatnonzero(change), len(bits)))
        large = np.repeat(sizes > most, sizes)
        if large.any():
            yield from passed([x[large] for x in k], bits[large])
            k, bits = [x[~large] for x in k], bits[~large]
    yield from links(k, bits)


def close_links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, most: int = BUCKET) -> DataFrame:
    """distinct: bits. Links a, b that connect the same fingerprints as all pairs within radius do; none is farther.

    A pair within radius lies in a common bucket for one of the masks. Buckets above `most` are cut into chunks, and each
    pair of chunks is compared by a task of its own, so no bucket is ever held whole."""
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("bits").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(parts, radius))]))
    keyed = distinct.select("bits", cells.alias("_c")).select(F.col("_c.t").alias("t"), F.col("_c.key").alias("key"), "bits")
    first = materialise(_bucket_links(keyed.repartition("t", "key").sortWithinPartitions("t", "key"), ["t", "key"], radius, most), "simhash-links")
    found = first.where("b IS NOT NULL").select("a", "b")
    large = first.where("b IS NULL").select("t", "key", F.col("a").alias("bits"))
    sizes = large.groupBy("t", "key").agg(F.ceil(F.count("*") / (most // 2)).cast("int").alias("chunks"))
    chunked = large.join(sizes, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiles = chunked.withColumn("other", other).where("own <> other OR chunks = 1")
    tiles = tiles.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "bits")
    keys = ["t", "key", "i", "j"]
    rest = _bucket_links(tiles.repartition(*keys).sortWithinPartitions(*keys), keys, radius, None)
    return found.unionByName(rest.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, bits, component_id, root, and the columns of keep: documents whose fingerprints differ in at most radius bits
    are linked; component_id is the smallest doc_id that links lead to, root the smallest fingerprint.

    Equal fingerprints are first counted as one. Null and empty texts have fingerprint zero and are linked like any other;
    texts of fewer words than a shingle are one shingle; documents with a null id belong to a component but name none, so
    a component of null ids alone has a null id; repeated rows give repeated rows; an empty table gives no rows; other
    columns are ignored."""
    marked = materialise(fingerprint_documents(docs, id_col, text_col, shingle, keep=keep), "simhash-bits")
    distinct = materialise(marked.groupBy("bits").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = components(close_links(distinct.select("bits"), radius))
    named = distinct.join(roots, distinct["bits"] == roots["node"], "left").select("bits", "least_id", F.coalesce("root", "bits").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_bits = named.join(lowest, "root").select("bits", "component_id", "root")
    return marked.join(by_bits, "bits").select("doc_id", "bits", "component_id", "root", *marked.columns[2:])


def hex_of(bits):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
