"""Embedding near-duplicates: randomised-rotation binary codes, stored with their correction factors, give unbiased
estimates of inner products with confidence bounds; these decide which pairs of a bucket are recomputed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.components import components
from tracewright.llm.shared import discard, materialise

COSINE = 0.93
#: Estimates are trusted within so many standard deviations; about one pair in 10^6 lies outside.
CONFIDENCE = 5.0
#: Bits to which a rotated vector is rounded where it meets another's code.
LEVEL_BITS = 4
#: Vectors that a bucket should have on average, and has at most before it is cut into tiles.
BUCKET, LARGEST = 512, 2048
#: Of the pairs at the threshold, the share that the tables of buckets may miss.
MISS = 0.001
SEED = 20


@cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables(size: int, cosine: float = COSINE, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket's key, and tables, for a label of `size` vectors. A random hyperplane parts two vectors at the
    threshold with probability angle / pi; with no bits one table holds the label whole and misses nothing."""
    bits = min(30, max(0, math.ceil(math.log2(max(1, size) / bucket))))
    return bits, table_count(bits, cosine, miss)


def table_count(bits: int, cosine: float = COSINE, miss: float = MISS) -> int:
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if not bits else math.ceil(math.log(miss) / math.log(1 - together))


@cache
def _planes(dim: int, many: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, 1, dim]).standard_normal((many, dim)).T


def bucket_keys(x: np.ndarray, bits: int, n_tables: int) -> np.ndarray:
    """int64[rows, tables]: the signs of random projections, `bits` of them to a table."""
    if not bits:
        return np.zeros((len(x), 1), np.int64)
    signs = (x @ _planes(x.shape[1], n_tables * bits) > 0).reshape(len(x), n_tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


@dataclass
class Codes:
    """What is stored of vectors besides themselves.

    signs: uint64[rows, words], the signs of the rotated unit vector; factor: the inner product of the code, +-1 /
    sqrt(dim), with its vector; levels: uint64[rows, LEVEL_BITS, words], bit planes of the rotated vector's components in
    steps above the lowest; low and step: those."""

    dim: int
    signs: np.ndarray
    factor: np.ndarray
    levels: np.ndarray
    low: np.ndarray
    step: np.ndarray

    def __len__(self) -> int:
        return len(self.signs)

    def __getitem__(self, at) -> Codes:
        return Codes(self.dim, self.signs[at], self.factor[at], self.levels[at], self.low[at], self.step[at])


def _packed(bits: np.ndarray) -> np.ndarray:
    """Booleans of the last axis as words of 64 bits, padded with zeros."""
    data = np.packbits(bits, axis=-1, bitorder="little")
    pad = -data.shape[-1] % 8
    return np.ascontiguousarray(np.pad(data, [(0, 0)] * (data.ndim - 1) + [(0, pad)])).view("<u8")


def encode(unit: np.ndarray) -> Codes:
    """Codes of unit vectors. Components are rounded with one dither for each dimension, which keeps estimates unbiased."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim).T
    signs = turned >= 0
    factor = np.maximum(np.abs(turned).sum(axis=1) / math.sqrt(dim), 1e-6)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << LEVEL_BITS) - 1), 1e-9)
    dither = np.random.default_rng([SEED, 2, dim]).random(dim)
    steps = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, (1 << LEVEL_BITS) - 1).astype(np.uint8)
    planes = (steps[:, None, :] >> np.arange(LEVEL_BITS, dtype=np.uint8)[None, :, None]) & 1
    return Codes(dim, _packed(signs), factor.astype(np.float32), _packed(planes), low.astype(np.float32), step.astype(np.float32))


def estimates(a: Codes, b: Codes) -> tuple[np.ndarray, np.ndarray]:
    """float32[len(a), len(b)]: unbiased estimates of the inner products, from a's codes and b's levels by AND and popcount,
    and standard deviations of their errors."""
    met = np.zeros((len(a), len(b)), np.int32)
    for word in range(a.signs.shape[1]):
        for k in range(LEVEL_BITS):
            met += np.bitwise_count(a.signs[:, word, None] & b.levels[None, :, k, word]).astype(np.int32) << k
    ones = np.bitwise_count(a.signs).sum(axis=1, dtype=np.int64).astype(np.float32)
    steps = (np.bitwise_count(b.levels).sum(axis=2, dtype=np.int64) << np.arange(LEVEL_BITS)).sum(axis=1).astype(np.float32)
    inner = 2 * b.step * met + 2 * b.low * ones[:, None] - (a.dim * b.low + b.step * steps)
    estimate = inner / (math.sqrt(a.dim) * a.factor)[:, None]
    f2 = a.factor.astype(np.float64)[:, None] ** 2
    error = np.sqrt(np.maximum(1 - f2, 0) / f2 / max(a.dim - 1, 1) + b.step.astype(np.float64) ** 2 / 4 / f2)
    return estimate, error.astype(np.float32)


def undecided(codes: Codes, cosine: float = COSINE, block: int = 256) -> np.ndarray:
    """bool[n, n], above the diagonal: pairs that neither of their two estimates rules out within its confidence bound."""
    n = len(codes)
    may = np.zeros((n, n), bool)
    for a in range(0, n, block):
        estimate, error = estimates(codes[a : a + block], codes)
        may[a : a + block] = estimate + CONFIDENCE * error + 1e-4 >= cosine
    return np.triu(may & may.T, 1)


def linked(unit: np.ndarray, may: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """bool[n, n], symmetric: the pairs of may whose cosine, recomputed in double, is at least `cosine`."""
    a, b = np.nonzero(may)
    out = np.zeros_like(may)
    at_once = max(1, (1 << 21) // unit.shape[1])
    for k in range(0, len(a), at_once):
        i, j = a[k : k + at_once], b[k : k + at_once]
        good = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        out[i[good], j[good]] = True
    return out | out.T


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all of near connects, one fewer than the rows of each component."""
    fresh, out = np.ones(len(near), bool), []
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if not fresh[start]:
            continue
        fresh[start] = False
        queue = [start]
        while queue:
            u = queue.pop()
            new = np.flatnonzero(near[u] & fresh)
            if len(new):
                fresh[new] = False
                out += [(u, v) for v in new.tolist()]
                queue += new.tolist()
    return out


def _unit(values: pa.Array, n: int) -> np.ndarray:
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, no underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: What is stored for each distinct vector of a label besides label, dim, bits, g, rep, many and v.
_CODE = "keys array<bigint>, signs binary, factor float, levels binary, low float, step float"
_CODE_NAMES = ["keys", "signs", "factor", "levels", "low", "step"]


def _coded(groups: DataFrame, cosine: float, miss: float) -> DataFrame:
    """Adds the columns of _CODE; keys are the vector's buckets, one for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "bits")], axis=1)
            for dim, bits in np.unique(kind, axis=0).tolist():
                at = np.flatnonzero((kind == (dim, bits)).all(axis=1))
                for a in range(0, len(at), 2048):
                    rows = batch.take(pa.array(at[a : a + 2048]))
                    unit = _unit(rows.column("v"), rows.num_rows)
                    c = encode(unit)
                    keys = bucket_keys(unit, bits, table_count(bits, cosine, miss))
                    code = [
                        pa.array(list(keys), pa.list_(pa.int64())), pa.array([x.tobytes() for x in c.signs], pa.binary()), pa.array(c.factor),
                        pa.array([x.tobytes() for x in c.levels], pa.binary()), pa.array(c.low), pa.array(c.step),
                    ]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *code], names=[*rows.schema.names, *_CODE_NAMES])

    extra = [f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema.fields]
    return groups.mapInArrow(run, ", ".join([*extra, _CODE]))


def _codes_of(bucket: pa.Table) -> Codes:
    def wide(name: str, *shape: int) -> np.ndarray:
        return np.frombuffer(b"".join(bucket.column(name).to_pylist()), "<u8").reshape(bucket.num_rows, *shape)

    dim = bucket.column("dim")[0].as_py()
    return Codes(dim, wide("signs", -1), bucket.column("factor").to_numpy(), wide("levels", LEVEL_BITS, -(-dim // 64)), bucket.column("low").to_numpy(), bucket.column("step").to_numpy())


_BUCKET = ["label", "dim", "t", "key", "i", "j"]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Buckets of a sorted stream, each whole. Their rows are bounded by the tiles."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in _BUCKET]
        change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if table.num_rows > 1 else np.zeros(0, bool)
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _open_pairs(bucket: pa.Table, cosine: float) -> np.ndarray:
    """bool[n, n]: undecided pairs that this bucket's table is the first to bring together, for a tile of two chunks those
    between the chunks."""
    may = undecided(_codes_of(bucket), cosine)
    i, j = bucket.column("i")[0].as_py(), bucket.column("j")[0].as_py()
    if i != j:
        own = bucket.column("own").to_numpy()
        may &= own[:, None] != own[None, :]
    t = bucket.column("t")[0].as_py()
    if t:
        keys = bucket.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(bucket.num_rows, -1)[:, :t]
        x, y = np.nonzero(may)
        for a in range(0, len(x), 1 << 16):
            again = (keys[x[a : a + (1 << 16)]] == keys[y[a : a + (1 << 16)]]).any(axis=1)
            may[x[a : a + (1 << 16)][again], y[a : a + (1 << 16)][again]] = False
    return may


def _candidates(tiles: DataFrame, cosine: float) -> DataFrame:
    """Rows of buckets that are in an undecided pair there: the bucket, own and g. Only codes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches):
            if bucket.num_rows < 2:
                continue
            may = _open_pairs(bucket, cosine)
            at = np.flatnonzero(may.any(axis=0) | may.any(axis=1))
            if len(at):
                yield bucket.select([*_BUCKET, "own", "g"]).take(pa.array(at)).combine_chunks().to_batches()[0]

    return tiles.mapInArrow(run, "label int, dim int, t int, key long, i int, j int, own int, g long")


def _decide(rows: DataFrame, cosine: float) -> DataFrame:
    """Links (a, b) that connect what is linked in a bucket, and sums of links (a, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches):
            g, many = bucket.column("g").to_numpy(), bucket.column("many").to_numpy()
            near = linked(_unit(bucket.column("v").combine_chunks(), len(g)), _open_pairs(bucket, cosine), cosine)
            if edges := forest(near):
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(g[e[:, 0]]), pa.array(g[e[:, 1]]), pa.nulls(len(e), pa.int64())], names=["a", "b", "n"])
                sums = near @ many.astype(np.float64)
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.nulls(len(at), pa.int64()), pa.array(sums[at].astype(np.int64))], names=["a", "b", "n"])

    return rows.mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, bucket: int = BUCKET, largest: int = LARGEST, miss: float = MISS,
) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id that links lead to), kept.

    Rows are compared if label and dimension agree. A null id, label or vector, an empty or zero vector, and one with a
    null or non-finite component links with nothing: n_links 0, component_id its own id. Equal vectors of a label are one
    from the start, with their number; repeated rows and repeated ids count as other rows. An empty table gives no rows;
    other columns are ignored.

    Each distinct vector is stored with its code, factor and buckets. A label of up to `bucket` vectors is one bucket;
    in larger ones buckets are signs of random projections, in so many tables that a pair at the threshold shares none
    with odds of `miss`, closer pairs with less. Codes meet in the buckets; vectors go only where an undecided pair waits
    for them, in the first table that brings it together, and every link is recomputed in double precision. A bucket
    above `largest` is cut into chunks before it is dealt out, and each pair of chunks is a task's."""
    v = F.col(vector_col).cast("array<float>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0)
    usable = F.coalesce(good, F.lit(False))
    groups = rows.where(usable).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    groups = materialise(groups.select("label", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("g"), "rep", "many", "v"), "embedding-groups")
    sizes = groups.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    bits = F.least(F.lit(30), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / F.lit(bucket))))).cast("int")
    stored = materialise(_coded(groups.join(sizes.select("label", "dim", bits.alias("bits")), ["label", "dim"]), cosine, miss), "embedding-codes")
    keyed = stored.select("label", "dim", "g", *_CODE_NAMES, F.posexplode("keys").alias("t", "key"))
    crowds = stored.select("label", "dim", F.posexplode("keys").alias("t", "key")).groupBy("label", "dim", "t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.when(F.col("n") > largest, F.ceil(F.col("n") / F.lit(max(1, largest // 2)))).otherwise(F.lit(1)).cast("int")
    crowds = materialise(crowds.select("label", "dim", "t", "key", chunks.alias("chunks")), "embedding-crowds")
    met = keyed.join(crowds, ["label", "dim", "t", "key"]).withColumn("own", F.pmod(F.xxhash64("g"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("label", "dim", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "g", *_CODE_NAMES)
    waiting = materialise(_candidates(met.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET), cosine), "embedding-undecided")
    fetched = waiting.join(stored.select("g", "many", "v", *_CODE_NAMES), "g").select(*_BUCKET, "own", "g", "many", "v", *_CODE_NAMES)
    found = materialise(_decide(fetched.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET), cosine), "embedding-links")
    discard(waiting)
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    sums = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"))
    one = groups.select("g", "rep")
    least = roots.join(one, roots["node"] == one["g"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    led = roots.join(least, "root").select(F.col("node").alias("g"), "component_id")
    known = groups.join(led, "g", "left").join(sums.withColumnRenamed("a", "g"), "g", "left")
    known = known.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.where(usable).join(known, ["label", "v"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
