"""Backward slices: everything that a register's or a byte's value depends on."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.deps import HALF1, HALF2, MAIN, SHARED, mem_bytes, mem_last_def, reg_defs, reg_last_def

#: Lines before a given one that a definition-use chain searches for a definition.
LOOK_BACK = 50_000
#: Edges that the driver holds at once; they are fetched by ranges of lines with about so many.
EDGES_AT_ONCE = 20_000_000
PARTS = (MAIN, HALF1, HALF2, SHARED)
STACK_REGISTERS = ("sp", "x29", "fp", "wsp", "w29")


@dataclass(frozen=True)
class Start:
    """Where a slice begins: reg:NAME@last, reg:NAME@LINE, mem:HEX[:SIZE]@last or mem:HEX[:SIZE]@LINE; lines count from 1."""

    kind: str
    name: str
    address: int
    size: int
    line: int | None


def parse_start(spec: str) -> Start:
    m = re.fullmatch(r"(reg|mem):([^@:]+)(?::(\d+))?@(last|\d+)", spec.strip())
    if not m:
        raise ValueError(f"not a slice start: {spec!r}")
    kind, name, size, line = m.groups()
    number = None if line == "last" else int(line)
    if number == 0:
        raise ValueError("lines count from 1")
    if kind == "mem":
        return Start(kind, name, int(name, 16), int(size or 1), number)
    return Start(kind, name.lower(), 0, 1, number)


def register_number(name: str) -> int:
    n = name.lower()
    fixed = {"fp": 29, "x29": 29, "lr": 30, "x30": 30, "sp": 31, "wsp": 31, "xzr": 32, "wzr": 32, "nzcv": 65, "w29": 29, "w30": 30}
    if n in fixed:
        return fixed[n]
    m = re.fullmatch(r"([a-z])(\d+)", n)
    if m and m[1] in "xw" and int(m[2]) <= 28:
        return int(m[2])
    if m and m[1] in "bhsdqv" and int(m[2]) <= 31:
        return 33 + int(m[2])
    raise ValueError(f"not a register: {name!r}")


def resolve(insn: DataFrame, start: Start, external: DataFrame | None = None, look_back: int | None = None) -> list[tuple[int, str]]:
    """(seq, part) of the definitions that the start means: the newest at or before its line, or among look_back lines
    before it. Every byte of a memory range has its own."""
    oldest = 0 if look_back is None or start.line is None else max(0, start.line - 1 - look_back)
    if start.kind == "reg":
        reg = register_number(start.name)
        if start.line is None:
            got = reg_last_def(insn, external).where(F.col("reg") == reg).collect()
        else:
            seq = F.col("seq")
            near = reg_defs(insn, external).where((F.col("reg") == reg) & seq.between(oldest, start.line - 1))
            got = near.groupBy("reg").agg(F.max(F.struct("seq", "part")).alias("d")).select("d.seq", "d.part").collect()
    else:
        wanted = F.col("addr").between(start.address, start.address + start.size - 1)
        if start.line is None:
            got = mem_last_def(insn).where(wanted).collect()
        else:
            near = mem_bytes(insn).where(wanted & F.col("is_write") & F.col("seq").between(oldest, start.line - 1))
            got = near.groupBy("addr").agg(F.max(F.struct("seq", "part")).alias("d")).select("d.seq", "d.part").collect()
    return sorted({(r["seq"], r["part"]) for r in got})


def reach(edges: DataFrame, starts: list[tuple[int, str]], data_only: bool = False, at_once: int = EDGES_AT_ONCE, keep_edges: bool = True) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Shortest distance of each node that the starts depend on (a node is 4 * line + part), and the edges met, if kept.

    Edges lead to earlier lines only, so all that leads to a line is known when its turn comes: the lines are gone
    through once, from the last start down, in ranges of about at_once edges. Rounds don't depend on how deep the graph
    is, and the driver holds one range and what is marked."""
    if not starts:
        return {}, []
    top = max(s for s, _ in starts)
    e = edges.where(F.col("src_seq") <= top)
    if data_only:
        e = e.where("kind = 'data'")
    code = lambda c: F.coalesce(*[F.when(F.col(c) == p, F.lit(i)) for i, p in enumerate(PARTS)])
    packed = e.select((F.col("src_seq") * 4 + code("src_part")).alias("s"), (F.col("dst_seq") * 4 + code("dst_part")).alias("d"), "src_seq")
    many = packed.count()
    ranges = max(1, -(-many // at_once))
    cuts = {0}
    if ranges > 1:
        cuts |= {int(x) for x in packed.approxQuantile("src_seq", [k / ranges for k in range(1, ranges)], 0.001)}
    cuts = [*sorted(cuts), top + 1]
    depth = {4 * s + PARTS.index(p): 0 for s, p in starts}
    met: list[tuple[int, int]] = []
    far = 1 << 62
    for low, high in zip(reversed(cuts[:-1]), reversed(cuts[1:]), strict=True):
        got = packed.where((F.col("src_seq") >= low) & (F.col("src_seq") < high)).select("s", "d").toArrow()
        s, d = got.column("s").to_numpy(), got.column("d").to_numpy()
        order = np.lexsort((-d, -s))
        s, d = s[order], d[order]
        bounds = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s)) if len(s) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            node = int(s[a])
            near = depth.get(node, far)
            if node & 3 == 3:  # the shared part of a pair belongs to either half
                near = min(near, depth.get(node - 2, far), depth.get(node - 1, far))
            if near < far:
                for x in d[a:b].tolist():
                    if keep_edges:
                        met.append((node, x))
                    if near + 1 < depth.get(x, far):
                        depth[x] = near + 1
    return depth, met


def closure(edges: DataFrame, starts: list[tuple[int, str]], data_only: bool = False, at_once: int = EDGES_AT_ONCE) -> np.ndarray:
    """Sorted lines that the starts depend on, they included; a pair's halves and shared part are apart."""
    depth, _ = reach(edges, starts, data_only, at_once, keep_edges=False)
    return np.unique(np.fromiter(depth, np.int64, len(depth)) >> 2)


def slice_lines(spark, insn: DataFrame, edges: DataFrame, specs: list[str], data_only: bool = False, external: DataFrame | None = None, start_seq: int | None = None, end_seq: int | None = None) -> DataFrame:
    """seq of the slice of all specs together; a range is cut out after the closure."""
    starts = [x for s in specs for x in resolve(insn, parse_start(s), external)]
    if not starts:
        raise LookupError(f"nothing defines {', '.join(specs)}")
    seqs = closure(edges, starts, data_only)
    keep = (seqs >= (0 if start_seq is None else start_seq)) & (seqs <= (np.iinfo(np.int64).max if end_seq is None else end_seq))
    return spark.createDataFrame(pd.DataFrame({"seq": seqs[keep]}), "seq long")


def slice_stats(tainted: DataFrame, total_lines: int) -> dict:
    marked = tainted.count()
    return {"marked_count": marked, "total_lines": total_lines, "percentage": 100.0 * marked / total_lines if total_lines else 0.0}


def slice_page(lines: DataFrame, tainted: DataFrame, start: int, count: int) -> DataFrame:
    """seq, marked for a range of lines."""
    page = lines.where((F.col("seq") >= start) & (F.col("seq") < start + count)).select("seq")
    return page.join(tainted.withColumn("_m", F.lit(True)), "seq", "left").select("seq", F.coalesce("_m", F.lit(False)).alias("marked"))


def with_context(tainted: DataFrame, k: int, total: int) -> DataFrame:
    """seq, tainted: the slice and k lines to each side of its lines."""
    around = tainted.select(F.explode(F.sequence(F.greatest(F.col("seq") - k, F.lit(0)), F.least(F.col("seq") + k, F.lit(total - 1)))).alias("seq")).distinct()
    return around.join(tainted.withColumn("_t", F.lit(True)), "seq", "left").select("seq", F.coalesce("_t", F.lit(False)).alias("tainted"))


def stack_only(insn: DataFrame) -> DataFrame:
    """seq of lines that change stack registers and nothing else."""
    return insn.where((F.size("post") > 0) & F.forall("post", lambda p: p["name"].isin(*STACK_REGISTERS))).select("seq")
