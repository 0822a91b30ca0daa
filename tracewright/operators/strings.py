"""Strings that appear in memory while a trace runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes to each side of an access that are looked at for a string; bytes that a string needs.
REACH, LEAST = 1024, 2


def printable(b: int) -> bool:
    return 0x20 <= b <= 0x7E or 0x80 <= b <= 0xF4


@dataclass
class Found:
    addr: int
    data: bytes
    encoding: str
    seq: int
    rw: str


class Tracker:
    """Memory of one island of addresses and the strings that stand in it.

    A write that changes a byte ends the strings it touches; they are kept as they were, unless what stands there
    afterwards begins at the same place and continues them. Runs of printable bytes around the write are read anew."""

    def __init__(self) -> None:
        self.memory: dict[int, int] = {}
        self.active: dict[int, Found] = {}
        self.owner: dict[int, int] = {}
        self.done: list[Found] = []

    def access(self, addr: int, data: bytes, seq: int, rw: str) -> None:
        if all(self.memory.get(addr + k) == b for k, b in enumerate(data)):
            return
        for k, b in enumerate(data):
            self.memory[addr + k] = b
        low, high = addr, addr + len(data)
        while addr - low < REACH and printable(self.memory.get(low - 1, 0)):
            low -= 1
        while high - addr - len(data) < REACH and printable(self.memory.get(high, 0)):
            high += 1
        ended = [self.active.pop(s) for s in sorted({self.owner[a] for a in range(low, high) if a in self.owner})]
        for f in ended:
            for a in range(f.addr, f.addr + len(f.data)):
                self.owner.pop(a, None)
        new = list(self._runs(low, high, seq, rw))
        for f in ended:
            if not any(n.addr == f.addr and n.data.startswith(f.data) for n in new):
                self.done.append(f)
        for n in new:
            same = next((f for f in ended if f.addr == n.addr and f.data == n.data), None)
            self.active[n.addr] = same or n
            for a in range(n.addr, n.addr + len(n.data)):
                self.owner[a] = n.addr

    def _runs(self, low: int, high: int, seq: int, rw: str) -> Iterator[Found]:
        a = low
        while a < high:
            if not printable(self.memory.get(a, 0)):
                a += 1
                continue
            b = a
            while b < high and printable(self.memory.get(b, 0)):
                b += 1
            run = bytes(self.memory[x] for x in range(a, b))
            try:
                run.decode()
            except UnicodeDecodeError as e:
                run = run[: next((k for k, x in enumerate(run) if x >= 0x80), e.start)]
            if len(run) >= LEAST:
                yield Found(a, run, "ASCII" if run.isascii() else "UTF-8", seq, rw)
            a = b

    def finish(self) -> list[Found]:
        return sorted([*self.done, *self.active.values()], key=lambda f: (f.seq, f.addr))


def islands(records: DataFrame) -> DataFrame:
    """records with island: the first address of its run of ever-touched bytes. No string crosses an untouched byte, so
    islands are independent. Addresses are compared in cells first, then over the few cells' borders."""
    cell = 1 << 12
    spans = records.select("addr", (F.col("addr") + F.col("size")).alias("end")).distinct().withColumn("_cell", F.floor(F.col("addr") / cell))
    order = W.partitionBy("_cell").orderBy("addr", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(reach.isNull() | (F.col("addr") > reach), F.col("addr")))
    spans = spans.withColumn("_local", F.last("_new", ignorenulls=True).over(order))
    parts = spans.groupBy("_cell", "_local").agg(F.max("end").alias("_end"))
    line = W.partitionBy(F.lit(1)).orderBy("_local", "_end")
    joined = F.max("_end").over(line.rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_head", F.when(joined.isNull() | (F.col("_local") > joined), F.col("_local")))
    parts = parts.withColumn("island", F.last("_head", ignorenulls=True).over(line)).select("_cell", "_local", "island")
    own = spans.join(parts, ["_cell", "_local"]).select("addr", (F.col("end") - F.col("addr")).cast("int").alias("size"), "island")
    return records.join(own, ["addr", "size"])


def find_strings(records: DataFrame, writes_only: bool = False) -> DataFrame:
    """addr, content, encoding, byte_len, seq, rw. records: addr, seq, rw, data, size. An island is tracked by one task:
    its accesses build on each other."""
    kept = records.where("rw = 'W'") if writes_only else records

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        t = Tracker()
        for r in pdf.sort_values(["seq", "addr"]).itertuples():
            t.access(r.addr, (int(r.data) & (1 << 8 * r.size) - 1).to_bytes(r.size, "little"), r.seq, r.rw)
        return pd.DataFrame([(f.addr, f.data.decode(), f.encoding, len(f.data), f.seq, f.rw) for f in t.finish()], columns=["addr", "content", "encoding", "byte_len", "seq", "rw"])

    return islands(kept).groupBy("island").applyInPandas(track, "addr long, content string, encoding string, byte_len int, seq long, rw string")


def with_xrefs(strings: DataFrame, records: DataFrame) -> DataFrame:
    """strings with xref_count: reads based at any of its bytes."""
    reads = records.where("rw = 'R'").groupBy(F.col("addr").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    spread = strings.select("addr", "seq", "byte_len", F.explode(F.sequence(F.col("addr"), F.col("addr") + F.col("byte_len") - 1)).alias("_at"))
    sums = spread.join(reads, "_at").groupBy("addr", "seq", "byte_len").agg(F.sum("_n").alias("xref_count"))
    return strings.join(sums, ["addr", "seq", "byte_len"], "left").withColumn("xref_count", F.coalesce("xref_count", F.lit(0)))


def xrefs(records: DataFrame, addr: int, length: int) -> DataFrame:
    """seq, rw, addr: the first record of each line that is based in the range, in order."""
    near = records.where(F.col("addr").between(addr, addr + length - 1))
    return near.groupBy("seq").agg(F.min(F.struct("addr", "rw")).alias("r")).select("seq", "r.rw", "r.addr").orderBy("seq")


def list_strings(strings: DataFrame, least: int = 4, text: str = "", offset: int = 0, limit: int = 50) -> tuple[DataFrame, int]:
    """A page in order of seq, and how many there are."""
    kept = strings.where((F.col("byte_len") >= least) & F.contains(F.lower("content"), F.lit(text.lower())))
    return kept.orderBy("seq", "addr").offset(offset).limit(limit), kept.count()
