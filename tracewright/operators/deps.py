"""The dependency graph of a trace: every edge leads from a line to an earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.ordered import BUCKET, ordered_last

#: Parts of a line: pair instructions have two halves and what both share; other lines have one.
MAIN, HALF1, HALF2, SHARED = "main", "half1", "half2", "shared"


def reg_defs(insn: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """reg, seq, part for each register defined. A pair load's second register is its second half, a written-back base of
    a pair is shared. external: seq of `ret:` lines, which define x0."""
    base = insn.where(F.size("defs") > 0).select("seq", "is_pair", "class", "base_reg", "operands", "writeback", F.explode("defs").alias("reg"))
    second = F.get("operands", F.lit(1))["reg"]
    is_second = (F.col("reg") == second) | (F.col("reg") == second + 33) & second.between(33, 64)
    part = F.when(F.col("is_pair") & F.col("writeback") & (F.col("reg") == F.col("base_reg")) & (F.col("class") != "load_pair"), SHARED).when(F.col("is_pair") & (F.col("class") == "load_pair"), F.when(is_second, HALF2).when((F.col("reg") == F.col("base_reg")) & F.col("writeback"), SHARED).otherwise(HALF1)).otherwise(MAIN)
    out = base.select("reg", "seq", part.alias("part"))
    if external is not None:
        out = out.unionByName(external.select(F.lit(0).alias("reg"), "seq", F.lit(MAIN).alias("part")))
    return out


def reg_uses(insn: DataFrame) -> DataFrame:
    """reg, seq, part for each register used: of a store pair its data registers belong to their halves."""
    base = insn.where(F.size("uses") > 0).select("seq", "is_pair", "class", "operands", "base_reg", F.explode("uses").alias("reg"))
    first, second = F.get("operands", F.lit(0))["reg"], F.get("operands", F.lit(1))["reg"]
    of = lambda r: (F.col("reg") == r) | ((F.col("reg") == r + 33) & r.between(33, 64))
    pair = F.col("is_pair") & (F.col("class") == "store_pair")
    parts = F.when(pair, F.array_compact(F.array(F.when(of(first), HALF1), F.when(of(second), HALF2), F.when(F.col("reg") == F.col("base_reg"), SHARED)))).when(F.col("is_pair"), F.array(F.lit(SHARED))).otherwise(F.array(F.lit(MAIN)))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(SHARED)))
    return base.select("reg", "seq", F.explode(parts).alias("part"))


def mem_bytes(insn: DataFrame) -> DataFrame:
    """addr, seq, is_write, part, value (the byte's whole access value, for plain accesses), width: a row for each byte touched."""
    m = insn.where(F.col("mem").isNotNull()).select("seq", "is_pair", "class", "mem.*")
    byte = F.explode(F.sequence(F.lit(0), F.col("total_width") - 1))
    m = m.withColumn("_k", byte)
    part = F.when(F.col("is_pair"), F.when(F.col("_k") < F.col("elem_width"), HALF1).otherwise(HALF2)).otherwise(MAIN)
    return m.select((F.col("abs") + F.col("_k")).alias("addr"), "seq", "is_write", part.alias("part"), "value", F.col("total_width").alias("width"), F.col("_k").alias("byte"))


def register_edges(insn: DataFrame, external: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """src_seq, src_part, dst_seq, dst_part: each use leads to the last definition before its line."""
    uses = reg_uses(insn).select("reg", "seq", "part", F.lit(0).alias("ord"), F.lit(None).cast("struct<seq:bigint,part:string>").alias("def"))
    defs = reg_defs(insn, external).select("reg", "seq", "part", F.lit(1).alias("ord"), F.struct("seq", "part").alias("def"))
    found = ordered_last(uses.unionByName(defs), ["reg"], ["seq", "ord", "part"], F.col("def"), "last", bucket)
    return found.where("ord = 0 AND last IS NOT NULL").select(F.col("seq").alias("src_seq"), F.col("part").alias("src_part"), F.col("last.seq").alias("dst_seq"), F.col("last.part").alias("dst_part")).distinct()


def loaded_bytes(insn: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A row for each byte that a line reads: seq, part, addr, value, width, byte, def (seq, part, value, width, byte of the
    last store to it, or null)."""
    b = mem_bytes(insn)
    reads = b.where("NOT is_write").select("addr", "seq", "part", "value", "width", "byte", F.lit(0).alias("ord"), F.lit(None).cast("struct<seq:bigint,part:string,value:bigint,width:int,byte:int>").alias("_def"))
    writes = b.where("is_write").select("addr", "seq", "part", "value", "width", "byte", F.lit(1).alias("ord"), F.struct("seq", "part", "value", "width", "byte").alias("_def"))
    return ordered_last(reads.unionByName(writes), ["addr"], ["seq", "ord", "byte"], F.col("_def"), "def", bucket).where("ord = 0").drop("ord", "_def")


def memory_edges(loaded: DataFrame) -> DataFrame:
    return loaded.where("def IS NOT NULL").select(F.col("seq").alias("src_seq"), F.col("part").alias("src_part"), F.col("def.seq").alias("dst_seq"), F.col("def.part").alias("dst_part")).distinct()


def load_flags(loaded: DataFrame) -> DataFrame:
    """seq, init_mem (a byte was never stored), pass_through (all bytes come from one store, which stored what is loaded)."""
    source = F.struct("def.seq", "def.part")
    one = (F.count(F.when(F.col("def").isNull(), 1)) == 0) & (F.min(source) == F.max(source)) & (F.min("part") == "main")
    same = F.coalesce(F.max("value") == F.max("def.value"), F.lit(False))
    return loaded.groupBy("seq").agg((F.count(F.when(F.col("def").isNull(), 1)) > 0).alias("init_mem"), F.coalesce(one & same, F.lit(False)).alias("pass_through"))


def control_edges(insn: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each instruction leads to the last conditional branch before it; of a pair it is the shared part that does."""
    branch = F.when(F.col("class").isin("cond_branch", "compare_branch"), F.col("seq"))
    found = ordered_last(insn.select("seq", "is_pair", "class"), [], ["seq"], branch, "last", bucket).where("last IS NOT NULL")
    return found.select(F.col("seq").alias("src_seq"), F.when(F.col("is_pair"), SHARED).otherwise(MAIN).alias("src_part"), F.col("last").alias("dst_seq"), F.lit(MAIN).alias("dst_part"))


def dependencies(insn: DataFrame, external: DataFrame | None = None, prune: bool = True, bucket: int = BUCKET) -> DataFrame:
    """src_seq, src_part, dst_seq, dst_part, kind (data, control). prune drops the register edges of pass-through loads:
    such a load's value is the stored one, however its address came about."""
    loaded = loaded_bytes(insn, bucket)
    registers = register_edges(insn, external, bucket)
    if prune:
        through = load_flags(loaded).where("pass_through").select(F.col("seq").alias("src_seq"))
        registers = registers.join(through, "src_seq", "left_anti")
    data = registers.unionByName(memory_edges(loaded)).distinct().withColumn("kind", F.lit("data"))
    return data.unionByName(control_edges(insn, bucket).withColumn("kind", F.lit("control")))


def reg_last_def(insn: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """reg, seq, part: the last definition of each register."""
    return reg_defs(insn, external).groupBy("reg").agg(F.max(F.struct("seq", "part")).alias("d")).select("reg", "d.seq", "d.part")


def mem_last_def(insn: DataFrame) -> DataFrame:
    """addr, seq, part, value: the last store to each byte."""
    return mem_bytes(insn).where("is_write").groupBy("addr").agg(F.max_by(F.struct("seq", "part", "value"), F.col("seq")).alias("d")).select("addr", "d.seq", "d.part", "d.value")
