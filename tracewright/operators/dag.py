"""Dependency graphs of a value, with each line as an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.registers import reg_name, to_hex
from tracewright.operators.slicing import PARTS, parse_start, reach, resolve

#: Infix signs of arithmetic mnemonics.
SIGNS = {"add": "+", "adds": "+", "sub": "-", "subs": "-", "mul": "*", "sdiv": "/", "udiv": "/", "and": "&", "ands": "&", "orr": "|", "eor": "^", "lsl": "<<", "lsr": ">>", "asr": ">>"}


def expression(operands: Column, mnemonic: Column, cls: Column, mem: Column, asm: Column) -> Column:
    """A line as a C-like assignment; the instruction's text where there is no simple form."""
    shown = F.transform(operands, lambda o: F.when(o["kind"] == "imm", F.when(o["imm"].between(-9, 9), o["imm"].cast("string")).otherwise(to_hex(o["imm"]))).otherwise(reg_name(o["reg"])))
    a, b, c = (F.get(shown, F.lit(k)) for k in range(3))
    out = F.when(mnemonic.isin("mov", "movz", "adr", "adrp") & (F.size(shown) == 2), F.concat(a, F.lit(" = "), b)).when(mnemonic == "mvn", F.concat(a, F.lit(" = ~"), b)).when(mnemonic == "neg", F.concat(a, F.lit(" = -"), b))
    for name, sign in SIGNS.items():
        out = out.when((mnemonic == name) & (F.size(shown) == 3), F.concat(a, F.lit(" = "), b, F.lit(f" {sign} "), c))
    kind = F.concat(F.lit("*(u"), (mem["elem_width"] * 8).cast("string"), F.lit("*)"), to_hex(mem["abs"]))
    out = out.when((cls == "load") & mem.isNotNull(), F.concat(a, F.lit(" = "), kind)).when((cls == "store") & mem.isNotNull(), F.concat(kind, F.lit(" = "), a))
    out = out.when(cls.isin("compare") & (F.size(shown) == 2), F.concat(F.lit("compare("), a, F.lit(", "), b, F.lit(")")))
    return F.coalesce(out, asm)


def graph(spark, insn: DataFrame, edges: DataFrame, spec: str, external: DataFrame | None = None, data_only: bool = False, most: int = 10_000) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes (seq, depth, expression, asm, operation, is_leaf, value), edges (src_seq, dst_seq) and totals of what a start
    depends on. Over `most` lines those nearest to the start stay, of equally near ones the later."""
    depth, met = reach(edges, resolve(insn, parse_start(spec), external), data_only)
    lines: dict[int, int] = {}
    for node, d in depth.items():
        lines[node >> 2] = min(d, lines.get(node >> 2, d))
    kept = dict(sorted(lines.items(), key=lambda x: (x[1], -x[0]))[:most])
    pairs = sorted({(s >> 2, d >> 2) for s, d in met if s >> 2 in kept and d >> 2 in kept and s >> 2 != d >> 2})
    sources = {s for s, _ in pairs}
    nodes = spark.createDataFrame([(s, d, s not in sources) for s, d in kept.items()], "seq long, depth int, is_leaf boolean")
    told = insn.select("seq", expression(F.col("operands"), F.col("mnemonic"), F.col("class"), F.col("mem"), F.col("asm")).alias("expression"), "asm", F.col("mnemonic").alias("operation"), F.array_join(F.transform("post", lambda p: F.concat(p["name"], F.lit("=0x"), p["digits"])), " ").alias("_value"))
    nodes = nodes.join(told, "seq", "left").withColumn("value", F.when(F.col("is_leaf"), F.col("_value"))).drop("_value")
    return nodes, spark.createDataFrame(pairs, "src_seq long, dst_seq long"), {"root": max(kept, default=None), "total_reachable": len(lines), "truncated": len(lines) > most, "parts": PARTS}
