"""Trace lines to columns: one select of expressions for both formats.

QUOTED: [time][module 0xOFF] [encoding] 0xPC: "mnemonic operands" ; mem[READ] abs=0x.. r=0x.. => r=0x..
BANG:   [module] 0xPC!0xOFF mnemonic operands; r=0x.. mem_r=0x.. -> r=0x.."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.isa import decoded
from tracewright.functions.registers import XZR, hex_high, hex_long, masked, pairs, reg_id
from tracewright.sources.traces import QUOTED

#: The instruction in quotes behind the header, and the notes behind it; without a header, the first quotes of the line.
QUOTE = r'^(?:.*?\] 0x[0-9a-fA-F]+: )?[^"]*"([^"]*)"(.*)$'


def is_special(raw: Column) -> Column:
    """Lines of a BANG trace that are no instruction."""
    return ~raw.startswith("[")


def split_line(lines: DataFrame, fmt: str, *keep: str) -> DataFrame:
    """seq, raw, columns to keep, and the parts of instruction lines: module, insn_addr, insn_offset, asm, before, after, has_arrow. asm is
    null for other lines."""
    raw = F.col("raw")
    # each step has a select of its own, so that no pattern is matched twice
    if fmt == QUOTED:
        module, offset = F.regexp_extract(raw, r"\]\[([^\s\]]+) 0x", 1), F.regexp_extract(raw, r"\]\[[^\]]* 0x([0-9a-fA-F]+)\]", 1)
        address = F.regexp_extract(raw, r'\] 0x([0-9a-fA-F]+): "', 1)
        out = lines.select("seq", "raw", *keep, module.alias("module"), address.alias("_pc"), offset.alias("_offset"), F.nullif(F.regexp_extract(raw, QUOTE, 1), F.lit("")).alias("asm"), F.regexp_extract(raw, QUOTE, 2).alias("_notes"))
        arrow = " => "
    else:
        # [module] 0xPC!0xOFF body
        head = F.substring_index(raw, " ", 2)
        module = F.when(raw.startswith("["), F.substring_index(F.substring(head, 2, 1 << 30), "]", 1)).otherwise("")
        place = F.regexp_extract(raw, r"^\[[^\]]*\] 0x([0-9a-fA-F]+)!", 1)
        body = F.when(raw.startswith("["), F.regexp_extract(raw, r"!0x([0-9a-fA-F]+ .*)$", 1))
        out = lines.select("seq", "raw", *keep, module.alias("module"), place.alias("_pc"), body.alias("_tail"))
        out = out.withColumns({"_offset": F.substring_index("_tail", " ", 1), "_body": F.substring(F.col("_tail"), F.instr("_tail", " ") + 1, F.lit(1 << 30)), "_marked": F.col("_tail").contains(";")})
        out = out.withColumn("_cut", F.when(F.col("_marked"), F.instr("_body", ";")).otherwise(F.regexp_instr("_body", F.lit(r" [a-z][a-z0-9_]+=0x"))))
        text = F.when(F.col("_cut") > 0, F.substring(F.col("_body"), F.lit(1), F.col("_cut") - 1)).otherwise(F.substring_index("_body", " -> ", 1))
        notes = F.when(F.col("_cut") > 0, F.substring(F.col("_body"), F.col("_cut") + F.col("_marked").cast("int"), F.lit(1 << 30))).otherwise("")
        out = out.withColumns({"asm": F.nullif(F.trim(text), F.lit("")), "_notes": notes})
        arrow = " -> "
    has = F.col("_notes").contains(arrow)
    return out.select(
        "seq", "raw", *keep, "asm", F.nullif("module", F.lit("")).alias("module"), hex_long(F.col("_pc")).alias("insn_addr"), hex_long(F.col("_offset")).alias("insn_offset"), has.alias("has_arrow"),
        F.when(has, F.substring_index("_notes", arrow, 1)).otherwise(F.col("_notes")).alias("before"), F.when(has, F.substring_index("_notes", arrow, -1)).otherwise("").alias("after"),
    )


def _digits(found: Column, names: Column) -> Column:
    """Digits of the first of an array of names that pairs() has."""
    each = F.transform(names, lambda n: F.get(F.filter(found, lambda p: p["name"] == n), F.lit(0))["digits"])
    return F.get(F.filter(each, lambda d: d.isNotNull()), F.lit(0))


def parse(lines: DataFrame, fmt: str) -> DataFrame:
    """Instruction lines only: seq, raw, module, insn_addr, insn_offset, asm, mnemonic, ops_text, operands, base_reg,
    writeback, lane_index, elem_width, n_data (data registers), is_pair, mem (is_write, abs, elem_width, total_width and
    values), class, known, defs, uses, pre, post (array<struct<name, digits>>), has_arrow.

    What follows from the instruction's text alone is decoded once for each text; values are read from each line."""
    # the filter is on what is decoded: one on asm would be moved below and match all patterns again
    p = split_line(lines, fmt).withColumn("_d", decoded(F.col("asm"))).where("_d.mnemonic IS NOT NULL")
    p = p.withColumns({"pre": pairs(F.col("before")), "post": pairs(F.col("after"))})
    if fmt == QUOTED:
        way, abs_ = F.regexp_extract("before", r"mem\[([RW])", 1), F.regexp_extract("before", r"mem\[[^\]]*\][^=]*abs=0x([0-9a-fA-F]+)", 1)
        is_write = way == "W"
    else:
        way, abs_ = F.regexp_extract("before", r"mem_([rw])=0x", 1), F.regexp_extract("before", r"mem_[rw]=0x([0-9a-fA-F]+)", 1)
        is_write = F.when(F.col("_d.mnemonic").startswith("ld"), F.lit(False)).when(F.col("_d.mnemonic").startswith("st"), F.lit(True)).otherwise(way == "w")
    p = p.withColumns({"_abs": hex_long(abs_), "_write": is_write}).withColumn("_from", F.when(F.col("_write"), F.col("pre")).otherwise(F.col("post")))
    touches = F.col("_abs").isNotNull()
    p = p.withColumns({"_d1": F.when(touches, _digits(F.col("_from"), F.col("_d.names1"))), "_d2": F.when(touches & F.col("_d.is_pair"), _digits(F.col("_from"), F.col("_d.names2")))})
    width, d1, d2 = F.col("_d.elem_width"), F.col("_d1"), F.col("_d2")
    narrow = width <= 8
    mem = F.when(touches, F.struct(
        F.col("_write").alias("is_write"), F.col("_abs").alias("abs"), width.alias("elem_width"), (width * F.col("_d.n_data")).cast("int").alias("total_width"),
        F.when(narrow, masked(hex_long(d1), width)).alias("value"), F.when(narrow, masked(hex_long(d2), width)).alias("value2"),
        F.when(~narrow, hex_long(d1)).alias("value_lo"), F.when(~narrow, hex_high(d1)).alias("value_hi"), F.when(~narrow, hex_long(d2)).alias("value2_lo"), F.when(~narrow, hex_high(d2)).alias("value2_hi"),
    ))
    written = F.array_distinct(F.filter(F.transform("post", lambda x: reg_id(x["name"])), lambda r: r.isNotNull() & (r != XZR)))
    defs = F.when(F.col("_d.class") == "system_call", written).otherwise(F.col("_d.defs"))
    plain = [F.col(f"_d.{x}") for x in ("mnemonic", "ops_text", "operands", "base_reg", "writeback", "lane_index", "elem_width", "n_data", "is_pair")]
    return p.select("seq", "raw", "asm", "module", "insn_addr", "insn_offset", "has_arrow", *plain, "pre", "post", mem.alias("mem"), F.col("_d.class"), defs.alias("defs"), F.col("_d.uses"), F.col("_d.known"))


def special(lines: DataFrame) -> DataFrame:
    """Lines of a BANG trace that are no instruction: seq, raw, kind (call, arg, ret, hexdump, other), func_name, is_jni,
    arg_index, value."""
    raw = F.col("raw")
    call = r"^call (jni )?func: ([^(]*)\("
    kind = F.when(raw.rlike(call), "call").when(raw.rlike(r"^args\d+: "), "arg").when(raw.startswith("ret: "), "ret").when(raw.startswith("hexdump") | raw.rlike("^[0-9a-fA-F]"), "hexdump").otherwise("other")
    return lines.where(is_special(raw)).select(
        "seq", "raw", kind.alias("kind"), F.when(kind == "call", F.regexp_extract(raw, call, 2)).alias("func_name"), F.when(kind == "call", raw.startswith("call jni")).alias("is_jni"),
        F.when(kind == "arg", F.regexp_extract(raw, r"^args(\d+): ", 1)).alias("arg_index"),
        F.when(kind == "arg", F.regexp_extract(raw, r"^args\d+: (.*)$", 1)).when(kind == "ret", F.substring(raw, 6, 1 << 30)).when(kind == "call", F.regexp_extract(raw, r"\((.*)\)", 1)).alias("value"),
    )


def display(lines: DataFrame, fmt: str) -> DataFrame:
    """What a viewer shows of instruction lines: seq, address, so_offset, so_name, disasm, changes, reg_before, mem_rw,
    mem_addr, mem_size (all bytes), raw."""
    p = split_line(lines, fmt).where("asm IS NOT NULL")
    insn = parse(lines, fmt).select(F.col("seq").alias("_seq"), "mem")
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    out = p.join(insn, p["seq"] == insn["_seq"])
    before = F.trim(F.regexp_replace("before", r"^\s*;?\s*|mem\[[^\]]*\]\s*abs=0x[0-9a-fA-F]+|mem_[rw]=0x[0-9a-fA-F]+", ""))
    return out.select("seq", hexed("insn_addr").alias("address"), hexed("insn_offset").alias("so_offset"), F.col("module").alias("so_name"), F.col("asm").alias("disasm"), F.trim("after").alias("changes"), before.alias("reg_before"), F.when(F.col("mem.is_write"), "W").when(F.col("mem").isNotNull(), "R").alias("mem_rw"), hexed("mem.abs").alias("mem_addr"), F.col("mem.total_width").alias("mem_size"), "raw")
