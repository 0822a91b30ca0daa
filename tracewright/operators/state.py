"""Register and memory contents at a line, access histories, and definition-use chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.registers import COUNT, NZCV, SP, V_HIGH, V_LOW, hex_high, hex_long, reg_id, reg_name, to_hex
from tracewright.operators.slicing import LOOK_BACK

SAMPLES = 300


def register_writes(insn: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """reg, seq, value: what the notes behind the arrow say; vector registers in two halves. returns: seq, value (text) of
    `ret:` lines, which set x0; a write to nzcv from a register sets it to that register's noted value."""
    w = insn.select("seq", F.posexplode("post").alias("_k", "p")).withColumn("reg", reg_id(F.col("p.name")))
    vector = F.col("reg").between(V_LOW, V_LOW + 31)
    low = w.where("reg IS NOT NULL").select("reg", "seq", hex_long(F.col("p.digits")).alias("value"), "_k")
    high = w.where(vector).select((F.col("reg") + (V_HIGH - V_LOW)).alias("reg"), "seq", hex_high(F.col("p.digits")).alias("value"), "_k")
    flags = insn.where((F.col("class") == "write_system") & F.lower("ops_text").contains("nzcv") & (F.size("pre") > 0)).select(F.lit(NZCV).alias("reg"), "seq", hex_long(F.get("pre", F.lit(0))["digits"]).alias("value"), F.lit(-1).alias("_k"))
    out = low.unionByName(high).unionByName(flags)
    if returns is not None:
        out = out.unionByName(returns.where(F.col("value").rlike("^0x[0-9a-fA-F]+")).select(F.lit(0).alias("reg"), "seq", hex_long(F.regexp_extract("value", "^0x([0-9a-fA-F]+)", 1)).alias("value"), F.lit(0).alias("_k")))
    return out.groupBy("reg", "seq").agg(F.max_by("value", "_k").alias("value"))


def registers_at(writes: DataFrame, seq: int) -> DataFrame:
    """reg, name, value (0x and 16 digits, ? if unknown) of x0-x28, fp, lr, sp and nzcv after a line."""
    known = writes.where(F.col("seq") <= seq).groupBy("reg").agg(F.max_by("value", "seq").alias("_v"))
    wanted = writes.sparkSession.range(COUNT).select(F.col("id").cast("int").alias("reg")).where((F.col("reg") <= SP) | (F.col("reg") == NZCV))
    return wanted.join(known, "reg", "left").select("reg", reg_name(F.col("reg")).alias("name"), F.when(F.col("_v").isNull(), "?").otherwise(to_hex(F.col("_v"), 16)).alias("value"))


def accesses(insn: DataFrame) -> DataFrame:
    """addr, seq, insn_addr, rw, data, size: one record for each element; 16-byte elements are two of 8 bytes."""
    m = insn.where(F.col("mem").isNotNull()).select("seq", "insn_addr", "is_pair", F.when(F.col("mem.is_write"), "W").otherwise("R").alias("rw"), "mem.*")

    def record(at: Column, data: Column, size: Column) -> Column:
        return F.struct(at.alias("addr"), data.cast("long").alias("data"), size.cast("int").alias("size"))

    a, w, eight = F.col("abs"), F.col("elem_width"), F.lit(8)
    narrow = F.array(record(a, F.coalesce("value", F.lit(0)), w), F.when(F.col("is_pair") & F.col("value2").isNotNull(), record(a + w, F.col("value2"), w)))
    wide = F.array(
        F.when(F.col("value_lo").isNotNull(), record(a, F.col("value_lo"), eight)), F.when(F.col("value_hi").isNotNull(), record(a + 8, F.col("value_hi"), eight)),
        F.when(F.col("value2_lo").isNotNull(), record(a + 16, F.col("value2_lo"), eight)), F.when(F.col("value2_hi").isNotNull(), record(a + 24, F.col("value2_hi"), eight)),
    )
    return m.select("seq", "insn_addr", "rw", F.explode(F.array_compact(F.when(w <= 8, narrow).otherwise(wide))).alias("r")).select("r.addr", "seq", "insn_addr", "rw", "r.data", "r.size")


def access_bytes(records: DataFrame) -> DataFrame:
    """addr, seq, byte: little-endian."""
    k = F.explode(F.sequence(F.lit(0), F.col("size") - 1))
    return records.withColumn("_k", k).select((F.col("addr") + F.col("_k")).alias("addr"), "seq", "rw", F.expr("CAST(shiftrightunsigned(data, 8 * _k) & 255 AS INT)").alias("byte"))


def memory_at(records: DataFrame, addr: int, seq: int, length: int = 16) -> DataFrame:
    """addr, byte, known for a range from a 16-aligned address: the newest access (read or write) of each byte by a line."""
    base, size = addr & ~15, max(length, 16)
    near = records.where(F.col("addr").between(base - 7, base + size - 1) & (F.col("seq") <= seq))
    newest = access_bytes(near).groupBy("addr").agg(F.max_by("byte", F.struct("seq", "rw")).alias("byte"))
    wanted = records.sparkSession.range(base, base + size).select(F.col("id").alias("addr"))
    return wanted.join(newest, "addr", "left").select("addr", F.coalesce("byte", F.lit(0)).alias("byte"), F.col("byte").isNotNull().alias("known"))


def hexdump_text(snapshot: DataFrame) -> DataFrame:
    """row_addr, hex, ascii: 16 bytes a row; unknown bytes as ??."""
    row = (F.floor(F.col("addr") / 16) * 16).alias("row_addr")
    shown = F.when(F.col("known"), F.lower(F.lpad(F.hex("byte"), 2, "0"))).otherwise("??")
    letter = F.when(F.col("known") & F.col("byte").between(32, 126), F.chr(F.col("byte"))).otherwise(".")
    parts = F.sort_array(F.collect_list(F.struct("addr", shown.alias("h"), letter.alias("c"))))
    return snapshot.groupBy(row).agg(parts.alias("_p")).select("row_addr", F.array_join(F.transform("_p", lambda p: p["h"]), " ").alias("hex"), F.array_join(F.transform("_p", lambda p: p["c"]), "").alias("ascii"))


def history(records: DataFrame, addr: int) -> DataFrame:
    """position, seq, insn_addr, rw, data, size of all records at an address, in order."""
    own = records.where(F.col("addr") == addr)
    return own.withColumn("position", F.row_number().over(W.partitionBy("addr").orderBy("seq", "rw")) - 1).select("position", "seq", "insn_addr", "rw", "data", "size")


def history_meta(records: DataFrame, addr: int, center: int) -> dict:
    """total, center_index (records before the line, within the list), samples: up to SAMPLES even positions."""
    h = history(records, addr)
    row = h.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("seq") < center, 1)).alias("before")).first()
    total = row["total"]
    picks = sorted({i * total // SAMPLES for i in range(SAMPLES)}) if total > SAMPLES else list(range(total))
    samples = h.where(F.col("position").isin(picks)).orderBy("position").collect() if total else []
    return {"total": total, "center_index": min(row["before"], max(total - 1, 0)), "samples": samples}


def history_page(records: DataFrame, addr: int, start: int, limit: int) -> DataFrame:
    return history(records, addr).where(F.col("position").between(start, start + limit - 1))


def def_use_chain(defs: DataFrame, uses: DataFrame, seq: int, reg: int, look_back: int = LOOK_BACK) -> dict:
    """def_seq (the last definition above, if the line uses the register), redefined_seq, uses (below, up to and with the
    line that redefines it, if the line defines the register)."""
    d, u = defs.where(F.col("reg") == reg).select("seq").distinct(), uses.where(F.col("reg") == reg).select("seq").distinct()
    here = d.where(F.col("seq") == seq).count() > 0
    used = u.where(F.col("seq") == seq).count() > 0
    above = d.where((F.col("seq") < seq) & (F.col("seq") >= seq - look_back)).agg(F.max("seq")).first()[0] if used else None
    out = {"def_seq": above, "redefined_seq": None, "uses": []}
    if here:
        end = d.where(F.col("seq") > seq).agg(F.min("seq")).first()[0]
        below = u.where(F.col("seq") > seq)
        out |= {"redefined_seq": end, "uses": [r["seq"] for r in (below if end is None else below.where(F.col("seq") <= end)).orderBy("seq").collect()]}
    return out


def all_chains(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """reg, def_seq, redefined_seq, n_uses, last_use for every definition: the chains of a whole trace in one pass."""
    from tracewright.operators.calls import ordered_next
    from tracewright.plans.ordered import ordered_last

    d = defs.select("reg", "seq").distinct()
    ends = ordered_next(d, ["reg"], ["seq"], F.col("seq"), "redefined_seq")
    both = uses.select("reg", "seq").distinct().select("reg", "seq", F.lit(0).alias("ord"), F.lit(None).cast("long").alias("def")).unionByName(d.select("reg", "seq", F.lit(1).alias("ord"), F.col("seq").alias("def")))
    met = ordered_last(both, ["reg"], ["seq", "ord"], F.col("def"), "def_seq").where("ord = 0 AND def_seq IS NOT NULL")
    sums = met.groupBy("reg", "def_seq").agg(F.count(F.lit(1)).alias("n_uses"), F.max("seq").alias("last_use"))
    return ends.withColumnRenamed("seq", "def_seq").join(sums, ["reg", "def_seq"], "left").withColumn("n_uses", F.coalesce("n_uses", F.lit(0)))
