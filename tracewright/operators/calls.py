"""Calls: the call tree, the annotations of external calls, and functions by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.parsing import special
from tracewright.functions.registers import digits_of, hex_long, to_hex
from tracewright.plans.ordered import BUCKET, ordered_depth, ordered_last
from tracewright.plans.settled import settle

CALLS, BRANCHES = ("call", "call_reg"), ("call", "call_reg", "branch_reg")


def ordered_next(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """The first non-null value after each row: ordered_last of the reversed order."""
    back = [f"_back_{c}" for c in order]
    d = df.withColumns({b: -F.col(c) for b, c in zip(back, order, strict=True)})
    return ordered_last(d, keys, back, value, name, bucket).drop(*back)


def call_events(insn: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """seq, ord, step (1 call, -1 return), func_addr, exit_at (where a call left by this return ends).

    A register call whose next instruction is the one behind it went to code that the trace lacks: it returns at once,
    before that next instruction."""
    marks = insn.where(F.col("class").isin(*CALLS, "return") | F.col("insn_addr").isNotNull()).select("seq", "class", "insn_addr", "operands", "pre", "ops_text")
    marks = settle(marks)
    ahead = settle(ordered_next(marks, [], ["seq"], F.when(F.col("insn_addr").isNotNull(), F.struct("seq", "insn_addr")), "ahead", bucket).where(F.col("class").isin(*CALLS)))
    target = F.when(F.col("class") == "call", F.get("operands", F.lit(0))["imm"]).otherwise(hex_long(digits_of(F.col("pre"), F.lower(F.trim("ops_text")))))
    calls = ahead.where(F.col("class").isin(*CALLS)).select("seq", F.lit(1).alias("ord"), F.lit(1).alias("step"), target.alias("func_addr"), F.lit(None).cast("long").alias("exit_at"))
    returns = marks.where(F.col("class") == "return").select("seq", F.lit(1).alias("ord"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("func_addr"), F.col("seq").alias("exit_at"))
    passed = ahead.where((F.col("class") == "call_reg") & (F.col("ahead.insn_addr") == F.col("insn_addr") + 4))
    at_once = passed.select(F.col("ahead.seq").alias("seq"), F.lit(0).alias("ord"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("func_addr"), (F.col("ahead.seq") - 1).alias("exit_at"))
    return settle(calls.unionByName(returns).unionByName(at_once))


def call_tree(events: DataFrame, last_seq: int, first_addr: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """id, func_addr, entry_seq, exit_seq, parent_id, depth. Node 0 is the whole trace; ids follow the calls. A return with
    nothing open is ignored, an unclosed call ends with the trace."""
    d = settle(ordered_depth(events, ["seq", "ord"], F.col("step"), "depth", bucket))
    d = settle(ordered_depth(d, ["seq", "ord"], F.when(F.col("step") == 1, 1).otherwise(0), "id", bucket))
    calls = d.where("step = 1").select(F.col("depth").alias("level"), "seq", "ord", "id", "func_addr", "depth")
    ask = calls.select((F.col("level") - 1).alias("level"), "seq", "ord", "id", "func_addr", "depth", F.lit(None).cast("long").alias("found"))
    give = calls.select("level", "seq", "ord", "id", "func_addr", "depth", F.col("id").alias("found"))
    both = ask.withColumn("side", F.lit(0)).unionByName(give.withColumn("side", F.lit(1)))
    parents = ordered_last(both, ["level"], ["seq", "ord", "side"], F.col("found"), "parent_id", bucket).where("side = 0").select("id", "parent_id")
    # a return that leaves depth n has depth n - 1 after it
    leave = d.where("step = -1").select((F.col("depth") + 1).alias("level"), "seq", "ord", F.lit(None).cast("long").alias("id"), F.col("exit_at").alias("found"))
    enter = calls.select("level", "seq", "ord", "id", F.lit(None).cast("long").alias("found"))
    exits = ordered_next(enter.unionByName(leave), ["level"], ["seq", "ord"], F.col("found"), "exit_seq", bucket).where("id IS NOT NULL").select("id", "exit_seq")
    nodes = calls.join(parents, "id").join(exits, "id").select("id", "func_addr", F.col("seq").alias("entry_seq"), F.coalesce("exit_seq", F.lit(last_seq)).cast("long").alias("exit_seq"), F.coalesce("parent_id", F.lit(0)).cast("long").alias("parent_id"), "depth")
    root = events.sparkSession.range(1).select("id", F.lit(first_addr).cast("long").alias("func_addr"), F.lit(0).cast("long").alias("entry_seq"), F.lit(last_seq).cast("long").alias("exit_seq"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("depth"))
    return root.unionByName(nodes)


def named(tree: DataFrame, annotations: DataFrame) -> DataFrame:
    """The tree with func_name where its call has an annotation."""
    names = annotations.select(F.col("seq").alias("_at"), "func_name")
    return tree.join(names, tree["entry_seq"] == names["_at"], "left").drop("_at")


def children(tree: DataFrame, node: int, include_self: bool = True) -> DataFrame:
    wanted = F.col("parent_id") == node
    return tree.where(wanted | (F.col("id") == node) if include_self else wanted).orderBy("id")


def subtree(tree: DataFrame, node: int, depth: int, most: int = 500) -> DataFrame:
    """The node and what it calls, depth levels deep (1 to 3), in call order, at most `most` rows."""
    own = tree.where(F.col("id") == node).select(F.col("entry_seq").alias("_a"), F.col("exit_seq").alias("_b"), F.col("depth").alias("_d"), F.col("id").alias("_id"))
    inside = (F.col("entry_seq") >= F.col("_a")) & (F.col("entry_seq") <= F.col("_b")) & (F.col("depth") > F.col("_d")) | (F.col("id") == F.col("_id"))
    return tree.join(F.broadcast(own), inside).where(F.col("depth") <= F.col("_d") + max(1, min(3, depth))).drop("_a", "_b", "_d", "_id").orderBy("id").limit(most)


def containing(tree: DataFrame, seqs: DataFrame) -> DataFrame:
    """seqs: seq. seq, id of the innermost call that contains each."""
    size = 4096
    spans = tree.select("id", "entry_seq", "exit_seq", "depth", F.explode(F.sequence(F.floor(F.col("entry_seq") / size), F.floor(F.col("exit_seq") / size))).alias("_cell"))
    hit = seqs.withColumn("_cell", F.floor(F.col("seq") / size)).join(spans, "_cell").where("seq BETWEEN entry_seq AND exit_seq")
    return hit.groupBy("seq").agg(F.max_by("id", "depth").alias("id"))


def annotations(lines: DataFrame, insn: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """External calls (seq of the branch, call_seq, func_name, is_jni, args, ret, raw_lines) and the lines (seq) that they
    consume.

    A branch or call arms; the first `call func:` line after it opens its annotation; argument, hexdump and other special
    lines belong to it until `ret:` closes it or the next call line begins."""
    sp = special(lines).select("seq", "raw", "kind", "func_name", "is_jni", "arg_index", "value")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("raw", "string"), ("kind", "string"), ("func_name", "string"), ("is_jni", "boolean"), ("arg_index", "string"), ("value", "string"))]
    armed = insn.where(F.col("class").isin(*BRANCHES)).select("seq", *nothing, F.lit(True).alias("branch"))
    both = settle(armed.unionByName(sp.withColumn("branch", F.lit(False))))
    both = settle(ordered_last(both, [], ["seq"], F.when(F.col("branch"), F.col("seq")), "armed", bucket))
    both = settle(ordered_last(both, [], ["seq"], F.when(F.col("kind") == "call", F.col("seq")), "last_call", bucket))
    rows = both.where("NOT branch").withColumn("call_seq", F.when(F.col("kind") == "call", F.col("seq")).otherwise(F.col("last_call")))
    rows = rows.where("call_seq IS NOT NULL")
    closes = rows.where("kind = 'ret'").groupBy("call_seq").agg(F.min("seq").alias("_closed"))
    opens = rows.where("kind = 'call' AND armed IS NOT NULL AND (last_call IS NULL OR armed > last_call)").select("call_seq", F.col("armed").alias("branch_seq"))
    own = rows.join(opens, "call_seq").join(closes, "call_seq", "left").where("_closed IS NULL OR seq <= _closed")
    args = F.sort_array(F.collect_list(F.when(F.col("kind") == "arg", F.struct("seq", F.col("arg_index").alias("idx"), F.col("value").alias("val")))))
    raws = F.sort_array(F.collect_list(F.struct("seq", "raw")))
    found = own.groupBy("call_seq", "branch_seq").agg(F.max("func_name").alias("func_name"), F.max("is_jni").alias("is_jni"), F.max(F.when(F.col("kind") == "call", F.col("value"))).alias("_call"), args.alias("_args"), F.max(F.when(F.col("kind") == "ret", F.col("value"))).alias("ret"), raws.alias("_raws"))
    given = F.transform(F.filter(F.split("_call", ", *"), lambda x: x != ""), lambda x, i: F.struct(i.cast("string").alias("idx"), x.alias("val")))
    listed = F.transform("_args", lambda a: F.struct(a["idx"].alias("idx"), a["val"].alias("val")))
    out = found.select(F.col("branch_seq").alias("seq"), "call_seq", "func_name", "is_jni", F.when(F.size("_args") > 0, listed).otherwise(given).alias("args"), "ret", F.transform("_raws", lambda r: r["raw"]).alias("raw_lines"))
    return out, own.select("seq")


def summary(args: Column, name: Column, ret: Column) -> Column:
    """name("text", 0x1) -> ret: what is no hexadecimal number is quoted."""
    shown = F.transform(args, lambda a: F.when(a["val"].rlike("^0x[0-9a-fA-F]+$"), a["val"]).otherwise(F.concat(F.lit('"'), a["val"], F.lit('"'))))
    call = F.concat(name, F.lit("("), F.array_join(shown, ", "), F.lit(")"))
    return F.when(ret.isNotNull(), F.concat(call, F.lit(" → "), ret)).otherwise(call)


def tooltip(raw_lines: Column) -> Column:
    return F.array_join(raw_lines, "\n")


def hexdump(raw_lines: Column) -> Column:
    """The bytes of all hexdump rows of an annotation, as lowercase digits."""
    rows = F.filter(raw_lines, lambda r: r.rlike(r"^[0-9a-fA-F]+: "))
    return F.array_join(F.transform(rows, lambda r: F.regexp_replace(F.regexp_extract(r, r"^[0-9a-fA-F]+: ((?:[0-9a-fA-F]{2} ?)*)", 1), " ", "")), "")


def searchable(args: Column, name: Column, ret: Column, raw_lines: Column) -> Column:
    """All text of an annotation that a search may find: summary, lines, dumped bytes spaced, unspaced and as ASCII."""
    digits = hexdump(raw_lines)
    spaced = F.trim(F.regexp_replace(digits, "(..)", "$1 "))
    text = F.regexp_replace(F.decode(F.unhex(digits), "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    return F.concat_ws("\n", summary(args, name, ret), tooltip(raw_lines), F.nullif(spaced, F.lit("")), F.nullif(digits, F.lit("")), F.nullif(text, F.lit("")))


def functions(annotations: DataFrame) -> DataFrame:
    """func_name, is_jni (of the first), calls, first_seq, occurrences (seq, summary in order)."""
    a = annotations.withColumn("summary", summary(F.col("args"), F.col("func_name"), F.col("ret")))
    return a.groupBy("func_name").agg(F.min_by("is_jni", "seq").alias("is_jni"), F.count(F.lit(1)).alias("calls"), F.min("seq").alias("first_seq"), F.sort_array(F.collect_list(F.struct("seq", "summary"))).alias("occurrences"))


def find_functions(found: DataFrame, text: str = "", jni: bool | None = None) -> DataFrame:
    kept = found.where(F.contains(F.lower("func_name"), F.lit(text.lower()))) if text else found
    return kept if jni is None else kept.where(F.col("is_jni") == jni)


def rename(tree: DataFrame, aliases: DataFrame) -> DataFrame:
    """aliases: func_addr, alias. Users' names win."""
    return tree.join(aliases, "func_addr", "left").withColumn("func_name", F.coalesce("alias", "func_name")).drop("alias")


def fold_rows(total: int, tree: DataFrame, folded: list[int]) -> DataFrame:
    """The outermost folded calls: id, entry_seq, exit_seq, hidden (rows that vanish), virtual_start."""
    from pyspark.sql import Window as W

    own = tree.where(F.col("id").isin(folded)).select("id", "entry_seq", "exit_seq")
    order = W.partitionBy(F.lit(1)).orderBy("entry_seq", F.desc("exit_seq"))
    outer = own.withColumn("_reach", F.max("exit_seq").over(order.rowsBetween(W.unboundedPreceding, -1))).where("_reach IS NULL OR entry_seq > _reach")
    outer = outer.withColumn("hidden", F.col("exit_seq") - F.col("entry_seq"))
    before = F.coalesce(F.sum("hidden").over(W.partitionBy(F.lit(1)).orderBy("entry_seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return outer.select("id", "entry_seq", "exit_seq", "hidden", (F.col("entry_seq") - before).alias("virtual_start"))


def shown_address(tree: DataFrame, insn: DataFrame) -> DataFrame:
    """The tree with line_count, and func_offset: the module offset of the calling line, else the address."""
    at = insn.select(F.col("seq").alias("_s"), F.col("insn_offset").alias("_o"))
    return tree.join(at, tree["entry_seq"] == at["_s"], "left").withColumn("line_count", F.col("exit_seq") - F.col("entry_seq") + 1).withColumn("func_offset", to_hex(F.coalesce("_o", "func_addr"))).drop("_s", "_o")
