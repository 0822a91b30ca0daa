"""What a tool or viewer asks for: the other operators put together, paged and decorated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.registers import to_hex
from tracewright.operators.search import CONSTANTS, Query, constant_scan, page
from tracewright.operators.slicing import parse_start, resolve, slice_lines, slice_stats, stack_only
from tracewright.operators.state import hexdump_text, memory_at, registers_at
from tracewright.plans.ordered import BUCKET, ordered_last

#: Rows of a page if nothing is said, and at most.
LINES_PAGE, SLICE_PAGE, FIRST_SLICE_PAGE, FUNCTIONS_PAGE, MEMORY_BYTES = (20, 100), (50, 200), (30, 200), (30, 100), (64, 256)
#: Lines of context at most, for slices and for constants; bytes of a visible summary; occurrences of a function shown.
SLICE_CONTEXT, CONSTANT_CONTEXT, SUMMARY_BYTES, OCCURRENCES = 5, 10, 80, 50


def _limit(count: int | None, bounds: tuple[int, int]) -> int:
    return min(bounds[0] if count is None else max(count, 0), bounds[1])


# --- lines ------------------------------------------------------------------------------------------------------------


def trace_page(shown: DataFrame, start: int, count: int | None = None) -> DataFrame:
    """Rows of a range of lines; a page has 20 if nothing is said and 100 at most."""
    return shown.where((F.col("seq") >= start) & (F.col("seq") < start + _limit(count, LINES_PAGE))).orderBy("seq")


def compact(shown: DataFrame, full: bool = False) -> DataFrame:
    """seq, line: the row as JSON without what is null or empty; the raw text only if full."""
    fields = [c for c in shown.columns if full or c != "raw"]
    given = [F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in shown.select(*fields).dtypes]
    return shown.select("seq", F.to_json(F.struct(*given)).alias("line"))


def visible_text(rw: Column, address: Column, disasm: Column, summary: Column, changes: Column) -> Column:
    """What a viewer shows of a line, a part to a line of text; empty parts are left out."""
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (rw, address, disasm, summary, changes)])


def _cut(text: Column, size: int) -> Column:
    """The first size bytes of a text, less what would split a character, and an ellipsis if some are left out."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, size).cast("string"))
    whole = F.regexp_replace(head, "\ufffd+$", "")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(whole, F.lit("...")))


def matches(shown: DataFrame, query: Query, notes: DataFrame | None = None) -> DataFrame:
    """The matching rows of shown (as `display` gives), with summary (cut) and hidden_content: the annotation's searchable
    text, if nothing that is visible matches. notes: seq, summary, searchable."""
    d = shown.withColumns({"_s": F.lit(None).cast("string"), "_n": F.lit(None).cast("string")}) if notes is None else shown.join(notes.select("seq", F.col("summary").alias("_s"), F.col("searchable").alias("_n")), "seq", "left")
    cut = _cut(F.col("_s"), SUMMARY_BYTES)
    seen = query.matches(visible_text(F.col("mem_rw"), F.col("address"), F.col("disasm"), cut, F.col("changes")))
    held = F.coalesce(query.matches(F.col("raw")), F.lit(False)) | F.coalesce(query.matches(F.col("_n")), F.lit(False))
    return d.where(held | seen).withColumns({"summary": cut, "hidden_content": F.when(~seen & query.matches(F.col("_n")), F.col("_n"))}).drop("_s", "_n")


# --- slices -----------------------------------------------------------------------------------------------------------


def start_spec(kind: str, name: str, size: int = 1, seq: int | None = None) -> str:
    """The text of a slice's start; seq counts from 0, the text's line from 1."""
    where = "last" if seq is None else str(seq + 1)
    return f"reg:{name.lower()}@{where}" if kind == "reg" else f"mem:{name}:{size}@{where}"


def kept_of_slice(tainted: DataFrame, insn: DataFrame, ignore_stack: bool = False, addresses: tuple[int, int] | None = None) -> DataFrame:
    """seq of the slice's lines, less those that only move the stack, and within a range of offsets (inclusive)."""
    out = tainted.select("seq")
    if ignore_stack:
        out = out.join(stack_only(insn), "seq", "left_anti")
    if addresses is not None:
        out = out.join(insn.where(F.col("insn_offset").between(*addresses)).select("seq"), "seq", "left_semi")
    return out


def sliced_page(tainted: DataFrame, insn: DataFrame, total_lines: int, offset: int = 0, count: int | None = None, context: int = 0, ignore_stack: bool = False, addresses: tuple[int, int] | None = None) -> DataFrame:
    """seq, tainted: a page of the slice's kept lines by seq, and up to five lines to each side of them."""
    own = page(kept_of_slice(tainted, insn, ignore_stack, addresses), ["seq"], offset, _limit(count, SLICE_PAGE))
    k = min(max(context, 0), SLICE_CONTEXT)
    near = own.select(F.explode(F.sequence(F.greatest(F.col("seq") - k, F.lit(0)), F.least(F.col("seq") + k, F.lit(total_lines - 1)))).alias("seq"), F.col("seq").alias("_own"))
    return near.groupBy("seq").agg(F.max(F.col("seq") == F.col("_own")).alias("tainted"))


def slice_and_page(spark, insn: DataFrame, edges: DataFrame, specs: list[str], total_lines: int, data_only: bool = False, external: DataFrame | None = None, include: int | None = None, ignore_stack: bool = False, addresses: tuple[int, int] | None = None, seqs: tuple[int | None, int | None] = (None, None)) -> tuple[DataFrame, DataFrame, dict]:
    """The slice, its first page and its totals (those of slice_stats, and after_filter, stack_filtered, has_more). include
    = 0 gives totals only."""
    tainted = slice_lines(spark, insn, edges, specs, data_only, external, *seqs)
    stats = slice_stats(tainted, total_lines)
    size = _limit(include, FIRST_SLICE_PAGE)
    after_stack = kept_of_slice(tainted, insn, ignore_stack and size > 0).count()
    after = kept_of_slice(tainted, insn, ignore_stack, addresses).count() if size else stats["marked_count"]
    first = page(kept_of_slice(tainted, insn, ignore_stack, addresses), ["seq"], 0, size)
    return tainted, first, stats | {"after_filter": after, "stack_filtered": stats["marked_count"] - after_stack, "has_more": after > size}


def resolve_or_last(insn: DataFrame, spec: str, total_lines: int, external: DataFrame | None = None) -> list[tuple[int, str]]:
    """As `resolve`, but a line that has no definition at or before it falls back to the last one of the trace."""
    start = parse_start(spec)
    if start.line is not None and start.line > total_lines:
        raise LookupError(f"the trace has {total_lines} lines: {spec}")
    found = resolve(insn, start, external)
    if not found and start.line is not None:
        found = resolve(insn, parse_start(f"{spec.rsplit('@', 1)[0]}@last"), external)
    if not found:
        raise LookupError(f"nothing defines {spec}")
    return found


def row_edges(edges: DataFrame, seq: int, part: str | None = None) -> DataFrame:
    """What a line (or one part of it) depends on directly."""
    own = edges.where(F.col("src_seq") == seq)
    return own if part is None else own.where(F.col("src_part").isin(part, "shared"))


# --- state ------------------------------------------------------------------------------------------------------------


def register_view(writes: DataFrame, insn: DataFrame, seq: int) -> DataFrame:
    """reg, name, value, changed, read after a line, and the line's own address as pc (its reg is null)."""
    line = insn.where(F.col("seq") == seq)
    changed = line.select(F.explode("defs").alias("reg")).distinct().withColumn("_changed", F.lit(True))
    read = line.select(F.explode("uses").alias("reg")).distinct().withColumn("_read", F.lit(True))
    own = registers_at(writes, seq).join(changed, "reg", "left").join(read, "reg", "left")
    no = F.lit(False)
    own = own.select("reg", "name", "value", F.coalesce("_changed", no).alias("changed"), F.coalesce("_read", no).alias("read"))
    return own.unionByName(line.select(F.lit(None).cast("int").alias("reg"), F.lit("pc").alias("name"), to_hex(F.col("insn_addr"), 16).alias("value"), no.alias("changed"), no.alias("read")))


def memory_view(records: DataFrame, addr: int, total_lines: int, seq: int | None = None, length: int | None = None) -> DataFrame:
    """hexdump_text of memory after a line, the last one if nothing is said; 64 bytes, or 256 at most."""
    return hexdump_text(memory_at(records, addr, total_lines - 1 if seq is None else seq, _limit(length, MEMORY_BYTES)))


def bytes_view(strings: DataFrame) -> DataFrame:
    """addr, row_addr, hex, ascii: the bytes of found strings (addr, content), 16 a row."""
    data = strings.select("addr", F.encode("content", "UTF-8").alias("_b"))
    rows = data.select("addr", "_b", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("_b"), F.lit(1)) - 1) / 16))).alias("_r"))
    digits = F.lower(F.hex(F.expr("substring(_b, CAST(16 * _r + 1 AS INT), 16)")))
    text = F.regexp_replace(F.decode(F.unhex(digits), "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    return rows.select("addr", (F.col("addr") + 16 * F.col("_r")).alias("row_addr"), F.trim(F.regexp_replace(digits, "(..)", "$1 ")).alias("hex"), text.alias("ascii"))


# --- calls ------------------------------------------------------------------------------------------------------------


def call_details(tree: DataFrame, writes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For each call id: func_addr, entry_seq, exit_seq, line_count, args (x0 to x7 after the entry line, null if unknown),
    returned (x0 after the exit line, if that is a later one), sub_calls (how many calls it makes itself)."""
    low = writes.where(F.col("reg") < 8).select("reg", "seq", "value")
    ask = tree.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("reg"), F.col("entry_seq").alias("seq"), "id", F.lit(False).alias("at_exit"))
    leave = tree.where("exit_seq > entry_seq").select(F.lit(0).alias("reg"), F.col("exit_seq").alias("seq"), "id", F.lit(True).alias("at_exit"))
    asked = ask.unionByName(leave).withColumns({"value": F.lit(None).cast("long"), "ord": F.lit(1)})
    given = low.withColumns({"id": F.lit(None).cast("long"), "at_exit": F.lit(False), "ord": F.lit(0)})
    # calls that end with the same line ask the same: id breaks the tie
    known = ordered_last(asked.unionByName(given), ["reg"], ["seq", "ord", "id"], F.col("value"), "found", bucket).where("ord = 1")
    args = F.transform(F.sort_array(F.collect_list(F.when(~F.col("at_exit"), F.struct("reg", "found")))), lambda a: a["found"])
    state = known.groupBy("id").agg(args.alias("args"), F.max(F.when(F.col("at_exit"), F.col("found"))).alias("returned"))
    below = tree.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    out = tree.join(state, "id").join(below, "id", "left")
    return out.select("id", "func_addr", "entry_seq", "exit_seq", (F.col("exit_seq") - F.col("entry_seq") + 1).alias("line_count"), "args", "returned", F.coalesce("_n", F.lit(0)).alias("sub_calls"))


def functions_page(annotations: DataFrame, offset: int = 0, count: int | None = None) -> DataFrame:
    """func_name, is_jni, calls, first_seq by the first call; 30 rows, or 100 at most."""
    found = annotations.groupBy("func_name").agg(F.min_by("is_jni", "seq").alias("is_jni"), F.count(F.lit(1)).alias("calls"), F.min("seq").alias("first_seq"))
    return page(found, ["first_seq", "func_name"], offset, _limit(count, FUNCTIONS_PAGE))


def occurrences(annotations: DataFrame, text: str) -> tuple[DataFrame, int, bool]:
    """The first 50 annotations whose name has a text, without regard to case; the total; whether some are left out."""
    own = annotations.where(F.contains(F.lower("func_name"), F.lit(text.lower())))
    total = own.count()
    return page(own, ["seq"], 0, OCCURRENCES), total, total > OCCURRENCES


def flat_tree(tree: DataFrame, expanded: list[int] | None = None) -> DataFrame:
    """id, depth in order of the calls: all of them, or those whose callers are all expanded (a list that a user made)."""
    if expanded is None:
        return tree.select("id", "depth").orderBy("id")
    spark = tree.sparkSession
    open_ = spark.createDataFrame([(x,) for x in expanded], "id long").distinct()
    own = tree.join(F.broadcast(open_), "id").select("id", "parent_id", "depth").collect()  # of the user's list only
    whole, seen = {0} & set(expanded), {r["id"]: r["parent_id"] for r in own}
    for i in sorted(seen):  # a caller's id is less than its calls'
        if seen[i] in whole:
            whole.add(i)
    shown = spark.createDataFrame([(x,) for x in sorted(whole)], "parent_id long")
    return tree.join(F.broadcast(shown), "parent_id", "left_semi").unionByName(tree.where("id = 0")).select("id", "depth").orderBy("id")


def virtual_to_seq(folds: DataFrame, index: int) -> int:
    """The line that a row shows, of folds as `fold_rows` gives them; a fold's row shows its first line."""
    before = folds.where(F.col("virtual_start") < index).agg(F.coalesce(F.sum("hidden"), F.lit(0))).first()[0]
    return index + before


def seq_to_virtual(folds: DataFrame, seq: int) -> int:
    """The row that shows a line, or the fold that has it."""
    inside = folds.where(F.lit(seq).between(F.col("entry_seq"), F.col("exit_seq"))).select("virtual_start").first()
    if inside is not None:
        return inside[0]
    return seq - folds.where(F.col("exit_seq") < seq).agg(F.coalesce(F.sum("hidden"), F.lit(0))).first()[0]


def reveal(tree: DataFrame, folded: list[int], seq: int) -> list[int]:
    """The folded calls that stay folded when a line within others is to be seen."""
    hiding = tree.where(F.col("id").isin(folded) & (F.col("entry_seq") < seq) & (F.col("exit_seq") >= seq)).select("id")
    gone = {r["id"] for r in hiding.collect()}
    return [x for x in folded if x not in gone]


# --- constants --------------------------------------------------------------------------------------------------------


def constants_in_context(lines: DataFrame, context: int = 3, constants: dict[str, tuple[int, ...]] | None = None, algorithm: str | None = None) -> DataFrame:
    """match_seq, algorithm, magic_hex, seq, is_match, raw: each match with up to ten lines to each side."""
    k = min(max(context, 0), CONSTANT_CONTEXT)
    found = constant_scan(lines, constants or CONSTANTS)
    if algorithm is not None:
        found = found.where(F.contains(F.lower("algorithm"), F.lit(algorithm.lower())))
    near = found.select(F.col("seq").alias("match_seq"), "algorithm", "magic_hex", F.explode(F.sequence(F.col("seq") - k, F.col("seq") + k)).alias("seq"))
    return near.join(lines.select("seq", "raw"), "seq").select("match_seq", "algorithm", "magic_hex", "seq", (F.col("seq") == F.col("match_seq")).alias("is_match"), "raw")
