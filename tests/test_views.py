"""Pages, details and decorated matches on the small trace."""

import pytest
from pyspark.sql import functions as F

from tests.test_trace import BANG, frame
from tracewright.functions.parsing import display, parse, special
from tracewright.operators import calls, deps, search, slicing, state, views


@pytest.fixture(scope="module")
def bang(spark):
    lines = frame(spark, BANG)
    return lines, parse(lines, "bang")


def test_constants_are_whole_numbers(spark):
    text = ["x0=0x428a2f98", "x0=0x00428a2f98ff", "x0=0x0000000071374491", "nzcv=0x80000000", "x=0xfff1", "x=0xfff12", "x=0xf3bcc90884caa73b", "x=0xd76aa4780", "0x5a827999 0xd76aa478"]
    got = {r["seq"]: (r["algorithm"], r["magic_hex"]) for r in search.constant_scan(frame(spark, text)).collect()}
    assert got == {0: ("SHA-256", "0x428a2f98"), 2: ("SHA-256", "0x71374491"), 4: ("Adler-32", "0xfff1"), 6: ("SHA-512", "0xf3bcc908"), 8: ("MD5", "0xd76aa478")}
    near = views.constants_in_context(frame(spark, text), 1, algorithm="adler").orderBy("seq").collect()
    assert [(r["seq"], r["is_match"]) for r in near] == [(3, False), (4, True), (5, False)]


@pytest.mark.parametrize("bucket", [2, 4, 100])
def test_runs_and_nearest(spark, bucket):
    seqs = [0, 1, 2, 3, 4, 6, 9, 10, 11, 12, 15, 16, 23, 24]
    d = spark.createDataFrame([(s,) for s in seqs], "seq long")
    assert sorted(tuple(r) for r in search.runs(d, bucket).select("first", "last", "n").collect()) == [(0, 4, 5), (6, 6, 1), (9, 12, 4), (15, 16, 2), (23, 24, 2)]
    for at in range(-1, 27):
        best = min(range(len(seqs)), key=lambda k: (abs(seqs[k] - at), k))
        assert tuple(search.nearest(d, at).first()) == (best, seqs[best])
    assert search.nearest(d.where("seq < 0"), 3).collect() == []


def test_slice_pages(spark, bang):
    lines, insn = bang
    edges, total = deps.dependencies(insn), len(BANG)
    tainted, first, stats = views.slice_and_page(spark, insn, edges, ["reg:x6@last"], total, data_only=True, include=2)
    own = sorted(r["seq"] for r in tainted.collect())
    assert own == [0, 1, 2, 3, 4] and [r["seq"] for r in first.orderBy("seq").collect()] == own[:2]
    assert (stats["marked_count"], stats["after_filter"], stats["has_more"]) == (5, 5, True)
    page = {r["seq"]: r["tainted"] for r in views.sliced_page(tainted, insn, total, 3, 1, 2).collect()}
    assert page == {1: False, 2: False, 3: True, 4: False, 5: False}
    kept = views.kept_of_slice(tainted, insn, addresses=(0x104, 0x10C))
    assert sorted(r["seq"] for r in kept.collect()) == [1, 2, 3]
    assert views.start_spec("reg", "X5", seq=4) == "reg:x5@5" and views.start_spec("mem", "0x10", 8) == "mem:0x10:8@last"
    assert views.resolve_or_last(insn, "reg:x6@1", total) == slicing.resolve(insn, slicing.parse_start("reg:x6@last"))
    with pytest.raises(LookupError):
        views.resolve_or_last(insn, "reg:x6@99", total)
    assert {r["dst_seq"] for r in views.row_edges(edges, 4).collect()} == {2, 3}


def test_a_definition_far_back_is_found(spark):
    rows = [(0, BANG[0])] + [(60_000, "[liba.so] 0x9000104!0x104 nop")]
    insn = parse(spark.createDataFrame(rows, "seq long, raw string"), "bang")
    start = slicing.parse_start("reg:x3@60001")
    assert slicing.resolve(insn, start) == [(0, "main")] and slicing.resolve(insn, start, look_back=50_000) == []


def test_matches_tell_what_is_hidden(spark, bang):
    lines, insn = bang
    notes, _ = calls.annotations(lines, insn)
    name = [F.col(c) for c in ("args", "func_name", "ret")]
    notes = notes.select("seq", calls.summary(*name).alias("summary"), calls.searchable(*name, F.col("raw_lines")).alias("searchable"))
    shown = display(lines, "bang")
    seen = views.matches(shown, search.Query("hello"), notes).collect()
    assert [(r["seq"], r["hidden_content"]) for r in seen] == [(5, None)] and "hello" in seen[0]["summary"]
    held = views.matches(shown, search.Query("args0"), notes).collect()
    assert [r["seq"] for r in held] == [5] and "args0: hello" in held[0]["hidden_content"]
    long = notes.withColumn("summary", F.lit("é" * 60))
    assert {r["summary"] for r in views.matches(shown, search.Query("blr"), long).collect()} == {"é" * 40 + "..."}
    assert [r["seq"] for r in views.matches(shown, search.Query("blr")).collect()] == [5]
    line = views.compact(shown).where("seq = 0").first()["line"]
    assert '"disasm":"mov x3, #7"' in line and "mem_rw" not in line and "raw" not in line
    assert views.trace_page(shown, 0).count() == 10 and views.trace_page(shown, 2, 3).count() == 3


def test_registers_memory_and_bytes(spark, bang):
    lines, insn = bang
    returns = special(lines).where("kind = 'ret'").select("seq", "value")
    view = {r["name"]: r for r in views.register_view(state.register_writes(insn, returns), insn, 4).collect()}
    assert (view["x6"]["value"], view["x6"]["changed"], view["x6"]["read"]) == ("0x0000000000000017", True, False)
    assert view["x4"]["read"] and view["pc"]["value"] == "0x0000000009000110"
    rows = views.memory_view(state.accesses(insn), 0x2008, len(BANG)).orderBy("row_addr").collect()
    assert len(rows) == 4 and rows[0]["hex"].split()[8] == "07"
    text = spark.createDataFrame([(0x1000, "ABCDEFGHIJKLMNOPé")], "addr long, content string")
    got = [tuple(r) for r in views.bytes_view(text).orderBy("row_addr").collect()]
    assert got == [(0x1000, 0x1000, "41 42 43 44 45 46 47 48 49 4a 4b 4c 4d 4e 4f 50", "ABCDEFGHIJKLMNOP"), (0x1000, 0x1010, "c3 a9", "..")]


def test_calls_and_folds(spark):
    tree = spark.createDataFrame([(0, None, 0, 99, None, 0), (1, 16, 10, 40, 0, 1), (2, 32, 20, 30, 1, 2), (3, 48, 50, 60, 0, 1)], "id long, func_addr long, entry_seq long, exit_seq long, parent_id long, depth long")
    writes = spark.createDataFrame([(0, 5, 7), (1, 10, 8), (0, 35, 9), (0, 60, 1), (9, 1, 1)], "reg int, seq long, value long")
    got = {r["id"]: (r["args"][:2], r["returned"], r["sub_calls"], r["line_count"]) for r in views.call_details(tree, writes, 16).collect()}
    assert got == {0: ([None, None], 1, 2, 100), 1: ([7, 8], 9, 1, 31), 2: ([7, 8], 7, 0, 11), 3: ([9, 8], 1, 0, 11)}
    flat = lambda x: [r["id"] for r in views.flat_tree(tree, x).collect()]
    assert flat(None) == [0, 1, 2, 3] and flat([0]) == [0, 1, 3] and flat([0, 1]) == [0, 1, 2, 3] and flat([1]) == [0]
    folds = calls.fold_rows(100, tree, [1, 2])
    rows = [s for s in range(100) if not 10 < s <= 40]
    for k in (0, 10, 11, 30, 69):
        assert views.virtual_to_seq(folds, k) == rows[k] and views.seq_to_virtual(folds, rows[k]) == k
    assert views.seq_to_virtual(folds, 33) == 10
    assert views.reveal(tree, [1, 2], 25) == [] and views.reveal(tree, [1, 2], 35) == [2] and views.reveal(tree, [1, 2], 10) == [1, 2]
    notes = spark.createDataFrame([(k, "free" if k % 2 else "Malloc", False) for k in range(120)], "seq long, func_name string, is_jni boolean")
    first, total, more = views.occurrences(notes, "malloc")
    assert (first.count(), total, more) == (50, 60, True)
    assert [(r["func_name"], r["calls"], r["first_seq"]) for r in views.functions_page(notes).collect()] == [("Malloc", 60, 0), ("free", 60, 1)]
