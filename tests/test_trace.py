"""Parsers, dependencies, slices, calls and state on small invented traces."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions.parsing import parse, special
from tracewright.operators import calls, deps, slicing, state, strings
from tracewright.plans.ordered import ordered_depth, ordered_last
from tracewright.plans.settled import settle
from tracewright.sources.traces import detect_format, read_lines

BANG = [
    "[liba.so] 0x9000100!0x100 mov x3, #7; x3=0x0 -> x3=0x7",
    "[liba.so] 0x9000104!0x104 str x3, [sp, #8]; x3=0x7 sp=0x2000 mem_w=0x2008",
    "[liba.so] 0x9000108!0x108 mov x5, #0x10; x5=0x0 -> x5=0x10",
    "[liba.so] 0x900010c!0x10c ldr x4, [sp, #8]; sp=0x2000 mem_r=0x2008 -> x4=0x7",
    "[liba.so] 0x9000110!0x110 add x6, x4, x5; x4=0x7 x5=0x10 -> x6=0x17",
    "[liba.so] 0x9000114!0x114 blr x9; x9=0x9100000",
    "call func: demo(0x2008)",
    "args0: hello",
    "ret: 0x5",
    "[liba.so] 0x9000118!0x118 mov x7, x0; x0=0x5 -> x7=0x5",
    "[liba.so] 0x900011c!0x11c stp x6, x7, [sp, #-0x10]!; x6=0x17 x7=0x5 sp=0x2000 mem_w=0x1ff0",
    "[liba.so] 0x9000120!0x120 ldp x1, x2, [sp], #0x10; sp=0x1ff0 mem_r=0x1ff0 -> x1=0x17 x2=0x5",
    "[liba.so] 0x9000124!0x124 ldr w8, [x1]; x1=0x17 mem_r=0x3000 -> w8=0x64636261",
]
QUOTED = [
    '[00:00:01 000][liba.so 0x100] [00000000] 0x1000100: "mov x3, #7" => x3=0x7',
    '[00:00:01 000][liba.so 0x104] [00000000] 0x1000104: "str x3, [sp, #8]" ; mem[WRITE] abs=0x2008 x3=0x7 sp=0x2000 => x3=0x7',
    '[00:00:01 000][liba.so 0x108] [00000000] 0x1000108: "ldr x4, [sp, #8]" ; mem[READ] abs=0x2008 sp=0x2000 => x4=0x7',
]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "seq long, raw string")


@pytest.fixture(scope="module")
def bang(spark):
    lines = frame(spark, BANG)
    insn = settle(parse(lines, "bang"))
    external = special(lines).where("kind = 'ret'").select("seq")
    return lines, insn, external


def test_fields_of_both_formats(spark, bang):
    rows = {r["seq"]: r for r in bang[1].collect()}
    assert rows[0]["mnemonic"] == "mov" and rows[0]["defs"] == [3] and rows[0]["uses"] == []
    assert rows[1]["mem"]["is_write"] and rows[1]["mem"]["abs"] == 0x2008 and rows[1]["mem"]["value"] == 7 and set(rows[1]["uses"]) == {3, 31}
    assert rows[10]["writeback"] and rows[10]["is_pair"] and rows[10]["mem"]["total_width"] == 16 and rows[10]["mem"]["value2"] == 5
    assert rows[12]["mem"]["elem_width"] == 4 and rows[12]["mem"]["value"] == 0x64636261
    q = {r["seq"]: r for r in parse(frame(spark, QUOTED), "quoted").collect()}
    assert q[1]["mem"]["is_write"] and q[1]["mem"]["abs"] == 0x2008 and q[1]["mem"]["value"] == 7
    assert not q[2]["mem"]["is_write"] and q[2]["mem"]["value"] == 7 and q[2]["insn_offset"] == 0x108


def test_slices_follow_registers_memory_and_external_returns(spark, bang):
    _, insn, external = bang
    edges = settle(deps.dependencies(insn, external, bucket=4))
    whole = lambda spec: [r["seq"] for r in slicing.slice_lines(spark, insn, edges, [spec], True, external).orderBy("seq").collect()]
    assert whole("reg:x6@last") == [0, 1, 2, 3, 4]
    assert whole("reg:x7@last") == [8, 9]
    # the pair's second half carries x7, its first x6
    assert whole("reg:x2@last") == [8, 9, 10, 11]
    assert whole("reg:x1@last") == [0, 1, 2, 3, 4, 10, 11]
    assert whole("mem:2008@last") == [0, 1]
    with pytest.raises(ValueError):
        slicing.parse_start("reg:x1")
    with pytest.raises(LookupError):
        slicing.slice_lines(spark, insn, edges, ["reg:x28@last"])


def test_closure_does_not_depend_on_ranges(bang):
    _, insn, external = bang
    edges = settle(deps.dependencies(insn, external, bucket=4))
    starts = slicing.resolve(insn, slicing.parse_start("reg:x2@last"), external)
    assert slicing.closure(edges, starts).tolist() == slicing.closure(edges, starts, at_once=3).tolist()


def test_load_flags(bang):
    flags = {r["seq"]: (r["init_mem"], r["pass_through"]) for r in deps.load_flags(deps.loaded_bytes(bang[1], 4)).collect()}
    assert flags[3] == (False, True) and flags[12] == (True, False)


def test_call_tree_and_annotations(bang):
    lines, insn, _ = bang
    notes, consumed = calls.annotations(lines, insn, 4)
    row = notes.withColumn("s", calls.summary(F.col("args"), F.col("func_name"), F.col("ret"))).first()
    assert (row["seq"], row["func_name"], row["s"]) == (5, "demo", 'demo("hello") → 0x5')
    assert sorted(r["seq"] for r in consumed.collect()) == [6, 7, 8]
    tree = {r["id"]: r for r in calls.named(calls.call_tree(calls.call_events(insn, 4), 12, None, 4), notes).collect()}
    assert (tree[1]["entry_seq"], tree[1]["exit_seq"], tree[1]["parent_id"], tree[1]["func_name"]) == (5, 8, 0, "demo")


def test_registers_and_memory(spark, bang):
    lines, insn, _ = bang
    returns = special(lines).where("kind = 'ret'").select("seq", "value")
    at = {r["name"]: r["value"] for r in state.registers_at(state.register_writes(insn, returns), 9).collect()}
    assert at["x0"] == "0x0000000000000005" and at["x4"] == "0x0000000000000007" and at["x1"] == "?"
    rec = state.accesses(insn)
    got = {r["addr"]: (r["byte"], r["known"]) for r in state.memory_at(rec, 0x2008, 12).collect()}
    assert got[0x2008] == (7, True) and got[0x2000] == (0, False)
    chain = state.def_use_chain(deps.reg_defs(insn), deps.reg_uses(insn), 3, 4)
    assert chain == {"def_seq": None, "redefined_seq": None, "uses": [4]}


def test_strings(spark):
    rows = [(0x1000, 1, "W", int.from_bytes(b"Hell", "little"), 4), (0x1004, 2, "W", ord("o"), 1), (0x1000, 3, "W", int.from_bytes(b"\0\0\0\0", "little"), 4), (0x9000, 4, "W", int.from_bytes(b"ok\0\0", "little"), 4)]
    rec = spark.createDataFrame(rows, "addr long, seq long, rw string, data long, size int")
    got = {(r["addr"], r["content"], r["seq"]) for r in strings.find_strings(rec).collect()}
    assert got == {(0x1000, "Hello", 2), (0x9000, "ok", 4)}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = tmp_path / "t.log"
    path.write_bytes(b"".join(b"[m] 0x%x!0x%x nop\r\n" % (k, k) for k in range(500)) + b"last \xff")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = read_lines(spark, f"file://{path}").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["seq"] for r in got] == list(range(501)) and got[7]["raw"] == "[m] 0x7!0x7 nop" and got[500]["raw"] == "last \\xff"
    assert detect_format(frame(spark, BANG)) == "bang" and detect_format(frame(spark, QUOTED)) == "quoted"


@pytest.mark.parametrize("bucket", [3, 7, 1000])
def test_ordered_scans_equal_plain_loops(spark, bucket):
    rows = [(k, k * 7 % 3, k if k * 5 % 4 == 0 else None, (1, -1, -1, 1, 0)[k % 5]) for k in range(60)]
    df = spark.createDataFrame(rows, "seq long, key long, v long, step int")
    last, want = {}, {}
    for s, key, v, _ in rows:
        want[s] = last.get(key)
        last[key] = v if v is not None else last.get(key)
    assert {r["seq"]: r["got"] for r in ordered_last(df, ["key"], ["seq"], F.col("v"), "got", bucket).collect()} == want
    depth, level = {}, 0
    for s, _, _, step in rows:
        level = max(0, level + step)
        depth[s] = level
    assert {r["seq"]: r["got"] for r in ordered_depth(df, ["seq"], F.col("step"), "got", bucket).collect()} == depth


def test_decoding(spark):
    """Quotes near a line's start, register pairs, lanes by their half, lanes of lists, and system calls."""
    lines = [
        '[a 0x1][l 0x3] [6] 0x4: "mov x3, #7" => x3=0x7',
        '[00:00:01 000][m 0x1] [0] 0x4: "casp x0, x1, x2, x3, [x4]" => x0=0x1',
        '[00:00:01 000][m 0x1] [0] 0x4: "umov w0, v1.s[3]"',
        '[00:00:01 000][m 0x1] [0] 0x4: "fmov x0, v1.d[0]"',
        '[00:00:01 000][m 0x1] [0] 0x4: "ins v2.d[1], x5"',
        '[00:00:01 000][m 0x1] [0] 0x4: "ld1 {v0.s}[1], [x9]"',
        '[00:00:01 000][m 0x1] [0] 0x4: "svc #0" => x0=0x1 x1=0x2',
        '[00:00:01 000][m 0x1] [0] 0x4: "ldp x29, x30, [sp], #0x10" ; mem[READ] abs=0x10 sp=0x10 => fp=0x5 lr=0x6',
        "[00:00:01 000][m 0x1] no instruction",
    ]
    got = {r["seq"]: r for r in parse(frame(spark, lines), "quoted").collect()}
    assert sorted(got) == list(range(8))
    sets = {k: (r["defs"], r["uses"]) for k, r in got.items()}
    assert sets[0] == ([3], []) and sets[1] == ([0, 1], [0, 1, 2, 3, 4])
    assert sets[2] == ([0], [34 + 33]) and sets[3] == ([0], [34])
    assert sets[4] == ([35, 68], [35, 68, 5]) and got[5]["class"] == "simd_lane_load" and got[5]["lane_index"] == 1
    assert sets[6] == ([0, 1], [])
    assert (got[7]["mem"]["value"], got[7]["mem"]["value2"], sets[7][0]) == (5, 6, [29, 30, 31])
