"""The trace operators as queries over the tables of a folder, each with SQL that says what it must return.

`events` is rendered as a trace: a line of text for each event. The queries read that text with the parsers; the SQL works
from the columns of `events`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.parsing import parse
from tracewright.functions.registers import reg_name
from tracewright.operators import calls, deps, search, slicing, state, strings, views
from tracewright.plans.ordered import BUCKET, ordered_last
from tracewright.plans.settled import settle

HEX = "lower(hex({}))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, raw: the events as lines of a BANG trace, written as a real one would be."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "CAST(floor(value * 100) AS BIGINT) AS data", "user_id", "user_id % 29 AS r", "(user_id * 7 + event_id) % 29 AS r2", "4096 + 8 * user_id + event_id % 8 AS addr", "CAST(element_at(array(1, 2, 4, 8), CAST(event_id % 4 AS INT) + 1) AS INT) AS width",
        "CASE event_type WHEN 'click' THEN 'def' WHEN 'view' THEN 'use' WHEN 'purchase' THEN 'store' WHEN 'signup' THEN 'load' ELSE element_at(array('cond', 'call', 'ret'), CAST(event_id % 3 AS INT) + 1) END AS kind", "65536 + 4 * (event_id % 1000) AS pc",
    )
    h = HEX.format
    suffix = "CASE width WHEN 1 THEN 'b' WHEN 2 THEN 'h' ELSE '' END"
    name = "concat(CASE WHEN width = 8 THEN 'x' ELSE 'w' END, r)"
    body = f"""CASE kind
        WHEN 'def' THEN concat('mov x', r, ', #0x', {h('data')}, '; x', r, '=0x', {h('user_id')}, ' -> x', r, '=0x', {h('data')})
        WHEN 'use' THEN concat('add x', r2, ', x', r, ', #1; x', r, '=0x', {h('data')}, ' -> x', r2, '=0x', {h('data + 1')})
        WHEN 'store' THEN concat('str', {suffix}, ' ', {name}, ', [x', r2, ', #8]; ', {name}, '=0x', {h('data')}, ' x', r2, '=0x', {h('addr - 8')}, ' mem_w=0x', {h('addr')})
        WHEN 'load' THEN concat('ldr', {suffix}, ' ', {name}, ', [x', r2, ']; x', r2, '=0x', {h('addr')}, ' mem_r=0x', {h('addr')}, ' -> ', {name}, '=0x', {h('data')})
        WHEN 'cond' THEN concat('b.eq #0x', {h('pc + 64')}) WHEN 'call' THEN concat('bl #0x', {h('pc + 4096')}) ELSE 'ret' END"""
    return settle(e.select("seq", F.expr(f"concat('[libdemo.so] 0x', {h('481036337152 + pc')}, '!0x', {h('pc')}, ' ', {body})").alias("raw")))


_INDEX: dict[tuple[str, str], DataFrame] = {}


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed trace, made once for each application and folder: the index that the other queries read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEX:
        _INDEX[key] = settle(parse(trace(spark, sf_dir), "bang"))
    return _INDEX[key]


#: The same events for SQL.
_E = """e AS (SELECT event_id AS seq, CAST(floor(value * 100) AS BIGINT) AS data, user_id, user_id % 29 AS r, (user_id * 7 + event_id) % 29 AS r2,
  4096 + 8 * user_id + event_id % 8 AS addr, [1, 2, 4, 8][event_id % 4 + 1] AS width, 65536 + 4 * (event_id % 1000) AS pc,
  CASE event_type WHEN 'click' THEN 'def' WHEN 'view' THEN 'use' WHEN 'purchase' THEN 'store' WHEN 'signup' THEN 'load' ELSE ['cond', 'call', 'ret'][event_id % 3 + 1] END AS kind
  FROM events)"""
_M = _E + """, m AS (SELECT *, CASE width WHEN 1 THEN data & 255 WHEN 2 THEN data & 65535 WHEN 4 THEN data & 4294967295 ELSE data END AS v FROM e)"""
_REGS = _M + """, d AS (SELECT CASE kind WHEN 'use' THEN r2 WHEN 'call' THEN 30 ELSE r END AS reg, seq FROM m WHERE kind IN ('def', 'use', 'load', 'call')),
u AS (SELECT r AS reg, seq FROM m WHERE kind IN ('use', 'store') UNION SELECT r2, seq FROM m WHERE kind IN ('store', 'load') UNION SELECT 65, seq FROM m WHERE kind = 'cond' UNION SELECT 30, seq FROM m WHERE kind = 'ret')"""
_BYTES = _REGS + """, b AS (SELECT seq, kind, v, width, addr + unnest(range(width)) AS byte_addr FROM m WHERE kind IN ('store', 'load')),
w AS (SELECT *, last_value(CASE WHEN kind = 'store' THEN seq END IGNORE NULLS) OVER (PARTITION BY byte_addr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_seq FROM b),
l AS (SELECT w.seq, w.byte_addr, w.v, w.def_seq, s.v AS stored FROM w LEFT JOIN m s ON s.seq = w.def_seq WHERE w.kind = 'load'),
f AS (SELECT seq, count(*) FILTER (def_seq IS NULL) > 0 AS init_mem, count(*) FILTER (def_seq IS NULL) = 0 AND min(def_seq) = max(def_seq) AND max(v) = max(stored) AS pass_through FROM l GROUP BY seq)"""
_EDGES = _BYTES + """, ru AS (SELECT reg, seq, 0 AS ord, CAST(NULL AS BIGINT) AS def FROM u UNION ALL SELECT reg, seq, 1, seq FROM d),
rl AS (SELECT *, last_value(def IGNORE NULLS) OVER (PARTITION BY reg ORDER BY seq, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ru),
re AS (SELECT DISTINCT seq AS src_seq, last AS dst_seq FROM rl WHERE ord = 0 AND last IS NOT NULL),
me AS (SELECT DISTINCT seq AS src_seq, def_seq AS dst_seq FROM l WHERE def_seq IS NOT NULL),
ce AS (SELECT seq AS src_seq, last_value(CASE WHEN kind = 'cond' THEN seq END IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dst_seq FROM e),
de AS (SELECT * FROM re WHERE src_seq NOT IN (SELECT seq FROM f WHERE pass_through) UNION SELECT * FROM me)"""


def q_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of parsed lines."""
    return instructions(spark, sf_dir).select(
        "seq", "mnemonic", "insn_addr", "insn_offset", "module", F.size("operands").cast("long").alias("n_operands"), F.col("mem.is_write").alias("is_write"), F.col("mem.abs").alias("mem_addr"), F.col("mem.elem_width").cast("long").alias("mem_width"), F.col("mem.value").alias("mem_value"), "has_arrow",
    )


SQL_PARSE = f"""WITH {_M} SELECT seq, CASE kind WHEN 'def' THEN 'mov' WHEN 'use' THEN 'add' WHEN 'cond' THEN 'b.eq' WHEN 'call' THEN 'bl' WHEN 'ret' THEN 'ret'
  WHEN 'store' THEN 'str' || CASE width WHEN 1 THEN 'b' WHEN 2 THEN 'h' ELSE '' END ELSE 'ldr' || CASE width WHEN 1 THEN 'b' WHEN 2 THEN 'h' ELSE '' END END AS mnemonic,
  481036337152 + pc AS insn_addr, pc AS insn_offset, 'libdemo.so' AS module, CAST(CASE kind WHEN 'use' THEN 3 WHEN 'cond' THEN 1 WHEN 'call' THEN 1 WHEN 'ret' THEN 0 ELSE 2 END AS BIGINT) AS n_operands,
  CASE WHEN kind IN ('store', 'load') THEN kind = 'store' END AS is_write, CASE WHEN kind IN ('store', 'load') THEN addr END AS mem_addr, CAST(CASE WHEN kind IN ('store', 'load') THEN width END AS BIGINT) AS mem_width,
  CASE WHEN kind IN ('store', 'load') THEN v END AS mem_value, kind IN ('def', 'use', 'load') AS has_arrow FROM m"""


def q_def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and the registers defined and used."""
    i = instructions(spark, sf_dir)
    d = i.select("seq", "class", F.explode("defs").alias("reg"), F.lit("def").alias("role"))
    return d.unionByName(i.select("seq", "class", F.explode("uses").alias("reg"), F.lit("use").alias("role"))).select("seq", "class", F.col("reg").cast("long").alias("reg"), reg_name(F.col("reg")).alias("name"), "role")


SQL_DEF_USE = f"""WITH {_REGS}, c AS (SELECT seq, CASE kind WHEN 'def' THEN 'alu' WHEN 'use' THEN 'alu' WHEN 'cond' THEN 'cond_branch' WHEN 'ret' THEN 'return' ELSE kind END AS class FROM e),
x AS (SELECT DISTINCT seq, reg, 'def' AS role FROM d UNION ALL SELECT DISTINCT seq, reg, 'use' FROM u)
SELECT x.seq, class, CAST(reg AS BIGINT) AS reg, CASE WHEN reg < 29 THEN 'x' || reg WHEN reg = 30 THEN 'lr' ELSE 'nzcv' END AS name, role FROM x JOIN c USING (seq)"""


def q_register_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last definition before each use, by the two-level scan."""
    return deps.register_edges(instructions(spark, sf_dir), bucket=BUCKET).select("src_seq", "dst_seq").distinct()


def q_memory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last store to each loaded byte."""
    return deps.memory_edges(deps.loaded_bytes(instructions(spark, sf_dir), BUCKET)).select("src_seq", "dst_seq").distinct()


def q_load_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of memory never stored, and loads that pass a stored value on."""
    return deps.load_flags(deps.loaded_bytes(instructions(spark, sf_dir), BUCKET))


def q_control_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last conditional branch before each line."""
    return deps.control_edges(instructions(spark, sf_dir), BUCKET).select("src_seq", "dst_seq")


def q_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph, register edges of pass-through loads dropped."""
    return deps.dependencies(instructions(spark, sf_dir), bucket=BUCKET).select("src_seq", "dst_seq", "kind").distinct()


SQL_DEPENDENCIES = f"WITH {_EDGES} SELECT src_seq, dst_seq, 'data' AS kind FROM de UNION SELECT src_seq, dst_seq, 'control' FROM ce WHERE dst_seq IS NOT NULL"


def q_last_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last definition of each register and last store to each byte."""
    i = instructions(spark, sf_dir)
    r = deps.reg_last_def(i).select(F.lit("reg").alias("what"), F.col("reg").cast("long").alias("key"), "seq")
    return r.unionByName(deps.mem_last_def(i).select(F.lit("mem").alias("what"), F.col("addr").alias("key"), "seq"))


def q_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data slice of the last definition of x5."""
    i = instructions(spark, sf_dir)
    return slicing.slice_lines(spark, i, settle(deps.dependencies(i, bucket=BUCKET)), ["reg:x5@last"], data_only=True)


SQL_SLICE = f"WITH RECURSIVE {_EDGES}, z AS (SELECT max(seq) AS seq FROM d WHERE reg = 5 UNION SELECT de.dst_seq FROM z JOIN de ON de.src_seq = z.seq) SELECT seq FROM z WHERE seq IS NOT NULL"


def q_slice_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest distance of every line in the dependency graph of the last definition of x7."""
    i = instructions(spark, sf_dir)
    starts = slicing.resolve(i, slicing.parse_start("reg:x7@last"))
    depth, _ = slicing.reach(settle(deps.dependencies(i, bucket=BUCKET)), starts, data_only=True)
    return spark.createDataFrame([(k >> 2, v) for k, v in depth.items()], "seq long, depth long").groupBy("seq").agg(F.min("depth").alias("depth"))


SQL_SLICE_DEPTH = f"""WITH RECURSIVE {_EDGES}, z AS (SELECT max(seq) AS seq, 0 AS depth FROM d WHERE reg = 7 UNION SELECT de.dst_seq, depth + 1 FROM z JOIN de ON de.src_seq = z.seq WHERE depth < 64)
SELECT seq, CAST(min(depth) AS BIGINT) AS depth FROM z WHERE seq IS NOT NULL GROUP BY seq"""


def q_call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each call by the clamped running sum; parents and exits."""
    i = instructions(spark, sf_dir)
    last = i.agg(F.max("seq")).first()[0]
    return calls.call_tree(calls.call_events(i, BUCKET), last, 0, BUCKET).where("id > 0").select("id", "entry_seq", "exit_seq", "parent_id", "depth")


SQL_CALL_TREE = f"""WITH {_E}, c AS (SELECT seq, CASE kind WHEN 'call' THEN 1 ELSE -1 END AS step FROM e WHERE kind IN ('call', 'ret')),
s AS (SELECT *, sum(step) OVER (ORDER BY seq) AS run FROM c), t AS (SELECT *, CAST(run - least(0, min(run) OVER (ORDER BY seq)) AS BIGINT) AS depth FROM s),
n AS (SELECT row_number() OVER (ORDER BY seq) AS id, seq, depth FROM t WHERE step = 1)
SELECT n.id, n.seq AS entry_seq, coalesce((SELECT min(x.seq) FROM t x WHERE x.step = -1 AND x.depth = n.depth - 1 AND x.seq > n.seq), (SELECT max(seq) FROM e)) AS exit_seq,
coalesce((SELECT max(p.id) FROM n p WHERE p.depth = n.depth - 1 AND p.seq < n.seq), 0) AS parent_id, n.depth FROM n"""


def q_registers_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register values after line 5000."""
    i = instructions(spark, sf_dir)
    return state.registers_at(state.register_writes(i), 5000).select(F.col("reg").cast("long").alias("reg"), "name", "value")


SQL_REGISTERS_AT = f"""WITH {_M}, w AS (SELECT CASE kind WHEN 'use' THEN r2 ELSE r END AS reg, seq, CASE kind WHEN 'use' THEN data + 1 ELSE data END AS v FROM m WHERE kind IN ('def', 'use', 'load') AND seq <= 5000),
k AS (SELECT reg, arg_max(v, seq) AS v FROM w GROUP BY reg), a AS (SELECT unnest(range(32)) AS reg UNION ALL SELECT 65)
SELECT CAST(a.reg AS BIGINT) AS reg, CASE WHEN a.reg < 29 THEN 'x' || a.reg WHEN a.reg = 29 THEN 'fp' WHEN a.reg = 30 THEN 'lr' WHEN a.reg = 31 THEN 'sp' ELSE 'nzcv' END AS name,
CASE WHEN k.v IS NULL THEN '?' ELSE '0x' || lpad(lower(to_hex(k.v)), 16, '0') END AS value FROM a LEFT JOIN k ON a.reg = k.reg"""


def q_memory_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3: 256 bytes of memory after line 7000."""
    return state.memory_at(state.accesses(instructions(spark, sf_dir)), 4096, 7000, 256).select("addr", F.col("byte").cast("long").alias("byte"), "known")


SQL_MEMORY_AT = f"""WITH {_M}, b AS (SELECT addr + k AS a, seq, (v >> (8 * k)) & 255 AS byte FROM m, range(8) t(k) WHERE kind IN ('store', 'load') AND k < width AND seq <= 7000),
k AS (SELECT a, arg_max(byte, seq) AS byte FROM b GROUP BY a), r AS (SELECT unnest(range(4096, 4352)) AS addr)
SELECT r.addr, CAST(coalesce(k.byte, 0) AS BIGINT) AS byte, k.byte IS NOT NULL AS known FROM r LEFT JOIN k ON k.a = r.addr"""


def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M4, M5: a page of the accesses at the most used address."""
    rec = settle(state.accesses(instructions(spark, sf_dir)))
    top = rec.groupBy("addr").count().orderBy(F.desc("count"), "addr").first()["addr"]
    return state.history_page(rec, top, 2, 10).select(F.col("position").cast("long").alias("position"), "seq", "rw", "data", F.col("size").cast("long").alias("size"))


SQL_HISTORY = f"""WITH {_M}, a AS (SELECT * FROM m WHERE kind IN ('store', 'load')), t AS (SELECT addr FROM a GROUP BY addr ORDER BY count(*) DESC, addr LIMIT 1),
h AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS position, seq, CASE kind WHEN 'store' THEN 'W' ELSE 'R' END AS rw, v AS data, CAST(width AS BIGINT) AS size FROM a WHERE addr = (SELECT addr FROM t))
SELECT * FROM h WHERE position BETWEEN 2 AND 11"""


def q_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every definition its redefinition and uses."""
    i = instructions(spark, sf_dir)
    c = state.all_chains(deps.reg_defs(i), deps.reg_uses(i))
    return c.select(F.col("reg").cast("long").alias("reg"), "def_seq", "redefined_seq", "n_uses", "last_use")


SQL_CHAINS = f"""WITH {_REGS}, dd AS (SELECT DISTINCT reg, seq FROM d), x AS (SELECT reg, seq AS def_seq, lead(seq) OVER (PARTITION BY reg ORDER BY seq) AS redefined_seq FROM dd)
SELECT CAST(x.reg AS BIGINT) AS reg, def_seq, redefined_seq, count(DISTINCT u.seq) AS n_uses, max(u.seq) AS last_use FROM x
LEFT JOIN u ON u.reg = x.reg AND u.seq > def_seq AND (redefined_seq IS NULL OR u.seq <= redefined_seq) GROUP BY ALL"""


def q_string_xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads based in each of a set of ranges, and their first records."""
    rec = settle(state.accesses(instructions(spark, sf_dir)))
    ranges = spark.range(8).select((4096 + F.col("id") * 128).alias("addr"), F.col("id").alias("seq"), F.lit(64).alias("byte_len"))
    return strings.with_xrefs(ranges, rec).select("addr", F.col("xref_count").cast("long").alias("xref_count"))


SQL_STRING_XREFS = f"WITH {_M} SELECT 4096 + k * 128 AS addr, count(m.seq) AS xref_count FROM range(8) t(k) LEFT JOIN m ON m.kind = 'load' AND m.addr BETWEEN 4096 + k * 128 AND 4096 + k * 128 + 63 GROUP BY k"


def q_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that appear in memory."""
    return strings.find_strings(state.accesses(instructions(spark, sf_dir)))


def q_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The independent stretches of memory that the string tracker works on."""
    return strings.islands(state.accesses(instructions(spark, sf_dir))).groupBy("island").agg(F.count(F.lit(1)).alias("n"))


SQL_ISLANDS = f"""WITH {_M}, a AS (SELECT addr, addr + width AS fin, seq FROM m WHERE kind IN ('store', 'load')),
g AS (SELECT *, max(fin) OVER (ORDER BY addr, fin, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
h AS (SELECT *, last_value(CASE WHEN reach IS NULL OR addr > reach THEN addr END IGNORE NULLS) OVER (ORDER BY addr, fin, seq) AS island FROM g) SELECT island, count(*) AS n FROM h GROUP BY island"""


def _lines_of(name: str, text: str, key: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, name).select(F.col(key).alias("seq"), F.col(text).alias("raw"))


def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q5: every mode of search over the documents."""
    lines = _lines_of("documents", "text", "doc_id")(spark, sf_dir)
    modes = {"plain": search.Query("THE ER"), "case": search.Query("The", case_sensitive=True), "fuzzy": search.Query("the of and", fuzzy=True), "regex": search.Query("th[aeiou]n{1,2}d", use_regex=True), "slashes": search.Query("/[A-Z]r.ti/")}
    out = None
    for name, q in modes.items():
        found = search.search(lines, q).withColumn("mode", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


SQL_SEARCH = r"""SELECT doc_id AS seq, 'plain' AS mode FROM documents WHERE contains(lower(text), 'the er') UNION ALL SELECT doc_id, 'case' FROM documents WHERE contains(text, 'The')
UNION ALL SELECT doc_id, 'fuzzy' FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of') AND contains(lower(text), 'and')
UNION ALL SELECT doc_id, 'regex' FROM documents WHERE regexp_matches(text, '(?i)th[aeiou]n{1,2}d') UNION ALL SELECT doc_id, 'slashes' FROM documents WHERE regexp_matches(text, '[A-Z]r.ti')"""


def q_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6-Q8, Q11: rows 20 to 39 of the lines of a range that write memory."""
    found = search.in_ranges(search.search(trace(spark, sf_dir), search.Query("mem_w=")), seqs=(1000, 9000))
    return search.page(found, ["seq"], 20, 20)


SQL_SEARCH_PAGE = f"WITH {_E} SELECT seq FROM e WHERE kind = 'store' AND seq BETWEEN 1000 AND 9000 ORDER BY seq LIMIT 20 OFFSET 20"


_TABLE = [(name, f"{v:x}") for name, values in search.CONSTANTS.items() for v in values]


def constant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, raw: a line for each event with a constant of the shipped table: alone, begun by another digit, continued by
    one digit, and as the upper half of 64 bits."""
    digits = ", ".join(f"'{h}'" for _, h in _TABLE)
    number = f"element_at(array({digits}), CAST(event_id % {len(_TABLE)} AS INT) + 1)"
    shown = f"CASE event_id % 4 WHEN 0 THEN {number} WHEN 1 THEN concat('f', {number}) WHEN 2 THEN concat({number}, '0') ELSE concat({number}, 'deadbeef') END"
    return table(spark, sf_dir, "events").selectExpr("event_id AS seq", f"concat('ldr x0, [x1]; x1=0x', {HEX.format('user_id % 64')}, ' -> x0=0x', {shown}) AS raw")


def q_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K3: constants of the shipped table in the lines."""
    return search.constant_scan(constant_lines(spark, sf_dir))


_FOUND = f"""c AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{name}', '{h}')" for k, (name, h) in enumerate(_TABLE))}) v(k, name, h)), one AS (SELECT h, arg_min(name, k) AS name FROM c GROUP BY h),
found AS (SELECT event_id AS seq, one.name AS algorithm, '0x' || one.h AS magic_hex FROM events JOIN c ON c.k = event_id % {len(_TABLE)} JOIN one USING (h) WHERE event_id % 4 = 0 OR event_id % 4 = 3 AND length(one.h) = 8)"""
SQL_CONSTANTS = f"WITH {_FOUND} SELECT * FROM found"


def q_constants_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5: each constant of one family with two lines to each side."""
    return views.constants_in_context(constant_lines(spark, sf_dir), 2, algorithm="sha").drop("raw")


SQL_CONSTANTS_IN_CONTEXT = f"""WITH {_FOUND} SELECT found.seq AS match_seq, algorithm, magic_hex, event_id AS seq, event_id = found.seq AS is_match
FROM found JOIN events ON event_id BETWEEN found.seq - 2 AND found.seq + 2 WHERE contains(lower(algorithm), 'sha')"""


def q_sliced_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 2 to 41 of the slice of x5, with three lines to each side."""
    i = instructions(spark, sf_dir)
    total = i.agg(F.max("seq")).first()[0] + 1
    tainted = slicing.slice_lines(spark, i, settle(deps.dependencies(i, bucket=BUCKET)), ["reg:x5@last"], data_only=True)
    return views.sliced_page(tainted, i, total, 2, 40, 3)


SQL_SLICED_PAGE = SQL_SLICE.replace("SELECT seq FROM z WHERE seq IS NOT NULL", "") + """, p AS (SELECT DISTINCT seq FROM z WHERE seq IS NOT NULL ORDER BY seq LIMIT 40 OFFSET 2)
SELECT event_id AS seq, bool_or(event_id = p.seq) AS tainted FROM p JOIN events ON event_id BETWEEN p.seq - 3 AND p.seq + 3 GROUP BY event_id"""


def q_register_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers after the line at three quarters of the trace, what it changed and read, and its address."""
    i = instructions(spark, sf_dir)
    at = i.agg(F.max("seq")).first()[0] * 3 // 4
    return views.register_view(state.register_writes(i), i, at).select("name", "value", "changed", "read")


SQL_REGISTER_VIEW = f"""WITH {_REGS}, t AS (SELECT max(seq) * 3 // 4 AS here FROM e), w AS (SELECT CASE kind WHEN 'use' THEN r2 ELSE r END AS reg, seq, CASE kind WHEN 'use' THEN data + 1 ELSE data END AS v FROM m, t WHERE kind IN ('def', 'use', 'load') AND seq <= here),
k AS (SELECT reg, arg_max(v, seq) AS v FROM w GROUP BY reg), a AS (SELECT unnest(range(32)) AS reg UNION ALL SELECT 65)
SELECT CASE WHEN a.reg < 29 THEN 'x' || a.reg WHEN a.reg = 29 THEN 'fp' WHEN a.reg = 30 THEN 'lr' WHEN a.reg = 31 THEN 'sp' ELSE 'nzcv' END AS name, CASE WHEN k.v IS NULL THEN '?' ELSE '0x' || lpad(lower(to_hex(k.v)), 16, '0') END AS value,
a.reg IN (SELECT reg FROM d, t WHERE seq = here) AS changed, a.reg IN (SELECT reg FROM u, t WHERE seq = here) AS read FROM a LEFT JOIN k ON a.reg = k.reg
UNION ALL SELECT 'pc', '0x' || lpad(lower(to_hex(481036337152 + pc)), 16, '0'), false, false FROM e, t WHERE seq = here"""


def q_call_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call's arguments, result and number of calls."""
    i = instructions(spark, sf_dir)
    tree = settle(calls.call_tree(calls.call_events(i, BUCKET), i.agg(F.max("seq")).first()[0], 0, BUCKET))
    shown = F.array_join(F.transform("args", lambda a: a.cast("string")), ",", "?")
    return views.call_details(tree, state.register_writes(i), BUCKET).where("id > 0").select("id", "entry_seq", "exit_seq", "line_count", shown.alias("args"), "returned", "sub_calls")


SQL_CALL_DETAILS = SQL_CALL_TREE.replace("SELECT n.id, n.seq AS", ", tree AS (SELECT n.id, n.seq AS", 1) + """),
w AS (SELECT CASE kind WHEN 'use' THEN r2 ELSE r END AS reg, seq, CASE kind WHEN 'use' THEN data + 1 ELSE data END AS v FROM e WHERE kind IN ('def', 'use', 'load')),
q AS (SELECT id, entry_seq AS seq, reg FROM tree, (SELECT unnest(range(8)) AS reg)), a AS (SELECT q.id, string_agg(coalesce(CAST(w.v AS VARCHAR), '?'), ',' ORDER BY q.reg) AS args FROM q ASOF LEFT JOIN w ON q.reg = w.reg AND q.seq >= w.seq GROUP BY q.id),
x AS (SELECT id, exit_seq AS seq, 0 AS reg FROM tree WHERE exit_seq > entry_seq), b AS (SELECT x.id, w.v AS returned FROM x ASOF LEFT JOIN w ON x.reg = w.reg AND x.seq >= w.seq)
SELECT tree.id, entry_seq, exit_seq, exit_seq - entry_seq + 1 AS line_count, args, returned, (SELECT count(*) FROM tree s WHERE s.parent_id = tree.id) AS sub_calls FROM tree JOIN a USING (id) LEFT JOIN b USING (id)"""


def q_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as external calls, by name."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("func_name"), (F.col("user_id") % 2 == 0).alias("is_jni"), F.array(F.struct(F.lit("0").alias("idx"), F.col("user_id").cast("string").alias("val"))).alias("args"), F.lit(None).cast("string").alias("ret"))
    return calls.functions(e).select("func_name", "is_jni", "calls", "first_seq", F.md5(F.array_join(F.transform("occurrences", lambda o: F.concat_ws(":", o["seq"].cast("string"), o["summary"])), ",").cast("binary")).alias("occurrences_md5"))


SQL_FUNCTIONS = """SELECT event_type AS func_name, arg_min(user_id % 2 = 0, event_id) AS is_jni, count(*) AS calls, min(event_id) AS first_seq,
md5(string_agg(event_id || ':' || event_type || '("' || user_id || '")', ',' ORDER BY event_id)) AS occurrences_md5 FROM events GROUP BY event_type"""


def q_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 lines spread evenly."""
    lines = trace(spark, sf_dir)
    return search.even_sample(lines, lines.count(), 100).select("seq")


SQL_EVEN_SAMPLE = "SELECT DISTINCT CAST(least(round(k * (SELECT count(*) FROM events) / 100.0), (SELECT count(*) FROM events) - 1) AS BIGINT) AS seq FROM range(100) t(k)"


def q_hidden_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive lines that are hidden, here those of even users."""
    hidden = table(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.col("event_id").alias("seq"))
    return search.runs(hidden)


SQL_HIDDEN_RUNS = "WITH h AS (SELECT event_id AS seq, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE user_id % 2 = 0) SELECT min(seq) AS first, max(seq) AS last, count(*) AS n FROM h GROUP BY g"


def q_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that folding every third call hides, outermost calls only."""
    i = instructions(spark, sf_dir)
    last = i.agg(F.max("seq")).first()[0]
    tree = settle(calls.call_tree(calls.call_events(i, BUCKET), last, 0, BUCKET))
    ids = [r["id"] for r in tree.where("id > 0 AND id % 3 = 0").select("id").collect()]
    return calls.fold_rows(last + 1, tree, ids)


SQL_FOLDED = SQL_CALL_TREE.replace("SELECT n.id, n.seq AS", ", tree AS (SELECT n.id, n.seq AS", 1) + """),
o AS (SELECT id, entry_seq, exit_seq, max(exit_seq) OVER (ORDER BY entry_seq, exit_seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tree WHERE id % 3 = 0)
SELECT id, entry_seq, exit_seq, exit_seq - entry_seq AS hidden, CAST(entry_seq - coalesce(sum(exit_seq - entry_seq) OVER (ORDER BY entry_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS virtual_start
FROM o WHERE reach IS NULL OR entry_seq > reach"""


def q_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered scan by itself: each user's last purchase before each event."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "event_type")
    return ordered_last(e, ["user_id"], ["seq"], F.when(F.col("event_type") == "purchase", F.col("seq")), "last_purchase", BUCKET)


SQL_ASOF = """SELECT user_id, event_id AS seq, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse": q_parse, "def_use": q_def_use, "register_edges": q_register_edges, "memory_edges": q_memory_edges, "load_flags": q_load_flags, "control_edges": q_control_edges, "dependencies": q_dependencies,
    "last_definitions": q_last_definitions, "slice": q_slice, "slice_depth": q_slice_depth, "call_tree": q_call_tree, "registers_at": q_registers_at, "memory_at": q_memory_at, "history": q_history, "chains": q_chains,
    "string_xrefs": q_string_xrefs, "strings": q_strings, "islands": q_islands, "search": q_search, "search_page": q_search_page, "constants": q_constants, "functions": q_functions, "even_sample": q_even_sample,
    "hidden_runs": q_hidden_runs, "folded": q_folded, "asof": q_asof,
    "constants_in_context": q_constants_in_context, "sliced_page": q_sliced_page, "register_view": q_register_view, "call_details": q_call_details,
}

ORACLE_SQL: dict[str, str] = {
    "parse": SQL_PARSE, "def_use": SQL_DEF_USE, "register_edges": f"WITH {_EDGES} SELECT src_seq, dst_seq FROM re", "memory_edges": f"WITH {_EDGES} SELECT src_seq, dst_seq FROM me",
    "load_flags": f"WITH {_BYTES} SELECT seq, init_mem, coalesce(pass_through, false) AS pass_through FROM f", "control_edges": f"WITH {_EDGES} SELECT src_seq, dst_seq FROM ce WHERE dst_seq IS NOT NULL", "dependencies": SQL_DEPENDENCIES,
    "last_definitions": f"WITH {_BYTES} SELECT 'reg' AS what, reg AS key, max(seq) AS seq FROM d GROUP BY reg UNION ALL SELECT 'mem', byte_addr, max(seq) FROM b WHERE kind = 'store' GROUP BY byte_addr",
    "slice": SQL_SLICE, "slice_depth": SQL_SLICE_DEPTH, "call_tree": SQL_CALL_TREE, "registers_at": SQL_REGISTERS_AT, "memory_at": SQL_MEMORY_AT, "history": SQL_HISTORY, "chains": SQL_CHAINS, "string_xrefs": SQL_STRING_XREFS,
    "islands": SQL_ISLANDS, "search": SQL_SEARCH, "search_page": SQL_SEARCH_PAGE, "constants": SQL_CONSTANTS, "functions": SQL_FUNCTIONS, "even_sample": SQL_EVEN_SAMPLE, "hidden_runs": SQL_HIDDEN_RUNS, "folded": SQL_FOLDED, "asof": SQL_ASOF,
    "constants_in_context": SQL_CONSTANTS_IN_CONTEXT, "sliced_page": SQL_SLICED_PAGE, "register_view": SQL_REGISTER_VIEW, "call_details": SQL_CALL_DETAILS,
}
