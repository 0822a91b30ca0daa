import os

import pytest
from test_trace import BANG

from tracewright.operators import dag
from tracewright.operators.session import Engine


def test_index_slice_export_and_graph(spark, tmp_path):
    path = tmp_path / "trace.log"
    path.write_text("\n".join(BANG))
    engine = Engine(spark, f"file://{tmp_path}/index")
    s = engine.open(f"file://{path}")
    assert (s.fmt, s.total_lines) == ("bang", len(BANG)) and engine.get() is s
    assert engine.open(f"file://{path}").index == s.index
    got = engine.run_slice(["reg:x6@last"], data_only=True, session_id=s.id)
    assert got["marked_count"] == 5
    engine.export_slice(f"file://{tmp_path}/out", "txt", s.id)
    assert sorted(x for x in spark.read.text(f"file://{tmp_path}/out").toPandas()["value"]) == sorted(BANG[:5])
    engine.run_slice(["reg:x8@last"], data_only=True, session_id=s.id)
    assert any(r["raw"].endswith("[INIT_MEM]") for r in engine.sliced_lines(s.id).collect())
    nodes, edges, told = dag.graph(spark, s.tables["insn"], s.tables["deps"], "reg:x6@last", data_only=True)
    text = {r["seq"]: (r["depth"], r["expression"]) for r in nodes.collect()}
    assert text[4] == (0, "x6 = x4 + x5") and text[2] == (1, "x5 = 0x10") and text[3][1] == "x4 = *(u64*)0x2008" and text[0][0] == 3
    assert {(r["src_seq"], r["dst_seq"]) for r in edges.collect()} == {(4, 3), (4, 2), (3, 1), (1, 0)} and told["total_reachable"] == 5


def test_cache_and_graph_of_the_slice(spark, tmp_path):
    path = tmp_path / "trace.log"
    path.write_text("\n".join(BANG))
    engine = Engine(spark, f"file://{tmp_path}/index")
    assert engine.cache_info()["files"] == 0
    s = engine.open(f"file://{path}")
    assert engine.info()["total_lines"] == len(BANG) and engine.info()["bytes"] == path.stat().st_size
    with pytest.raises(LookupError):
        engine.slice_graph()
    engine.run_slice(["reg:x6@last"], data_only=True)
    nodes, _, told = engine.slice_graph()
    assert told["total_reachable"] == 5 and engine.info()["sliced"]
    key = engine._key(f"file://{path}")
    os.utime(path, (1, 1))  # written anew, equal in size and head
    assert engine._key(f"file://{path}")[0] == key[0] and engine._key(f"file://{path}")[1] != key[1]
    assert engine.delete_cache(s.path)["files"] > 0 and engine.cache_info()["files"] == 0
    assert engine.clear_cache()["bytes"] == 0
