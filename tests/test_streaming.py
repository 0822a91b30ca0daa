from test_trace import BANG

from tracewright.operators.search import Query
from tracewright.streaming.tail import alerts, follow, mnemonic_counts


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_stream_follows_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(BANG[:6]))
    (tmp_path / "b.log").write_text("\n".join(BANG[6:]))
    lines = follow(spark, f"file://{tmp_path}")
    assert len(run(alerts(lines, Query("MEM_W=")), "found", "append")) == 2
    counts = {r["mnemonic"]: r["n"] for r in run(mnemonic_counts(lines, "bang"), "counted", "complete")}
    assert counts["mov"] == 3 and counts["ldr"] == 2 and counts["stp"] == 1
