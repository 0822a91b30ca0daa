"""Open traces: their index as Parquet, reused while the file is the same, and slices written out."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.parsing import parse, special
from tracewright.operators import calls, dag, deps, slicing
from tracewright.sources.traces import BANG, detect_format, read_lines

HEAD_BYTES = 1 << 20


@dataclass
class Session:
    """One trace. tables: lines, insn, special, deps and, for BANG traces, annotations and consumed."""

    id: str
    path: str
    index: str
    fmt: str
    total_lines: int
    tables: dict[str, DataFrame] = field(default_factory=dict)
    slice: DataFrame | None = None
    origin: dict | None = None


class Engine:
    """Sessions by id, and the folder of their indexes (on a cluster, one that all executors share)."""

    def __init__(self, spark: SparkSession, index_root: str):
        self.spark, self.root = spark, index_root.rstrip("/")
        self.sessions: dict[str, Session] = {}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _key(self, path: str) -> tuple[str, str]:
        """A folder by the path, and what tells whether the file is still the same: its size, when it was
        written and the hash of its head."""
        head = self.spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("length", "modificationTime").first()
        text = self.spark.read.option("lineSep", "\n").text(path).limit(2000)
        digest = hashlib.sha256("\n".join(r["value"] for r in text.collect())[:HEAD_BYTES].encode("utf-8", "replace")).hexdigest()
        return hashlib.sha256(path.encode()).hexdigest(), f"{head['length']}-{head['modificationTime'].timestamp()}-{digest}"

    def open(self, path: str, force: bool = False) -> Session:
        """Reads or builds the index. A trace without instructions, or a quoted one without memory accesses, is refused."""
        folder, state = self._key(path)
        index = f"{self.root}/{folder}/{hashlib.sha256(state.encode()).hexdigest()[:16]}"
        fs, done = self._fs(f"{index}/_DONE")
        if force or not fs.exists(done):
            fs.delete(done.getParent(), True)
            lines = read_lines(self.spark, path)
            fmt = detect_format(lines)
            made = self._build(lines, fmt, index)
            told = made["insn"].agg(F.count(F.lit(1)).alias("n"), F.count("mem").alias("m")).first()
            if not told["n"] or (fmt != BANG and not told["m"]):
                fs.delete(done.getParent(), True)
                raise ValueError(f"no trace that can be read: {path}")
            self.spark.createDataFrame([(fmt, made["lines"].count())], "fmt string, total_lines long").write.parquet(f"{index}/meta")
            fs.create(done).close()
        meta = self.spark.read.parquet(f"{index}/meta").first()
        names = ["lines", "insn", "special", "deps", "annotations", "consumed"]
        s = Session(uuid.uuid4().hex, path, index, meta["fmt"], meta["total_lines"], {n: self.spark.read.parquet(f"{index}/{n}") for n in names})
        self.sessions[s.id] = s
        return s

    def _build(self, lines: DataFrame, fmt: str, index: str) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}

        def put(name: str, df: DataFrame) -> None:
            df.write.parquet(f"{index}/{name}")
            out[name] = self.spark.read.parquet(f"{index}/{name}")

        put("lines", lines)
        put("insn", parse(out["lines"], fmt))
        put("special", special(out["lines"]) if fmt == BANG else special(out["lines"]).limit(0))
        notes, consumed = calls.annotations(out["special"].select("seq", "raw"), out["insn"])
        put("annotations", notes)
        put("consumed", consumed)
        put("deps", deps.dependencies(out["insn"], out["special"].where("kind = 'ret'").select("seq")))
        return out

    def get(self, session_id: str | None = None) -> Session:
        """The session of an id; without one, the only session."""
        if session_id is not None:
            return self.sessions[session_id]
        if len(self.sessions) != 1:
            raise LookupError("no session is open" if not self.sessions else "several sessions are open; say which")
        return next(iter(self.sessions.values()))

    def close(self, session_id: str) -> None:
        self.sessions.pop(session_id, None)

    def list(self) -> DataFrame:
        return self.spark.createDataFrame([(s.id, s.path, s.fmt, s.total_lines) for s in self.sessions.values()], "id string, path string, fmt string, total_lines long")

    def info(self, session_id: str | None = None) -> dict:
        s = self.get(session_id)
        fs, p = self._fs(s.path)
        return {"id": s.id, "path": s.path, "fmt": s.fmt, "total_lines": s.total_lines, "bytes": fs.getContentSummary(p).getLength(), "sliced": s.slice is not None}

    def _held(self, folder: str) -> dict:
        """path, files, bytes of a folder of indexes."""
        fs, p = self._fs(folder)
        told = fs.getContentSummary(p) if fs.exists(p) else None
        return {"path": folder, "files": told.getFileCount() if told else 0, "bytes": told.getLength() if told else 0}

    def cache_info(self) -> dict:
        return self._held(self.root)

    def delete_cache(self, path: str) -> dict:
        """Deletes all indexes of one file, and tells what they held."""
        return self._drop(f"{self.root}/{hashlib.sha256(path.encode()).hexdigest()}")

    def clear_cache(self) -> dict:
        return self._drop(self.root)

    def _drop(self, folder: str) -> dict:
        held = self._held(folder)
        fs, p = self._fs(folder)
        fs.delete(p, True)
        return held

    def slice_graph(self, data_only: bool = False, most: int = 10_000, session_id: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
        """The dependency graph of the kept slice's first start; data only if either says so."""
        s = self.get(session_id)
        if s.origin is None:
            raise LookupError("no slice was made")
        external = s.tables["special"].where("kind = 'ret'").select("seq")
        return dag.graph(self.spark, s.tables["insn"], s.tables["deps"], s.origin["from_specs"][0], external, data_only or s.origin["data_only"], most)

    def run_slice(self, specs: list[str], data_only: bool = False, start_seq: int | None = None, end_seq: int | None = None, session_id: str | None = None) -> dict:
        s = self.get(session_id)
        external = s.tables["special"].where("kind = 'ret'").select("seq")
        s.slice = slicing.slice_lines(self.spark, s.tables["insn"], s.tables["deps"], specs, data_only, external, start_seq, end_seq)
        s.origin = {"from_specs": specs, "data_only": data_only, "start_seq": start_seq, "end_seq": end_seq}
        return slicing.slice_stats(s.slice, s.total_lines)

    def clear_slice(self, session_id: str | None = None) -> None:
        s = self.get(session_id)
        s.slice = s.origin = None

    def export_slice(self, path: str, fmt: str = "json", session_id: str | None = None) -> None:
        """txt: the slice's lines in order. json: one line with source, config and stats, then a line for each line of the
        slice, counted from 1."""
        s = self.get(session_id)
        if s.slice is None:
            raise LookupError("no slice to export")
        rows = s.tables["lines"].join(s.slice, "seq", "left_semi")
        if fmt == "txt":
            rows.repartitionByRange("seq").sortWithinPartitions("seq").select("raw").write.text(path)
            return
        head = json.dumps({"source": s.path, "config": s.origin, "stats": slicing.slice_stats(s.slice, s.total_lines)})
        body = rows.select("seq", F.to_json(F.struct((F.col("seq") + 1).alias("seq"), "raw")).alias("value"))
        first = self.spark.createDataFrame([(-1, head)], "seq long, value string")
        first.unionByName(body).repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(path)

    def sliced_lines(self, session_id: str | None = None) -> DataFrame:
        """seq, raw of the slice; loads of memory that the trace never stored are marked."""
        s = self.get(session_id)
        flags = deps.load_flags(deps.loaded_bytes(s.tables["insn"])).where("init_mem").select("seq", F.lit(" ; [INIT_MEM]").alias("_mark"))
        return s.tables["lines"].join(s.slice, "seq", "left_semi").join(flags, "seq", "left").select("seq", F.concat("raw", F.coalesce("_mark", F.lit(""))).alias("raw"))
