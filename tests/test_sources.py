"""Trace files, graph documents and the running trace statistics."""

import json

from tessera.sources import graph_json, trace_csv
from tessera.streaming import history_stream

TRACE = """taskname,type,start,end,duration,size,policy,acclname
load,Kernel,0.0,1.5,1.5,64,sdq,Some Device 0
Internal-copy of load,MemFlushOut,1.5,2.0,0.5,777,sdq,Some Device 0
store,Kernel,2.0,3.0,1.0,64,sdq,Other 1
"""


def test_trace_files(spark, tmp_path):
    (tmp_path / "linear10-sdq-hostb.csv").write_text(TRACE)
    trace = trace_csv.read_trace(spark, str(tmp_path))
    got = sorted((r["taskname"], r["dag"], r["schedule"], r["system"], r["device"], r["devno"], r["size"]) for r in trace.collect())
    assert got == [("Internal-copy of load", "linear10", "sdq", "hostb", "Some Device", 0, None), ("load", "linear10", "sdq", "hostb", "Some Device", 0, 64), ("store", "linear10", "sdq", "hostb", "Other", 1, 64)]
    out = str(tmp_path / "out")
    trace_csv.write_trace(trace, out)
    assert trace_csv.read_trace(spark, out).count() == 3


def test_trace_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(TRACE)
    (tmp_path / "in" / "b.csv").write_text(TRACE)
    stats = history_stream.running_stats(history_stream.trace_stream(spark, str(tmp_path / "in"), 1))
    query = history_stream.start(stats, "trace_stats", str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert {(r["taskname"], r["n"], r["total"]) for r in spark.table("trace_stats").collect() if not r["taskname"].startswith("Internal")} == {("load", 2, 3.0), ("store", 2, 2.0)}


DOC = {"a-graph": {"inputs": ["n", "x"], "graph": {"tasks": [
    {"name": "t0", "commands": [{"h2d": {"name": "c", "device_memory": "m", "host_memory": "x", "offset": "0", "size": 64}}, {"kernel": {"name": "k", "global_size": [16], "parameters": [{"type": "scalar", "name": "n", "value": "n", "data_type": "int32_t"}, {"type": "memory_object", "value": "m", "permissions": "rw"}]}}]},
    {"name": "t1", "target": "nvidia", "depends": ["t0", None], "commands": [{"d2h": {"name": "c", "device_memory": "m", "host_memory": "x", "offset": [0], "size": ["64"]}}]},
]}}}


def test_graph_documents(spark):
    bad = {"a-graph": {"graph": {"tasks": [{"name": "t", "commands": [{"kernel": {"name": "k", "global_size": [1], "parameters": [{"type": "other"}]}}]}]}}}
    docs = spark.createDataFrame([(1, json.dumps(DOC)), (2, "not json"), (3, json.dumps(bad))], "doc long, json string")
    parsed = graph_json.parse(docs)
    good = parsed.filter("doc = 1")
    assert [(r["seq"], r["name"], r["target"], r["depends"]) for r in graph_json.tasks(good, "doc").orderBy("seq").collect()] == [(0, "t0", "default", []), (1, "t1", "nvidia", ["t0"])]
    assert [(r["opcode"], r["memory"], r["off"], r["size"]) for r in graph_json.commands(good, "doc").orderBy("seq", "pos").collect()] == [("h2d", "m", 0, 64), ("kernel", None, None, 16), ("d2h", "m", 0, 64)]
    bound = graph_json.parameters(good, "doc", bindings=spark.createDataFrame([("n", "8")], "name string, bound string"))
    assert [(r["type"], r["value"], r["mode"]) for r in bound.orderBy("idx").collect()] == [("scalar", "8", None), ("memory_object", "m", "rw")]
    assert {(r["doc"], r["problem"]) for r in graph_json.problems(parsed, "doc").collect()} == {(2, "no task list"), (3, "parameter of an unknown type")}
