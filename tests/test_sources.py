"""Log lines and audit records through the public readers."""

import gzip
import io
import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tracelight.functions import answers
from tracelight.sources import audit_graph, avro, manifest, snapshot, syslog

LOG = """1600000000.100000001;;0;;bash;;41;;>;;write;;/tmp;;0;;fd=3(<f>/tmp/a.txt) size=10
1600000000.100000051;;0;;bash;;41;;<;;write;;/tmp;;50;;res=10 data=xxxxxxxxxx
1600000000.200000001;;0;;curl;;42;;>;;recvfrom;;/tmp;;0;;fd=5(<4t>10.0.0.1:5000->10.0.0.2:80) size=99
1600000000.200000031;;0;;curl;;42;;<;;recvfrom;;/tmp;;30;;res=99 data=x tuple=NULL
1600000000.3;;0;;sh;;43;;>;;execve;;/tmp;;0;;filename=/bin/ls
1600000000.300000010;;0;;ls;;43;;<;;execve;;/tmp;;10;;res=0 exe=ls ptid=40(bash) x
1600000000.4;;0;;srv;;50;;<;;accept;;/;;5;;fd=4(<4t>10.0.0.9:1->10.0.0.2:22) x
1600000000.5;;0;;mv;;51;;<;;rename;;/;;5;;res=0 oldpath=/a newpath=/b x
1600000000.6;;0;;cat;;52;;>;;read;;/;;0;;fd=3(<f>/etc/x) size=4
1600000000.600000004;;0;;cat;;52;;<;;read;;/;;4;;res=-5
broken;;line
1600000000.7;;0;;ls;;43;;>;;read;;/;;0;;fd=3(<f>/etc/y) size=4
1600000000.700000009;;0;;ls;;43;;<;;read;;/;;9;;res=4 data=
"""


def test_log(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LOG)
    lines = syslog.read_log(spark, str(tmp_path / "a.txt"))
    got = {(r.src, r.dst, r.etype, r.size) for r in syslog.edges(lines).collect()}
    s = 1600000000 * 10**9
    assert ("P:41bash", "F:/tmp/a.txt", "PtoF", 10) in got
    assert ("N:10.0.0.1:5000->10.0.0.2:80", "P:42curl", "NtoP", 99) in got
    assert ("F:/bin/ls", "P:43ls", "FtoP", 0) in got and ("P:40bash", "P:43ls", "PtoP", 0) in got and ("P:43ls", "P:40bash", "PtoP", 0) in got
    assert ("N:10.0.0.9:1->10.0.0.2:22", "P:50srv", "NtoP", 0) in got and ("P:50srv", "N:10.0.0.9:1->10.0.0.2:22", "PtoN", 0) in got
    assert ("F:/a", "P:51mv", "FtoP", 0) in got and ("P:51mv", "F:/b", "PtoF", 0) in got
    assert not any("/etc/x" in a for a, *_ in got)
    back = {(r.src, r.dst): r.end_t for r in syslog.edges(lines).where("etype = 'PtoP'").collect()}
    assert back["P:43ls", "P:40bash"] == s + 700000009 and back["P:40bash", "P:43ls"] == s + 300000010
    assert syslog.line_counts(lines).first() == (12, 1)


def test_later_event_of_a_key_overwrites(spark):
    def pair(n, name, path):
        return [(n, f"1.5;;0;;{name};;1;;>;;write;;/;;0;;fd=3(<f>{path}) x"), (n + 1, f"1.5000001;;0;;{name};;1;;<;;write;;/;;100;;res=3 x")]

    rows = [*pair(1, "a", "/x"), *pair(3, "b", "/y")]
    got = syslog.edges(spark.createDataFrame(rows, "line_no long, value string")).collect()
    assert [(r.src, r.dst) for r in got] == [("P:1b", "F:/y")]


U, S, L = {"type": "fixed", "name": "UUID", "size": 16}, ["null", "string"], ["null", "long"]
M = ["null", {"type": "map", "values": "string"}]


def record(name, **fields):
    return {"type": "record", "name": name, "fields": [{"name": k, "type": v} for k, v in fields.items()]}


AVRO = record(
    "TCCDMDatum",
    datum=[
        record("Subject", uuid=U, type={"type": "enum", "name": "SubjectType", "symbols": ["SUBJECT_PROCESS"]}, cid="int", parentSubject=["null", "UUID"], cmdLine=S, properties=M),
        record("FileObject", uuid="UUID", baseObject=record("AbstractObject", properties=M), type={"type": "enum", "name": "FileObjectType", "symbols": ["FILE_OBJECT_FILE"]}),
        record("Event", uuid="UUID", type={"type": "enum", "name": "EventType", "symbols": ["EVENT_WRITE", "EVENT_READ", "EVENT_EXECUTE"]}, subject=["null", "UUID"], predicateObject=["null", "UUID"], predicateObjectPath=S, predicateObject2=["null", "UUID"], predicateObject2Path=S, timestampNanos="long", size=L),
    ],
    type={"type": "enum", "name": "RecordType", "symbols": ["RECORD_SUBJECT", "RECORD_FILE_OBJECT", "RECORD_EVENT"]},
) | {"namespace": avro.RECORD.rsplit(".", 1)[0]}


class Encoder:
    def __init__(self):
        self.names = {}

    def long(self, n):
        n, out = (n << 1) ^ (n >> 63), bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def text(self, b):
        b = b.encode() if isinstance(b, str) else b
        return self.long(len(b)) + b

    def put(self, s, v):
        if isinstance(s, list):
            i, v = v if isinstance(v, tuple) and isinstance(v[0], int) else ((0 if v is None else 1), v)
            return self.long(i) + self.put(s[i], v)
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(s, dict) and "name" in s:
            self.names[s["name"]] = s
        if kind == "null":
            return b""
        if kind in ("int", "long"):
            return self.long(v)
        if kind == "string":
            return self.text(v)
        if kind == "fixed":
            return v
        if kind == "enum":
            return self.long(s["symbols"].index(v))
        if kind == "map":
            return (self.long(len(v)) + b"".join(self.text(k) + self.put(s["values"], x) for k, x in v.items()) if v else b"") + self.long(0)
        if kind == "record":
            return b"".join(self.put(f["type"], v.get(f["name"])) for f in s["fields"])
        return self.put(self.names[kind], v)


def uid(n):
    return n.to_bytes(16, "big")


def learn(e, s):
    if isinstance(s, list):
        for x in s:
            learn(e, x)
    elif isinstance(s, dict):
        if "name" in s:
            e.names[s["name"]] = s
        for f in s.get("fields", ()):
            learn(e, f["type"])


def write_avro(path, rows, block=10**9, codec="null", schema=AVRO):
    e, sync = Encoder(), b"s" * 16
    learn(e, schema)
    meta = e.long(2) + e.text("avro.schema") + e.text(json.dumps(schema)) + e.text("avro.codec") + e.text(codec) + e.long(0)
    out = b"Obj\x01" + meta + sync
    for i in range(0, len(rows), block):
        body = b"".join(e.put(schema, r) for r in rows[i : i + block])
        if codec == "deflate":
            z = zlib.compressobj(wbits=-15)
            body = z.compress(body) + z.flush()
        out += e.long(len(rows[i : i + block])) + e.long(len(body)) + body + sync
    with open(path, "wb") as f:
        f.write(gzip.compress(out) if str(path).endswith(".gz") else out)


def subject(n, cid, name, parent=None):
    return {"datum": (0, {"uuid": uid(n), "type": "SUBJECT_PROCESS", "cid": cid, "parentSubject": None if parent is None else uid(parent), "cmdLine": None, "properties": {"path": f"/usr/bin/{name}"}}), "type": "RECORD_SUBJECT"}


def file(n, name):
    return {"datum": (1, {"uuid": uid(n), "baseObject": {"properties": {"filename": name}}, "type": "FILE_OBJECT_FILE"}), "type": "RECORD_FILE_OBJECT"}


T0 = 1557241091148522395


def event(kind, s, o, path=None, t=T0, size=0):
    return {"datum": (2, {"uuid": uid(900), "type": kind, "subject": uid(s), "predicateObject": uid(o), "predicateObjectPath": path, "predicateObject2": None, "predicateObject2Path": None, "timestampNanos": t, "size": size}), "type": "RECORD_EVENT"}


def load(spark, folder, glob="*"):
    spark.dataSource.register(avro.AuditSource)
    return spark.read.format("audit").option("dir", str(folder)).option("glob", glob).load()


def shape(edges):
    return edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().count(), edges.count()


LOGF = "/home/admin/.vnc/ta1-theia-target-1:1.log"


@pytest.mark.parametrize("suffix", ["avro", "avro.gz"])
def test_write_reaches_poi(spark, tmp_path, suffix):
    write_avro(tmp_path / f"case1.{suffix}", [subject(1, 31337, "python3"), file(2, LOGF), event("EVENT_WRITE", 1, 2, LOGF, size=128)])
    e = audit_graph.edges(load(spark, tmp_path), poi=[LOGF])
    r = e.first()
    assert shape(e) == (2, 1) and (r.src, r.etype, r.event, r.size, r.start_t) == ("P:31337@00000001python3", "PtoF", "WRITE", 128, T0)


def test_several_points_of_interest(spark, tmp_path):
    write_avro(tmp_path / "case2.avro", [subject(1, 1, "a"), subject(2, 2, "b"), file(3, "/tmp/poi-a.log"), file(4, "/tmp/poi-b.log"), event("EVENT_WRITE", 1, 3, "/tmp/poi-a.log"), event("EVENT_WRITE", 2, 4, "/tmp/poi-b.log", T0 + 1)])
    r = load(spark, tmp_path)
    assert shape(audit_graph.edges(r, poi=["/tmp/poi-a.log", "/tmp/poi-b.log"])) == (4, 2)
    assert shape(audit_graph.edges(r, poi=["/tmp/poi-a.log"])) == (2, 1)


def test_execute_parents_across_files(spark, tmp_path):
    write_avro(tmp_path / "case1.avro", [subject(7, 9, "idle")])
    write_avro(tmp_path / "case2.avro", [subject(1, 100, "bash"), subject(2, 200, "python3", 1), file(3, "/tmp/payload.py")])
    write_avro(tmp_path / "case10.avro", [event("EVENT_EXECUTE", 2, 3, "/tmp/payload.py")])
    assert [os.path.basename(p) for p in manifest.input_files(str(tmp_path), "case*")] == ["case1.avro", "case2.avro", "case10.avro"]
    e = audit_graph.edges(load(spark, tmp_path), poi=["200@00000002python3"])
    assert shape(e) == (3, 2) and "P:100@00000001bash" in {r.src for r in e.collect()}


def test_path_stands_for_a_missing_object(spark, tmp_path):
    write_avro(tmp_path / "a.avro", [subject(1, 5, "x"), event("EVENT_WRITE", 1, 99, "/tmp/fallback-only.log", size=512)])
    assert shape(audit_graph.edges(load(spark, tmp_path), poi=["/tmp/fallback-only.log"])) == (2, 1)


def test_window_and_time_index(spark, tmp_path):
    write_avro(tmp_path / "case1.avro", [subject(1, 5, "x"), file(2, "/tmp/early.log"), event("EVENT_WRITE", 1, 2, "/tmp/early.log", T0 - 10)])
    write_avro(tmp_path / "case2.avro", [subject(3, 6, "y"), file(4, "/tmp/target.log"), event("EVENT_WRITE", 3, 4, "/tmp/target.log", T0)])
    (tmp_path / "m.cdm").write_text(f"cdm.input_dir={tmp_path}\ncdm.file_glob=case*.avro\ncdm.start_nanos={T0}\ncdm.end_nanos={T0}\ncdm.max_events=0\n")
    m = manifest.Manifest.load(str(tmp_path / "m.cdm"))
    times = lambda p: (r["datum"]["timestampNanos"] for r in avro.records(p) if r["type"] == "RECORD_EVENT")
    side = str(tmp_path / ".cdm-time-index.json")
    index = manifest.time_index(m.files(), times, side)
    assert os.path.exists(side) and [os.path.basename(p) for p in manifest.overlapping(index, m.start, m.end)] == ["case2.avro"]
    assert manifest.time_index(m.files(), None, side) == index
    assert shape(audit_graph.edges(load(spark, tmp_path, "case*.avro"), m.start, m.end)) == (2, 1)


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_splits_of_a_file(spark, tmp_path, codec):
    """Each record once and in order, wherever the splits fall."""
    rows = [event("EVENT_WRITE", i % 7, 3, f"/p/{i}", T0 + i, i) for i in range(900)]
    write_avro(tmp_path / "a.avro", rows, block=13, codec=codec)
    spark.dataSource.register(avro.AuditSource)
    for split in (700, 5000, 10**9):
        got = spark.read.format("audit").option("dir", str(tmp_path)).option("split", split).load()
        assert (got.rdd.getNumPartitions() > 1) == (split < 10**9)
        assert [(r.t, r.size, r.object_path) for r in got.orderBy("rec_no").collect()] == [(T0 + i, i, f"/p/{i}") for i in range(900)]
    avro.to_json(spark, [str(tmp_path / "a.avro")], str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).agg(F.sum("size")).first()[0] == sum(range(900))


def test_all_kinds_of_values():
    e = Encoder()
    schema = {"type": "record", "name": "R", "namespace": "x.y", "fields": [{"name": "a", "type": {"type": "array", "items": "long"}}, {"name": "b", "type": "boolean"}, {"name": "d", "type": "double"}, {"name": "f", "type": "float"}, {"name": "raw", "type": "bytes"}, {"name": "next", "type": ["null", "R"]}]}
    read = avro.compiled(schema, {})
    one = e.long(2) + e.long(5) + e.long(-(2**40)) + e.long(-1) + e.long(1) + e.long(7) + e.long(0) + b"\x01" + struct.pack("<d", 0.5) + struct.pack("<f", 0.25) + e.text(b"xy")
    whole = one + e.long(1) + one + e.long(0)
    inner = {"a": [5, -(2**40), 7], "b": True, "d": 0.5, "f": 0.25, "raw": b"xy"}
    assert read(whole, 0) == (inner | {"next": inner | {"next": None}}, len(whole))


def test_bad_files(tmp_path):
    with pytest.raises(ValueError):
        avro.Container(io.BytesIO(b"nothing"))
    write_avro(tmp_path / "other.avro", [], schema=AVRO | {"name": "Other"})
    with pytest.raises(ValueError, match="Other"):
        list(avro.records(str(tmp_path / "other.avro")))
    assert list(avro.records(str(tmp_path / "other.avro"), None)) == []


def test_case_files(tmp_path):
    (tmp_path / "x.property").write_text("POI=/p\nhighRP=/h,\nlowRP=a, b\nentry= e1 , e2\ndetectionSize=7\n")
    (tmp_path / "x.txt").write_text("")
    (tmp_path / "y.txt").write_text("")
    c = manifest.CaseConfig.load(str(tmp_path / "x.property"))
    assert (c.poi, c.high, c.low, c.entry, c.detection_size) == ("/p", ["/h", "/p"], ["a", " b"], ["e1", "e2"], 7.0)
    assert [os.path.basename(p) for p in manifest.logs_with_cases(str(tmp_path))] == ["x.txt"]


def test_answers(spark):
    r = spark.createDataFrame([("```json\nEDGES: [1, 2,x]\nENTRY_NODES: ['a', \"b\"]```",), ("keep [7, 9]",)], "a string").select(answers.edge_ids(F.col("a")), answers.entry_nodes(F.col("a"))).collect()
    assert tuple(r[0]) == ([1, 2], ["a", "b"]) and r[1][0] == [7, 9]


def test_snapshot_and_filter(spark, tmp_path):
    body = {"poi_event": "b", "entry_points": ["a"], "nodes": [{"id": 1, "signature": "a", "reputation": 0.5, "node_type": "P"}, {"id": 2, "signature": "b", "reputation": 1.0, "node_type": "F"}], "edges": [{"id": 1, "source": "a", "target": "b", "size": 3}, {"id": 2, "source": "a", "target": "gone"}]}
    (tmp_path / "s.json").write_text(json.dumps(body))
    nodes, edges, head = snapshot.read_snapshot(spark, str(tmp_path / "s.json"))
    assert (nodes.count(), edges.count(), head.first()[0]) == (2, 1, "b")
    snapshot.write_snapshot(str(tmp_path / "t.json"), "b", ["a"], nodes, edges)
    assert snapshot.read_snapshot(spark, str(tmp_path / "t.json"))[1].count() == 1
    g = spark.createDataFrame([(1, "P:a", "P:b", "x"), (2, "P:b", "F:c", "y"), (3, "P:z", "F:q", "n")], "edge_id long, src string, dst string, event string")
    assert snapshot.filtered(g, "F:c", [], None).count() == 3
    assert sorted(r[0] for r in snapshot.filtered(g, "F:c", ["P:a"], lambda p: "EDGES:[2,3]").select("edge_id").collect()) == [1, 2]
    snapshot.write_dot(str(tmp_path / "g.dot"), snapshot.dot_lines(g, spark.createDataFrame([("P:a", 0.5)], "node string, reputation double"), "F:c", ["P:a"]))
    text = (tmp_path / "g.dot").read_text()
    assert 'fillcolor="red"' in text and 'fillcolor="yellow"' in text and '"P:b" -> "F:c"' in text


def test_stream_of_runs(spark, tmp_path):
    from tracelight.streaming.runs import session_runs

    rows = [("2024-01-01 00:00:00", 1), ("2024-01-01 00:00:05", 2), ("2024-01-01 00:10:00", 4), ("2024-01-02 00:00:00", 8)]
    spark.createDataFrame(rows, "ts string, size long").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("w").alias("event"), F.lit("a").alias("src"), F.lit("b").alias("dst"), "size").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event string, src string, dst string, size long").parquet(str(tmp_path / "in"))
    q = session_runs(stream, "10 seconds", "1 minute").writeStream.outputMode("append").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["size"] for r in spark.sql("select size from runs").collect()) == [3, 4]
