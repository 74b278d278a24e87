"""The batch runner over folders of logs, manifests and cases."""

import json
import os

import pytest

from tests.test_sources import T0, event, file, subject, write_avro
from tracelight import runner
from tracelight.sources import manifest, snapshot


def lines(t, event_name, process, pid, start, end):
    s = 1_600_000_000 + t
    return [f"{s}.1;;0;;{process};;{pid};;>;;{event_name};;/;;0;;{start}", f"{s}.10000005;;0;;{process};;{pid};;<;;{event_name};;/;;50;;{end}"]


@pytest.fixture
def folder(tmp_path):
    out = []
    out += lines(1, "recvfrom", "nc", 7, "fd=3(<4t>10.0.0.9:1->10.0.0.2:22) x", "res=64 data=")
    out += lines(2, "write", "nc", 7, "fd=4(<f>/tmp/drop) x", "res=64 data=")
    out += lines(3, "read", "sh", 8, "fd=4(<f>/tmp/drop) x", "res=64 data=")
    out += lines(3, "write", "sh", 8, "fd=5(<f>/etc/passwd) x", "res=10 data=")
    out += lines(6, "write", "sh", 8, "fd=5(<f>/etc/passwd) x", "res=12 data=")
    out += lines(60, "write", "sh", 8, "fd=5(<f>/etc/passwd) x", "res=14 data=")
    out += lines(70, "read", "cat", 9, "fd=5(<f>/etc/passwd) x", "res=14 data=")
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "host.txt").write_text("\n".join(out) + "\n")
    (logs / "host.property").write_text("POI=/etc/passwd\nhighRP=\nentry=nc\n")
    (logs / "host:two.property").write_text("POI=/tmp/drop\ndetectionSize=64\n")
    (logs / "host:wrong.property").write_text("POI=/none\n")
    (logs / "alone.txt").write_text("x\n")
    write_avro(logs / "case1.avro", [subject(1, 100, "bash"), subject(2, 200, "python3", 1), file(3, "/tmp/x.py"), file(4, "/tmp/out"), event("EVENT_EXECUTE", 2, 3, "/tmp/x.py", T0), event("EVENT_WRITE", 2, 4, "/tmp/out", T0 + 5, 9)])
    (logs / "audit.cdm").write_text(f"cdm.input_dir={logs}\ncdm.file_glob=case*.avro\ncdm.start_nanos={T0}\n")
    (logs / "audit.property").write_text("POI=/tmp/out\n")
    return logs


def test_two_cases_of_a_log(spark, folder, tmp_path):
    settings = manifest.Settings(weight_mode="nonml")
    out = runner.run(spark, str(folder), str(tmp_path / "res"), ["host.txt", "missing.txt"], settings)
    assert list(out) == ["host.txt"]
    res = tmp_path / "res" / "host"
    for name in ("summary", "entry_points"):
        assert json.loads((res / f"{name}.json").read_text()) == out["host.txt"][name]
    by = {e["Scenario"]: e for e in out["host.txt"]["summary"]["Experiments"]}
    one = by["host"]
    assert (one["Mode"], one["CPRMode"], one["CPRTimeWindow"], one["Case"]) == ("nonml", "windowed_sequence", 10.0, "host.txt")
    # The first two writes are three seconds apart and merge in the window of ten, the third is a minute later.
    assert (one["BackTrackVertexNumber"], one["BackTrackEdgeNumber"], one["CPREdgeNumber"]) == (5, 6, 5)
    assert one["EntryPointsNumber"] == 2 and one["CompleteProvenanceEdgeNumber"] == 5 and one["PropagationTimeCost"] >= 0
    assert (by["host:two"]["BackTrackEdgeNumber"], by["host:two"]["BackTrackVertexNumber"]) == (2, 3)
    assert "BackTrackEdgeNumber" not in by["host:wrong"] and "Timestamp" in by["host:wrong"]
    points = {e["Scenario"]: e for e in out["host.txt"]["entry_points"]["Experiments"]}["host"]
    net = "10.0.0.9:1->10.0.0.2:22"
    assert points["CandidateEntryPoints"] == [net, "8sh"] and points["ForwardSelectedByCategory"] == {"process": ["8sh"], "network": [net], "file": []}
    assert points["HighlightedEntryPoints"] == ["nc", "8sh", net] and points["RankedEntryPointsByCategory"]["network"][0]["reputation"] > 0.9
    text = (res / "host.log").read_text()
    assert "host:wrong failed" in text and "is not in the graph" in text
    edges, rep, poi, entries = snapshot.load_graph(spark, str(res / "snapshot_host_graphs.json"))
    assert edges.count() == 5 and poi == "F:/etc/passwd" and sorted(entries) == [f"N:{net}", "P:8sh"]
    for suffix in ("dot", "svg"):
        assert net in (res / "graphs" / f"complete_provenance_graph_host.{suffix}").read_text().replace("&gt;", ">")
    told = runner.replay(spark, str(res / "snapshot_host_graphs.json"), str(tmp_path / "again"), None)
    assert told == {"vertices": 5, "edges": 5, "kept_vertices": 5, "kept_edges": 5} and (tmp_path / "again" / "snapshot_graph.dot").exists()


def test_audit_manifest(spark, folder, tmp_path):
    settings = manifest.Settings(weight_mode="nonml", llm_enabled=True)
    out = runner.run(spark, str(folder), str(tmp_path / "res"), ["audit.cdm"], settings, lambda prompt: "EDGES:[]")
    one = out["audit.cdm"]["summary"]["Experiments"][0]
    assert (one["BackTrackVertexNumber"], one["BackTrackEdgeNumber"], one["LLMEdgeCompressionRatio"]) == (4, 3, 1.0)
    points = out["audit.cdm"]["entry_points"]["Experiments"][0]
    assert points["CandidateEntryPoints"] == ["/tmp/x.py", "100@00000001bash"]
    assert (folder / ".cdm-time-index.json").exists()


def test_choice_of_a_log(folder):
    answers = iter(["", "9", "nothing", "2"])
    assert runner.chosen(str(folder), lambda _: next(answers)) == "host.txt"
    assert runner.chosen(str(folder), lambda _: "audit.cdm") == "audit.cdm"
    assert [os.path.basename(p) for p in manifest.logs_with_cases(str(folder))] == ["audit.cdm", "host.txt"]


def test_usage(capsys):
    assert runner.main([]) == 2


def test_settings(tmp_path):
    (tmp_path / "s.properties").write_text("weight_mode=nonml\ncpr_time_window=2.5\nfd_window_size=3\nsyscall.ftop=read, pread\n")
    s = manifest.Settings.load(str(tmp_path / "s.properties"))
    assert (s.weight_mode, s.cpr_time_window, s.fd_window_size) == ("nonml", 2.5, 3)
    rules = runner.rules(s)
    assert rules.file_to_process == ["read", "pread"] and ("pread", "F", "-") in rules.table() and ("write", "F", "-") in rules.table()
