"""Runs all cases of the logs in a folder and writes their reports.

    python -m tracelight.runner LOG_DIR RESULT_DIR "a.txt;b.cdm"     or --interactive, settings in TRACELIGHT_SETTINGS

A log's graph is built once and shared by its cases, which are property files beside it. RESULT_DIR/<log> gets summary.json
and entry_points.json, <log>.log, graphs/ with DOT and SVG, and a snapshot of each case's merged graph. A case that fails
is told in the log and leaves its metrics out; the others go on.
"""

from __future__ import annotations

import json
import logging
import os
import sys
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight import graph
from tracelight.plans import attack
from tracelight.plans.fixpoint import checkpoint
from tracelight.sources import audit_graph, avro, manifest, snapshot, syslog

LOG = logging.getLogger("tracelight")
CATEGORIES = (("process", "P"), ("network", "N"), ("file", "F"))
#: Rows of a ranking or a merged graph that reports and snapshots hold; the frames themselves hold all.
LISTED = 100_000


def rules(settings: manifest.Settings) -> syslog.Rules:
    """The settings' lists of system calls, the usual ones where there is none."""
    given = {field: settings.syscalls[key] for key, field in (("ftop", "file_to_process"), ("ptof", "process_to_file"), ("ntop", "network_to_process"), ("pton", "process_to_network")) if settings.syscalls.get(key)}
    return syslog.Rules(**given)


def load_graph(spark: SparkSession, log: str, settings: manifest.Settings, poi: list[str]) -> tuple[DataFrame, float]:
    """The edges of a log or of a manifest of audit records, and the reputation that its nodes begin with."""
    if not log.lower().endswith(".cdm"):
        return checkpoint(syslog.edges(syslog.read_log(spark, log), rules(settings))), 0.0
    if not any(poi):
        raise ValueError(f"{log}: an audit manifest needs a case with a point of interest")
    m = manifest.Manifest.load(log)
    files = m.files()
    if m.start is not None or m.end is not None:
        index = manifest.time_index(files, avro.event_times, os.path.join(m.folder, ".cdm-time-index.json"))
        hit = manifest.overlapping(index, m.start, m.end)
        LOG.info("events of the window are in %d of %d files", len(hit), len(files))
    spark.dataSource.register(avro.AuditSource)
    records = checkpoint(spark.read.format("audit").option("files", "\n".join(files)).load())
    return checkpoint(audit_graph.edges(records, m.start, m.end, m.max_events, poi)), audit_graph.REPUTATION


def _listed(rows: DataFrame, order: list) -> list:
    return rows.orderBy(*order).limit(LISTED).collect()


def entry_report(case: attack.Case, result: attack.Result, top: int = 3) -> dict:
    ranked = {k: _listed(result.ranked.where(F.col("kind") == kind), ["rank"]) for k, kind in CATEGORIES}
    name = lambda r: r["node"][2:]
    chosen = {k: [name(r) for r in rows[:top]] for k, rows in ranked.items()}
    selected = list(dict.fromkeys(x for rows in chosen.values() for x in rows))
    return {
        "POI": case.poi, "CandidateEntryPointsCount": result.candidates.count(), "CandidateEntryPoints": [name(r) for r in _listed(result.candidates, ["node"])],
        "HighlightedEntryPoints": list(dict.fromkeys([e.strip() for e in case.entries if e.strip()] + selected)),
        "RankedEntryPointsByCategory": {k: [{"signature": name(r), "reputation": r["reputation"]} for r in rows] for k, rows in ranked.items()},
        "ForwardSelectedByCategory": chosen, "ForwardSelectedEntryPoints": selected,
    }


def run_case(edges: DataFrame, case: attack.Case, settings: manifest.Settings, folder: str, name: str, ask: Callable[[str], str] | None = None) -> tuple[dict, dict]:
    """Summary and entry report of one case; writes its graphs and snapshot."""
    result = attack.investigate(edges, case, settings.cpr_mode, round(settings.cpr_time_window * graph.SECOND), settings.weight_mode, settings.fd_window_size, settings.sd_source_set_limit)
    merged = checkpoint(result.merged())
    summary = {r["metric"]: r["value"] for r in result.metrics(merged).collect()} | {k: round(v, 3) for k, v in result.seconds.items()}
    report = entry_report(case, result)
    entries = [r["node"] for r in result.top.collect()]
    graphs = os.path.join(folder, "graphs")
    os.makedirs(graphs, exist_ok=True)

    def drawn(df: DataFrame, what: str) -> None:
        base = os.path.join(graphs, f"{what}_{name}")
        snapshot.write_dot(f"{base}.dot", snapshot.dot_lines(df, result.reputation, result.poi, entries))
        snapshot.write_svg(f"{base}.svg", df, result.reputation, result.poi, entries)

    drawn(merged, "complete_provenance_graph")
    snapshot.write_graph(os.path.join(folder, f"snapshot_{name}_graphs.json"), result.poi, entries, merged, result.reputation)
    if settings.llm_enabled and ask is not None:
        kept = checkpoint(snapshot.filtered(merged, result.poi, entries, ask))
        drawn(kept, "llm_filtered_graph")
        n = [graph.nodes_of(df).count() for df in (merged, kept)] + [df.count() for df in (merged, kept)]
        ratio = lambda a, b: round(a / b, 4) if b else 0.0
        summary |= {"LLMFilteredVertexNumber": n[1], "LLMFilteredEdgeNumber": n[3], "LLMVertexCompressionRatio": ratio(n[0], n[1]), "LLMEdgeCompressionRatio": ratio(n[2], n[3])}
    return summary, report


def run_log(spark: SparkSession, log: str, result_dir: str, settings: manifest.Settings, ask: Callable[[str], str] | None = None) -> dict[str, dict]:
    """Runs the cases of one log on one graph and writes its reports; returns them."""
    base = os.path.splitext(os.path.basename(log))[0]
    folder = os.path.join(result_dir, base)
    os.makedirs(folder, exist_ok=True)
    tee = logging.FileHandler(os.path.join(folder, f"{base}.log"), encoding="utf-8")
    tee.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    LOG.addHandler(tee)
    LOG.setLevel(logging.INFO)
    try:
        configs = [(p, manifest.CaseConfig.load(p, settings.default_mid_rp)) for p in manifest.cases_of(os.path.dirname(os.path.abspath(log)), log)]
        began = time.time()
        edges, reputation = load_graph(spark, log, settings, [c.poi for _, c in configs])
        LOG.info("%s: %d edges in %.1f s", base, edges.count(), time.time() - began)
        summaries, points = [], []
        for path, c in configs:
            scenario = os.path.splitext(os.path.basename(path))[0]
            head = {"Case": os.path.basename(log), "Scenario": scenario}
            summary, report = {}, {}
            try:
                case = attack.Case(c.poi, c.high, c.low, c.mid, c.detection_size, c.entry, reputation)
                summary, report = run_case(edges, case, settings, folder, snapshot.safe_name(scenario), ask)
                LOG.info("%s: %s", scenario, summary)
            except Exception:
                LOG.exception("%s failed", scenario)
            stamp = {"Timestamp": datetime.now().isoformat(sep=" ", timespec="milliseconds")}
            summaries.append(head | {"Mode": settings.weight_mode, "CPRMode": settings.cpr_mode, "CPRTimeWindow": settings.cpr_time_window} | summary | stamp)
            points.append(head | report | stamp)
        out = {"summary": {"Case": os.path.basename(log), "Experiments": summaries}, "entry_points": {"Case": os.path.basename(log), "Experiments": points}}
        for name, what in out.items():
            snapshot.write_json(os.path.join(folder, f"{name}.json"), what)
        return out
    finally:
        LOG.removeHandler(tee)
        tee.close()


def run(spark: SparkSession, log_dir: str, result_dir: str, names: list[str], settings: manifest.Settings | None = None, ask: Callable[[str], str] | None = None) -> dict[str, dict]:
    """Reports of each named log of a folder. A log that cannot be read is told and left out."""
    here = [n for n in names if os.path.isfile(os.path.join(log_dir, n))]
    if not here:
        raise FileNotFoundError(f"no such logs in {log_dir}: {names}")
    os.makedirs(result_dir, exist_ok=True)
    out = {}
    for n in here:
        try:
            out[n] = run_log(spark, os.path.join(log_dir, n), result_dir, settings or manifest.Settings(), ask)
        except (OSError, ValueError):
            LOG.exception("%s failed", n)
    return out


def chosen(log_dir: str, answer: Callable[[str], str] = input) -> str:
    """The log that is picked by number or name of those that have cases."""
    logs = [os.path.basename(p) for p in manifest.logs_with_cases(log_dir)]
    if not logs:
        raise FileNotFoundError(f"no logs with cases in {log_dir}")
    for i, n in enumerate(logs, 1):
        print(f"{i}. {n}")
    while True:
        text = answer("Enter a log number or file name: ").strip()
        if text.isdigit() and 1 <= int(text) <= len(logs):
            return logs[int(text) - 1]
        if text in logs:
            return text


def replay(spark: SparkSession, snapshot_file: str, result_dir: str, ask: Callable[[str], str] | None) -> dict[str, int]:
    """Filters a stored snapshot again: DOT of what it holds and of what is kept, and their sizes."""
    edges, reputation, poi, entries = snapshot.load_graph(spark, snapshot_file)
    kept = checkpoint(snapshot.filtered(edges, poi, entries, ask))
    os.makedirs(result_dir, exist_ok=True)
    for name, df in (("snapshot_graph", edges), ("llm_filtered_graph", kept)):
        snapshot.write_dot(os.path.join(result_dir, f"{name}.dot"), snapshot.dot_lines(df, reputation, poi, entries))
    return {"vertices": graph.nodes_of(edges).count(), "edges": edges.count(), "kept_vertices": graph.nodes_of(kept).count(), "kept_edges": kept.count()}


def main(args: list[str]) -> int:
    if len(args) != 3:
        print(__doc__, file=sys.stderr)
        return 2
    logging.basicConfig(format="%(message)s")
    log_dir, result_dir, names = args
    path = os.environ.get("TRACELIGHT_SETTINGS")
    settings = manifest.Settings.load(path) if path else manifest.Settings()
    wanted = [chosen(log_dir)] if names.lower() in ("--interactive", "-i") else [n for n in names.split(";") if n]
    spark = SparkSession.builder.appName("tracelight").getOrCreate()
    print(json.dumps({n: len(r["summary"]["Experiments"]) for n, r in run(spark, log_dir, result_dir, wanted, settings).items()}))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
