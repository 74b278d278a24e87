"""Property files: input manifests, cases, global settings; and the files' time index."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from dataclasses import dataclass, field


def properties(path: str) -> dict[str, str]:
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip()
            if line and line[0] not in "#!":
                m = re.match(r"((?:\\.|[^=:\s\\])+)\s*[=:\s]\s*(.*)", line)
                if m:
                    out[m[1].replace("\\", "")] = m[2].strip()
    return out


def natural(name: str) -> list:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x.lower()) for x in re.findall(r"\d+|\D+", name)]


def input_files(folder: str, glob: str) -> list[str]:
    """Files whose name matches, digits in names by value, letters without case."""
    names = [n for n in os.listdir(folder) if os.path.isfile(os.path.join(folder, n)) and fnmatch.fnmatchcase(n, glob)]
    return [os.path.join(folder, n) for n in sorted(names, key=natural)]


@dataclass
class Manifest:
    folder: str
    glob: str
    start: int | None = None
    end: int | None = None
    max_events: int = 0

    @classmethod
    def load(cls, path: str) -> "Manifest":
        p = properties(path)
        for k in ("cdm.input_dir", "cdm.file_glob"):
            if not p.get(k):
                raise ValueError(f"{path}: {k} is missing")
        start, end = (int(p[k]) if p.get(k) else None for k in ("cdm.start_nanos", "cdm.end_nanos"))
        if start is not None and end is not None and start > end:
            raise ValueError("the window ends before it starts")
        most = int(p.get("cdm.max_events") or 0)
        if most < 0:
            raise ValueError("cdm.max_events is negative")
        folder = p["cdm.input_dir"]
        if not os.path.isabs(folder) and not os.path.isdir(folder):
            folder = os.path.join(os.path.dirname(os.path.abspath(path)), folder)
        return cls(folder, p["cdm.file_glob"], start, end, most)

    def files(self) -> list[str]:
        return input_files(self.folder, self.glob)


def time_index(files: list[str], times, sidecar: str) -> dict[str, dict]:
    """Least and greatest time and number of events of each file, kept in a sidecar by size and time of change.

    times(path): an iterator over a file's event times.
    """
    try:
        with open(sidecar, encoding="utf-8") as f:
            held = {e["fileName"]: e for e in json.load(f)["files"]}
    except (OSError, ValueError, KeyError):
        held = {}
    out = {}
    for path in files:
        s = os.stat(path)
        name, stamp = os.path.basename(path), (s.st_size, s.st_mtime_ns // 1_000_000)
        e = held.get(name)
        if not e or (e["sizeBytes"], e["lastModifiedMillis"]) != stamp:
            low = high = None
            n = 0
            for t in times(path):
                low, high, n = (t if low is None else min(low, t)), (t if high is None else max(high, t)), n + 1
            e = {"fileName": name, "sizeBytes": stamp[0], "lastModifiedMillis": stamp[1], "minTimestampNanos": low, "maxTimestampNanos": high, "eventCount": n}
        out[path] = e
    with open(sidecar, "w", encoding="utf-8") as f:
        json.dump({"version": 1, "files": list(out.values())}, f)
    return out


def overlapping(index: dict[str, dict], start: int | None, end: int | None) -> list[str]:
    low, high = start if start is not None else -(1 << 63), end if end is not None else (1 << 63)
    return [p for p, e in index.items() if e.get("eventCount") is None or (e["eventCount"] and e["maxTimestampNanos"] >= low and e["minTimestampNanos"] <= high)]


def _list(text: str | None, trim: bool = True) -> list[str]:
    parts = [(x.strip() if trim else x) for x in (text or "").split(",")]
    return list(dict.fromkeys(x for x in parts if x))


@dataclass
class CaseConfig:
    poi: str
    high: list[str]
    low: list[str]
    mid: list[str]
    detection_size: float
    entry: list[str]

    @classmethod
    def load(cls, path: str, default_mid: list[str] = ()) -> "CaseConfig":
        p = properties(path)
        poi = p.get("POI", "")
        high = [x for x in dict.fromkeys([*_list(p.get("highRP"), False), poi]) if x]
        return cls(poi, high, _list(p.get("lowRP"), False), [*default_mid, *_list(p.get("midRP"), False)], float(p.get("detectionSize") or 0), _list(p.get("entry")))


def cases_of(folder: str, log: str) -> list[str]:
    """Case files of a log: `<base>.property` or names that begin with `<base>:`."""
    base = os.path.splitext(os.path.basename(log))[0]
    return [os.path.join(folder, n) for n in sorted(os.listdir(folder), key=str.lower) if n.endswith(".property") and (n == f"{base}.property" or n.startswith(f"{base}:"))]


def logs_with_cases(folder: str) -> list[str]:
    names = sorted((n for n in os.listdir(folder) if n.endswith((".txt", ".cdm"))), key=str.lower)
    return [os.path.join(folder, n) for n in names if cases_of(folder, n)]


@dataclass
class Settings:
    weight_mode: str = "clusterall"
    cpr_mode: str = "windowed_sequence"
    cpr_time_window: float = 10.0
    fd_window_size: int = -1
    sd_source_set_limit: int = -1
    llm_enabled: bool = False
    temperature: float = 0.1
    max_tokens: int = 20480
    default_mid_rp: list[str] = field(default_factory=list)
    syscalls: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "Settings":
        p = properties(path)
        out = cls()
        for k, kind in (("weight_mode", str), ("cpr_mode", str), ("cpr_time_window", float), ("fd_window_size", int), ("sd_source_set_limit", int), ("temperature", float), ("max_tokens", int)):
            if p.get(k):
                setattr(out, k, kind(p[k]))
        out.llm_enabled = p.get("llm_enabled", "false").lower() == "true"
        out.default_mid_rp = _list(p.get("default_mid_rp"))
        out.syscalls = {k.split(".", 1)[1]: _list(v) for k, v in p.items() if k.startswith("syscall.")}
        return out
