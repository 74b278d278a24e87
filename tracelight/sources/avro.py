"""Avro object container files of audit records as a Spark data source.

spark.dataSource.register(AuditSource); spark.read.format("audit").option("dir", ...).option("glob", "*.avro").load()

Plain files are split at sync markers, SPLIT bytes a task; a file inside gzip (suffix .gz) is one task. Values are decoded by
functions made from the writer's schema and come back as Arrow batches. rec_no is where a record's block begins, plus its
number in the block, so that it orders the records of a file whatever the splits.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "file_no int, rec_no long, type string, uuid string, subtype string, cid int, parent string, cmd string, "
    "local_address string, local_port int, remote_address string, remote_port int, memory_address long, reg_key string, subject string, object string, "
    "object_path string, object2 string, object2_path string, t long, size long, properties map<string,string>"
)
SPLIT, BATCH = 64 << 20, 4096
#: Fixed value: the full name of the record that audit files hold.
RECORD = "com.bbn.tc.schema.avro.cdm20.TCCDMDatum"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
FIELDS = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split(" ") for f in SCHEMA.split(", "))])

#: Reads a value from a buffer at a place and returns it with the place behind it.
Reader = Callable[[bytes, int], tuple]


def _long(b: bytes, p: int) -> tuple[int, int]:
    n = b[p]
    p += 1
    if n > 127:
        n, shift = n & 127, 7
        while True:
            c = b[p]
            p += 1
            n |= (c & 127) << shift
            if c < 128:
                break
            shift += 7
    return (n >> 1) ^ -(n & 1), p


def _bytes(b: bytes, p: int) -> tuple[bytes, int]:
    n, p = _long(b, p)
    return b[p : p + n], p + n


def _string(b: bytes, p: int) -> tuple[str, int]:
    n, p = _long(b, p)
    return b[p : p + n].decode("utf-8", "replace"), p + n


def _packed(form: str) -> Reader:
    s = struct.Struct(form)
    return lambda b, p: (s.unpack_from(b, p)[0], p + s.size)


PLAIN: dict[str, Reader] = {
    "null": lambda b, p: (None, p), "boolean": lambda b, p: (b[p] == 1, p + 1), "int": _long, "long": _long, "string": _string, "bytes": _bytes, "float": _packed("<f"), "double": _packed("<d"),
}


def _items(b: bytes, p: int, one: Callable[[bytes, int], int]) -> int:
    """Calls one(b, p) for each item of an array or map; returns the place behind it."""
    while True:
        n, p = _long(b, p)
        if not n:
            return p
        if n < 0:
            n, (_, p) = -n, _long(b, p)
        for _ in range(n):
            p = one(b, p)


def compiled(schema, names: dict[str, Reader], space: str = "") -> Reader:
    """A reader of values of a schema; named types are entered in names."""
    if isinstance(schema, list):
        branches = [compiled(x, names, space) for x in schema]

        def union(b, p):
            i, p = _long(b, p)
            return branches[i](b, p)

        return union
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return compiled(kind, names, space)
    if kind in PLAIN:
        return PLAIN[kind]
    if kind in ("record", "error", "enum", "fixed"):
        space = schema.get("namespace", space)
        short = schema["name"].rsplit(".", 1)[-1]
        of = {}
        names[schema["name"] if "." in schema["name"] else f"{space}.{short}"] = names[short] = lambda b, p: of["read"](b, p)
        if kind == "fixed":
            size = schema["size"]
            of["read"] = lambda b, p: (b[p : p + size], p + size)
        elif kind == "enum":
            symbols = schema["symbols"]

            def symbol(b, p):
                i, p = _long(b, p)
                return symbols[i], p

            of["read"] = symbol
        else:
            fields = [(f["name"], compiled(f["type"], names, space)) for f in schema["fields"]]

            def record(b, p):
                out = {}
                for name, read in fields:
                    out[name], p = read(b, p)
                return out, p

            of["read"] = record
        return of["read"]
    if kind in ("array", "map"):
        item = compiled(schema["items" if kind == "array" else "values"], names, space)

        def several(b, p):
            out = [] if kind == "array" else {}

            def one(b, p):
                if kind == "array":
                    v, p = item(b, p)
                    out.append(v)
                else:
                    k, p = _string(b, p)
                    out[k], p = item(b, p)
                return p

            return out, _items(b, p, one)

        return several
    return lambda b, p: names[kind](b, p)


class Container:
    """An open file: its schema's reader, codec and sync marker; the stream stands behind the header."""

    def __init__(self, stream: io.BufferedIOBase):
        self.f = stream
        if self.f.read(4) != b"Obj\x01":
            raise ValueError("not an Avro object container")
        meta = {}
        while n := self._number():
            if n < 0:
                self._number()
            for _ in range(abs(n)):
                key = self.f.read(self._number()).decode()
                meta[key] = self.f.read(self._number())
        schema = json.loads(meta["avro.schema"])
        name = schema.get("name", "") if isinstance(schema, dict) else ""
        self.name = name if "." in name else ".".join(x for x in (schema.get("namespace"), name) if x) if name else ""
        self.read = compiled(schema, {})
        self.codec = meta.get("avro.codec", b"null").decode()
        if self.codec not in ("null", "deflate"):
            raise ValueError(f"codec {self.codec}")
        self.sync = self.f.read(16)

    def _number(self) -> int:
        head = b""
        while not head or head[-1] > 127:
            c = self.f.read(1)
            if not c:
                raise EOFError
            head += c
        return _long(head, 0)[0]

    def _seek(self, start: int) -> bool:
        """To behind the first sync marker that begins at start or later."""
        self.f.seek(start)
        held = b""
        while chunk := self.f.read(1 << 20):
            held += chunk
            at = held.find(self.sync)
            if at >= 0:
                self.f.seek(start + at + 16)
                return True
            start, held = start + len(held) - 15, held[-15:]
        return False

    def records(self, start: int = 0, end: int | None = None) -> Iterator[tuple[int, dict]]:
        """(number, record) of the blocks whose preceding marker begins in [start, end)."""
        if start > self.f.tell() - 16 and not self._seek(start):
            return
        while end is None or self.f.tell() - 16 < end:
            at = self.f.tell()
            try:
                n = self._number()
            except EOFError:
                return
            data = self.f.read(self._number())
            if self.codec == "deflate":
                data = zlib.decompress(data, -15)
            p = 0
            for i in range(n):
                value, p = self.read(data, p)
                yield at + i, value
            if self.f.read(16) != self.sync:
                raise ValueError("lost synchronisation")


def uuid(raw) -> str | None:
    if raw is None:
        return None
    h = bytes(raw).hex()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def flat(record: dict) -> tuple:
    """One row of SCHEMA (without file and record numbers)."""
    d = record.get("datum") or {}
    base = d.get("baseObject") or {}
    props = {**(base.get("properties") or {}), **(d.get("properties") or {})}
    return (
        record.get("type"), uuid(d.get("uuid")), d.get("type"), d.get("cid"), uuid(d.get("parentSubject")), d.get("cmdLine"),
        d.get("localAddress"), d.get("localPort"), d.get("remoteAddress"), d.get("remotePort"), d.get("memoryAddress"), d.get("key"), uuid(d.get("subject")), uuid(d.get("predicateObject")),
        d.get("predicateObjectPath"), uuid(d.get("predicateObject2")), d.get("predicateObject2Path"), d.get("timestampNanos"), d.get("size"), [(k, str(v)) for k, v in props.items()],
    )


def opened(path: str, name: str | None = RECORD) -> Container:
    """An open audit file; a file of other records is refused."""
    raw = open(path, "rb")  # noqa: SIM115  lives as long as the container
    out = Container(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if path.endswith(".gz") else raw)
    if name and out.name != name:
        raise ValueError(f"{path} holds {out.name or 'no record'}, not {name}")
    return out


def records(path: str, name: str | None = RECORD) -> Iterator[dict]:
    for _, r in opened(path, name).records():
        yield r


def event_times(path: str) -> Iterator[int]:
    """The times of the event records of a file."""
    for r in records(path):
        t = (r.get("datum") or {}).get("timestampNanos") if r.get("type") == "RECORD_EVENT" else None
        if t is not None:
            yield t


class _Part(InputPartition):
    def __init__(self, number: int, path: str, start: int, end: int | None):
        self.number, self.path, self.start, self.end = number, path, start, end


class AuditReader(DataSourceReader):
    def __init__(self, options: dict):
        from tracelight.sources.manifest import input_files

        self.files = options.get("files", "").split("\n") if options.get("files") else input_files(options["dir"], options.get("glob", "*"))
        self.split, self.name = int(options.get("split", SPLIT)), options.get("record", RECORD)

    def partitions(self):
        out = []
        for i, path in enumerate(self.files):
            size = os.path.getsize(path)
            if path.endswith(".gz") or size <= self.split:
                out.append(_Part(i, path, 0, None))
            else:
                out += [_Part(i, path, a, a + self.split) for a in range(0, size, self.split)]
        return out or [_Part(0, "", 0, None)]

    def read(self, partition):
        rows = ((partition.number, n, *flat(r)) for n, r in opened(partition.path, self.name).records(partition.start, partition.end)) if partition.path else iter(())
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some), FIELDS)], schema=FIELDS)


class AuditSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audit"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return AuditReader(self.options)


def to_json(spark, files: list[str], path: str, compression: str = "gzip") -> None:
    """The records of audit files as lines of JSON, a file a task and split."""
    spark.dataSource.register(AuditSource)
    spark.read.format("audit").option("files", "\n".join(files)).load().write.json(path, compression=compression)
