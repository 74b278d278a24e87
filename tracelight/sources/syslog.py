"""System-call logs (nine fields split by `;;`) to edges.

Lines need an order: line_no, of any type that compares. read_log takes it from where a line lies in its file; any frame with
columns line_no and value will do. What the arguments name is parsed once a line, before lines are paired. Everything else
is windows and joins on the lines' own keys; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelight import graph
from tracelight.functions import syscall as fn
from tracelight.plans.fixpoint import checkpoint

FIELDS = ["timestamp", "cpu", "process", "pid", "direction", "event", "cwd", "latency", "args"]


@dataclass
class Rules:
    """Which system calls move data which way. The usual names."""

    file_to_process: list[str] = field(default_factory=lambda: ["read", "readv"])
    process_to_file: list[str] = field(default_factory=lambda: ["write", "writev"])
    network_to_process: list[str] = field(default_factory=lambda: ["read", "recvmsg", "recvfrom", "readv"])
    process_to_network: list[str] = field(default_factory=lambda: ["sendto", "write", "writev", "sendmsg"])

    def table(self) -> dict[tuple[str, str, str], str]:
        """(event, kind of the start line's object, kind of the end line's) -> family; a dash is no object.

        An event of several families of one kind has the last of them.
        """
        out = {}
        for family, kind, names in (("FtoP", "F", self.file_to_process), ("PtoF", "F", self.process_to_file), ("NtoP", "N", self.network_to_process), ("PtoN", "N", self.process_to_network)):
            out |= {(event, kind, "-"): family for event in names}
        return out | {("execve", "F", "-"): "execve", ("accept", "-", "N"): "accept", ("fcntl", "-", "N"): "fcntl", ("rename", "-", "-"): "rename"}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value. line_no: file, start of the split of the file, and the line's number in the task that reads it.

    Splits are read from their first line to their last, so lines of a file compare as they stand in it; no file is read
    as a whole.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), "value")
    return lines.select(F.struct("file", "split", "n").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")


def fields(lines: DataFrame) -> DataFrame:
    """The nine fields of each complete line, with times in nanoseconds, the object it names and its kind (P, F or a dash)."""
    parts = F.split("value", ";;", 10)
    out = lines.withColumn("p", parts).where(F.size("p") >= 9).select("line_no", *[F.col("p")[i].alias(n) for i, n in enumerate(FIELDS)])
    out = out.withColumns({"t": fn.epoch_nanos(F.col("timestamp")), "lat": F.coalesce(F.col("latency").try_cast("long"), F.lit(0)), "token": fn.descriptor(F.col("args"))})
    out = out.withColumns({"file": F.coalesce(fn.file_of(F.col("token")), fn.filename(F.col("args"))), "net": fn.socket_of(F.col("token"))})
    kind = F.when(F.col("file").isNotNull(), "F").when(F.col("net").isNotNull(), "N").otherwise("-")
    return out.withColumns({"kind": kind, "object": F.coalesce("file", "net")}).drop("token", "file", "net", "cpu", "timestamp", "latency")


def line_counts(lines: DataFrame) -> DataFrame:
    """Numbers of complete and of invalid lines."""
    n = F.size(F.split("value", ";;", 10))
    return lines.agg(F.count(F.when(n >= 9, 1)).alias("valid_lines"), F.count(F.when(n < 9, 1)).alias("invalid_lines"))


def paired(rows: DataFrame) -> DataFrame:
    """End lines with the time, process and object of their start line, or nulls.

    A start waits under (time, event, cwd) until an end of the same key takes it; a later start replaces it. So an end has
    a start just if the row before it of the same key is one.
    """
    is_start = F.col("direction") == ">"
    keyed = rows.withColumns({"is_start": is_start, "key_t": F.when(is_start, F.col("t")).otherwise(F.col("t") - F.col("lat"))})
    by = Window.partitionBy("key_t", "event", "cwd").orderBy("line_no")
    before = F.lag(F.struct("is_start", "process", "pid", "t", "kind", "object")).over(by)
    out = keyed.withColumn("before", before).where(~F.col("is_start"))
    return out.withColumn("start", F.when(F.col("before.is_start"), F.col("before"))).drop("before", "is_start", "key_t")


def dispatched(rows: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Paired lines that a rule knows, by a join to the table of rules, with the rule's family.

    Without a start line its object is none, its time the end's less the latency, its process the end's.
    """
    table = (rules or Rules()).table()
    dim = rows.sparkSession.createDataFrame([(*k, v) for k, v in table.items()], "event string, start_kind string, end_kind string, family string")
    own = graph.node("P", F.concat("pid", "process"))
    ends = paired(rows).select(
        "line_no", "event", "cwd", "args", F.coalesce("start.kind", F.lit("-")).alias("start_kind"), F.col("kind").alias("end_kind"),
        F.coalesce("start.t", F.col("t") - F.col("lat")).alias("start_t"), F.col("t").alias("end_t"), F.col("start.object").alias("begun"), F.col("object").alias("ended"),
        own.alias("own"), F.coalesce(graph.node("P", F.concat("start.pid", "start.process")), own).alias("starter"),
    )
    return ends.join(F.broadcast(dim), ["event", "start_kind", "end_kind"])  # one row a rule


def _edge(etype: str, src: Column, dst: Column, start: Column, end: Column, size: Column, suffix: str = "") -> Column:
    return F.struct(F.lit(etype).alias("etype"), src.alias("src"), dst.alias("dst"), start.alias("start_t"), end.alias("end_t"), size.cast("long").alias("size"), F.lit(suffix).alias("suffix"))


def events(known: DataFrame) -> DataFrame:
    """line_no, event, cwd, etype, src, dst, start_t, end_t, size, suffix of dispatched lines: edges before overwriting and
    before exec links. The suffix tells the second edge of a key and family apart."""
    x = known.withColumns({"size": fn.result_size(F.col("args")), "parent": fn.exec_parent(F.col("args")), "paths": F.when(F.col("family") == "rename", fn.rename_paths(F.col("args")))})
    family, starter, own, start, end, none = F.col("family"), F.col("starter"), F.col("own"), F.col("start_t"), F.col("end_t"), F.lit(0)
    file, net, peer, parent = graph.node("F", F.col("begun")), graph.node("N", F.col("begun")), graph.node("N", F.col("ended")), graph.node("P", F.col("parent"))
    moved = F.col("size").isNotNull()
    ran = (family == "execve") & F.col("args").contains("res=0")
    renamed = (family == "rename") & (F.col("paths.old") != "") & (F.col("paths.new") != "")
    made = [
        (moved & (family == "FtoP"), _edge("FtoP", file, starter, start, end, F.col("size"))),
        (moved & (family == "PtoF"), _edge("PtoF", starter, file, start, end, F.col("size"))),
        (moved & (family == "NtoP"), _edge("NtoP", net, starter, start, end, F.col("size"))),
        (moved & (family == "PtoN"), _edge("PtoN", starter, net, start, end, F.col("size"))),
        (ran & (F.col("begun") != "<NA>"), _edge("FtoP", file, own, start, start, none)),
        (ran & F.col("parent").isNotNull(), _edge("PtoP", parent, own, start, end, none)),
        (ran & F.col("parent").isNotNull(), _edge("PtoP", own, parent, start, end, none, "back")),
        (family == "accept", _edge("NtoP", peer, own, end, end, none)),
        (family == "accept", _edge("PtoN", own, peer, end, end, none)),
        (family == "fcntl", _edge("NtoP", peer, own, start, end, none)),
        (renamed, _edge("FtoP", graph.node("F", F.col("paths.old")), starter, start, end, none)),
        (renamed, _edge("PtoF", starter, graph.node("F", F.col("paths.new")), start, end, none)),
    ]
    out = x.select("line_no", "event", "cwd", F.explode(F.array_compact(F.array(*[F.when(c, e) for c, e in made]))).alias("e"))
    return out.select("line_no", "event", "cwd", "e.*")


def exec_links(known: DataFrame, found: DataFrame) -> DataFrame:
    """found with the ends of exec links raised to the latest read or write of their process that follows.

    The forward link belongs to the parent, the backward link to the child; a process raises its most recent of each, with
    every line that a rule of reads and writes knows, also where its size is bad: an as-of join by a window.
    """
    links = found.where("event = 'execve' and etype = 'PtoP'").select(F.col("src").alias("p"), "line_no", F.col("suffix").alias("side"), F.struct("line_no", "suffix").alias("link"), F.lit(None).cast("long").alias("end_t"))
    acts = known.where(F.col("family").isin("FtoP", "PtoF", "NtoP", "PtoN")).select(F.col("own").alias("p"), "line_no", "end_t").join(links.select("p").distinct(), "p", "left_semi")
    acts = acts.select("p", "line_no", F.explode(F.array(F.lit(""), F.lit("back"))).alias("side"), F.lit(None).cast(links.schema["link"].dataType).alias("link"), "end_t")
    recent = F.last("link", ignorenulls=True).over(Window.partitionBy("p", "side").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    raised = links.unionByName(acts).withColumn("of", recent).where("end_t is not null and of is not null").groupBy("of").agg(F.max("end_t").alias("raised"))
    keyed = found.withColumn("of", F.when((F.col("event") == "execve") & (F.col("etype") == "PtoP"), F.struct("line_no", "suffix")))
    return keyed.join(raised, "of", "left").withColumn("end_t", F.greatest("end_t", "raised")).drop("of", "raised")


def edges(lines: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The graph's edges: later events of a family and key (start, event, cwd) overwrite earlier ones, then equal ends fuse."""
    known = checkpoint(dispatched(fields(lines), rules))
    found = exec_links(known, events(known))
    last = Window.partitionBy("etype", "start_t", "event", "cwd", "suffix").orderBy(F.desc("line_no"))
    kept = found.withColumn("n", F.row_number().over(last)).where("n = 1")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(("FtoP", "NtoP", "PtoF", "PtoP", "PtoN")) for x in (k, i)])
    first = F.struct(F.element_at(rank, F.col("etype")), "line_no", "event")
    out = kept.groupBy("src", "dst", "start_t", "end_t").agg(F.min_by("etype", first).alias("etype"), F.min_by("event", first).alias("event"), F.min_by("size", first).alias("size"))
    return out.withColumn("edge_id", F.xxhash64("src", "dst", "start_t", "end_t")).select(*graph.COLUMNS)


def reversed_receives(edges: DataFrame) -> DataFrame:
    """Edges with the ends of network receives and reads exchanged."""
    turned = F.col("event").startswith("recv") | F.col("event").startswith("read")
    turned = turned & ((graph.kind("src") == "N") | (graph.kind("dst") == "N"))
    swap = {"src": F.when(turned, F.col("dst")).otherwise(F.col("src")), "dst": F.when(turned, F.col("src")).otherwise(F.col("dst"))}
    return edges.select(*[swap.get(c, F.col(c)).alias(c) for c in edges.columns])
