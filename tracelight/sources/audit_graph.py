"""Audit records (rows of tracelight.sources.avro.SCHEMA) to nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight import graph
from tracelight.functions import audit as fn
from tracelight.operators import slicing
from tracelight.plans.fixpoint import checkpoint, iterate

#: What a node of an audit graph has before anything is propagated; a node of a log's graph has 0.
REPUTATION = 0.5


def event_rows(records: DataFrame, start: int | None = None, end: int | None = None, max_events: int = 0) -> DataFrame:
    """Event records of the window (inclusive); with max_events the first so many by file and record."""
    e = records.where("type = 'RECORD_EVENT'")
    if start is not None:
        e = e.where(F.col("t") >= start)
    if end is not None:
        e = e.where(F.col("t") <= end)
    return e.orderBy("file_no", "rec_no").limit(max_events) if max_events else e


def references(events: DataFrame) -> DataFrame:
    """events with subject_ref, object_ref, object2_ref: a uuid, or a path where the uuid is missing."""
    ref = lambda u, p: F.when(F.col(u).isNotNull(), F.concat(F.lit("u:"), u)).when(F.trim(p) != "", F.concat(F.lit("p:"), p))
    return events.withColumns({"subject_ref": F.when(F.col("subject").isNotNull(), F.concat(F.lit("u:"), "subject")), "object_ref": ref("object", "object_path"), "object2_ref": ref("object2", "object2_path")})


def compact(events: DataFrame) -> DataFrame:
    """event_id, source, target, event, t, size for each event that moves something between two known ends."""
    flow = fn.flow_kind(F.col("subtype"))
    source = F.when(flow == "O2P", F.col("object_ref")).when(flow == "O2O", F.col("object_ref")).otherwise(F.col("subject_ref"))
    target = F.when(flow == "O2P", F.col("subject_ref")).when(flow == "O2O", F.col("object2_ref")).otherwise(F.col("object_ref"))
    out = references(events).where(flow != "SKIP").select("file_no", "rec_no", source.alias("source"), target.alias("target"), fn.normalised_event(F.col("subtype")).alias("event"), "t", F.coalesce("size", F.lit(0)).alias("size"))
    return out.where("source is not null and target is not null")


def scan_rank(file_no: Column, last_event_file: int) -> Column:
    """Objects are looked up from the last event file back to the first, then in the files after it."""
    return F.when(file_no <= last_event_file, last_event_file - file_no).otherwise(file_no)


def fallback_paths(events: DataFrame) -> DataFrame:
    """ref, signature: the first path that an event gives for an object."""
    both = references(events).select("file_no", "rec_no", F.explode(F.array(F.struct(F.col("object_ref").alias("ref"), F.col("object_path").alias("path")), F.struct(F.col("object2_ref").alias("ref"), F.col("object2_path").alias("path")))).alias("x"))
    return both.where("x.ref is not null and trim(x.path) <> ''").groupBy("x.ref").agg(F.min_by("x.path", F.struct("file_no", "rec_no")).alias("signature"))


def described(records: DataFrame) -> DataFrame:
    """ref, kind, signature, parent of each object record, by its type."""
    u8, props = fn.uuid8(F.col("uuid")), F.col("properties")
    path, file, name, uuid = props["path"], props["filename"], props["name"], F.col("uuid")
    made = lambda prefix: F.concat(F.lit(prefix + "-"), u8)
    process = F.concat(F.coalesce(F.col("cid"), F.lit(0)).cast("string"), F.lit("@"), u8, fn.first_non_blank(fn.base_name(path), fn.first_command_token(F.col("cmd")), F.concat(F.lit("subject-"), u8)))
    four = F.concat(fn.first_non_blank(F.col("local_address"), F.lit("0.0.0.0")), F.lit(":"), F.coalesce("local_port", F.lit(0)).cast("string"), F.lit("->"), fn.first_non_blank(F.col("remote_address"), F.lit("0.0.0.0")), F.lit(":"), F.coalesce("remote_port", F.lit(0)).cast("string"))
    t = F.col("type")
    ipc_net = (t == "RECORD_PACKET_SOCKET_OBJECT") | ((t == "RECORD_IPC_OBJECT") & F.upper(F.coalesce("subtype", F.lit(""))).contains("SOCKET"))
    default = F.when(t == "RECORD_IPC_OBJECT", made("ipc-socket")).otherwise(made("socket"))
    local = F.concat(F.lit("unix:0->"), fn.first_non_blank(path, file, name, default), F.lit(":0"))
    kind = F.when(t == "RECORD_SUBJECT", "P").when((t == "RECORD_NET_FLOW_OBJECT") | ipc_net, "N").otherwise("F")
    signature = (
        F.when(t == "RECORD_SUBJECT", process)
        .when(t == "RECORD_FILE_OBJECT", fn.first_non_blank(file, path, F.concat(F.lit("file://"), "uuid")))
        .when(t == "RECORD_NET_FLOW_OBJECT", four)
        .when(ipc_net, local)
        .when(t == "RECORD_IPC_OBJECT", fn.object_label("ipc", name, file, made("ipc")))
        .when(t == "RECORD_REGISTRY_KEY_OBJECT", fn.object_label("registry", F.col("reg_key"), name, path, uuid))
        .when(t == "RECORD_MEMORY_OBJECT", fn.object_label("mem", fn.memory_label(F.col("memory_address")), name, path, uuid))
        .when(t == "RECORD_SRC_SINK_OBJECT", fn.object_label("srcsink", name, file, made("srcsink")))
    )
    return records.where("type <> 'RECORD_EVENT'").select(F.concat(F.lit("u:"), "uuid").alias("ref"), kind.alias("kind"), signature.alias("signature"), F.when(F.col("parent").isNotNull(), F.concat(F.lit("u:"), "parent")).alias("parent"), "file_no", "rec_no").where("signature is not null and ref is not null")


def entities(records: DataFrame, events: DataFrame, wanted: DataFrame) -> DataFrame:
    """ref, kind, signature, parent for the wanted refs and, transitively, their parents.

    A path given by an event is enough for an object; other refs take their first record in scan order.
    """
    last = events.agg(F.max("file_no")).first()[0]
    if last is None:
        last = records.agg(F.max("file_no")).first()[0] or 0
    order = scan_rank(F.col("file_no"), last)
    known = described(records)
    first = checkpoint(known.groupBy("ref").agg(*[F.min_by(c, F.struct(order, "rec_no")).alias(c) for c in ("kind", "signature", "parent")]))
    parents = first.where("parent is not null").select("ref", "parent")

    closed = iterate(wanted.select("ref").distinct(), lambda frontier: parents.join(frontier, "ref").select(F.col("parent").alias("ref")), ["ref"])
    paths = fallback_paths(events).unionByName(wanted.where(F.col("ref").startswith("p:")).select("ref", F.expr("substring(ref, 3)").alias("signature")).distinct()).groupBy("ref").agg(F.min("signature").alias("path"))
    out = closed.join(paths, "ref", "left").join(first, "ref", "left")
    by_path = F.col("path").isNotNull() & (F.coalesce("kind", F.lit("F")) != "P")
    return out.select("ref", F.when(by_path, F.coalesce("kind", F.lit("F"))).otherwise(F.col("kind")).alias("kind"), F.when(by_path, F.col("path")).otherwise(F.col("signature")).alias("signature"), "parent").where("signature is not null")


def execute_parents(events: DataFrame, known: DataFrame) -> DataFrame:
    """Edges from the parent of each subject that executes to that subject."""
    runs = references(events).where(fn.normalised_event(F.col("subtype")) == "EXECUTE").select("file_no", "rec_no", F.col("subject_ref").alias("target"), "t")
    parent = known.where("parent is not null").select(F.col("ref").alias("target"), F.col("parent").alias("source"))
    return runs.join(parent, "target").join(known.select(F.col("ref").alias("source")), "source", "left_semi").select("file_no", "rec_no", "source", "target", F.lit("EXECUTE_PARENT").alias("event"), "t", F.lit(0).cast("long").alias("size"))


def built(records: DataFrame, start: int | None = None, end: int | None = None, max_events: int = 0, poi: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The graph's nodes (node) and edges; with poi (nodes or signatures) the union of their backward slices.

    Refs become nodes before slicing, so several uuids of one signature are one node, whose kind is the first ref's. Things
    that events name but no edge touches are nodes too, without poi. If no poi is there, the graph is whole.
    """
    e = checkpoint(event_rows(records, start, end, max_events))
    moves = compact(e)
    subjects = references(e).where("subject_ref is not null").select(F.col("subject_ref").alias("ref"))
    wanted = moves.select(F.explode(F.array("source", "target")).alias("ref")).unionAll(subjects).distinct()
    known = checkpoint(entities(records, e, wanted))
    every = moves.unionByName(execute_parents(e, known))
    kinds = known.groupBy("signature").agg(F.min_by("kind", "ref").alias("kind"))
    named = checkpoint(known.select("ref", "signature").join(kinds, "signature").select("ref", "kind", graph.node(F.col("kind"), F.col("signature")).alias("node")))
    side = lambda c, s: named.select(F.col("ref").alias(c), F.col("node").alias(s), F.col("kind").alias(f"{s}_kind"))
    out = every.join(side("source", "src"), "source").join(side("target", "dst"), "target")
    out = out.select(F.xxhash64("file_no", "rec_no", "event").alias("edge_id"), "src", "dst", fn.edge_type(F.col("src_kind"), F.col("dst_kind")).alias("etype"), "event", F.col("t").alias("start_t"), F.col("t").alias("end_t"), "size")
    nodes = named.select("node").distinct()
    if not poi:
        return nodes, out
    out, kept = checkpoint(out), None
    for p in graph.resolved(out, list(poi)):
        one = slicing.slice_edges(out, slicing.back_track(out, p))
        kept = one if kept is None else kept.unionByName(one)
    if kept is None:
        return nodes, out
    kept = checkpoint(kept.dropDuplicates(["edge_id"]))
    return graph.nodes_of(kept), kept


def edges(records: DataFrame, start: int | None = None, end: int | None = None, max_events: int = 0, poi: list[str] = ()) -> DataFrame:
    """The edges of built()."""
    return built(records, start, end, max_events, poi)[1]


def build_summary(records: DataFrame, made: DataFrame) -> DataFrame:
    n = records.agg(F.count(F.when(F.col("type") == "RECORD_EVENT", 1)).alias("events"), F.count(F.when(F.col("type") != "RECORD_EVENT", 1)).alias("objects"))
    return n.crossJoin(made.agg(F.count("*").alias("mapped_edges"))).crossJoin(made.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.countDistinct("n").alias("nodes")))  # single rows
