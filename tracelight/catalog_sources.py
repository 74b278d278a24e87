"""Registered queries of log and audit sources, column functions and cases built on them, with their SQL.

The tables hold no logs, so lines and records are written from orders by rules that the SQL states too.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight import catalog
from tracelight.functions import answers, audit, syscall
from tracelight.graph import SECOND
from tracelight.operators import ranking, slicing
from tracelight.plans import attack
from tracelight.plans.fixpoint import checkpoint, scratch
from tracelight.registry import query
from tracelight.sources import audit_graph, manifest, syslog


def _orders(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"))


O = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders)"
text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) and x not in ("k", "c", "p") else F.col(x) if isinstance(x, str) else x for x in parts])


# --- column functions --------------------------------------------------------------------------


@query("fn2_descriptor_forms", f"""WITH {O} SELECT k, CASE k % 6 WHEN 0 THEN '/d/' || c WHEN 1 THEN '/real/' || c END AS file,
 CASE k % 6 WHEN 2 THEN '10.0.0.1:' || c || '->10.0.0.2:53' WHEN 3 THEN '::1:' || c || '->fe80::2:80' WHEN 4 THEN '10.0.0.1:UNKNOWN->10.0.0.' || c || ':UNKNOWN' END AS socket FROM o""", graph=False)
def _(spark, d):
    forms = [text("x fd=3(<f>/d/", "c", ") y"), text("fd=3(<f>/link(/real/", "c", ")) y"), text("fd=4(<4u>10.0.0.1:", "c", "->10.0.0.2:domamin) y"), text("fd=4(<6t>::1:", "c", "->fe80::2:80)"), text("fd=5(<4r>10.0.0.1->10.0.0.", "c", ") z"), text("fd=6(<4t>10.0.0.1->broken) fd=7(<f>/late)")]
    args = F.get(F.array(*forms), (F.col("k") % 6).cast("int"))
    token = syscall.descriptor(args)
    return _orders(spark, d).select("k", syscall.file_of(token).alias("file"), syscall.socket_of(token).alias("socket"))


@query("fn1_odd_sizes", f"WITH {O} SELECT k, CASE k % 5 WHEN 0 THEN c WHEN 1 THEN 0 END AS size FROM o", graph=False)
def _(spark, d):
    forms = [text("a res=", "c", " res=7"), text("res=0"), text("res=-1 res=", "c"), text("size=", "c"), text("res=x", "c")]
    return _orders(spark, d).select("k", syscall.result_size(F.get(F.array(*forms), (F.col("k") % 5).cast("int"))).alias("size"))


@query("fn3_filename", f"WITH {O} SELECT k, CASE k % 3 WHEN 0 THEN '/bin/' || c WHEN 1 THEN '/real/' || c END AS file FROM o", graph=False)
def _(spark, d):
    forms = [text("res=0 filename=/bin/", "c", " x"), text("filename=link(/real/", "c", ")"), text("name=/bin/", "c")]
    return _orders(spark, d).select("k", syscall.filename(F.get(F.array(*forms), (F.col("k") % 3).cast("int"))).alias("file"))


@query("fn5_rename_paths", f"WITH {O} SELECT k, '/a ' || c AS old, CASE k % 2 WHEN 0 THEN '/b/' || c ELSE '/real/' || c END AS new FROM o", graph=False)
def _(spark, d):
    args = F.when(F.col("k") % 2 == 0, text("res=0 oldpath=/a ", "c", " newpath=/b/", "c", " x")).otherwise(text("res=0 oldpath=at(/a ", "c", ") newpath=/x(/real/", "c", ") "))
    paths = syscall.rename_paths(args)
    return _orders(spark, d).select("k", paths["old"].alias("old"), paths["new"].alias("new"))


@query("fn6_exec_parent", f"WITH {O} SELECT k, CASE WHEN k % 2 = 0 THEN c || 'bash' || k END AS parent FROM o", graph=False)
def _(spark, d):
    args = F.when(F.col("k") % 2 == 0, text("res=0 ptid=", "c", "(bash", "k", ") x")).otherwise(text("res=0 tid=", "c", "(bash)"))
    return _orders(spark, d).select("k", syscall.exec_parent(args).alias("parent"))


@query("fn10_accessors", f"""WITH {O}, h AS (SELECT *, printf('%032x', k * 1000003 + c) AS x FROM o) SELECT k, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) || '-' || substr(x, 21) AS uuid, right(x, 8) AS short,
 CASE WHEN k % 2 = 0 THEN p ELSE 'c' || c END AS first, CASE WHEN k % 3 = 0 THEN '/p/' || c END AS path FROM h""", graph=False)
def _(spark, d):
    raw = F.unhex(F.lpad(F.hex(F.col("k") * 1000003 + F.col("c")), 32, "0"))
    props = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("path"), text("/p/", "c"))).otherwise(F.create_map(F.lit("other"), text("k")))
    first = audit.first_non_blank(F.when(F.col("k") % 2 == 0, F.col("p")).otherwise(F.lit("  ")), F.lit(None).cast("string"), text("c", "c").substr(1, 0), F.concat(F.lit("c"), F.col("c").cast("string")))
    return _orders(spark, d).select("k", audit.uuid_text(raw).alias("uuid"), audit.uuid8(audit.uuid_text(raw)).alias("short"), first.alias("first"), props["path"].alias("path"))


@query("fn11_labels", f"""WITH {O} SELECT k, 'f' || c AS base, 'sh' || c AS token, '0x' || printf('%x', k) AS memory, CASE WHEN k % 2 = 0 THEN 'registry://HK' || c ELSE 'registry://u' || k END AS object FROM o""", graph=False)
def _(spark, d):
    return _orders(spark, d).select(
        "k", audit.base_name(F.when(F.col("k") % 2 == 0, text("/a/b/f", "c")).otherwise(text("C:\\\\x\\f", "c"))).alias("base"), audit.first_command_token(F.when(F.col("k") % 2 == 0, text("  /usr/sh", "c", "  -x y")).otherwise(text('"C:\\p q\\sh', "c", '" -x'))).alias("token"), audit.memory_label(F.col("k")).alias("memory"),
        audit.object_label("registry", F.when(F.col("k") % 2 == 0, text("HK", "c")).otherwise(F.lit(" ")), text("u", "k")).alias("object"),
    )


@query("fn13_dot_labels", f"WITH {O} SELECT k, 'n' || c || ' [' || printf('%.4f', k / 7.0) || ']' AS label, CASE k % 3 WHEN 0 THEN 'box' WHEN 1 THEN 'ellipse' ELSE 'parallelogram' END AS shape, CASE WHEN k % 2 = 0 THEN p ELSE 'unknown' END AS edge FROM o", graph=False)
def _(spark, d):
    kinds = F.get(F.array(*[F.lit(x) for x in "PFN"]), (F.col("k") % 3).cast("int"))
    return _orders(spark, d).select("k", answers.node_label(text("=n", "c"), F.col("k") / 7.0).alias("label"), answers.node_shape(kinds).alias("shape"), answers.edge_label(F.when(F.col("k") % 2 == 0, F.col("p"))).alias("edge"))


@query("fn14_answers", f"WITH {O} SELECT k, CASE WHEN k % 2 = 0 THEN k || ',' || c ELSE c || ',' || k END AS edges, CASE WHEN k % 2 = 0 THEN 'a' || c || ';' || p ELSE '' END AS nodes FROM o", graph=False)
def _(spark, d):
    answer = F.when(F.col("k") % 2 == 0, text("```json\nEDGES: [", "k", ", ", "c", ", x]\nENTRY_NODES: ['a", "c", "', \"", "p", "\"]\n```")).otherwise(text("Keep [1] or better [", "c", ", ", "k", "]"))
    return _orders(spark, d).select("k", F.array_join(answers.edge_ids(answer), ",").alias("edges"), F.array_join(answers.entry_nodes(answer), ";").alias("nodes"))


@query("src2_fields", f"WITH {O} SELECT k, 'sh' || c AS process, CAST(c AS VARCHAR) AS pid, 'read' AS event, '/w' AS cwd, 'res=' || k AS args, (1600000000 + k) * 1000000000 + 500000000 AS t, 50 AS lat FROM o WHERE k % 3 <> 0", graph=False)
def _(spark, d):
    tail = F.when(F.col("k") % 3 == 1, F.lit(";;more;;x")).otherwise(F.lit(""))
    line = F.when(F.col("k") % 3 == 0, text("k", ";;0;;short")).otherwise(text((F.col("k") + 1_600_000_000).cast("string"), ".5;;0;;sh", "c", ";;", "c", ";;<;;read;;/w;;50;;res=", "k", tail))
    return syslog.fields(_orders(spark, d).select(F.col("k").alias("line_no"), line.alias("value"))).select(F.col("line_no").alias("k"), "process", "pid", "event", "cwd", "args", "t", "lat")


LEGACY = ("plain", "no_exec", "with_exec", "host")


@query("src3_layouts", f"""WITH {O}, l AS (SELECT unnest(['plain', 'no_exec', 'with_exec', 'host']) AS layout) SELECT layout, k, CAST(k AS VARCHAR) AS timestamp, 'sh' AS process, CAST(c AS VARCHAR) AS pid, 'read' AS event, '/w' AS cwd, '7' AS latency, 'res=' || c || ' x=1' AS args FROM o, l WHERE k % 4 = 0""", graph=False)
def _(spark, d):
    o, out = _orders(spark, d).where("k % 4 = 0"), None
    for layout in LEGACY:
        line = text(*(["h1 "] if layout == "host" else []), "k", " 0 sh (", "c", ") < read cwd=/w latency=7 res=", "c", " x=1", *([" exepath=/bin/sh"] if layout == "with_exec" else []))
        one = o.select(F.lit(layout).alias("layout"), "k", syscall.legacy_fields(line, layout).alias("f")).select("layout", "k", *[f"f.{c}" for c in ("timestamp", "process", "pid", "event", "cwd", "latency", "args")])
        out = one if out is None else out.unionByName(one)
    return out


# --- logs --------------------------------------------------------------------------------------


def _rule_lines(spark, d) -> DataFrame:
    """A start and an end line for each order, of the rule that its key's remainder by 12 names; see RULES."""
    k, c, p = F.col("k"), F.col("c"), F.col("p")
    file, net = text("fd=3(<f>/f/", "c", ") x"), text("fd=5(<4t>10.0.0.1:", "c", "->10.0.0.2:80) x")
    done = text("res=", "c", " data=")
    forms = {0: ("read", file, done), 1: ("write", file, done), 2: ("recvmsg", net, done), 3: ("sendto", net, done), 4: ("execve", text("filename=/bin/", "c"), text("res=0 ptid=", "c", "(init) x")), 5: ("accept", None, net), 6: ("fcntl", text("cmd=1"), net),
             7: ("rename", text("x"), text("res=0 oldpath=/o/", "c", " newpath=/n/", "c", " y")), 8: ("execve", text("filename=/bin/", "c"), text("res=-2 ptid=", "c", "(init) x")), 9: ("fcntl", net, text("res=0")), 10: ("read", file, text("res=-5")), 11: ("execve", text("nothing"), text("res=0 ptid=", "c", "(init) x"))}
    pick = lambda i: F.get(F.array(*[F.lit(None).cast("string") if f[i] is None else F.lit(f[i]) if i == 0 else f[i] for f in forms.values()]), (k % 12).cast("int"))
    stamp = lambda frac: F.concat((k + 1_600_000_000).cast("string"), F.lit(frac))
    line = lambda no, s, side, lat, args: F.struct((k * 2 + no).alias("line_no"), F.concat_ws(";;", s, F.lit("0"), F.lit("sh"), c.cast("string"), F.lit(side), pick(0), F.concat(F.lit("/"), p), F.lit(lat), args).alias("value"))
    start, end = line(0, stamp(".1"), ">", "0", pick(1)), line(1, stamp(".10000005"), "<", "50", pick(2))
    return _orders(spark, d).select(F.explode(F.when(k % 12 == 5, F.array(end)).otherwise(F.array(start, end))).alias("l")).select("l.*")


#: The same edges: times are start and end, an exec link's end is set apart.
RULES = f"""WITH {O}, t AS (SELECT *, k % 12 AS r, (k + 1600000000) * 1000000000 + 100000000 AS s, (k + 1600000000) * 1000000000 + 100000050 AS e, 'P:' || c || 'sh' AS own, 'F:/f/' || c AS f, 'N:10.0.0.1:' || c || '->10.0.0.2:80' AS n, 'P:' || c || 'init' AS parent FROM o)
SELECT f AS src, own AS dst, 'FtoP' AS etype, 'read' AS event, s AS start_t, e AS end_t, c AS size FROM t WHERE r = 0
UNION ALL SELECT own, f, 'PtoF', 'write', s, e, c FROM t WHERE r = 1
UNION ALL SELECT n, own, 'NtoP', 'recvmsg', s, e, c FROM t WHERE r = 2
UNION ALL SELECT own, n, 'PtoN', 'sendto', s, e, c FROM t WHERE r = 3
UNION ALL SELECT 'F:/bin/' || c, own, 'FtoP', 'execve', s, s, 0 FROM t WHERE r = 4
UNION ALL SELECT n, own, 'NtoP', 'accept', e, e, 0 FROM t WHERE r = 5
UNION ALL SELECT own, n, 'PtoN', 'accept', e, e, 0 FROM t WHERE r = 5
UNION ALL SELECT n, own, 'NtoP', 'fcntl', s, e, 0 FROM t WHERE r = 6
UNION ALL SELECT 'F:/o/' || c, own, 'FtoP', 'rename', s, e, 0 FROM t WHERE r = 7
UNION ALL SELECT own, 'F:/n/' || c, 'PtoF', 'rename', s, e, 0 FROM t WHERE r = 7"""


def _edges(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "etype", "event", "start_t", "end_t", "size")


@query("ing3_ing10_rules", RULES, graph=False)
def _(spark, d):
    return _edges(syslog.edges(_rule_lines(spark, d)).where("not (event = 'execve' and etype = 'PtoP')"))


# Each read or write of a process moves the end of its last exec link: the process raises the link back to its parent.
@query("ing7_exec_links", f"""WITH {O}, t AS (SELECT *, k % 12 AS r, (k + 1600000000) * 1000000000 + 100000050 AS e FROM o), x AS (SELECT c, k, e, lead(k, 1, 99999999999) OVER (PARTITION BY c ORDER BY k) AS until FROM t WHERE r = 4),
a AS (SELECT x.c, x.k, max(t.e) AS raised FROM x JOIN t ON t.c = x.c AND t.k > x.k AND t.k < x.until AND t.r IN (0, 1, 2, 3, 10) GROUP BY x.c, x.k)
SELECT 'P:' || c || 'init' AS src, 'P:' || c || 'sh' AS dst, e AS end_t FROM x UNION ALL SELECT 'P:' || c || 'sh', 'P:' || c || 'init', coalesce(greatest(e, raised), e) FROM x LEFT JOIN a USING (c, k)""", graph=False)
def _(spark, d):
    return syslog.edges(_rule_lines(spark, d)).where("event = 'execve' and etype = 'PtoP'").select("src", "dst", "end_t")


@query("ing12_reversed", RULES.replace("SELECT f AS src, own AS dst, 'FtoP'", "SELECT f AS src, own AS dst, 'FtoP'").replace("UNION ALL SELECT n, own, 'NtoP', 'recvmsg'", "UNION ALL SELECT own, n, 'NtoP', 'recvmsg'"), graph=False)
def _(spark, d):
    return _edges(syslog.reversed_receives(syslog.edges(_rule_lines(spark, d)).where("not (event = 'execve' and etype = 'PtoP')")))


@query("src1_log_files", RULES, graph=False)
def _(spark, d):
    """The lines written to a text file and read in its order."""
    path = scratch(spark)
    _rule_lines(spark, d).coalesce(1).sortWithinPartitions("line_no").select("value").write.text(path)
    return _edges(syslog.edges(syslog.read_log(spark, path)).where("not (event = 'execve' and etype = 'PtoP')"))


# --- a case from log lines to entry points -------------------------------------------------------


def _case_lines(spark, d) -> DataFrame:
    """For each customer: a receive, a read and a write to one of ten files; a collector reads those and writes one file."""
    o = _orders(spark, d).groupBy("c").agg(F.min("k").alias("k"))
    mod = F.col("c") % 10

    def pair(o: DataFrame, at: Column, process: str, pid: Column, event: str, args: Column, size: Column) -> DataFrame:
        stamp = lambda frac: F.concat(at.cast("string"), F.lit(frac))
        line = lambda no, s, side, lat, a: F.struct((at * 2 + no).alias("line_no"), F.concat_ws(";;", s, F.lit("0"), F.lit(process), pid.cast("string"), F.lit(side), F.lit(event), F.lit("/"), F.lit(lat), a).alias("value"))
        return o.select(F.explode(F.array(line(0, stamp(".1"), ">", "0", args), line(1, stamp(".10000005"), "<", "50", F.concat(F.lit("res="), size.cast("string"))))).alias("l")).select("l.*")

    c, base = F.col("c"), 1_600_000_000
    ten = spark.range(10).select(F.col("id").alias("c"))
    parts = [
        pair(o, c + base, "sh", c, "recvfrom", text("fd=3(<4t>10.0.0.1:", "c", "->10.0.0.2:80) x"), c + 10),
        pair(o, c + base + 1_000_000, "sh", c, "read", text("fd=3(<f>/in/", (c % 7).cast("string"), ") x"), c + 20),
        pair(o, c + base + 2_000_000, "sh", c, "write", text("fd=3(<f>/out/", mod.cast("string"), ") x"), c + 30),
        pair(ten, c + base + 3_000_000, "collect", c, "read", text("fd=3(<f>/out/", "c", ") x"), c + 40),
        pair(ten, c + base + 4_000_000, "collect", c, "write", text("fd=3(<f>/sum) x"), c + 100),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CASE = f"""WITH RECURSIVE cust AS (SELECT DISTINCT o_custkey AS c FROM orders), b AS (SELECT 1600000000000000000 AS t),
raw(src, dst, etype, event, start_t, size) AS (SELECT 'N:10.0.0.1:' || c || '->10.0.0.2:80', 'P:' || c || 'sh', 'NtoP', 'recvfrom', t + c * {SECOND}, c + 10 FROM cust, b
 UNION ALL SELECT 'F:/in/' || (c % 7), 'P:' || c || 'sh', 'FtoP', 'read', t + (c + 1000000) * {SECOND}, c + 20 FROM cust, b
 UNION ALL SELECT 'P:' || c || 'sh', 'F:/out/' || (c % 10), 'PtoF', 'write', t + (c + 2000000) * {SECOND}, c + 30 FROM cust, b
 UNION ALL SELECT 'F:/out/' || c, 'P:' || c || 'collect', 'FtoP', 'read', t + (c + 3000000) * {SECOND}, c + 40 FROM range(10) r(c), b
 UNION ALL SELECT 'P:' || c || 'collect', 'F:/sum', 'PtoF', 'write', t + (c + 4000000) * {SECOND}, c + 100 FROM range(10) r(c), b),
edges AS MATERIALIZED (SELECT row_number() OVER () AS edge_id, src, dst, etype, event, start_t + 100000000 AS start_t, start_t + 100000050 AS end_t, size FROM raw), poi AS (SELECT 'F:/sum' AS poi)"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("node", "kind", F.round("reputation", 6).alias("reputation"), F.col("rank").cast("long").alias("rank"))


RANKED = catalog.PROPAGATED.removeprefix(catalog.START) + catalog.CANDIDATES + catalog.RANKED


@query("case_log_ranked", CASE + catalog.START + RANKED + " SELECT node, kind, reputation, rank FROM rk", graph=False)
def _(spark, d):
    """From log lines to ranked entry points. No way to the point of interest is longer than the rounds that the SQL takes."""
    r = attack.investigate(checkpoint(syslog.edges(_case_lines(spark, d))), attack.Case("/sum"), weight_mode="nonml")
    return _rounded(ranking.ranked_candidates(r.candidates, r.reputation.select("node", F.round("reputation", 6).alias("reputation"))))


@query("case_log_merged", CASE + ", low AS (SELECT node FROM (SELECT src AS node FROM edges WHERE src LIKE 'N:%' ORDER BY 1 LIMIT 1)) SELECT src, dst, event, size FROM edges WHERE src IN (SELECT node FROM low)", graph=False)
def _(spark, d):
    """The log's graph: what leaves the first network node."""
    e = checkpoint(syslog.edges(_case_lines(spark, d)))
    first = e.where(F.col("src").startswith("N:")).agg(F.min("src").alias("src"))
    return e.join(F.broadcast(first), "src", "left_semi").select("src", "dst", "event", "size")  # one row


# --- audit records -------------------------------------------------------------------------------


UUID = lambda c: F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(c.cast("string"), 12, "0"))
VOID = {"subtype": "string", "cid": "int", "parent": "string", "cmd": "string", "local_address": "string", "local_port": "int", "remote_address": "string", "remote_port": "int", "memory_address": "long", "reg_key": "string", "subject": "string", "object": "string", "object_path": "string", "object2": "string", "object2_path": "string", "t": "long", "size": "long", "properties": "map<string,string>"}


def _records(df: DataFrame, file_no: int, kind: str | Column, uuid: Column, **has: Column) -> DataFrame:
    """Audit records: one a row of df, which has a column rec_no."""
    return df.select(F.lit(file_no).alias("file_no"), "rec_no", (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), uuid.alias("uuid"), *[has.get(c, F.lit(None)).cast(t).alias(c) for c, t in VOID.items()])


@query("cdm6_node_kinds", """WITH q AS (SELECT DISTINCT p_partkey AS k FROM part), h AS (SELECT *, printf('00000000-0000-0000-0000-%012d', k) AS u, right(printf('%012d', k), 8) AS s FROM q)
SELECT k, CASE k % 9 WHEN 0 THEN 'P' WHEN 2 THEN 'N' WHEN 4 THEN 'N' WHEN 5 THEN 'N' ELSE 'F' END AS kind,
 CASE k % 9 WHEN 0 THEN k || '@' || s || CASE k % 3 WHEN 0 THEN 'sh' || k ELSE '' END WHEN 1 THEN '/f/' || k WHEN 2 THEN CASE WHEN k % 2 = 0 THEN '10.0.0.1:' || k ELSE '0.0.0.0:0' END || '->10.0.0.2:80'
  WHEN 3 THEN 'ipc://i' || k WHEN 4 THEN 'unix:0->/i/' || k || ':0' WHEN 5 THEN 'unix:0->socket-' || s || ':0' WHEN 6 THEN 'registry://HK' || k WHEN 7 THEN CASE WHEN k % 2 = 0 THEN 'mem://0x' || printf('%x', k) ELSE 'mem://' || u END ELSE 'srcsink://srcsink-' || s END AS signature FROM h""", graph=False)
def _(spark, d):
    k = F.col("k")
    q = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k")).distinct().withColumn("rec_no", k)
    pick = lambda *v: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in v]), (k % 9).cast("int"))
    kind = pick(*[f"RECORD_{x}" for x in ("SUBJECT", "FILE_OBJECT", "NET_FLOW_OBJECT", "IPC_OBJECT", "IPC_OBJECT", "PACKET_SOCKET_OBJECT", "REGISTRY_KEY_OBJECT", "MEMORY_OBJECT", "SRC_SINK_OBJECT")])
    net = (k % 9 == 2) & (k % 2 == 0)
    props = F.when(k % 9 == 1, F.create_map(F.lit("filename"), F.concat(F.lit("/f/"), k))).when(k % 9 == 3, F.create_map(F.lit("name"), F.concat(F.lit("i"), k))).when(k % 9 == 4, F.create_map(F.lit("path"), F.concat(F.lit("/i/"), k)))
    records = _records(q, 0, kind, UUID(k), subtype=pick("", "", "", "IPC_PIPE", "IPC_SOCKET", F.lit(None).cast("string"), "", "", ""), cid=k, cmd=F.concat(F.lit("sh"), k, F.lit(" -x")), local_address=F.when(net, "10.0.0.1"), local_port=F.when(net, k), remote_address=F.lit("10.0.0.2"), remote_port=F.lit(80), reg_key=F.concat(F.lit("HK"), k), memory_address=F.when(k % 2 == 0, k), properties=props)
    return audit_graph.described(records).select(F.substring("ref", -12, 12).cast("long").alias("k"), "kind", "signature")


def _family(spark, d) -> DataFrame:
    """Customers as subjects, each the child of half its number; odd ones execute a file; orders write to files by priority."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    people = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("c")).distinct().withColumn("rec_no", F.col("c"))
    parent = F.when(F.col("c") > 1, UUID(F.floor(F.col("c") / 2)))
    subjects = _records(people, 0, "RECORD_SUBJECT", UUID(F.col("c")), cid=F.col("c"), cmd=F.lit("sh"), parent=parent)
    runs = F.col("k") % 3 == 0
    events = _records(o.withColumn("rec_no", F.col("k")), 1, "RECORD_EVENT", F.lit(None).cast("string"), subtype=F.when(runs, "EVENT_EXECUTE").otherwise("EVENT_WRITE"), subject=UUID(F.col("c")), object_path=F.when(runs, F.lit("/bin/x")).otherwise(F.concat(F.lit("/p/"), "p")), t=F.col("us") * 1000, size=F.col("k"))
    return checkpoint(subjects.unionByName(events))


FAMILY = """f AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, 1000 * epoch_us(o_orderdate) AS t, o_orderkey % 3 = 0 AS runs FROM orders), name(c, node) AS (SELECT c_custkey, 'P:' || c_custkey || '@' || right(printf('%012d', c_custkey), 8) || 'sh' FROM customer),
moves AS (SELECT CASE WHEN runs THEN 'F:/bin/x' ELSE node END AS src, CASE WHEN runs THEN node ELSE 'F:/p/' || p END AS dst, CASE WHEN runs THEN 'FtoP' ELSE 'PtoF' END AS etype, CASE WHEN runs THEN 'EXECUTE' ELSE 'WRITE' END AS event, t AS start_t, t AS end_t, k AS size FROM f JOIN name USING (c)
 UNION ALL SELECT b.node, a.node, 'PtoP', 'EXECUTE_PARENT', t, t, 0 FROM f JOIN name a USING (c) JOIN name b ON b.c = f.c // 2 WHERE runs AND f.c > 1)"""


@query("cdm5_cdm7_parents", f"WITH {FAMILY} SELECT * FROM moves", graph=False)
def _(spark, d):
    return _edges(audit_graph.edges(_family(spark, d)))


@query("cdm10_nodes", f"WITH RECURSIVE {FAMILY}, up(c) AS (SELECT DISTINCT c FROM f UNION SELECT c // 2 FROM up WHERE c > 1) SELECT node FROM up JOIN name USING (c) UNION SELECT 'F:/p/' || p FROM f WHERE NOT runs UNION SELECT 'F:/bin/x' FROM f WHERE runs", graph=False)
def _(spark, d):
    """All things and, by the closure over parents, processes that no edge touches."""
    return audit_graph.built(_family(spark, d))[0]


@query("cdm8_sliced", f"WITH RECURSIVE {FAMILY}, bt(node, thr) AS (SELECT 'F:/p/2-HIGH', max(end_t) FROM moves WHERE dst = 'F:/p/2-HIGH' UNION SELECT src, least(end_t, thr) FROM bt JOIN moves ON dst = node WHERE start_t <= thr), thr AS (SELECT node, max(thr) AS thr FROM bt GROUP BY node) SELECT moves.* FROM moves JOIN thr ON dst = node WHERE start_t <= thr", graph=False)
def _(spark, d):
    return _edges(audit_graph.edges(_family(spark, d), poi=["/p/2-HIGH"]))


@query("cdm3_cdm4_scan_order", """WITH q AS (SELECT DISTINCT s_suppkey AS k FROM supplier) SELECT k, CASE WHEN k % 3 = 0 THEN '/given/' || k WHEN k % 3 = 1 THEN '/two/' || k ELSE '/three/' || k END AS signature FROM q""", graph=False)
def _(spark, d):
    """An object that several files tell: the event's path, then the last event file and those before it, then later files."""
    k = F.col("k")
    q = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k")).distinct().withColumn("rec_no", k)
    told = lambda df, file_no, name: _records(df, file_no, "RECORD_FILE_OBJECT", UUID(k), properties=F.create_map(F.lit("filename"), F.concat(F.lit(name), k)))
    events = lambda file_no: _records(q, file_no, "RECORD_EVENT", F.lit(None).cast("string"), subtype=F.lit("EVENT_WRITE"), subject=F.lit(UUID(k)), object=UUID(k), object_path=F.when(k % 3 == 0, F.concat(F.lit("/given/"), k)), t=k, size=k)
    every = told(q, 0, "/zero/").unionByName(told(q.where("k % 3 = 1"), 2, "/two/")).unionByName(events(1)).unionByName(told(q.where("k % 3 <> 2"), 1, "/two/").where("false")).unionByName(told(q, 3, "/three/"))
    every = every.where("not (file_no = 0 and type = 'RECORD_FILE_OBJECT')").unionByName(events(2).where("false"))
    every = checkpoint(every.withColumn("subject", F.lit(None).cast("string")))
    found = audit_graph.entities(every, every.where("type = 'RECORD_EVENT'"), q.select(F.concat(F.lit("u:"), UUID(k)).alias("ref")))
    return found.select(F.substring("ref", -12, 12).cast("long").alias("k"), "signature")


@query("fn15_window_and_cut", f"WITH {FAMILY}, w AS (SELECT *, row_number() OVER (ORDER BY k) AS n FROM f WHERE t BETWEEN 800000000000000000 AND 900000000000000000) SELECT k FROM w WHERE n <= 500", graph=False)
def _(spark, d):
    return audit_graph.event_rows(_family(spark, d), 800_000_000_000_000_000, 900_000_000_000_000_000, 500).select(F.col("rec_no").alias("k"))


@query("cdm11_summary", f"WITH {FAMILY} SELECT (SELECT count(*) FROM f) AS events, (SELECT count(DISTINCT c_custkey) FROM customer) AS objects, (SELECT count(*) FROM moves) AS mapped_edges, (SELECT count(*) FROM (SELECT src FROM moves UNION SELECT dst FROM moves)) AS nodes", graph=False)
def _(spark, d):
    r = _family(spark, d)
    return audit_graph.build_summary(r, audit_graph.edges(r))


@query("case_cdm_candidates", f"""WITH RECURSIVE {FAMILY}, bt(node, thr) AS (SELECT 'F:/p/2-HIGH', max(end_t) FROM moves WHERE dst = 'F:/p/2-HIGH' UNION SELECT src, least(end_t, thr) FROM bt JOIN moves ON dst = node WHERE start_t <= thr), thr AS (SELECT node, max(thr) AS thr FROM bt GROUP BY node),
s AS (SELECT moves.* FROM moves JOIN thr ON dst = node WHERE start_t <= thr), n AS (SELECT src AS node FROM s UNION SELECT dst FROM s)
SELECT node, substr(node, 1, 1) AS kind FROM n WHERE node <> 'F:/p/2-HIGH' AND ((node LIKE 'P:%' AND node NOT IN (SELECT dst FROM s WHERE src LIKE 'P:%')) OR (node LIKE 'F:%' AND node NOT IN (SELECT dst FROM s)))""", graph=False)
def _(spark, d):
    """From audit records to entry points."""
    e = audit_graph.edges(_family(spark, d))
    r = attack.investigate(checkpoint(e), attack.Case("/p/2-HIGH", reputation=audit_graph.REPUTATION), weight_mode="nonml")
    return r.candidates.select("node", "kind")


@query("t12_entries_reach", CASE + ", goal AS (SELECT DISTINCT src FROM edges WHERE src LIKE 'N:%') SELECT count(*) AS reached FROM goal", graph=False)
def _(spark, d):
    """A model keeps one edge of the log's graph: each network node that a case lists is linked back to the point of interest."""
    e = checkpoint(syslog.edges(_case_lines(spark, d)))
    nets = [r[0] for r in e.where(F.col("src").startswith("N:")).select("src").distinct().collect()]
    out = checkpoint(slicing.connected_to_poi(e, e.where("dst = 'F:/sum'").orderBy("edge_id").limit(1), nets, "F:/sum"))
    back = slicing.back_track(out, "F:/sum")
    return back.where(F.col("node").startswith("N:")).agg(F.count("*").alias("reached"))


@query("t9_repaired", CASE + " SELECT src, dst, event, size FROM edges WHERE src NOT LIKE 'F:/in/%'", graph=False)
def _(spark, d):
    """Kept: what enters the point of interest. Each network node comes back to it by its shortest way through the log's graph."""
    e = checkpoint(syslog.edges(_case_lines(spark, d)))
    nets = e.where(F.col("src").startswith("N:")).select(F.col("src").alias("node")).distinct()
    high = spark.createDataFrame([("F:/sum", 1.0)], "node string, reputation double")
    return slicing.repaired(e.where("dst = 'F:/sum'"), nets, e, high).select("src", "dst", "event", "size")


# --- files beside the logs -----------------------------------------------------------------------


def _files(spark, d, name: str, body: str, where: str = "true") -> tuple[str, list[str]]:
    """A folder with a file for each nation; name and body have its key as {k} and its name as {n}."""
    folder = scratch(spark)
    os.makedirs(folder)
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").where(where).orderBy("n_nationkey").collect()  # 25 rows
    for r in rows:
        with open(os.path.join(folder, name.format(k=r[0], n=r[1])), "w", encoding="utf-8") as f:
            f.write(body.format(k=r[0], n=r[1]))
    return folder, [r[1] for r in rows]


@query("src6_file_order", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS place, 'Case' || n_nationkey || 'x.avro' AS name FROM nation", graph=False)
def _(spark, d):
    folder, _ = _files(spark, d, "Case{k}x.avro", "")
    open(os.path.join(folder, "other.txt"), "w").close()
    names = [os.path.basename(p) for p in manifest.input_files(folder, "Case*.avro")]
    return spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "place int, name string")


@query("src7_time_index", "SELECT 'f' || n_nationkey AS name, n_nationkey * 10 AS least, n_nationkey * 20 + 5 AS greatest, 2 AS n FROM nation WHERE n_nationkey * 20 + 5 >= 100 AND n_nationkey * 10 <= 180", graph=False)
def _(spark, d):
    """Files whose times, kept in a sidecar, overlap a window."""
    folder, _ = _files(spark, d, "f{k}", "{k}0\n{k}")
    times = lambda p: (lambda a, b: [int(a), 2 * int(a) + 5])(*open(p).read().split("\n"))
    for _ in range(2):  # built, then read again
        index = manifest.time_index(manifest.input_files(folder, "f*"), times, os.path.join(folder, "index.json"))
    kept = [index[p] for p in manifest.overlapping(index, 100, 180)]
    return spark.createDataFrame([(e["fileName"], e["minTimestampNanos"], e["maxTimestampNanos"], e["eventCount"]) for e in kept], "name string, least int, greatest int, n int")


@query("src9_src10_cases", """SELECT n_name AS log, '/n/' || n_nationkey AS poi, '/h,/n/' || n_nationkey AS high, 'a, b' AS low, 'lib,m' AS mid, CAST(n_nationkey + 0.5 AS DOUBLE) AS size, 'e1,e2' AS entry FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_name, '/two', '/two', '', 'lib', 0.0, '' FROM nation WHERE n_nationkey % 4 = 0""", graph=False)
def _(spark, d):
    """Cases of the logs in a folder; logs without one are left out."""
    folder, names = _files(spark, d, "{n}.txt", "")
    for name, body, where in (("{n}.property", "POI=/n/{k}\nhighRP=/h,\nlowRP=a, b\nmidRP=m\nentry= e1 , e2,\ndetectionSize={k}.5\n", "n_nationkey % 2 = 0"), ("{n}:2.property", "POI=/two\n", "n_nationkey % 4 = 0"), ("x{n}.property", "POI=/no\n", "true")):
        other, _ = _files(spark, d, name, body, where)
        for f in os.listdir(other):
            os.rename(os.path.join(other, f), os.path.join(folder, f))
    rows = []
    for log in manifest.logs_with_cases(folder):
        for path in manifest.cases_of(folder, log):
            c = manifest.CaseConfig.load(path, ["lib"])
            rows.append((os.path.splitext(os.path.basename(log))[0], c.poi, ",".join(c.high), ",".join(c.low), ",".join(c.mid), c.detection_size, ",".join(c.entry)))
    return spark.createDataFrame(rows, "log string, poi string, high string, low string, mid string, size double, entry string")


@query("src5_manifest", "SELECT 'case*' || n_nationkey || '.avro' AS pattern, CAST(n_nationkey AS BIGINT) AS first_t, CAST(n_nationkey + 5 AS BIGINT) AS last_t, n_nationkey % 3 AS most FROM nation", graph=False)
def _(spark, d):
    folder, _ = _files(spark, d, "m{k}.cdm", "# a manifest\ncdm.input_dir=.\ncdm.file_glob = case*{k}.avro\ncdm.start_nanos={k}\ncdm.end_nanos: {k}\ncdm.max_events=\n")
    out = []
    for path in manifest.input_files(folder, "*.cdm"):
        m = manifest.Manifest.load(path)
        out.append((m.glob, m.start, m.end + 5, m.start % 3 + m.max_events))
    return spark.createDataFrame(out, "pattern string, first_t long, last_t long, most int")
