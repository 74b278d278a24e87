"""The registered queries of the library and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelight.functions import audit, syscall
from tracelight.graph import SECOND, kind, nodes_of
from tracelight.operators import ranking, reduction, slicing, statistics, weights
from tracelight.plans import attack, testgraph
from tracelight.plans.fixpoint import checkpoint, scratch, stored
from tracelight.registry import QUERIES, SQL, query
from tracelight.sources import audit_graph, snapshot, syslog

DAY = 86_400 * SECOND
def graph(spark: SparkSession, d: str, ids: bool = False) -> DataFrame:
    return testgraph.edges(spark, d, ids)


def _poi(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    e = stored(graph(spark, d))
    return e, testgraph.point_of_interest(e)


def _r(column: str, alias: str | None = None, places: int = 6):
    return F.round(column, places).alias(alias or column)


# --- assembly and statistics -----------------------------------------------------------------


@query("ing11_graph_edges", "SELECT src, dst, etype, event, start_t, end_t, size, edge_id FROM edges")
def _(spark, d):
    return graph(spark, d, ids=True).select("src", "dst", "etype", "event", "start_t", "end_t", "size", F.col("edge_id").cast("long").alias("edge_id"))


@query("ing11_graph_nodes", "SELECT substr(node, 1, 1) AS kind, node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)")
def _(spark, d):
    return nodes_of(graph(spark, d)).select(kind("node").alias("kind"), "node")


@query("a1_detection_size", ", m AS (SELECT max(size) FILTER (dst = poi) AS i, max(size) FILTER (src = poi) AS o FROM edges, poi) SELECT CASE WHEN i > 0 THEN i ELSE coalesce(o, 0) END AS detection_size FROM m")
def _(spark, d):
    return statistics.detection_size(*_poi(spark, d))


@query("a2_poi_time", "SELECT max(end_t) AS poi_time FROM edges")
def _(spark, d):
    return statistics.poi_time(graph(spark, d))


@query("a3_latest_operation", "SELECT max(end_t) AS latest_end, max(start_t) AS latest_start FROM edges, poi WHERE dst = poi")
def _(spark, d):
    return statistics.latest_operation(*_poi(spark, d))


@query("a4_degrees", "SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node")
def _(spark, d):
    return weights.degrees(graph(spark, d))


@query("a5_source_sums", "SELECT src, CAST(sum(size) AS BIGINT) AS size_sum, count(*) AS n FROM edges GROUP BY src")
def _(spark, d):
    return statistics.source_sums(graph(spark, d))


@query("a6_moments", "SELECT round(avg(size), 4) AS mean, round(stddev_samp(size), 4) AS deviation, min(size) AS least, max(size) AS greatest, (SELECT min(size) FROM edges WHERE size > (SELECT min(size) FROM edges)) AS second_least FROM edges")
def _(spark, d):
    return statistics.moments(graph(spark, d), "size").select(_r("mean", places=4), _r("deviation", places=4), "least", "greatest", "second_least")


@query("a7_pair_counts", "SELECT src, dst, count(*) AS n FROM edges GROUP BY src, dst")
def _(spark, d):
    return statistics.pair_counts(graph(spark, d))


@query("a8_kind_event_counts", "SELECT 'kind' AS what, substr(node, 1, 1) AS name, count(*) AS n FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) GROUP BY 2 UNION ALL SELECT 'event', event, count(*) FROM edges GROUP BY event")
def _(spark, d):
    return statistics.kind_event_counts(graph(spark, d))


@query("a12_compression", "SELECT count(*) AS edges_before, count(DISTINCT (src, dst)) AS edges_after, round(count(*) / count(DISTINCT (src, dst)), 4) AS ratio FROM edges")
def _(spark, d):
    e = checkpoint(graph(spark, d))
    return statistics.compression(e, reduction.full_merge(e))


@query("a13_time_index", "SELECT event_type AS file, 1000 * epoch_us(min(ts)) AS least, 1000 * epoch_us(max(ts)) AS greatest, count(*) AS n_events FROM events GROUP BY 1", graph=False)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", testgraph.nanos("ts").alias("t"))
    return statistics.time_index(e, "event_type", "t")


@query("a11_read_only_stats", """, entered AS (SELECT DISTINCT dst FROM edges), plain AS (SELECT DISTINCT src FROM edges WHERE src LIKE 'F:%' AND src NOT IN (SELECT dst FROM entered))
SELECT (SELECT count(*) FROM edges) AS edges_before, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT src FROM plain)) AS edges_after,
 (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes_before, (SELECT count(*) FROM plain) AS files_dropped""")
def _(spark, d):
    return ranking.read_only_stats(checkpoint(graph(spark, d)))


# --- reduction -------------------------------------------------------------------------------


@query("c1_windowed_sequence", f""", b AS (SELECT *, CASE WHEN start_t - lag(end_t) OVER w > {30 * DAY} THEN 1 ELSE 0 END AS brk FROM edges WINDOW w AS (PARTITION BY event, src, dst ORDER BY start_t, end_t)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY event, src, dst ORDER BY start_t, end_t) AS run FROM b)
SELECT event, src, dst, min(start_t) AS start_t, arg_max(end_t, (start_t, end_t)) AS end_t, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY event, src, dst, run""")
def _(spark, d):
    return reduction.windowed_sequence(graph(spark, d), 30 * DAY).select("event", "src", "dst", "start_t", "end_t", "size")


def _event_edges(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", testgraph.nanos("ts").alias("t"))
    return e.select(F.col("event_id").alias("edge_id"), F.concat(F.lit("P:user#"), "user_id").alias("src"), F.concat(F.lit("F:"), "event_type").alias("dst"), F.lit("PtoF").alias("etype"), F.col("event_type").alias("event"), F.col("t").alias("start_t"), F.col("t").alias("end_t"), F.lit(1).cast("long").alias("size"))


EV = "ev AS MATERIALIZED (SELECT event_id AS edge_id, 'P:user#' || user_id AS src, 'F:' || event_type AS dst, event_type AS event, 'PtoF' AS etype, 1000 * epoch_us(ts) AS start_t, 1000 * epoch_us(ts) AS end_t, 1 AS size FROM events)"


@query("c1_event_runs", f"""WITH {EV}, b AS (SELECT *, CASE WHEN start_t - lag(end_t) OVER (PARTITION BY event, src, dst ORDER BY start_t, end_t, edge_id) > {DAY // 2} THEN 1 ELSE 0 END AS brk FROM ev),
r AS (SELECT *, sum(brk) OVER (PARTITION BY event, src, dst ORDER BY start_t, end_t, edge_id) AS run FROM b)
SELECT event, src, dst, min(start_t) AS start_t, max(end_t) AS end_t, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY event, src, dst, run""", graph=False)
def _(spark, d):
    return reduction.windowed_sequence(_event_edges(spark, d), DAY // 2).select("event", "src", "dst", "start_t", "end_t", "size")


CPR = """, o AS (SELECT *, lag(edge_id) OVER (PARTITION BY event, src, dst ORDER BY start_t, end_t, edge_id) AS p FROM edges),
g AS (SELECT o.*, q.start_t AS ps, q.end_t AS pe, row_number() OVER (PARTITION BY o.event, o.src, o.dst ORDER BY o.start_t, o.end_t, o.edge_id) AS n FROM o LEFT JOIN edges q ON q.edge_id = o.p),
k AS (SELECT g.*, pe < end_t AND EXISTS (SELECT 1 FROM edges x WHERE x.dst = g.src AND ((x.start_t < g.end_t AND x.end_t >= g.end_t) OR (x.end_t < g.end_t AND x.end_t > g.pe))) AS back FROM g),
r(event, src, dst, n, run, rs, size, end_t) AS (
 SELECT event, src, dst, n, edge_id, start_t, size, end_t FROM k WHERE n = 1
 UNION ALL
 SELECT k.event, k.src, k.dst, k.n, CASE WHEN x.brk THEN k.edge_id ELSE r.run END, CASE WHEN x.brk THEN k.start_t ELSE r.rs END, k.size, k.end_t
 FROM r JOIN k ON k.event = r.event AND k.src = r.src AND k.dst = r.dst AND k.n = r.n + 1,
 LATERAL (SELECT k.back OR (r.rs < k.start_t AND EXISTS (SELECT 1 FROM edges x WHERE x.src = k.dst AND ((x.start_t < k.start_t AND x.end_t >= k.start_t) OR (x.end_t < k.start_t AND x.end_t > r.rs)))) AS brk) x)
SELECT event, src, dst, min(rs) AS start_t, arg_max(end_t, n) AS end_t, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY event, src, dst, run"""


@query("c2_standard_cpr", CPR, recursive=True)
def _(spark, d):
    return reduction.standard_cpr(checkpoint(graph(spark, d))).select("event", "src", "dst", "start_t", "end_t", "size")


@query("c3_full_merge", "SELECT src, dst, 'NullAfterMerge' AS event, arg_min(start_t, (end_t, edge_id)) AS start_t, max(end_t) AS end_t, CAST(sum(size) AS BIGINT) AS size FROM edges GROUP BY src, dst")
def _(spark, d):
    return reduction.full_merge(graph(spark, d, ids=True)).select("src", "dst", "event", "start_t", "end_t", "size")


@query("c4_no_merge", "SELECT src, dst, event, start_t, end_t, size FROM edges")
def _(spark, d):
    return reduction.reduced(graph(spark, d), "no_merge").select("src", "dst", "event", "start_t", "end_t", "size")


for _mode in ("fd", "sd"):

    @query(f"c{5 if _mode == 'fd' else 6}_{_mode}")
    def _(spark, d, mode=_mode):
        return reduction.reduced(stored(graph(spark, d, ids=True)), mode)


# The events as a graph: a hundred users that touch a few things again and again, so that reductions merge thousands of edges.

MERGED = "SELECT src, dst, {event} AS event, min(start_t) AS start_t, arg_max(end_t, (start_t, end_t, edge_id)) AS end_t, CAST(sum(size) AS BIGINT) AS size FROM ev GROUP BY ALL"


@query("c2_event_cpr", f"WITH RECURSIVE {EV}, edges AS (SELECT * FROM ev)" + CPR, graph=False)
def _(spark, d):
    return reduction.standard_cpr(checkpoint(_event_edges(spark, d))).select("event", "src", "dst", "start_t", "end_t", "size")


@query("c3_event_merge", f"WITH {EV} " + MERGED.format(event="'NullAfterMerge'"), graph=False)
def _(spark, d):
    return reduction.full_merge(_event_edges(spark, d)).select("src", "dst", "event", "start_t", "end_t", "size")


# Nothing enters a user, so what it has told once it never tells anew: one edge of each pair is left.
for _mode in ("fd", "sd"):

    @query(f"c{5 if _mode == 'fd' else 6}_event_{_mode}", f"WITH {EV} " + MERGED.format(event="event"), graph=False)
    def _(spark, d, mode=_mode):
        return reduction.reduced(checkpoint(_event_edges(spark, d)), mode).select("src", "dst", "event", "start_t", "end_t", "size")


# --- slices ----------------------------------------------------------------------------------

BACK = """, bt(node, thr) AS (SELECT poi, (SELECT max(end_t) FROM edges, poi WHERE dst = poi) FROM poi
 UNION SELECT e.src, least(e.end_t, b.thr) FROM bt b JOIN edges e ON e.dst = b.node WHERE e.start_t <= b.thr),
thr AS (SELECT node, max(thr) AS thr FROM bt GROUP BY node),
sl AS MATERIALIZED (SELECT e.* FROM edges e JOIN thr ON e.dst = thr.node WHERE e.start_t <= thr.thr)"""


@query("t1_back_track", BACK + " SELECT node, thr FROM thr", recursive=True)
def _(spark, d):
    return slicing.back_track(*_poi(spark, d))


@query("t1_slice_edges", BACK + " SELECT src, dst, event, start_t, end_t, size FROM sl", recursive=True)
def _(spark, d):
    e, poi = _poi(spark, d)
    return slicing.slice_edges(e, slicing.back_track(e, poi)).select("src", "dst", "event", "start_t", "end_t", "size")


@query("t2_steps", BACK + """, tr AS MATERIALIZED (SELECT DISTINCT src, dst FROM sl), st(node, step) AS (SELECT poi, 1 FROM poi UNION SELECT src, step + 1 FROM st JOIN tr ON dst = node WHERE step < 60)
SELECT thr.node, thr, min(step) AS step FROM st JOIN thr ON thr.node = st.node GROUP BY thr.node, thr""", recursive=True)
def _(spark, d):
    return slicing.back_track_steps(*_poi(spark, d))


@query("t2_back_track_fifo")
def _(spark, d):
    e = checkpoint(graph(spark, d, ids=True))
    return slicing.back_track_fifo(e, testgraph.point_of_interest(e))


@query("t3_back_track_scan")
def _(spark, d):
    e = checkpoint(graph(spark, d, ids=True))
    return slicing.back_track_scan(e, testgraph.point_of_interest(e))


COMPONENT = ", cc(node) AS (SELECT poi FROM poi UNION SELECT CASE WHEN e.src = c.node THEN e.dst ELSE e.src END FROM cc c JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = c.node OR e.dst = c.node)"


@query("t4_component", ", two AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), cc(node) AS (SELECT poi FROM poi UNION SELECT b FROM cc JOIN two ON a = node) SELECT node FROM cc", recursive=True)
def _(spark, d):
    return slicing.component_of(*_poi(spark, d))


def _latest(e: DataFrame) -> int:
    return statistics.poi_time(e).first()[0]


def _roots(e: DataFrame, n: int) -> DataFrame:
    return e.where(F.col("src").startswith("N:")).select(F.col("src").alias("node")).distinct().orderBy("node").limit(n)


def _forward_sql(n: int, depth: int | None = None) -> str:
    level = ", lvl" if depth else ""
    return f""", roots AS (SELECT DISTINCT src AS node FROM edges WHERE src LIKE 'N:%' ORDER BY 1 LIMIT {n}), lim AS (SELECT max(end_t) AS t FROM edges, poi WHERE dst = poi),
fw(root, node, arr{level}) AS (SELECT node, node, {slicing.LOW}{', 0' if depth else ''} FROM roots UNION
 SELECT f.root, e.dst, e.start_t{', f.lvl + 1' if depth else ''} FROM fw f JOIN edges e ON e.src = f.node, lim WHERE e.start_t >= f.arr AND e.start_t < lim.t{f' AND f.lvl < {depth}' if depth else ''})
SELECT root, node, min(arr) AS arr FROM fw GROUP BY root, node"""


def _forward(spark, d, n, rounds=None):
    e, poi = _poi(spark, d)
    return slicing.forward(e, _roots(e, n), slicing.latest_in(e, poi), rounds)


@query("t5_forward", _forward_sql(1), recursive=True)
def _(spark, d):
    return _forward(spark, d, 1)


@query("t6_forward_steps", _forward_sql(3, 3), recursive=True)
def _(spark, d):
    return _forward(spark, d, 3, 3)


@query("t7_forward_many", _forward_sql(3), recursive=True)
def _(spark, d):
    return _forward(spark, d, 3)


@query("t8_merged_forward", BACK + f""", roots AS (SELECT DISTINCT src AS node FROM sl WHERE src LIKE 'N:%' ORDER BY 1 LIMIT 3), lim AS (SELECT max(end_t) AS t FROM sl),
fw(node, root, arr) AS (SELECT node, node, {slicing.LOW} FROM roots UNION SELECT e.dst, f.root, e.start_t FROM fw f JOIN sl e ON e.src = f.node, lim WHERE e.start_t >= f.arr AND e.start_t < lim.t),
best AS (SELECT root, node, min(arr) AS arr FROM fw GROUP BY root, node),
pairs AS (SELECT DISTINCT e.src, e.dst FROM best b JOIN sl e ON e.src = b.node, lim WHERE e.start_t >= b.arr AND e.start_t < lim.t)
SELECT src, dst, event, start_t, end_t, size FROM sl SEMI JOIN pairs USING (src, dst)""", recursive=True)
def _(spark, d):
    e, poi = _poi(spark, d)
    s = checkpoint(slicing.slice_edges(e, slicing.back_track(e, poi)))
    return slicing.merged_forward(s, _roots(s, 3), _latest(s)).select("src", "dst", "event", "start_t", "end_t", "size")


# SQL takes 1 or 3 roots: the queries above are held against it, these take all.


def _all_roots(e: DataFrame) -> DataFrame:
    return e.where(F.col("src").startswith("N:")).select(F.col("src").alias("node")).distinct()


def _forward_all(spark, d, rounds=None):
    e, poi = _poi(spark, d)
    return slicing.forward_many(e, _all_roots(e), slicing.latest_in(e, poi), rounds)


@query("t6_forward_all_steps")
def _(spark, d):
    return _forward_all(spark, d, 3)


@query("t7_forward_all")
def _(spark, d):
    return _forward_all(spark, d)


@query("t8_merged_candidates")
def _(spark, d):
    """From all entry candidates, so that their order by converged reputation does not matter."""
    e, poi = _poi(spark, d)
    s = checkpoint(slicing.slice_edges(e, slicing.back_track(e, poi)))
    starts = ranking.entry_candidates(s, poi)
    return slicing.merged_forward(s, starts, _latest(s)).select("src", "dst", "event", "start_t", "end_t", "size")


# --- weights ---------------------------------------------------------------------------------

FEATURES = """, c AS (SELECT max(end_t) AS pt, count(*) AS n FROM edges), det AS (SELECT CASE WHEN i > 0 THEN i ELSE coalesce(o, 0) END AS det FROM (SELECT max(size) FILTER (dst = poi) AS i, max(size) FILTER (src = poi) AS o FROM edges, poi)),
deg AS (SELECT node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node),
f AS MATERIALIZED (SELECT e.*, ln(1 + CASE WHEN end_t = pt THEN 1e10 ELSE 1 / (abs(end_t - pt) / 1e9) END) AS w_time, 1 / (abs(size - det) + 1e-4) AS w_amount,
 CASE WHEN dst = poi THEN CAST(n AS DOUBLE) ELSE n_out / n_in END AS w_struct FROM edges e JOIN deg ON node = dst, c, det, poi)"""
NONML = """, g AS (SELECT *, w_time / sum(w_time) OVER s AS t, w_amount / sum(w_amount) OVER s AS a,
 CASE WHEN src = poi THEN 1.0 WHEN sum(w_struct) OVER s > 1e-8 THEN w_struct / sum(w_struct) OVER s ELSE 1.0 END AS st, sum(size) OVER s < 1e-8 AS nodata FROM f, poi WINDOW s AS (PARTITION BY src)),
h AS (SELECT *, CASE WHEN nodata THEN 0.5 * t + 0.5 * st ELSE 0.334 * t + 0.333 * st + 0.333 * a END AS m FROM g),
w AS MATERIALIZED (SELECT *, m / sum(m) OVER (PARTITION BY src) * CASE WHEN nodata THEN 1 ELSE 0.99 END AS weight FROM h)"""
KEY = "src, dst, start_t, end_t"


def _features(spark, d):
    e, poi = _poi(spark, d)
    return weights.raw_features(e, statistics.poi_time(e).first()[0], float(statistics.detection_size(e, poi).first()[0]), [poi]), e, poi


def _weighted(spark, d):
    e, poi = _poi(spark, d)
    return checkpoint(weights.nonml(e, statistics.poi_time(e).first()[0], float(statistics.detection_size(e, poi).first()[0]), [poi])), poi


@query("w1_w3_features", FEATURES + f" SELECT {KEY}, round(w_time, 6) AS w_time, round(w_amount, 6) AS w_amount, round(w_struct, 6) AS w_struct FROM f")
def _(spark, d):
    return _features(spark, d)[0].select("src", "dst", "start_t", "end_t", *[_r(c) for c in weights.FEATURES])


#: Shares are often exact binary fractions: a shift keeps them off the ties of rounding.
SHIFT = 1.37e-9


@query("w4_normalised", FEATURES + f" SELECT {KEY}, round(w_time / sum(w_time) OVER s + {SHIFT}, 6) AS w_time, round(w_amount / sum(w_amount) OVER s + {SHIFT}, 6) AS w_amount, CASE WHEN sum(w_struct) OVER s > 0 THEN round(w_struct / sum(w_struct) OVER s + {SHIFT}, 6) ELSE 0 END AS w_struct FROM f WINDOW s AS (PARTITION BY src)")
def _(spark, d):
    return weights.normalised(_features(spark, d)[0]).select("src", "dst", "start_t", "end_t", *[_r(F.col(c) + SHIFT, c) for c in weights.FEATURES])


@query("w5_standardised", FEATURES + f", m AS MATERIALIZED (SELECT avg(w_time) AS m1, stddev_samp(w_time) AS s1, avg(w_amount) AS m2, stddev_samp(w_amount) AS s2, avg(w_struct) AS m3, stddev_samp(w_struct) AS s3 FROM f) SELECT {KEY}, round((w_time - m1) / s1, 5) AS w_time, round((w_amount - m2) / s2, 5) AS w_amount, round((w_struct - m3) / s3, 5) AS w_struct FROM f, m")
def _(spark, d):
    return weights.standardised(checkpoint(_features(spark, d)[0])).select("src", "dst", "start_t", "end_t", *[_r(c, places=5) for c in weights.FEATURES])


@query("w6_nonml", FEATURES + NONML + f" SELECT {KEY}, round(weight, 6) AS weight FROM w")
def _(spark, d):
    return _weighted(spark, d)[0].select("src", "dst", "start_t", "end_t", _r("weight"))


@query("w14_heuristic", FEATURES + f", g AS (SELECT *, w_time / sum(w_time) OVER s AS t, w_amount / sum(w_amount) OVER s AS a, CASE WHEN sum(w_struct) OVER s > 0 THEN w_struct / sum(w_struct) OVER s ELSE w_struct END AS st, sum(size) OVER s AS total FROM f WINDOW s AS (PARTITION BY src)) SELECT {KEY}, round(CASE WHEN total = 0 THEN 0.5 * t + 0.5 * st ELSE 0.3333 * t + 0.3333 * st + 0.3334 * a END, 6) AS weight FROM g")
def _(spark, d):
    return weights.heuristic(weights.normalised(_features(spark, d)[0])).select("src", "dst", "start_t", "end_t", _r("weight"))


@query("w17_fanout", ", deg AS (SELECT node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node)" + f" SELECT {KEY}, round(CASE WHEN src LIKE 'F:%' AND n_in = 0 THEN 1e-6 ELSE 1 / n_out + 1e-6 END, 9) AS fanout FROM edges JOIN deg ON node = src")
def _(spark, d):
    e = checkpoint(graph(spark, d))
    return e.join(weights.fanout(e), "edge_id").select("src", "dst", "start_t", "end_t", _r("fanout", places=9))


SHARES = FEATURES + " SELECT src, CAST(count(*) AS BIGINT) AS n, CAST({} AS DOUBLE) AS share FROM f GROUP BY src"


def _shares(w: DataFrame) -> DataFrame:
    """What holds of every drawn or clustered weighting: each source gives away the same share of itself."""
    return w.groupBy("src").agg(F.count("*").alias("n"), _r(F.sum("weight"), "share"))


def _by_mode(spark, d, mode):
    e, poi = _poi(spark, d)
    return weights.weighted(e, mode, statistics.poi_time(e).first()[0], float(statistics.detection_size(e, poi).first()[0]), [poi])


for _name, _mode, _total in (("w7_random_shares", "nonmlrandom", 0.99), ("w8_clustered_shares", "clusterall", 0.99), ("w9_nonoutlier_shares", "nonoutlier", 0.99), ("w16_localtime_shares", "localtime", 1.0), ("w18_zero_shares", "read_only", 0.0)):

    @query(_name, SHARES.format(_total))
    def _(spark, d, mode=_mode):
        return _shares(_by_mode(spark, d, mode))


# A lone edge takes all of its source, 0.99 of it.
@query("w10_local_shares", SHARES.format("0.99"))
def _(spark, d):
    return _shares(_by_mode(spark, d, "clusterlocal"))


for _name, _mode in (("w7_nonmlrandom", "nonmlrandom"), ("w8_clusterall", "clusterall"), ("w9_nonoutlier", "nonoutlier"), ("w10_clusterlocal", "clusterlocal"), ("w16_localtime", "localtime")):

    @query(_name)
    def _(spark, d, mode=_mode):
        e, poi = _poi(spark, d)
        return weights.weighted(e, mode, statistics.poi_time(e).first()[0], float(statistics.detection_size(e, poi).first()[0]), [poi]).select("src", "dst", "start_t", "end_t", "weight")


@query("a9_average_weight", FEATURES + NONML + " SELECT round(avg(weight), 6) AS average FROM w")
def _(spark, d):
    return _weighted(spark, d)[0].agg(_r(F.avg("weight"), "average"))


@query("a10_weight_bins", FEATURES + NONML + " SELECT CAST(greatest(least(floor(weight * 10), 9), 0) AS INTEGER) AS bin, count(*) AS n FROM w GROUP BY 1")
def _(spark, d):
    return statistics.weight_bins(_weighted(spark, d)[0])


# --- propagation and ranking -----------------------------------------------------------------

START = FEATURES + NONML + ", nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), p0 AS (SELECT node, CAST(node = poi AS DOUBLE) AS rep FROM nodes, poi)"
ROUNDS = 4
PROPAGATED = START + "".join(
    f", p{i} AS MATERIALIZED (SELECT n.node, CASE WHEN n.node = poi THEN 1.0 ELSE coalesce(s.rep, 0) END AS rep FROM nodes n LEFT JOIN (SELECT w.src, sum(w.weight * p.rep) AS rep FROM w JOIN p{i - 1} p ON p.node = w.dst GROUP BY w.src) s ON s.src = n.node, poi)"
    for i in range(1, ROUNDS + 1)
)
CANDIDATES = ", cand AS (SELECT node, substr(node, 1, 1) AS kind FROM nodes, poi WHERE node <> poi AND (node LIKE 'N:%' OR (node LIKE 'P:%' AND node NOT IN (SELECT dst FROM edges WHERE src LIKE 'N:%' OR src LIKE 'P:%')) OR (node LIKE 'F:%' AND node NOT IN (SELECT dst FROM edges))))"
RANKED = f", rk AS (SELECT node, kind, round(rep, 6) AS reputation, row_number() OVER (PARTITION BY kind ORDER BY round(rep, 6) DESC, node) AS rank FROM cand JOIN p{ROUNDS} USING (node))"


def _propagated(spark, d):
    w, poi = _weighted(spark, d)
    rep = ranking.propagate(w, ranking.initial_reputation(w, [poi], []), [poi], max_rounds=ROUNDS)
    return w, poi, rep.select("node", _r("reputation"))


def _converged(spark, d):
    """Weighted edges, point of interest and the reputations at convergence, which no SQL expresses."""
    w, poi = _weighted(spark, d)
    return w, poi, checkpoint(ranking.propagate(w, ranking.initial_reputation(w, [poi], []), [poi]))


def _ranks(w, poi, rep, ranked=ranking.ranked_candidates):
    """Rankings of converged reputations; those equal to 12 places stand by name, so that reruns agree."""
    out = ranked(ranking.entry_candidates(w, poi), rep.select("node", _r("reputation", places=12)))
    return out.select("node", "kind", _r("reputation"), F.col("rank").cast("long").alias("rank"))


@query("p1_initial_reputation", START + " SELECT node, rep AS reputation FROM p0")
def _(spark, d):
    e, poi = _poi(spark, d)
    return ranking.initial_reputation(e, [poi], [])


@query("p2_propagated", PROPAGATED + f" SELECT node, round(rep, 6) AS reputation FROM p{ROUNDS}")
def _(spark, d):
    return _propagated(spark, d)[2]


@query("p3_candidates", START + CANDIDATES + " SELECT node, kind FROM cand")
def _(spark, d):
    return ranking.entry_candidates(*_poi(spark, d))


@query("p4_ranked", PROPAGATED + CANDIDATES + RANKED + " SELECT node, kind, reputation, rank FROM rk")
def _(spark, d):
    w, poi, rep = _propagated(spark, d)
    return ranking.ranked_candidates(ranking.entry_candidates(w, poi), rep).select("node", "kind", "reputation", F.col("rank").cast("long").alias("rank"))


@query("p5_top", PROPAGATED + CANDIDATES + RANKED + " SELECT node, kind, reputation, rank FROM rk WHERE rank <= 3")
def _(spark, d):
    w, poi, rep = _propagated(spark, d)
    return ranking.top_candidates(ranking.entry_candidates(w, poi), rep).select("node", "kind", "reputation", F.col("rank").cast("long").alias("rank"))


@query("p6_highlighted", PROPAGATED + CANDIDATES + RANKED + " SELECT node FROM (SELECT node FROM rk WHERE rank <= 3 UNION SELECT 'N:cust#1')")
def _(spark, d):
    w, poi, rep = _propagated(spark, d)
    names = ranking.highlighted(["N:cust#1 ", ""], ranking.top_candidates(ranking.entry_candidates(w, poi), rep))
    return spark.createDataFrame([(n,) for n in names], "node string")


@query("p7_random_starts")
def _(spark, d):
    return ranking.random_starts(nodes_of(graph(spark, d)), 3)


@query("p7_starts_of_each_kind", ", nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT substr(node, 1, 1) AS kind, least(count(*), 3) AS n FROM nodes GROUP BY 1")
def _(spark, d):
    return ranking.random_starts(nodes_of(graph(spark, d)), 3).groupBy(kind("node").alias("kind")).agg(F.count("*").alias("n"))


@query("p8_edges_of_poi", FEATURES + NONML + " SELECT 'in' AS side, src, dst, start_t, end_t, round(weight, 6) AS weight FROM w WHERE dst = poi UNION ALL SELECT 'out', src, dst, start_t, end_t, round(weight, 6) FROM w WHERE src = poi")
def _(spark, d):
    w, poi = _weighted(spark, d)
    return ranking.edges_of(w, poi).select("side", "src", "dst", "start_t", "end_t", _r("weight"))


@query("p9_without_light_edges", FEATURES + NONML + f", mean AS MATERIALIZED (SELECT avg(weight) AS mean FROM w) SELECT {KEY} FROM w, mean WHERE weight >= mean / 100")
def _(spark, d):
    return ranking.without_light_edges(_weighted(spark, d)[0]).select("src", "dst", "start_t", "end_t")


@query("p9_without_unreputed", PROPAGATED + f", live AS MATERIALIZED (SELECT node FROM p{ROUNDS} WHERE round(rep, 6) <> 0) SELECT {KEY} FROM w WHERE src IN (SELECT node FROM live) AND dst IN (SELECT node FROM live)")
def _(spark, d):
    w, _, rep = _propagated(spark, d)
    return ranking.without_unreputed(w, rep).select("src", "dst", "start_t", "end_t")


# SQL chains ROUNDS rounds: the queries above are held against it, these run to convergence.


@query("p2_converged")
def _(spark, d):
    return _converged(spark, d)[2].select("node", _r("reputation"))


@query("p4_converged_ranked")
def _(spark, d):
    return _ranks(*_converged(spark, d))


@query("p5_converged_top")
def _(spark, d):
    return _ranks(*_converged(spark, d), ranking.top_candidates)


@query("p6_converged_highlighted")
def _(spark, d):
    names = ranking.highlighted(["N:cust#1 ", ""], _ranks(*_converged(spark, d), ranking.top_candidates))
    return spark.createDataFrame([(n,) for n in names], "node string")


@query("p9_converged_without_unreputed")
def _(spark, d):
    w, _, rep = _converged(spark, d)
    return ranking.without_unreputed(w, rep).select("src", "dst", "start_t", "end_t")


@query("t10_reputation_walk")
def _(spark, d):
    w, poi, rep = _converged(spark, d)
    return slicing.reputation_walk(w, rep, poi, 0.9, False).select("src", "dst", "start_t", "end_t", "weight")


@query("t11_heavy_paths")
def _(spark, d):
    w, poi = _weighted(spark, d)
    return slicing.heavy_paths(w, poi)


@query("investigation_top_entries")
def flagship(spark, d):
    e, poi = _poi(spark, d)
    return attack.investigate(e, attack.Case(poi), weight_mode="nonml").top


@query("investigation_merged")
def _(spark, d):
    e, poi = _poi(spark, d)
    return attack.investigate(e, attack.Case(poi), weight_mode="nonml").merged().select("src", "dst", "event", "start_t", "end_t", "size", "weight")


@query("out1_dot")
def _(spark, d):
    w, poi, rep = _converged(spark, d)
    return snapshot.dot_lines(w, rep, poi)


@query("out1_dot_initial", START + """ SELECT 0 AS part, '"' || node || '" [ shape=' || CASE substr(node, 1, 1) WHEN 'P' THEN 'box' WHEN 'N' THEN 'parallelogram' ELSE 'ellipse' END || ' label="' || node || ' [' || printf('%.4f', rep) || ']"' || CASE WHEN node = poi THEN ' style="filled" fillcolor="red"' WHEN node = 'N:cust#1' THEN ' style="filled" fillcolor="yellow"' ELSE '' END || ' ];' AS line FROM p0, poi
UNION ALL SELECT 1, '"' || src || '" -> "' || dst || '" [ label="' || event || '" ];' FROM edges""")
def _(spark, d):
    e, poi = _poi(spark, d)
    return snapshot.dot_lines(e, ranking.initial_reputation(e, [poi], []), poi, ["N:cust#1"])


@query("out1_dot_amount_time", ", t AS (SELECT *, rtrim(rtrim(printf('%d.%09d', start_t // 1000000000, start_t % 1000000000), '0'), '.') AS s, rtrim(rtrim(printf('%d.%09d', end_t // 1000000000, end_t % 1000000000), '0'), '.') AS e FROM edges) SELECT '\"' || src || '\" -> \"' || dst || '\" [ label=\"' || size || ' ' || s || ' ' || e || '\" ];' AS line FROM t")
def _(spark, d):
    e, poi = _poi(spark, d)
    return snapshot.dot_lines(e, ranking.initial_reputation(e, [poi], []), poi, labels="amount_time").where("part = 1").select("line")


@query("out6_text_dumps", START + " SELECT node || ' ' || printf('%.6f', rep) AS line FROM p0")
def _(spark, d):
    e, poi = _poi(spark, d)
    return snapshot.text_dumps(e.withColumn("weight", F.lit(0.0)), ranking.initial_reputation(e, [poi], []))["reputations"].select("line")


@query("src8_out4_snapshot", ", sl AS (SELECT * FROM edges, poi WHERE dst = poi OR src = poi) SELECT src, dst, etype, event, start_t, end_t, size, poi FROM sl")
def _(spark, d):
    """The edges at the point of interest, written as a snapshot and read again."""
    e, poi = _poi(spark, d)
    path = f"{scratch(spark)}.json"
    snapshot.write_graph(path, poi, ["N:cust#1"], e.where((F.col("src") == poi) | (F.col("dst") == poi)), ranking.initial_reputation(e, [poi], []))
    found, _, told, _ = snapshot.load_graph(spark, path)
    return found.select("src", "dst", "etype", "event", "start_t", "end_t", "size", F.lit(told).alias("poi"))


@query("case_metrics", BACK + f""", b AS (SELECT *, CASE WHEN start_t - lag(end_t) OVER w > {10 * SECOND} THEN 1 ELSE 0 END AS brk FROM sl WINDOW w AS (PARTITION BY event, src, dst ORDER BY start_t, end_t)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY event, src, dst ORDER BY start_t, end_t) AS run FROM b), less AS (SELECT DISTINCT event, src, dst, run FROM r), n AS (SELECT src AS node FROM sl UNION SELECT dst FROM sl),
cand AS (SELECT node FROM n, poi WHERE node <> poi AND (node LIKE 'N:%' OR (node LIKE 'P:%' AND node NOT IN (SELECT dst FROM sl WHERE src LIKE 'N:%' OR src LIKE 'P:%')) OR (node LIKE 'F:%' AND node NOT IN (SELECT dst FROM sl))))
SELECT 'BackTrackVertexNumber' AS metric, count(*) AS value FROM n UNION ALL SELECT 'BackTrackEdgeNumber', count(*) FROM sl UNION ALL SELECT 'CPRVertexNumber', count(*) FROM n UNION ALL SELECT 'CPREdgeNumber', count(*) FROM less
UNION ALL SELECT 'EntryPointsNumber', count(*) FROM cand""", recursive=True)
def _(spark, d):
    e, poi = _poi(spark, d)
    r = attack.investigate(e, attack.Case(poi), weight_mode="nonml")
    return r.metrics(r.reduced).where(~F.col("metric").startswith("Complete"))


# --- set operations --------------------------------------------------------------------------


@query("set_subsets", ", t AS (SELECT DISTINCT src, dst FROM edges WHERE src LIKE 'N:%'), a AS (SELECT src, list_sort(list(dst)) AS told FROM t GROUP BY src), b AS (SELECT src, list_sort(list(DISTINCT dst)) AS told FROM edges GROUP BY src) SELECT a.src, list_has_all(b.told, a.told) AS covered FROM a JOIN b USING (src)")
def _(spark, d):
    e = checkpoint(graph(spark, d))
    told = lambda df, n: df.groupBy("src").agg(F.collect_set("dst").alias(n))
    return told(e.where(kind("src") == "N"), "a").join(told(e, "b"), "src").select("src", (F.size(F.array_except("a", "b")) == 0).alias("covered"))


@query("set_operations", "SELECT 'both' AS what, count(*) AS n FROM (SELECT src FROM edges INTERSECT SELECT dst FROM edges) UNION ALL SELECT 'sources_only', count(*) FROM (SELECT src FROM edges EXCEPT SELECT dst FROM edges) UNION ALL SELECT 'any', count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)")
def _(spark, d):
    e = checkpoint(graph(spark, d))
    s, t = e.select(F.col("src").alias("node")), e.select(F.col("dst").alias("node"))
    named = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n")
    return named(s.intersect(t), "both").unionAll(named(s.subtract(t), "sources_only")).unionAll(named(s.union(t).distinct(), "any"))


# --- scalar functions ------------------------------------------------------------------------


@query("fn1_result_size", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS size FROM lineitem", graph=False)
def _(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    args = F.when(F.col("l_linenumber") == 7, F.lit("res=-2 res=5")).otherwise(F.concat(F.lit("fd=3 res="), F.col("l_quantity").cast("long"), F.lit(" data=res=9")))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", syscall.result_size(args).alias("size"))


@query("fn2_descriptors", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '/data/' || o_custkey END AS file, CASE WHEN o_orderkey % 2 = 1 THEN '10.0.0.1:' || o_custkey || '->10.0.0.2:53' END AS socket FROM orders", graph=False)
def _(spark, d):
    x = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    args = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x fd=3(<f>/data/"), "o_custkey", F.lit(") size=1"))).otherwise(F.concat(F.lit("fd=4(<4t>10.0.0.1:"), "o_custkey", F.lit("->10.0.0.2:domamin) size=1")))
    return x.select("o_orderkey", syscall.descriptor_file(args).alias("file"), syscall.socket_signature(syscall.socket(args)).alias("socket"))


@query("fn4_epoch_nanos", "SELECT event_id, epoch_us(ts) * 1000 AS nanos FROM events", graph=False)
def _(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return x.select("event_id", syscall.epoch_nanos(syscall.nanos_text(F.col("us") * 1000)).alias("nanos"))


@query("fn7_fn9_audit_events", "SELECT l_linenumber, upper(l_returnflag) AS event, CASE l_linenumber % 4 WHEN 0 THEN 'O2P' WHEN 1 THEN 'P2O' WHEN 2 THEN 'P2P' ELSE 'SKIP' END AS flow, CASE l_linenumber % 4 WHEN 0 THEN 'FtoP' WHEN 1 THEN 'PtoN' WHEN 2 THEN 'PtoP' ELSE 'ObjectFlow' END AS etype, count(*) AS n FROM lineitem GROUP BY ALL", graph=False)
def _(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_linenumber", "l_returnflag")
    pick = lambda *v: F.get(F.array(*[F.lit(s) for s in v]), F.col("l_linenumber") % 4)
    event = audit.normalised_event(F.concat(F.lit(" event_"), F.lower("l_returnflag")))
    return x.select("l_linenumber", event.alias("event"), audit.flow_kind(pick("EVENT_READ", "EVENT_WRITE", "event_fork ", "EVENT_OTHER")).alias("flow"), audit.edge_type(pick("F", "P", "P", "F"), pick("P", "N", "P", "N")).alias("etype")).groupBy("l_linenumber", "event", "flow", "etype").agg(F.count("*").alias("n"))


# --- log reading -----------------------------------------------------------------------------


def _log_lines(spark, d):
    """Two lines an order: reads of a file for even keys, receives from a socket for odd ones; orders without an end lack it."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("long").alias("size"))
    t = F.col("o_orderkey") + 1_600_000_000
    even = F.col("o_orderkey") % 2 == 0
    event = F.when(even, "read").otherwise("recvfrom")
    what = F.when(even, F.concat(F.lit("fd=3(<f>/data/"), "o_custkey", F.lit(")"))).otherwise(F.concat(F.lit("fd=3(<4t>10.0.0.1:"), "o_custkey", F.lit("->10.0.0.2:80)")))
    line = lambda no, stamp, side, lat, args: F.struct((F.col("o_orderkey") * 2 + no).alias("line_no"), F.concat_ws(";;", stamp, F.lit("0"), F.lit("sh"), F.col("o_custkey").cast("string"), F.lit(side), event, F.lit("/"), F.lit(lat), args).alias("value"))
    start = line(0, F.concat(t.cast("string"), F.lit(".100000000")), ">", "0", what)
    end = line(1, F.concat(t.cast("string"), F.lit(".100000050")), "<", "50", F.concat(F.lit("res="), "size", F.lit(" data=x")))
    return o.select(F.explode(F.when(F.col("o_orderkey") % 5 == 0, F.array(start)).otherwise(F.array(start, end))).alias("l")).select("l.*")


@query("ing_log_edges", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(trunc(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN k % 2 = 0 THEN 'F:/data/' || c ELSE 'N:10.0.0.1:' || c || '->10.0.0.2:80' END AS src, 'P:' || c || 'sh' AS dst, CASE WHEN k % 2 = 0 THEN 'FtoP' ELSE 'NtoP' END AS etype,
 CASE WHEN k % 2 = 0 THEN 'read' ELSE 'recvfrom' END AS event, (k + 1600000000) * 1000000000 + 100000000 AS start_t, (k + 1600000000) * 1000000000 + 100000050 AS end_t, size FROM o""", graph=False)
def _(spark, d):
    return syslog.edges(_log_lines(spark, d)).select("src", "dst", "etype", "event", "start_t", "end_t", "size")


@query("ing13_line_counts", "SELECT count(*) + count(*) FILTER (o_orderkey % 5 <> 0) AS valid_lines, 1 AS invalid_lines FROM orders", graph=False)
def _(spark, d):
    broken = spark.createDataFrame([(-1, "a;;b")], "line_no long, value string")
    return syslog.line_counts(_log_lines(spark, d).unionByName(broken)).select("valid_lines", F.col("invalid_lines").cast("int").alias("invalid_lines"))


def _audit_records(spark, d):
    """Customers as subjects, orders as events on files named by their priority, without object records for those."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    void = {"subtype": "string", "cid": "int", "parent": "string", "cmd": "string", "local_address": "string", "local_port": "int", "remote_address": "string", "remote_port": "int", "memory_address": "long", "reg_key": "string", "subject": "string", "object": "string", "object_path": "string", "object2": "string", "object2_path": "string", "t": "long", "size": "long", "properties": "map<string,string>"}

    def rows(df, file_no, kind, uuid, **has):
        return df.select(F.lit(file_no).alias("file_no"), F.col("rec_no"), F.lit(kind).alias("type"), uuid.alias("uuid"), *[has.get(c, F.lit(None)).cast(t).alias(c) for c, t in void.items()])

    uuid = lambda c: F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(c.cast("string"), 12, "0"))
    people = o.select(F.col("o_custkey").alias("rec_no")).distinct()
    subjects = rows(people, 0, "RECORD_SUBJECT", uuid(F.col("rec_no")), cid=F.col("rec_no"), cmd=F.lit("shell -x"))
    events = rows(o.withColumn("rec_no", F.col("o_orderkey")), 1, "RECORD_EVENT", F.lit(None).cast("string"), subtype=F.when(F.col("o_orderkey") % 2 == 0, "EVENT_WRITE").otherwise("EVENT_READ"), subject=uuid(F.col("o_custkey")), object_path=F.concat(F.lit("/p/"), "o_orderpriority"), t=F.col("t") * 1000, size=F.col("o_orderkey"))
    return subjects.unionByName(events)


@query("cdm_edges", """WITH o AS (SELECT o_custkey || '@' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || 'shell' AS p, '/p/' || o_orderpriority AS f, * FROM orders)
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'P:' || p ELSE 'F:' || f END AS src, CASE WHEN o_orderkey % 2 = 0 THEN 'F:' || f ELSE 'P:' || p END AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 'PtoF' ELSE 'FtoP' END AS etype,
 CASE WHEN o_orderkey % 2 = 0 THEN 'WRITE' ELSE 'READ' END AS event, epoch_us(o_orderdate) * 1000 AS start_t, epoch_us(o_orderdate) * 1000 AS end_t, o_orderkey AS size FROM o""", graph=False)
def _(spark, d):
    return audit_graph.edges(checkpoint(_audit_records(spark, d))).select("src", "dst", "etype", "event", "start_t", "end_t", "size")


from tracelight import catalog_sources  # noqa: E402, F401  registers its queries after those above


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
