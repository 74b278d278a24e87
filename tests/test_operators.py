"""The operators against brute force and by their properties."""

import collections
import datetime
import math
import random
import time
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelight import graph
from tracelight.graph import COLUMNS
from tracelight.operators import dependence, ranking, reduction, slicing, weights
from tracelight.plans import fixpoint, testgraph

SCHEMA = "edge_id long, src string, dst string, etype string, event string, start_t long, end_t long, size long"


@pytest.fixture(scope="module")
def edges(spark):
    r, rows = random.Random(4), []
    for i in range(150):
        a, b = r.randrange(14), r.randrange(14)
        s = r.randrange(400)
        kind = lambda x: "FPN"[x % 3]
        rows.append((i, f"{kind(a)}:{a}", f"{kind(b)}:{b}", f"{kind(a)}to{kind(b)}", r.choice(["read", "write"]), s, s + r.randrange(30), r.randrange(5)))
    return spark.createDataFrame(rows, SCHEMA).dropDuplicates(["src", "dst", "start_t", "end_t"]).cache()


def rows(df, *c):
    return sorted(map(tuple, df.select(*c).collect()))


def brute_back_track(items, poi):
    thr = {poi: max((e["end_t"] for e in items if e["dst"] == poi), default=0)}
    while True:
        new = dict(thr)
        for e in items:
            if e["dst"] in thr and e["start_t"] <= thr[e["dst"]]:
                new[e["src"]] = max(new.get(e["src"], slicing.LOW), min(e["end_t"], thr[e["dst"]]))
        if new == thr:
            return thr
        thr = new


def test_back_track_by_brute_force(edges):
    poi, items = "F:0", [r.asDict() for r in edges.collect()]
    a, thr = slicing.back_track(edges, poi), brute_back_track(items, poi)
    assert rows(a, "node", "thr") == sorted(thr.items())
    kept = {r[0] for r in rows(slicing.slice_edges(edges, a), "edge_id")}
    assert kept == {e["edge_id"] for e in items if e["dst"] in thr and e["start_t"] <= thr[e["dst"]]}
    fifo = {r[0] for r in rows(slicing.back_track_fifo(edges, poi), "edge_id")}
    assert fifo and fifo <= kept
    step, front, n = {poi: 1}, {poi}, 1
    while front:
        n += 1
        front = {e["src"] for e in items if e["edge_id"] in kept and e["dst"] in front} - step.keys()
        step |= dict.fromkeys(front, n)
    assert {r.node: r.step for r in slicing.back_track_steps(edges, poi).collect()} == step


def jobs(spark, run):
    """What run() gives, and how many Spark jobs it starts."""
    spark.sparkContext.setJobGroup("counted", "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def chain(spark, n):
    """A chain of n edges toward F:0, and as many that lead nowhere."""
    links = [(i, f"P:{i + 1}" if i < n - 1 else "N:0", f"P:{i}" if i else "F:0", "PtoP", "read", n - i, n - i, 1) for i in range(n)]
    return spark.createDataFrame(links + [(n + i, f"P:x{i}", f"P:y{i}", "PtoP", "read", i, i, 1) for i in range(n)], SCHEMA)


def test_a_long_chain_is_sliced_in_few_jobs(spark):
    """Rounds over a graph that one task holds are no jobs of their own."""
    links, n = fixpoint.checkpoint(chain(spark, 150)), 150
    got, count = jobs(spark, lambda: rows(slicing.back_track(links, "F:0"), "node", "thr"))
    assert len(got) == n + 1 and dict(got)["N:0"] == 1 and count < 20


def test_slices_in_one_task_agree(spark, edges):
    """In one task, and in rounds over what leads to the point of interest."""
    both = edges.unionByName(chain(spark, 5).withColumn("edge_id", F.col("edge_id") + 1000))
    for poi in ("F:0", "P:1", "F:none"):
        here, apart = (rows(slicing.back_track(both, poi, in_process=k), "node", "thr") for k in (10**6, 0))
        assert here == apart
    narrow, n = slicing.leading_to(both, "F:0", 0)
    assert n == narrow.count() < both.count() and not narrow.where("dst like 'P:y%'").count()
    assert rows(slicing.leading_to(both, "F:0", n)[0], *narrow.columns) == rows(narrow, *narrow.columns)


def test_every_round_is_broadcast_where_it_is_small(spark, edges):
    """The first one too, so that no round moves the links."""
    links, plans = fixpoint.checkpoint(edges.select("src", F.col("dst").alias("node"))), []

    def step(frontier):
        met = links.join(frontier, "node")
        plans.append(met._jdf.queryExecution().executedPlan().toString())
        return met.select(F.col("src").alias("node"))

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # nothing is known of sizes
    try:
        fixpoint.iterate(spark.createDataFrame([("F:0",)], "node string"), step, ["node"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(plans) > 1 and all("BroadcastHashJoin" in p for p in plans)


def test_graph_of_odd_tables(spark, tmp_path):
    """Edges meet their orders and each other by numbers in one shuffle; missing and repeated keys are edges as before."""
    at = lambda day: day and datetime.datetime(2020, 1, day)
    orders = [(1, 1, 10.5, 1), (1, 1, 9.4, 1), (1, 2, 3.0, 3), (2, None, 5.0, 2), (2, None, 4.0, 2), (None, 3, 1.0, 4), (None, None, 2.0, 4), (3, 4, None, None), (4, 5, 7.0, 5)]
    lines = [(1, 7, 1, 3.0, 2), (1, 7, 1, 2.0, 2), (1, 7, 2, 2.0, 2), (2, None, 1, 6.0, 2), (2, None, 2, 6.0, 9), (2, 8, None, 6.0, 9), (None, 8, 1, 6.0, 9), (3, 9, 1, 1.0, None), (9, 9, 1, 1.0, 1), (4, 1, 1, 1.0, None)]
    spark.createDataFrame([(*r[:3], at(r[3])) for r in orders], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(*r[:4], at(r[4])) for r in lines], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    name, nanos = (lambda kind, key: None if key is None else f"{kind}#{key}"), (lambda day: day and (day - 1) * 86_400 * 10**9 + 1_577_836_800 * 10**9)
    want = collections.defaultdict(list)
    for key, customer, price, day in orders:
        t = nanos(day)
        want[name("N:cust", customer), name("P:order", key), t, t].append(("NtoP", "recv", price and math.floor(price + 0.5)))
        for of, part, number, quantity, shipped in lines:
            if of is not None and of == key:
                times = [x for x in (t, nanos(shipped)) if x is not None] or [None]
                ends = (name("F:part", part), name("P:order", key))
                read = number is not None and number % 2 == 1
                want[(*(ends if read else ends[::-1]), min(times), max(times))].append(("FtoP", "read", int(quantity)) if read else ("PtoF", "write", int(quantity)))
    least = lambda v: min((x for x in v if x is not None), default=None)
    got = testgraph.edges(spark, str(tmp_path))
    assert collections.Counter((r.src, r.dst, r.etype, r.event, r.start_t, r.end_t, r.size) for r in got.collect()) == collections.Counter((k[0], k[1], *[least(c) for c in list(zip(*v))[:2]], k[2], k[3], least([x[2] for x in v])) for k, v in want.items())
    plan = testgraph.edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Broadcast" not in plan and "SortAggregate" not in plan


def test_steps_in_one_task(spark, edges):
    """A long chain takes few jobs, and the steps are those of the rounds."""
    links = fixpoint.checkpoint(chain(spark, 60))
    got, count = jobs(spark, lambda: rows(slicing.back_track_steps(links, "F:0"), "node", "step"))
    assert dict(got)["N:0"] == 61 and len(got) == 61 and count < 20
    here, apart = (rows(slicing.back_track_steps(edges, "F:0", in_process=k), "node", "thr", "step") for k in (10**6, 0))
    assert here == apart


@pytest.mark.parametrize("piece", [7, 10**6])
def test_slices_over_files_agree(edges, piece, monkeypatch):
    """Walks over hashes in files, piece by piece, give what rounds over names give; nothing is pruned in jobs first."""
    monkeypatch.setattr(slicing, "PIECE", piece)
    some = edges.select("src").distinct().where("src like 'N:%'").withColumnRenamed("src", "node")
    for run, told in (
        (lambda k: slicing.back_track(edges, "F:0", in_process=0, on_disk=k), ["node", "thr"]),
        (lambda k: slicing.back_track(edges, "F:0", max_rounds=1, in_process=0, on_disk=k), ["node", "thr"]),
        (lambda k: slicing.back_track_steps(edges, "F:0", in_process=0, on_disk=k), ["node", "thr", "step"]),
        (lambda k: slicing.back_track(edges, "F:none", in_process=0, on_disk=k), ["node", "thr"]),
        (lambda k: slicing.merged_forward(edges, some, 300, in_process=0, on_disk=k), ["edge_id"]),
    ):
        here, rounds = (rows(run(k), *told) for k in (10**6, 0))
        assert here == rounds and here


def test_a_long_chain_over_files(spark):
    """A chain of 60 edges takes few jobs where the graph is too large to be held."""
    links = fixpoint.checkpoint(chain(spark, 60))
    got, count = jobs(spark, lambda: rows(slicing.back_track(links, "F:0", in_process=0), "node"))
    assert len(got) == 61 and count < 40


def test_names_that_share_a_hash(edges, monkeypatch):
    """Then rounds over names are taken."""
    want = rows(slicing.back_track(edges, "F:0"), "node", "thr")
    monkeypatch.setattr(slicing.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    assert slicing._walked_on_disk(slicing._turned(edges), 0, "F:0", 10) is None
    monkeypatch.undo()
    monkeypatch.setattr(slicing, "_walked_on_disk", lambda *a: None)
    assert rows(slicing.back_track(edges, "F:0", in_process=0), "node", "thr") == want


def test_a_slice_does_not_move_the_edges(edges):
    """What was reached is broadcast where it is small."""
    cut = slicing.slice_edges(edges, slicing.back_track(edges, "F:0"))
    assert "BroadcastHashJoin" in cut._jdf.queryExecution().executedPlan().toString()


def test_merged_walks_in_one_task(spark, edges):
    """Few jobs along a long chain; with many starts the edges are those of the rounds."""
    links = fixpoint.checkpoint(chain(spark, 60).where("src not like 'P:x%'"))
    start = spark.createDataFrame([("N:0",)], "node string")
    got, count = jobs(spark, lambda: slicing.merged_forward(links, start, 50).count())
    assert got == 49 and count < 25
    some = edges.select("src").distinct().where("src like 'N:%'").withColumnRenamed("src", "node")
    here, apart = (rows(slicing.merged_forward(edges, some, 300, in_process=k), "edge_id") for k in (10**6, 0))
    assert here == apart and here


def test_scan_by_brute_force(edges):
    for poi in ("F:0", "P:1", "N:5"):
        items = sorted((r.asDict() for r in edges.collect()), key=lambda e: (-e["start_t"], e["edge_id"]))
        thr, kept = {poi: max((e["end_t"] for e in items if e["dst"] == poi), default=0)}, []
        for e in items:
            if e["dst"] in thr and e["start_t"] < thr[e["dst"]]:
                kept.append((e["edge_id"],))
                thr.setdefault(e["src"], min(e["end_t"], thr[e["dst"]]))
        assert rows(slicing.back_track_scan(edges, poi), "edge_id") == sorted(kept)


def test_back_track_of_a_missing_or_entry_node(edges):
    assert rows(slicing.back_track(edges, "F:none"), "node", "thr") == [("F:none", 0)]


def test_rounds_are_bounded(edges):
    assert rows(slicing.back_track(edges, "F:0", max_rounds=0), "node") == [("F:0",)]
    one = {r[0] for r in rows(slicing.back_track(edges, "F:0", max_rounds=1), "node")}
    assert one == {"F:0"} | {r.src for r in edges.where("dst = 'F:0'").collect()}


@pytest.mark.parametrize("bound", [10**6, 0])
def test_forward_by_brute_force(edges, spark, bound):
    names = ["N:2", "P:1", "F:none"]
    roots = spark.createDataFrame([(n,) for n in names], "node string")
    items, want = [r.asDict() for r in edges.collect()], []
    for n in names:
        arr = {n: slicing.LOW}
        while True:
            new = dict(arr)
            for e in items:
                if e["src"] in arr and arr[e["src"]] <= e["start_t"] < 300:
                    new[e["dst"]] = min(new.get(e["dst"], e["start_t"]), e["start_t"])
            if new == arr:
                break
            arr = new
        want += [(n, *x) for x in arr.items()]
    assert rows(slicing.forward_many(edges, roots, 300, broadcast_edges=bound), "root", "node", "arr") == sorted(want)


def test_components_by_brute_force(edges, spark):
    chain = spark.createDataFrame([(1000 + i, f"P:{1000 + i}", f"P:{1001 + i}", "", "", 0, 0, 0) for i in range(60)] + [(2000, "F:9", "F:9", "", "", 0, 0, 0)], SCHEMA)
    some = edges.where("edge_id % 9 = 0").unionByName(chain)
    label = {n: n for r in some.collect() for n in (r.src, r.dst)}
    changed = True
    while changed:
        changed = False
        for r in some.collect():
            low = min(label[r.src], label[r.dst])
            changed |= (label[r.src], label[r.dst]) != (low, low)
            label[r.src] = label[r.dst] = low
    assert rows(slicing.weak_components(some), "node", "component") == sorted(label.items())
    assert rows(slicing.component_of(some, "P:1005"), "node") == sorted((n,) for n, c in label.items() if c == label["P:1005"])


@pytest.mark.parametrize("mode", ["windowed_sequence", "full_merge", "standard_cpr", "no_merge"])
def test_reduction_keeps_sizes(edges, mode):
    out = reduction.reduced(edges, mode, 20)
    assert out.agg(F.sum("size")).first() == edges.agg(F.sum("size")).first()
    assert rows(graph.nodes_of(out), "node") == rows(graph.nodes_of(edges), "node")


def brute_cpr(items):
    """Neighbours of a pair merge unless an edge into the source or out of the target touches the gap."""
    touch = lambda x, a, b: (x["start_t"] < b <= x["end_t"]) or (a < x["end_t"] < b)
    groups, out = {}, []
    for e in sorted(items, key=lambda e: (e["start_t"], e["end_t"], e["edge_id"])):
        groups.setdefault((e["event"], e["src"], e["dst"]), []).append(e)
    for g in groups.values():
        run = None
        for e in g:
            if run is None:
                run = dict(e)
                continue
            back = run["end_t"] < e["end_t"] and any(touch(x, run["end_t"], e["end_t"]) for x in items if x["dst"] == e["src"] and x["edge_id"] != e["edge_id"])
            fore = run["start_t"] < e["start_t"] and any(touch(x, run["start_t"], e["start_t"]) for x in items if x["src"] == e["dst"] and x["edge_id"] != e["edge_id"])
            if back or fore:
                out.append(run)
                run = dict(e)
            else:
                run["end_t"], run["size"] = e["end_t"], run["size"] + e["size"]
        out.append(run)
    return sorted((e["edge_id"], e["start_t"], e["end_t"], e["size"]) for e in out)


def test_standard_cpr_by_brute_force(edges):
    assert rows(reduction.standard_cpr(edges), "edge_id", "start_t", "end_t", "size") == brute_cpr([r.asDict() for r in edges.collect()])


def naive_dependence(items, sources=False):
    """The definition read off: for each edge a look back over all kept edges before it."""
    items = sorted((dict(e) for e in items), key=lambda e: (e["start_t"], e["end_t"], e["edge_id"]))
    starts = {e["src"] for e in items} - {e["dst"] for e in items}
    kept = []

    def since(u):
        return max((i for i, e in kept if e["dst"] == u), default=-1)

    def knows(u):
        told = {u: {u} if u in starts else set() for u in {x for e in items for x in (e["src"], e["dst"])}}
        for _, e in kept:
            told[e["dst"]] |= told[e["src"]]
        return told[u]

    for i, e in enumerate(items):
        u, v = e["src"], e["dst"]
        if e["etype"] != "PtoP" and u != v:
            if any(k["src"] == v and k["dst"] == u and j > since(v) for j, k in kept):
                continue
            again = [k for j, k in kept if k["src"] == u and k["dst"] == v and j > since(u)]
            if again:
                for k in again[:0] + [k for k in again if k["etype"] == e["etype"]][:1]:
                    k["end_t"], k["size"] = e["end_t"], k["size"] + e["size"]
                continue
            if sources and knows(u) <= knows(v):
                continue
        kept.append((i, e))
    return sorted((k["edge_id"], k["end_t"], k["size"]) for _, k in kept)


@pytest.fixture(scope="module")
def busy(spark):
    """Few nodes, many repeated edges: thousands of merges."""
    r, rows_ = random.Random(8), []
    for i in range(700):
        a, b = r.choice([("P:1", "F:1"), ("F:1", "P:1"), ("P:2", "F:1"), ("F:1", "P:3"), ("P:3", "F:4"), ("N:1", "P:1"), ("F:4", "P:2"), ("P:1", "P:2"), ("P:2", "P:2"), ("F:4", "F:1"), ("N:5", "P:3")])
        s = r.randrange(900)
        rows_.append((i, a, b, f"{a[0]}to{b[0]}" if a[0] + b[0] != "FF" else "ObjectFlow", "e", s, s + r.randrange(20), r.randrange(9)))
    return spark.createDataFrame(rows_, SCHEMA).cache()


def test_full_dependence_by_definition(edges, busy, monkeypatch):
    for g in (edges, busy):
        items = [r.asDict() for r in g.collect()]
        want = naive_dependence(items)
        assert len(want) < len(items)
        assert rows(reduction.reduced(g, "fd"), "edge_id", "end_t", "size") == want
        one = dependence.in_order(g.toPandas(), False, -1, -1)
        assert sorted(map(tuple, one[["edge_id", "end_t", "size"]].to_numpy().tolist())) == want


def test_full_dependence_judges_contested_edges_only(spark, monkeypatch):
    """Of a thousand edges two share their ends; only these and what enters those ends are carried through the rounds."""
    told = [(i, f"P:{i}", f"F:{i}", "PtoF", "write", i, i, 1) for i in range(1000)] + [(1000, "P:7", "F:7", "PtoF", "write", 2000, 2001, 4)]
    carried, real = [], dependence.settled
    monkeypatch.setattr(dependence, "settled", lambda state, *a: (carried.append(state.count()), real(state, *a))[1])
    out = rows(reduction.reduced(spark.createDataFrame(told, SCHEMA), "fd"), "edge_id", "end_t", "size")
    assert carried == [2] and len(out) == 1000 and out[7] == (7, 2001, 5)


def test_source_dependence_by_definition(edges, busy):
    for g in (edges, busy):
        items = [r.asDict() for r in g.collect()]
        want = naive_dependence(items, True)
        assert len(want) <= len(naive_dependence(items))
        assert rows(reduction.reduced(g, "sd"), "edge_id", "end_t", "size") == want
        assert rows(reduction.reduced(g, "sd", sd_limit=10**6), "edge_id") == [(i,) for i, *_ in want]


def test_many_sources_are_passed_on_at_once():
    """A node that knows of 20,000 sources tells 400 others: sets are joined whole, not source by source."""
    n, m = 20_000, 400
    told = [(i, f"N:{i}", "P:hub", "NtoP", "recv", i, i, 1) for i in range(n)] + [(n + i, "P:hub", f"F:{i}", "PtoF", "write", n + i, n + i, 1) for i in range(m)]
    began = time.process_time()
    assert len(dependence.in_order(pd.DataFrame(told, columns=COLUMNS), True, -1, -1)) == n + m
    assert time.process_time() - began < 3
    held = dependence.in_order(pd.DataFrame(told, columns=COLUMNS), True, -1, 10)
    assert len(held) == n + m


def test_large_sets_of_sources_are_followed_in_blocks(edges, busy, monkeypatch):
    """Blocks of 64 sources give what whole sets give, whether edges are taken together or one by one."""
    real, made = dependence.told_anew, []
    monkeypatch.setattr(dependence, "told_anew", lambda *a: made.append(real(*a)) or made[-1])
    wide = [(i, f"N:{i}", f"F:{i % 40}", "NtoF", "send", i % 7, i, 1) for i in range(300)] + [(300 + i, f"F:{i % 40}", f"P:{i * 7 % 90}", "FtoP", "read", 8 + i % 3, i, 1) for i in range(400)]
    for pdf in (edges.toPandas(), busy.toPandas(), pd.DataFrame(wide, columns=COLUMNS)):
        blocks, whole = (sorted(map(tuple, dependence.in_order(pdf, True, -1, -1, room)[["edge_id", "end_t", "size"]].to_numpy().tolist())) for room in (0, 10**9))
        assert blocks == whole and len(blocks) < len(pdf)
    assert any(m is not None for m in made)


def test_what_ended_nodes_knew_is_forgotten():
    """20,000 files each know of other sources, and nothing comes after: 25 MB of sets are not held together."""
    n = 20_000
    told = [row for i in range(n) for row in ((2 * i, f"N:{i}", "P:hub", "NtoP", "recv", 2 * i, 2 * i, 1), (2 * i + 1, "P:hub", f"F:{i}", "PtoF", "write", 2 * i + 1, 2 * i + 1, 1))]
    pdf = pd.DataFrame(told, columns=COLUMNS)
    tracemalloc.start()
    assert len(dependence.in_order(pdf, True, -1, -1)) == 2 * n
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 40, most


def test_an_edge_without_an_end_stays(spark):
    """Where a source or a target is not known nothing can be judged."""
    told = [(1, None, "P:a", "FtoP", "read", 1, 2, 5), (2, "P:a", None, "PtoF", "write", 3, 4, 5), (3, "N:b", "P:a", "NtoP", "recv", 1, 1, 5)]
    assert rows(reduction.reduced(spark.createDataFrame(told, SCHEMA), "sd"), "edge_id") == [(1,), (2,), (3,)]


def test_components_in_one_task_agree(edges):
    a, b = (rows(fixpoint.components(edges, in_process=k), "node", "component") for k in (10**6, 0))
    assert a == b and a


def test_bounded_memory_keeps_more(busy):
    free, one = (reduction.reduced(busy, "fd", fd_window=n).count() for n in (10**6, 1))
    assert free == reduction.reduced(busy, "fd").count() and one >= free


def test_dependence_reduction(spark):
    e = spark.createDataFrame([(1, "P:a", "F:x", "PtoF", "write", 1, 2, 5), (2, "P:a", "F:x", "PtoF", "write", 3, 9, 7), (3, "F:x", "P:a", "FtoP", "read", 4, 5, 1), (4, "F:x", "P:b", "FtoP", "read", 6, 7, 1)], SCHEMA)
    assert rows(reduction.reduced(e, "fd"), "edge_id", "end_t", "size") == [(1, 9, 12), (4, 7, 1)]


def test_standard_cpr_with_many_merges(busy):
    got = rows(reduction.standard_cpr(busy), "edge_id", "start_t", "end_t", "size")
    assert got == brute_cpr([r.asDict() for r in busy.collect()]) and len(got) < 700


@pytest.mark.parametrize("mode", ["nonml", "nonmlrandom", "clusterall", "nonoutlier", "clusterlocal", "localtime"])
def test_weights_share_a_source(edges, mode):
    out = weights.weighted(edges, mode, 430, 3.0, ["F:0"])
    sums = [r[0] for r in out.groupBy("src").agg(F.sum("weight")).select("sum(weight)").collect()]
    assert all(s <= 1.0 + 1e-6 for s in sums) and max(sums) > 0.9


def test_propagation_forms_agree(edges):
    w = weights.nonml(edges, 430, 3.0, ["F:0"]).cache()
    start = ranking.initial_reputation(w, ["F:0"], ["N:2"])
    for rounds in (6, 3000):
        a, b = (ranking.propagate(w, start, ["F:0", "N:2"], tol=1e-3, max_rounds=rounds, in_process=k).orderBy("node").collect() for k in (10**6, 0))
        assert [r[0] for r in a] == [r[0] for r in b]
        assert all(abs(x[1] - y[1]) < 1e-9 and -1e-9 <= x[1] <= 1 + 1e-9 for x, y in zip(a, b))


def _no_frames(monkeypatch, df):
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("collected to the driver"))


def test_propagation_collects_nothing(edges, monkeypatch):
    """F14 to F23: the rounds of one process run in a task of an executor, over numbered nodes."""
    w = weights.nonml(edges, 430, 3.0, ["F:0"]).cache()
    start = ranking.initial_reputation(w, ["F:0"], ["N:2"], 0.25)
    _no_frames(monkeypatch, w)
    got = {r.node: r.reputation for r in ranking.propagate(w, start, ["F:0", "N:2"], tol=1e-3).collect()}
    rep, items = {r.node: r.reputation for r in start.collect()}, w.collect()
    for _ in range(3000):
        new = dict.fromkeys(rep, 0.0)
        for e in items:
            new[e.src] += rep[e.dst] * e.weight
        new |= {n: rep[n] for n in ("F:0", "N:2")}
        moved, rep = sum(abs(new[n] - rep[n]) for n in rep), new
        if moved < 1e-3:
            break
    assert got.keys() == rep.keys() and all(abs(got[n] - rep[n]) < 1e-9 for n in rep)


def test_fifo_in_a_task(edges, monkeypatch):
    """the walk holds numbers in one task; it is that of a queue."""
    _no_frames(monkeypatch, edges)
    items = sorted((r.asDict() for r in edges.collect()), key=lambda e: e["edge_id"])
    for poi in ("F:0", "P:1", "N:5", "F:none"):
        thr = {poi: max((e["end_t"] for e in items if e["dst"] == poi), default=0)}
        queue, kept = [poi], []
        for v in queue:
            for e in items:
                if e["dst"] == v and e["start_t"] <= thr[v]:
                    kept.append(e["edge_id"])
                    thr[e["src"]] = max(thr.get(e["src"], slicing.LOW), min(e["end_t"], thr[v]))
                    queue += [e["src"]] * (e["src"] not in queue)
        assert [r[0] for r in rows(slicing.back_track_fifo(edges, poi), "edge_id")] == sorted(kept)


def test_heavy_paths_in_a_task(edges, monkeypatch):
    """the same for walks along the heaviest edges."""
    w = weights.nonml(edges, 430, 3.0, ["F:0"]).cache()
    _no_frames(monkeypatch, w)
    items = sorted((r.asDict() for r in w.collect()), key=lambda e: (-e["weight"], e["edge_id"]))
    for start in ("F:0", "P:1", "F:none"):
        gone, want = set(), set()
        for walk in range(5):
            queue, visited = [start], set()
            while queue:
                v = queue.pop(0)
                if v in visited:
                    continue
                visited.add(v)
                for near, far in (("dst", "src"), ("src", "dst")):
                    live = [e for e in items if e[near] == v and e["edge_id"] not in gone]
                    if live:
                        want.add((walk, live[0]["edge_id"]))
                        gone |= {live[0]["edge_id"]} if len(live) > 1 else set()
                        queue.append(live[0][far])
        assert rows(slicing.heavy_paths(w, start), "walk", "edge_id") == sorted(want)


def test_merged_is_connected(spark):
    from tracelight.plans import attack

    e = spark.createDataFrame([(1, "N:a", "P:b", 1, 2), (2, "P:b", "F:p", 3, 8), (3, "N:c", "F:d", 5, 6), (4, "F:d", "P:b", 1, 7)], "edge_id long, src string, dst string, start_t long, end_t long")
    rep = spark.createDataFrame([("F:p", 1.0), ("P:b", 0.9)], "node string, reputation double")
    top = spark.createDataFrame([("N:a",), ("N:c",)], "node string")
    case = attack.Result("F:p", e, e, e, rep, top, top, top, 9)
    assert rows(case.merged(), "edge_id") == [(1,), (2,), (3,), (4,)]


def reach(pairs, a):
    seen, front = {a}, {a}
    while front:
        front = {d for s, d in pairs if s in front} - seen
        seen |= front
    return seen


def shortest(pairs, a, goals):
    """Number of links from a to the nearest goal, None without a way."""
    seen, front, n = {a}, {a}, 0
    while front:
        if front & goals:
            return n
        front, n = {d for s, d in pairs if s in front} - seen, n + 1
        seen |= front
    return None


def test_connected_to_poi(edges, spark):
    every = [(r.src, r.dst) for r in edges.collect()]
    kept = edges.where("edge_id % 30 = 7")
    for entries in (["N:2", "P:4", "N:none"], []):
        out = slicing.connected_to_poi(edges, kept, entries, "F:0")
        got = {(r.src, r.dst) for r in out.collect()}
        nodes = {n for p in got for n in p}
        both = got | {(d, s) for s, d in got}
        assert reach(both, min(nodes)) == nodes  # one weak component
        assert {r.edge_id for r in kept.collect()} <= {r.edge_id for r in out.collect()}  # all of kept can be bridged here
        for e in entries:
            if "F:0" in reach(every, e):
                assert "F:0" in reach(got, e)
        assert out.count() == out.dropDuplicates(["edge_id"]).count()


def test_bridges_and_pruning(spark):
    whole = spark.createDataFrame([(1, "P:a", "F:p"), (2, "F:x", "P:a"), (3, "F:x", "P:y"), (4, "P:y", "F:z"), (5, "N:1", "N:2"), (6, "P:y", "F:z")], "edge_id long, src string, dst string")
    kept = whole.where("edge_id in (1, 4, 5)")
    out = slicing.connected_to_poi(whole, kept, [], "F:p")
    assert rows(out, "edge_id") == [(1,), (2,), (3,), (4,)]  # F:z is bridged over F:x against and along edges, N:1 goes
    assert rows(slicing.connected_to_poi(whole, kept, ["P:a"], "F:p"), "edge_id") == [(1,), (2,), (3,), (4,)]
    largest = slicing.connected_to_poi(whole, whole.where("edge_id in (3, 4, 5)"), [], "F:none")
    assert rows(largest, "edge_id") == [(3,), (4,)]


def test_repaired(edges, spark):
    kept = edges.where("edge_id % 10 = 0")
    rep = spark.createDataFrame([("F:0", 1.0)], "node string, reputation double")
    out = slicing.repaired(kept, graph.nodes_of(edges), edges, rep)
    every, old, new = ({(r.src, r.dst) for r in df.collect()} for df in (edges, kept, out))
    label = {r.node: r.component for r in slicing.weak_components(kept).collect()}
    main = {n for n, c in label.items() if c == label["F:0"]}
    for n in {x for p in every for x in p} - main:
        n_links = shortest(every, n, main)
        assert n_links == shortest(new, n, main)
    assert old <= new and rows(kept, "edge_id") == rows(out.where("edge_id % 10 = 0").join(kept.select("edge_id"), "edge_id", "left_semi"), "edge_id")


def test_resolved_names(edges):
    assert graph.resolved(edges, ["F:0", "0", "nothing", ""]) == ["F:0"]
    assert graph.resolved(edges, ["1", "N:2"]) == ["P:1", "N:2"]


def test_larger_graph_by_plain_code(spark):
    """110,000 edges through the distributed rounds, held against plain Python."""
    import numpy as np

    r = np.random.default_rng(3)
    n = 110_000
    a, b, s = r.integers(0, 20_000, n), r.integers(0, 20_000, n), r.integers(0, 10**6, n)
    pdf = pd.DataFrame({"src": [f"P:{x}" for x in a], "dst": [f"P:{x}" for x in b], "start_t": s, "end_t": s + r.integers(0, 1000, n)})
    g, poi = spark.createDataFrame(pdf), "P:7"
    thr, into = {poi: int(pdf.loc[pdf["dst"] == poi, "end_t"].max())}, {}
    for e in pdf.itertuples():
        into.setdefault(e.dst, []).append(e)
    todo = [poi]
    while todo:
        v = todo.pop()
        for e in into.get(v, []):
            if e.start_t <= thr[v] and min(e.end_t, thr[v]) > thr.get(e.src, slicing.LOW):
                thr[e.src] = min(e.end_t, thr[v])
                todo.append(e.src)
    assert rows(slicing.back_track(g, poi), "node", "thr") == sorted(thr.items())
    pairs = set(zip(pdf["src"], pdf["dst"]))
    both = {}
    for x, y in pairs:
        both.setdefault(x, []).append(y)
        both.setdefault(y, []).append(x)
    seen, todo = {poi}, [poi]
    while todo:
        for x in both.get(todo.pop(), []):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    found = slicing.weak_components(g)
    assert {x.node for x in found.where(F.col("component") == min(seen)).collect()} == seen
