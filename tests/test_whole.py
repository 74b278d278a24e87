"""Queries without SQL by brute force: what SQL bounds (rounds, roots, edges) is not bounded here."""

import collections

import pytest

from tracelight import catalog
from tracelight.operators import slicing

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def case(spark):
    """Weighted edges, the point of interest and its reputations, by plain rounds until they move by less than 1e-5."""
    w, poi = catalog._weighted(spark, DATA)
    edges = w.collect()
    rep = {n: float(n == poi) for e in edges for n in (e.src, e.dst)}
    for _ in range(3000):
        new = dict.fromkeys(rep, 0.0)
        for e in edges:
            new[e.src] += e.weight * rep[e.dst]
        new[poi] = 1.0
        moved = sum(abs(new[n] - rep[n]) for n in rep)
        rep = new
        if moved < 1e-5:
            break
    return edges, poi, rep


def run(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def test_reputation_converges(spark, case):
    edges, poi, rep = case
    got = {r.node: r.reputation for r in run(spark, "p2_converged")}
    assert got.keys() == rep.keys() and all(abs(got[n] - rep[n]) < 2e-6 for n in rep)
    four = {r.node: r.reputation for r in run(spark, "p2_propagated")}
    assert sum(v > 0 for v in got.values()) > sum(v > 0 for v in four.values())


def test_converged_rankings(spark, case):
    edges, poi, rep = case
    fed = {e.dst for e in edges if e.src[0] in "NP"}
    entered = {e.dst for e in edges}
    kinds = collections.defaultdict(list)
    for n in rep:
        if n != poi and (n[0] == "N" or (n[0] == "P" and n not in fed) or (n[0] == "F" and n not in entered)):
            kinds[n[0]].append((-round(rep[n], 12), n))
    want = [(n, k, round(-v, 6), i + 1) for k, all_ in kinds.items() for i, (v, n) in enumerate(sorted(all_))]
    by_name = lambda rows: [(n, k, i) for n, k, _, i in sorted(rows)]
    assert by_name(run(spark, "p4_converged_ranked")) == by_name(want)
    top = [r for r in want if r[3] <= 3]
    assert by_name(run(spark, "p5_converged_top")) == by_name(top)
    assert {r.node for r in run(spark, "p6_converged_highlighted")} == {r[0] for r in top} | {"N:cust#1"}


def test_converged_filters(spark, case):
    edges, poi, rep = case
    key = lambda rows: sorted((e.src, e.dst, e.start_t, e.end_t) for e in rows)
    assert key(run(spark, "p9_converged_without_unreputed")) == key(e for e in edges if rep[e.src] and rep[e.dst])
    ok = [e for e in edges if rep[e.dst] and (rep[e.dst] - rep[e.src]) / rep[e.dst] <= 0.9]
    seen = {poi}
    while more := {e.src for e in ok if e.dst in seen} - seen:
        seen |= more
    assert key(run(spark, "t10_reputation_walk")) == key(e for e in ok if e.dst in seen)


def arrivals(edges, root, until, steps=None):
    """Earliest arrivals from one root by plain rounds over all edges."""
    arr = {root: slicing.LOW}
    while steps is None or steps:
        steps = steps and steps - 1
        new = dict(arr)
        for e in edges:
            if e.src in arr and arr[e.src] <= e.start_t < until:
                new[e.dst] = min(new.get(e.dst, e.start_t), e.start_t)
        if new == arr:
            break
        arr = new
    return arr


def test_forward_from_all_roots(spark, case):
    edges, poi, _ = case
    until = max(e.end_t for e in edges if e.dst == poi)
    roots = sorted({e.src for e in edges if e.src[0] == "N"})
    assert len(roots) > 64
    for name, steps in (("t7_forward_all", None), ("t6_forward_all_steps", 3)):
        got = collections.defaultdict(dict)
        for r in run(spark, name):
            got[r.root][r.node] = r.arr
        assert sorted(got) == roots
        for root in roots[::10]:
            assert got[root] == arrivals(edges, root, until, steps)


def test_merged_from_all_candidates(spark, case):
    _, poi, _ = case
    e = catalog.graph(spark, DATA)
    s = slicing.slice_edges(e, slicing.back_track(e, poi)).collect()
    until = max(x.end_t for x in s)
    fed, entered, nodes = {x.dst for x in s if x.src[0] in "NP"}, {x.dst for x in s}, {n for x in s for n in (x.src, x.dst)} - {poi}
    pairs = set()
    for n in nodes:
        if n[0] == "N" or (n[0] == "P" and n not in fed) or (n[0] == "F" and n not in entered):
            arr = arrivals(s, n, until)
            pairs |= {(x.src, x.dst) for x in s if x.src in arr and arr[x.src] <= x.start_t < until}
    key = lambda rows: sorted((x.src, x.dst, x.start_t, x.end_t) for x in rows)
    assert key(run(spark, "t8_merged_candidates")) == key(x for x in s if (x.src, x.dst) in pairs)


def test_dot_of_the_whole_graph(spark, case):
    edges, _, rep = case
    out = run(spark, "out1_dot")
    assert sum(r.part == 1 for r in out) == len(edges)
    assert sorted(r.line.split('"')[1] for r in out if r.part == 0) == sorted(rep)
