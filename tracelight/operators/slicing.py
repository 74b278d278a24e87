"""Temporal slices of a graph of timed edges (src, dst, start_t, end_t, ...).

Each slice is a fixpoint that does not depend on the order of edges. What can lead to the point of interest at all is found
in distributed rounds; at most IN_PROCESS edges (counted first) are then sliced in one task of an executor, more in further
rounds. Up to ON_DISK edges are sliced in one task without that, over hashes of names in files. Only back_track_fifo() and heavy_paths() follow the order of a queue: they are modes for comparison, in one task.
"""

from __future__ import annotations

import tempfile
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracelight.graph import nodes_of
from tracelight.plans.fixpoint import BROADCAST_ROWS, IN_PROCESS, checkpoint, coded, codes, components, filled, held, in_one_task, iterate, numbered_ends, released, settled, small, stored

LOW = -(1 << 62)
UNREACHED, LAST = np.iinfo(np.int64).min, (1 << 63) - 1
#: Rows of a batch that walks in one task tell.
OUT = 100_000
#: Edges that one task walks over files (32 bytes an edge; 20 bytes a node are held), and edges of them that are held at a time.
ON_DISK, PIECE = 100_000_000, 2_000_000
#: Stands before all starts of a walk; nodes begin with their kind and a colon.
START = "*"


def latest_in(edges: DataFrame, poi: str) -> int:
    """The latest end of the edges into the point of interest, 0 without any."""
    return edges.where(F.col("dst") == poi).agg(F.max("end_t")).first()[0] or 0


def _one(edges: DataFrame, schema: str, *row) -> DataFrame:
    return edges.sparkSession.createDataFrame([row], schema)


def _gathered(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the edges of nodes in edges sorted by node, and how many each has."""
    n = first[nodes + 1] - first[nodes]
    return np.repeat(first[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def latest(first: np.ndarray, far: np.ndarray, start: np.ndarray, end: np.ndarray, root: int, top: int, max_rounds: int | None = None) -> np.ndarray:
    """Of each numbered node the latest time that root, which has top, leaves it: an edge that starts no later than the time of
    its near end gives its far end the lesser of that and its own end. Edges are sorted by their near end; UNREACHED without any."""
    value, fresh, rounds = np.full(len(first) - 1, UNREACHED), np.array([root]), 0
    value[root] = top
    while len(fresh) and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        at, n = _gathered(first, fresh)
        till = np.repeat(value[fresh], n)
        taken = start[at] <= till
        at, till = at[taken], till[taken]
        made, to = np.minimum(end[at], till), far[at]
        better = made > value[to]
        made, to = made[better], to[better]
        np.maximum.at(value, to, made)
        fresh = np.unique(to)
    return value


def fewest(first: np.ndarray, far: np.ndarray, taken: np.ndarray, root: int) -> np.ndarray:
    """Of each numbered node one more than the fewest of the edges taken between it and root, 0 without any way."""
    step, fresh, at_step = np.zeros(len(first) - 1, np.int32), np.array([root]), 1
    while len(fresh):
        step[fresh] = at_step
        at_step += 1
        at, _ = _gathered(first, fresh)
        to = far[at[taken[at]]]
        fresh = np.unique(to[step[to] == 0])
    return step


def _walked_here(narrow: DataFrame, root: str, top: int, steps: bool = False, max_rounds: int | None = None) -> DataFrame:
    """node, thr (with steps: step) of latest(), in one task over numbered nodes; narrow has far, near, start and end."""
    schema = "node string, thr long, step int" if steps else "node string, thr long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (far, near), names, rest = numbered_ends(batches)
        at = pc.index(names, root).as_py()
        if at < 0:
            return
        order = np.argsort(near, kind="stable")
        start, end = (np.concatenate([b.column(i).to_numpy() for b in rest])[order] for i in range(2))
        del rest
        near, far = near[order], far[order]
        first = _offsets(near, len(names))
        value = latest(first, far, start, end, at, top, max_rounds)
        told = [value]
        if steps:
            told.append(fewest(first, far, start <= value[near], at))
        rows = np.flatnonzero(value != UNREACHED)
        rows = rows[rows != at]
        for lo in range(0, len(rows), OUT):
            some = rows[lo : lo + OUT]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), *[pa.array(c[some]) for c in told]], [f.split()[0] for f in schema.split(", ")])

    return checkpoint(narrow.repartition(1).mapInArrow(run, schema).unionByName(_one(narrow, schema, root, top, *([1] if steps else []))))


class _Files:
    """Columns of numbers in files without names in the temporary folder of the task, read and written in pieces."""

    def __init__(self, n: int, **kinds: type) -> None:
        self.n, self.kinds = n, kinds
        self.of = {c: tempfile.TemporaryFile() for c in kinds}

    def add(self, column: str, values: np.ndarray) -> None:
        self.of[column].write(np.ascontiguousarray(values, self.kinds[column]).data)

    def pieces(self, *columns: str) -> Iterator[list[np.ndarray]]:
        for c in columns:
            self.of[c].seek(0)
        for low in range(0, self.n, PIECE):
            k = min(PIECE, self.n - low)
            yield [np.frombuffer(self.of[c].read(k * np.dtype(self.kinds[c]).itemsize), self.kinds[c]) for c in columns]


def _placed(every: np.ndarray, first: np.ndarray, shift: int, x: np.ndarray) -> np.ndarray:
    """Places of hashes x in every (sorted, each once), begun at the first of those with the same leading bits."""
    at = first[(x >> shift) + len(first) // 2]
    off = np.flatnonzero(every[at] != x)
    while len(off):
        at[off] += 1
        off = off[every[at[off]] != x[off]]
    return at


def _renumbered(files: _Files, columns: dict[str, str], every: np.ndarray) -> None:
    """Write the places in every of what columns hold to other columns."""
    bits = max(1, min(24, len(every).bit_length()))
    first = np.searchsorted(every, np.arange(-(1 << bits - 1), 1 << bits - 1) << (64 - bits)).astype(np.int32)
    for c, to in columns.items():
        for (x,) in files.pieces(c):
            files.add(to, _placed(every, first, 64 - bits, x))
        files.of.pop(c).close()


def _scanned(files: _Files, n_nodes: int, root: int, top: int, steps: bool, max_rounds: int | None) -> tuple[np.ndarray, np.ndarray | None]:
    """latest() and fewest() by scans of all edges, which need no order."""
    value, fresh, rounds = np.full(n_nodes, UNREACHED), np.zeros(n_nodes, bool), 0
    value[root], fresh[root] = top, True
    while fresh.any() and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        known, now, fresh = value if max_rounds is None else value.copy(), fresh, np.zeros(n_nodes, bool)
        for near, far, start, end in files.pieces("near", "far", "start", "end"):
            at = np.flatnonzero(now[near])
            till = known[near[at]]
            at, till = at[taken := start[at] <= till], till[taken]
            made, to = np.minimum(end[at], till), far[at]
            better = made > value[to]
            made, to = made[better], to[better]
            np.maximum.at(value, to, made)
            fresh[to] = True
    if not steps:
        return value, None
    step, fresh, at_step = np.zeros(n_nodes, np.int32), np.zeros(n_nodes, bool), 1
    step[root], fresh[root] = 1, True
    while fresh.any():
        at_step, now, fresh = at_step + 1, fresh, np.zeros(n_nodes, bool)
        for near, far, start in files.pieces("near", "far", "start"):
            at = np.flatnonzero(now[near])
            to = far[at[start[at] <= value[near[at]]]]
            fresh[to[step[to] == 0]] = True
        step[fresh] = at_step
    return value, step


def _walked_on_disk(narrow: DataFrame, n: int, root: str, top: int, steps: bool = False, max_rounds: int | None = None) -> DataFrame | None:
    """As _walked_here(), over hashes of names in files of the task, so that only nodes are held; None where two names share a hash."""
    schema = "code long, thr long, step int" if steps else "code long, thr long"
    columns, code = [f.split()[0] for f in schema.split(", ")], F.xxhash64("node").alias("code")
    first = _one(narrow, "node string", root).select(code).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(n, h_near=np.int64, h_far=np.int64, start=np.int64, end=np.int64, near=np.int32, far=np.int32)
        nodes = []
        for b in batches:
            nodes.append(b.filter(pc.is_null(b["start"]))["h_near"].to_numpy())
            b = b.filter(pc.is_valid(b["start"])) if len(nodes[-1]) else b
            for c in ("h_near", "h_far", "start", "end"):
                files.add(c, b[c].to_numpy())
        every = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        del nodes
        every.sort()
        _renumbered(files, {"h_near": "near", "h_far": "far"}, every)
        at = int(np.searchsorted(every, first))
        if at == len(every) or every[at] != first:
            return
        value, step = _scanned(files, len(every), at, top, steps, max_rounds)
        rows = np.flatnonzero(value != UNREACHED)
        rows = rows[rows != at]
        for lo in range(0, len(rows), OUT):
            some = rows[lo : lo + OUT]
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (every, value, step)[: len(columns)]], columns)

    narrow = narrow.where("near IS NOT NULL AND far IS NOT NULL AND start IS NOT NULL").withColumn("end", F.coalesce("end", F.lit(LAST)))
    n = narrow.count()
    numbers = narrow.select(F.xxhash64("near").alias("h_near"), F.xxhash64("far").alias("h_far"), "start", "end")
    # Each node's hash comes once beside the edges, without a start.
    void = F.lit(None).cast("long")
    hashes = numbers.select(F.explode(F.array("h_near", "h_far")).alias("h_near")).distinct().select("h_near", void.alias("h_far"), void.alias("start"), void.alias("end"))
    reached = stored(numbers.unionAll(hashes).repartition(1).mapInArrow(run, schema))
    many = reached.count()
    named = narrow.select(F.explode(F.array("near", "far")).alias("node")).where(F.col("node") != root).select("node", code)
    known = small(reached, many)
    named = named.join(known.select("code"), "code", "left_semi").distinct() if many <= BROADCAST_ROWS else named.distinct()
    seen = Observation()
    out = stored(named.join(known, "code").select("node", *columns[1:]).observe(seen, F.count("*").alias("n")))
    if seen.get["n"] != many:
        return None
    return out.unionByName(_one(narrow, out.schema, root, top, *([1] if steps else [])))


def _walked(narrow: DataFrame, n: int, root: str, top: int, in_process: int, steps: bool = False, max_rounds: int | None = None, on_disk: int | None = None) -> DataFrame | None:
    """node, thr (with steps: step) of the n edges of narrow in one task; None of more than ON_DISK."""
    if n <= in_process:
        return _walked_here(narrow, root, top, steps, max_rounds)
    if n <= (ON_DISK if on_disk is None else on_disk):
        return _walked_on_disk(narrow, n, root, top, steps, max_rounds)
    return None


def _turned(edges: DataFrame) -> DataFrame:
    """far, near, start and end of edges that are followed from their targets."""
    return edges.select(F.col("src").alias("far"), F.col("dst").alias("near"), F.col("start_t").alias("start"), F.col("end_t").alias("end"))


def leading_to(edges: DataFrame, poi: str, in_process: int = IN_PROCESS) -> tuple[DataFrame, int]:
    """src, dst, start_t, end_t of edges, and their number; of more than in_process those from which links lead to poi at any time."""
    columns = ["src", "dst", "start_t", "end_t"]
    every = edges if held(edges) else stored(edges.select(*columns))
    n = every.count()
    if n > in_process:  # over hashes of names: where two names share one, some edges more are kept, which no slice takes
        code = lambda c, to: F.xxhash64(c).alias(to)
        links = stored(every.where("dst IS NOT NULL").select(code("src", "far"), code("dst", "node")))
        first = _one(edges, "node string", poi).select(code("node", "node"))
        nodes = iterate(first, lambda frontier: links.join(frontier, "node").select(F.col("far").alias("node")).distinct(), ["node"])
        released(links)
        led = small(nodes.withColumnRenamed("node", "_node"), nodes.count())
        every = checkpoint(every.where("dst IS NOT NULL").select(*columns).join(led, F.xxhash64("dst") == F.col("_node")).select(*columns))
        n = every.count()
    return every.select(*columns), n


def back_track(edges: DataFrame, poi: str, max_rounds: int | None = None, in_process: int = IN_PROCESS, on_disk: int | None = None) -> DataFrame:
    """node, thr: everything that can have reached poi, with the latest time at which it could still matter."""
    edges = edges if held(edges) else stored(edges.select("src", "dst", "start_t", "end_t"))
    if (here := _walked(_turned(edges), edges.count(), poi, latest_in(edges, poi), in_process, False, max_rounds, on_disk)) is not None:
        return here
    narrow, n = leading_to(edges, poi, in_process)
    top = latest_in(narrow, poi)
    if n <= in_process:
        return _walked_here(_turned(narrow), poi, top, max_rounds=max_rounds)
    narrow = checkpoint(narrow.withColumnRenamed("dst", "node").repartition("node"))

    def step(frontier: DataFrame) -> DataFrame:
        reached = narrow.join(frontier, "node").where("start_t <= thr")
        return reached.groupBy(F.col("src").alias("node")).agg(F.max(F.least("end_t", "thr")).alias("thr"))

    return iterate(_one(edges, "node string, thr long", poi, top), step, ["node"], "thr", max_rounds=max_rounds)


def slice_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges that a backward slice keeps: those that start no later than their target's time."""
    reached = reached if held(reached) else checkpoint(reached)
    return edges.join(small(reached.select(F.col("node").alias("dst"), "thr"), reached.count()), "dst").where("start_t <= thr").select(*edges.columns)


def back_track_steps(edges: DataFrame, poi: str, in_process: int = IN_PROCESS, on_disk: int | None = None) -> DataFrame:
    """node, thr, step: the slice with each node's step, the fewest edges of the slice between it and poi; poi has step 1."""
    edges = edges if held(edges) else stored(edges.select("src", "dst", "start_t", "end_t"))
    if (here := _walked(_turned(edges), edges.count(), poi, latest_in(edges, poi), in_process, True, None, on_disk)) is not None:
        return here
    narrow, n = leading_to(edges, poi, in_process)
    if n <= in_process:
        return _walked_here(_turned(narrow), poi, latest_in(narrow, poi), steps=True)
    reached = checkpoint(back_track(edges, poi, in_process=in_process, on_disk=on_disk))
    pairs = checkpoint(slice_edges(edges, reached).select("src", F.col("dst").alias("node")).distinct().repartition("node"))
    further = lambda frontier: pairs.join(frontier, "node").groupBy(F.col("src").alias("node")).agg((F.min("step") + 1).alias("step"))
    return reached.join(iterate(_one(edges, "node string, step int", poi, 1), further, ["node"], "step", least=True), "node").select("node", "thr", "step")


def back_track_scan(edges: DataFrame, poi: str) -> DataFrame:
    """One scan by start time, latest first: an edge stays if its target is in the slice and it starts before its time.

    A node enters with the latest edge that stays, of one start the one of the smallest id, and keeps the time of that edge.
    What an edge meets was settled by later ones, so rounds over all edges at once stand when nothing changes any more.
    """
    at = F.struct(F.col("start_t").alias("t"), (-F.col("edge_id")).alias("id"))
    far = F.struct(F.lit(1 << 62).alias("t"), F.lit(0).cast("long").alias("id"))
    narrow = checkpoint(edges.select("edge_id", "src", "dst", "end_t", "start_t", at.alias("at")).repartition("dst"))
    first = checkpoint(_one(edges, "node string, thr long", poi, latest_in(edges, poi)).select("node", far.cast(narrow.schema["at"].dataType).alias("at"), "thr"))
    known = lambda state: state.select(F.col("node").alias("dst"), F.col("at").alias("entered"), "thr")
    kept = lambda state: narrow.join(known(state), "dst").where((F.col("at") < F.col("entered")) & (F.col("start_t") < F.col("thr")))

    def step(state: DataFrame) -> DataFrame:
        made = kept(state).where(F.col("src") != poi).groupBy(F.col("src").alias("node")).agg(F.max("at").alias("at"), F.max_by(F.least("end_t", "thr"), "at").alias("thr"))
        return first.unionByName(made)

    return edges.join(kept(settled(first, step, ["node", "at", "thr"])).select("edge_id"), "edge_id", "left_semi").select(*edges.columns)


def forward(edges: DataFrame, roots: DataFrame, until: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """root, node, arr: earliest arrival of what leaves each root (column node of roots) before `until`.

    An edge is taken if it starts before `until` and not before its source was reached; a root is reached from the start.
    """
    narrow = edges.select(F.col("src").alias("node"), "dst", "start_t")
    if until is not None:
        narrow = narrow.where(F.col("start_t") < until)
    narrow = checkpoint(narrow.repartition("node"))

    def step(frontier: DataFrame) -> DataFrame:
        taken = narrow.join(frontier, "node").where("start_t >= arr")
        return taken.groupBy("root", F.col("dst").alias("node")).agg(F.min("start_t").alias("arr"))

    start = roots.select(F.col("node").alias("root"), "node", F.lit(LOW).alias("arr")).distinct()
    return iterate(start, step, ["root", "node"], "arr", least=True, max_rounds=max_rounds)


#: Edges that forward_many() sends to every task.
BROADCAST_EDGES = 1_000_000


def forward_many(edges: DataFrame, roots: DataFrame, until: int | None = None, max_rounds: int | None = None, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """forward() for many roots: where the edges are few (counted first) they are broadcast and tasks walk their own roots,
    which saves the shuffles of a state of roots times nodes; else as forward()."""
    narrow = edges.select("src", "dst", "start_t")
    if until is not None:
        narrow = narrow.where(F.col("start_t") < until)
    narrow = checkpoint(narrow)
    if narrow.limit(broadcast_edges + 1).count() > broadcast_edges:
        return forward(edges, roots, until, max_rounds)
    sc, pdf = edges.sparkSession.sparkContext, narrow.toPandas().sort_values("start_t", kind="stable")
    codes, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
    shared = sc.broadcast((codes[: len(pdf)], codes[len(pdf) :], pdf["start_t"].to_numpy(), np.asarray(names, object), {v: i for i, v in enumerate(names)}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, d, start, names, number = shared.value
        never = np.int64(1 << 62)
        for batch in batches:
            for root in batch["node"]:
                if root not in number:
                    yield pd.DataFrame({"root": [root], "node": [root], "arr": [LOW]})
                    continue
                arr = np.full(len(names), never)
                arr[number[root]] = LOW
                rounds, fresh = 0, np.arange(len(names)) == number[root]
                while fresh.any() and (max_rounds is None or rounds < max_rounds):
                    rounds += 1
                    at = np.flatnonzero(fresh[s])
                    at = at[start[at] >= arr[s[at]]]
                    new = arr.copy()
                    np.minimum.at(new, d[at], start[at])
                    fresh, arr = new < arr, new
                hit = arr < never
                yield pd.DataFrame({"root": root, "node": names[hit].astype(str), "arr": arr[hit]})

    return roots.select("node").distinct().repartition(4 * sc.defaultParallelism, "node").mapInPandas(run, "root string, node string, arr long")


def forward_edges(edges: DataFrame, arrived: DataFrame, until: int | None = None) -> DataFrame:
    out = edges.join(arrived.select("root", F.col("node").alias("src"), "arr"), "src").where("start_t >= arr")
    if until is not None:
        out = out.where(F.col("start_t") < until)
    return out.select("root", *edges.columns)


def merged_forward(slice_: DataFrame, starts: DataFrame, until: int, in_process: int = IN_PROCESS, on_disk: int | None = None) -> DataFrame:
    """Edges of the slice between any pair that a forward walk from a start takes; the whole slice if there is none.

    Some walk takes an edge if the one that reached its source first does, so all starts are walked as one.
    """
    away = starts.select(F.lit(START).alias("src"), F.col("node").alias("dst"), F.lit(LOW).alias("start_t")).distinct()
    linked = checkpoint(slice_.select("src", "dst", "start_t").where(F.col("start_t") < until).unionByName(away))
    # The earliest arrival is the latest one where time runs backward.
    turned = linked.select(F.col("dst").alias("far"), F.col("src").alias("near"), (-F.col("start_t")).alias("start"), (-F.col("start_t")).alias("end"))
    here = _walked(turned, linked.count(), START, -LOW, in_process, on_disk=on_disk)
    if here is not None:
        arrived = here.select(F.lit(START).alias("root"), "node", (-F.col("thr")).alias("arr"))
    else:
        arrived = forward(linked, _one(slice_, "node string", START), until)
    pairs = forward_edges(slice_, arrived, until).select("src", "dst").distinct()
    out = checkpoint(slice_.join(pairs, ["src", "dst"], "left_semi").select(*slice_.columns))
    return slice_ if out.isEmpty() else out


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node name that undirected links reach."""
    return components(edges)


def component_of(edges: DataFrame, node: str) -> DataFrame:
    """All nodes weakly connected to one, by breadth."""
    both = edges.select("src", "dst").unionAll(edges.select("dst", "src")).distinct()
    both = checkpoint(both.select(F.col("src").alias("node"), "dst").repartition("node"))
    return iterate(_one(edges, "node string", node), lambda frontier: both.join(frontier, "node").select(F.col("dst").alias("node")), ["node"])


def reputation_walk(edges: DataFrame, reputation: DataFrame, start: str, change: float, is_forward: bool) -> DataFrame:
    """Edges reached from start while the relative drop of reputation along each stays within change."""
    near, far = ("src", "dst") if is_forward else ("dst", "src")
    value = lambda c: reputation.select(F.col("node").alias(c), F.col("reputation").alias(f"r_{c}"))
    scored = edges.join(value("src"), "src").join(value("dst"), "dst")
    ok = checkpoint(scored.where((F.col(f"r_{near}") != 0) & ((F.col(f"r_{near}") - F.col(f"r_{far}")) / F.when(F.col(f"r_{near}") != 0, F.col(f"r_{near}")) <= change)).select(*edges.columns))

    step = lambda frontier: ok.join(frontier.withColumnRenamed("node", near), near).select(F.col(far).alias("node"))
    nodes = iterate(_one(edges, "node string", start), step, ["node"])
    return ok.join(nodes.withColumnRenamed("node", near), near, "left_semi").select(*edges.columns)


# --- connectivity ------------------------------------------------------------------------------


def paths(pairs: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """src, dst: the links of one shortest path along pairs (src, dst) from each start (column node) to the nearest goal.

    Breadth-first from the goals; of several ways on, a node keeps the one to the smallest name.
    """
    starts = checkpoint(starts.select("node").distinct())
    if starts.isEmpty():
        return pairs.select("src", "dst").limit(0)
    narrow = checkpoint(pairs.select("src", F.col("dst").alias("node")).distinct().repartition("node"))

    def back(frontier: DataFrame) -> DataFrame:
        at = narrow.join(frontier, "node").select("src", F.struct((F.col("way.hops") + 1).alias("hops"), F.col("node").alias("next")).alias("way"))
        return at.groupBy(F.col("src").alias("node")).agg(F.min("way").alias("way"))

    first = goals.select("node", F.struct(F.lit(0).alias("hops"), F.lit("").alias("next")).alias("way")).distinct()
    ways = checkpoint(iterate(first, back, ["node"], "way", least=True).where("way.hops > 0").select("node", "way.next"))
    passed = iterate(starts, lambda frontier: ways.join(frontier, "node").select(F.col("next").alias("node")), ["node"])
    return ways.join(passed, "node").select(F.col("node").alias("src"), F.col("next").alias("dst"))


def _least_edges(whole: DataFrame, links: DataFrame) -> DataFrame:
    """The edge of the smallest id of each link (src, dst)."""
    ids = whole.join(links.distinct(), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))
    return whole.join(ids.select("edge_id"), "edge_id", "left_semi").select(*whole.columns)


def _with(kept: DataFrame, more: DataFrame) -> DataFrame:
    return checkpoint(kept.unionByName(more.join(kept.select("edge_id"), "edge_id", "left_anti").select(*kept.columns)))


def repaired(kept: DataFrame, nodes: DataFrame, whole: DataFrame, reputation: DataFrame) -> DataFrame:
    """kept plus, for each node apart from the component with the highest reputation, a shortest forward path back to it."""
    label = checkpoint(weak_components(kept))
    best = label.join(reputation, "node", "left").select("component", F.coalesce("reputation", F.lit(0.0)).alias("r"), "node").orderBy(F.desc("r"), F.desc("node")).first()
    if best is None:
        return kept
    main = checkpoint(label.where(F.col("component") == best["component"]).select("node"))
    apart = nodes.select("node").distinct().join(main, "node", "left_anti")
    return _with(kept.select(*whole.columns), _least_edges(whole, paths(whole, apart, main)))


def connected_to_poi(whole: DataFrame, kept: DataFrame, entries: list[str], poi: str) -> DataFrame:
    """kept plus shortest directed paths of the whole graph to poi from each entry that does not reach it in kept; then one
    weak component: that of poi (without it the largest), with a shortest undirected bridge of the whole graph from each
    other component; components that none reaches go."""
    spark, kept = whole.sparkSession, checkpoint(kept.select(*whole.columns))
    goal = spark.createDataFrame([(poi,)], "node string")
    if entries:
        lost = spark.createDataFrame([(e,) for e in entries], "node string").distinct()
        backward = kept.select("src", F.col("dst").alias("node")).distinct()
        reach = iterate(goal, lambda frontier: backward.join(frontier, "node").select(F.col("src").alias("node")), ["node"])
        lost = checkpoint(lost.join(reach, "node", "left_anti"))
        if not lost.isEmpty():
            kept = _with(kept, _least_edges(whole, paths(whole, lost, goal)))
    label = checkpoint(weak_components(kept))
    mine = label.where(F.col("node") == poi).select("component").first() or label.groupBy("component").count().orderBy(F.desc("count"), "component").select("component").first()
    if mine is None:
        return kept
    main = checkpoint(label.where(F.col("component") == mine["component"]).select("node"))
    others = label.where(F.col("component") != mine["component"])
    if not others.isEmpty():
        turned = whole.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        both = checkpoint(whole.select("src", "dst").unionAll(turned).distinct())
        bridges = checkpoint(paths(both, others.groupBy("component").agg(F.min("node").alias("node")), main))
        # A bridge's link is an edge in either direction: that along it if there is one.
        along = bridges.join(whole.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        against = bridges.join(along, ["src", "dst"], "left_anti").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        kept = _with(kept, _least_edges(whole, along.unionByName(against)))
        main = checkpoint(component_of(kept, main.first()["node"]))
    return kept.join(main.withColumnRenamed("node", "src"), "src", "left_semi").select(*whole.columns)


# --- walks in the order of a queue: modes for comparison, in one task over numbered nodes -------------

def _offsets(sorted_codes: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_codes, np.arange(n + 1))


def _code(names: DataFrame, node: str) -> int | None:
    row = names.where(F.col("node") == node).select("code").first()
    return row[0] if row else None


def back_track_fifo(edges: DataFrame, poi: str) -> DataFrame:
    """The slice of a first-in-first-out walk that expands each node once, edges in id order: a part of back_track's."""
    names = codes(nodes_of(edges))
    of, n_nodes, at = checkpoint(coded(edges, names).select("s", "d", "start_t", "end_t", "edge_id")), names.count(), _code(names, poi)
    n = of.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, d, start, end, ids = filled(batches, n, [np.int32, np.int32, np.int64, np.int64, np.int64])
        first = _offsets(d, n_nodes)
        thr, seen, queue, kept = array("q", [LOW]) * n_nodes, bytearray(n_nodes), deque([at] if at is not None else []), array("q")
        if at is not None:
            own = end[first[at] : first[at + 1]]
            thr[at], seen[at] = int(own.max()) if len(own) else 0, 1
        while queue:
            v = queue.popleft()
            a, b = first[v], first[v + 1]
            till = thr[v]
            for i, (u, t0, t1) in enumerate(zip(s[a:b].tolist(), start[a:b].tolist(), end[a:b].tolist()), int(a)):
                if t0 > till:
                    continue
                kept.append(i)
                thr[u] = max(thr[u], min(t1, till))
                if not seen[u]:
                    seen[u] = 1
                    queue.append(u)
        for lo in range(0, len(kept), OUT):
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.frombuffer(kept[lo : lo + OUT], np.int64)])], ["edge_id"])

    found = in_one_task(of, ["d", "edge_id"], run, "edge_id long")
    return edges.join(found, "edge_id", "left_semi").select(*edges.columns)


def heavy_paths(edges: DataFrame, start: str, walks: int = 5) -> DataFrame:
    """walk, edge_id: greedy walks along the heaviest edge in and out of each node; edges taken by choice are used up."""
    names = codes(nodes_of(edges))
    of, n_nodes, root = checkpoint(coded(edges, names).select("s", "d", "edge_id", F.col("weight").cast("double"))), names.count(), _code(names, start)
    n = of.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, d, ids, weight = filled(batches, n, [np.int32, np.int32, np.int64, np.float64])
        sides = []  # of each node its edges, heaviest first; what stands before `low` is used up
        for near, far in ((d, s), (s, d)):
            order = np.lexsort((ids, -weight, near)).astype(np.int32)
            first = _offsets(near[order], n_nodes)
            sides.append((order, far, first, first[:-1].copy()))
        gone = bytearray(n)
        for walk in range(walks):
            queue, visited, taken = deque([root] if root is not None else []), bytearray(n_nodes), array("q")
            while queue:
                v = queue.popleft()
                if visited[v]:
                    continue
                visited[v] = 1
                for order, far, first, low in sides:
                    at, end = low[v], first[v + 1]
                    while at < end and gone[order[at]]:
                        at += 1
                    low[v] = at
                    if at == end:
                        continue
                    e = order[at]
                    taken.append(e)
                    if any(not gone[order[i]] for i in range(at + 1, end)):
                        gone[e] = 1
                    if not visited[far[e]]:
                        queue.append(far[e])
            rows = np.unique(ids[np.frombuffer(taken, np.int64)]) if taken else np.zeros(0, np.int64)
            for lo in range(0, len(rows), OUT):
                some = rows[lo : lo + OUT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), walk, np.int32)), pa.array(some)], ["walk", "edge_id"])

    return in_one_task(of, ["edge_id"], run, "walk int, edge_id long")
