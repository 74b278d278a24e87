"""Full-dependence and source-dependence preserving reduction.

Edges are taken in the order of (start, end, id); an edge before another is "earlier". What a node has told others since it
was last told anything is its present knowledge. So an edge u -> v, unless both ends are processes or the same node, is
redundant if

* the latest kept earlier edge v -> u is later than all kept earlier edges into v: u told v nothing that v had not told u, or
* the latest kept earlier edge u -> v is later than all kept earlier edges into u: u has nothing new to tell. Then it also
  lends its end and size to the first kept edge of its type from u to v since u was last told anything, if there is one.

Whether an edge stays depends on earlier edges alone, so rounds in which all edges are judged at once by the verdicts of
the round before stand after finitely many rounds, and there is one standing state. A round is running maxima over the
edges at each node and between each pair of nodes, split into spans of the order, so that a busy node is many tasks.

Source dependence (sources) further drops an edge u -> v if all sources known to u are known to v; sources are the nodes
that nothing enters, and knowledge of them follows the kept edges. Its sets, and the bounded memory of targets (window), are
followed edge by edge over numbers, one task a weak component.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.graph import COLUMNS, nodes_of
from tracelight.plans.fixpoint import IN_PROCESS, checkpoint, coded, codes, earlier, held, linked_numbers, ranked, settled, stored


def _judged(edges: DataFrame) -> DataFrame:
    """edges (pos, src, dst, plain, kept) with the latest kept earlier edges: into each end, along it and against it."""
    told = F.when(F.col("kept"), F.col("pos"))
    at = edges.select(
        F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(None).cast("long").alias("told"), F.lit("in_u").alias("what")), F.struct(F.col("dst").alias("node"), told.alias("told"), F.lit("in_v").alias("what")))).alias("x"), "pos"
    ).select("x.*", "pos")
    entered = earlier(at, ["node"], "pos", {"last": F.max("told")})
    entered = entered.groupBy("pos").agg(F.max(F.when(F.col("what") == "in_u", F.col("last"))).alias("in_u"), F.max(F.when(F.col("what") == "in_v", F.col("last"))).alias("in_v"))
    up = F.col("src") < F.col("dst")
    pair = edges.select("*", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), up.alias("up"))
    both = earlier(pair, ["a", "b"], "pos", {"ups": F.max(F.when(up, told)), "downs": F.max(F.when(~up, told))})
    both = both.select(*edges.columns, F.when(F.col("up"), F.col("ups")).otherwise(F.col("downs")).alias("along"), F.when(F.col("up"), F.col("downs")).otherwise(F.col("ups")).alias("against"))
    return both.join(entered, "pos")


def contested(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between ends that several edges link in either direction, and with them all edges into those ends.

    Only the first can be redundant, as what drops an edge is an earlier one between its ends; the others always stay and
    matter to verdicts only by entering such an end.
    """
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    pairs = checkpoint(edges.groupBy(a, b).agg(F.count("*").alias("n"), F.max((F.col("etype") != "PtoP") & (F.col("src") != F.col("dst"))).alias("plain")).where("n > 1 and plain").select("a", "b"))
    between = edges.withColumns({"a": a, "b": b}).join(pairs, ["a", "b"], "left_semi").select(*COLUMNS)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("dst")).distinct()
    return checkpoint(between), edges.join(ends, "dst", "left_semi").select(*COLUMNS)


def full_dependence(edges: DataFrame) -> DataFrame:
    """`fd` without a bound on remembered targets; only contested edges are judged, by their order among the edges that matter."""
    edges = checkpoint(edges.select(*COLUMNS))
    between, entering = contested(edges)
    order = ["start_t", "end_t", "edge_id"]
    placed = checkpoint(ranked(between.unionByName(entering).dropDuplicates(["edge_id"]), order, "pos"))
    none = F.lit(0)  # positions begin at 1
    answered = F.coalesce("against", none) > F.coalesce("in_v", none)
    repeated = F.coalesce("along", none) > F.coalesce("in_u", none)

    def step(state: DataFrame) -> DataFrame:
        return _judged(state).select("pos", "src", "dst", "plain", (~(F.col("plain") & (answered | repeated))).alias("kept"))

    start = placed.select("pos", "src", "dst", ((F.col("etype") != "PtoP") & (F.col("src") != F.col("dst"))).alias("plain"), F.lit(True).alias("kept"))
    verdicts = checkpoint(_judged(settled(start, step, ["pos", "kept"])))
    # An edge that lends is of the same telling as the one it lends to: nothing has entered its source in between.
    lends = verdicts.where(F.col("plain") & ~answered).select("pos", "kept", F.coalesce("in_u", none).alias("telling"))
    tellings = placed.join(lends, "pos").join(between.select("edge_id"), "edge_id", "left_semi").groupBy("src", "dst", "etype", "telling")
    grown = tellings.agg(F.min(F.when(F.col("kept"), F.col("pos"))).alias("pos"), F.max_by("end_t", "pos").alias("last"), F.sum("size").alias("total")).where("pos is not null").select("pos", "last", "total")
    touched = between.join(placed.select("edge_id", "pos"), "edge_id").join(verdicts.where("kept").select("pos"), "pos", "left_semi").join(grown, "pos", "left")
    touched = touched.withColumns({"end_t": F.coalesce("last", "end_t"), "size": F.coalesce("total", "size")}).select(*COLUMNS)
    return edges.join(between.select("edge_id"), "edge_id", "left_anti").select(*COLUMNS).unionByName(touched)


#: Edges whose numbers are Python objects at a time.
AT_ONCE = 100_000


#: Bytes of the sets of sources that are followed at a time; sets that take less all together are followed edge by edge.
ROOM = 200_000_000


def told_anew(src: np.ndarray, dst: np.ndarray, passed: np.ndarray, bit: np.ndarray, room: int = ROOM) -> np.ndarray | None:
    """Whether the source of each edge knows a source (bit: each node's place among them, -1 of others) that its target does not.

    All edges that pass on what is known are taken in their order, for so many sources at a time as room allows. Edges are taken
    together where no two of them meet in a node that one of them enters; None where too few ever are.
    """
    at = np.flatnonzero(passed)
    s, d, n_nodes = src[at], dst[at], len(bit)
    written, read, level = array("i", [0]) * n_nodes, array("i", [0]) * n_nodes, np.empty(len(at), np.int32)
    for low in range(0, len(at), AT_ONCE):
        some, out = slice(low, low + AT_ONCE), []
        for u, v in zip(s[some].tolist(), d[some].tolist()):
            now = max(written[u], written[v]) + 1
            if read[v] > now:
                now = read[v]
            written[v] = now
            if read[u] < now:
                read[u] = now
            out.append(now)
        level[some] = out
    most = int(level.max()) if len(level) else 0
    if most * 16 > len(at):
        return None
    order = np.argsort(level, kind="stable").astype(np.int32)
    bounds = np.searchsorted(level[order], np.arange(1, most + 2)).tolist()
    s, d = s[order], d[order]
    anew, sources = np.zeros(len(at), bool), np.flatnonzero(bit >= 0)
    n_bits = int(bit.max()) + 1
    words = max(1, min(-(-n_bits // 64), room // (8 * n_nodes)))
    for low in range(0, n_bits, 64 * words):
        own = sources[(bit[sources] >= low) & (bit[sources] < low + 64 * words)]
        known, place = np.zeros((n_nodes, words), np.uint64), bit[own] - low
        known[own, place // 64] = np.uint64(1) << (place % 64).astype(np.uint64)
        knows = np.zeros(n_nodes, bool)
        knows[own] = True
        for a, b in zip(bounds, bounds[1:]):
            of = np.flatnonzero(knows[s[a:b]]) + a
            to = d[of]
            told, had = known[s[of]], known[to]  # of a node that an edge of this level enters, from before it
            np.bitwise_or(told, had, out=told)
            fresh = np.flatnonzero((told != had).any(axis=1))
            to = to[fresh]
            anew[of[fresh]] = knows[to] = True
            known[to] = told[fresh]
    out = np.zeros(len(src), bool)
    out[at[order]] = anew
    return out


def judged(src: np.ndarray, dst: np.ndarray, etype: np.ndarray, process: int, part: np.ndarray, end: Callable, size: Callable, sources: bool, window: int, limit: int, room: int = ROOM) -> tuple[np.ndarray, dict]:
    """Which of the edges stay, and the new end and size of those that are lent any, by the same rules edge by edge.

    src and dst are numbers of nodes in the order of their names, etype and process (that of edges between processes) numbers,
    end and size tell those of the i-th edge. Edges lie weak component (part) by component, each in the order of its edges.
    What is known to a node is forgotten after its last edge, so only nodes that edges are still to come for hold sets. Where
    sets are large, told_anew() tells what they would: what is known does not depend on the edges that a node's sources drop,
    as these tell nothing new, but only on those that are dropped as answered. They are told apart by edges before them, so
    that it is asked again until they stand; after a few times edges are followed one by one after all.

    window: a node remembers that many targets since it was last told anything, the latest first. limit: a node whose
    sources would be more holds that many, and its edges are never dropped for their sources.
    """
    n, n_nodes = len(src), int(max(src.max(), dst.max())) + 1 if len(src) else 0
    again = pd.Series(np.minimum(src, dst) * np.int64(n_nodes) + np.maximum(src, dst)).duplicated(keep=False).to_numpy()  # others never meet their pair again
    at, last, into = np.arange(n, dtype=np.int32), np.zeros(n_nodes, np.int32), np.zeros(n_nodes, np.int32)
    last[src], into[dst] = at, at
    last = np.maximum(last, into)
    dies = ((last[src] == at) + 2 * (last[dst] == at)).astype(np.int8)
    bit = array("i", [-1]) * n_nodes  # of each source its place among those of its component
    if sources:
        of = np.zeros(n_nodes, np.int32)
        of[src] = part
        starts = np.setdiff1d(src, dst)
        starts = starts[np.argsort(of[starts], kind="stable")]
        first = np.searchsorted(of[starts], of[starts])
        np.frombuffer(bit, np.int32)[starts] = np.arange(len(starts)) - first
        del of, starts, first
    del at, last, into
    places = np.frombuffer(bit, np.int32)
    if sources and limit <= 0 and n_nodes * (int(places.max(initial=-1)) + 1) // 8 > room // 4:
        asked, answered = 4, _followed(src, dst, etype, process, again, dies, bit, end, size, False, window, limit, None)[2]
        while asked and (anew := told_anew(src, dst, passed := ~answered, places, room)) is not None:
            keep, lent, answered = _followed(src, dst, etype, process, again, dies, bit, end, size, True, window, limit, anew)
            if (passed != answered).all():
                return np.flatnonzero(keep), lent
            asked -= 1
    keep, lent, _ = _followed(src, dst, etype, process, again, dies, bit, end, size, sources, window, limit, None)
    return np.flatnonzero(keep), lent


def _followed(src: np.ndarray, dst: np.ndarray, etype: np.ndarray, process: int, again: np.ndarray, dies: np.ndarray, bit: array, end: Callable, size: Callable, sources: bool, window: int, limit: int, anew: np.ndarray | None) -> tuple[np.ndarray, dict, np.ndarray]:
    """Which edges stay, what is lent, and which edges are answered; anew tells of each edge whether it tells of new sources."""
    n, holds = len(src), sources and anew is None
    if not sources or anew is None:
        anew = np.ones(n, bool)
    known, entered, sent, first, place, targets, full, lent = {}, array("i", [-1]) * len(bit), {}, {}, {}, {}, set(), {}
    keep, answered, gone = np.zeros(n, bool), np.zeros(n, bool), ()
    for low in range(0, n, AT_ONCE):
        some = slice(low, low + AT_ONCE)
        for i, (u, v, kind, more_of, ended, news) in enumerate(zip(*(x[some].tolist() for x in (src, dst, etype, again, dies, anew))), low):
            for x in gone:
                known.pop(x, None)
                full.discard(x)
            gone = ((), (u,), (v,), (u, v))[ended]
            since = entered[u]
            remembered = more_of and sent.get((u, v), -1) > since
            if window > 0:  # the number of targets since then, and at which of them v was
                told_at, many = targets.get(u, (since, 0))
                many = many if told_at == since else 0
                seen = place.get((u, v), (since, -window))
                remembered = remembered and seen[0] == since and many - seen[1] <= window
            told = (1 << bit[u] if bit[u] >= 0 else known.get(u, 0)) if holds else 0
            if kind != process and u != v:
                if more_of and sent.get((v, u), -1) > entered[v]:
                    answered[i] = True
                    continue
                if remembered:
                    of = first.get((u, v, kind), -1)
                    if of > since:
                        had, more = lent[of][1] if of in lent else size(of), size(i)
                        lent[of] = (end(i), more if had is None else had if more is None else had + more)
                    continue
                if not news or (holds and u not in full and not told & ~known.get(v, 0)):
                    continue
                if more_of and first.get((u, v, kind), -1) <= since:
                    first[u, v, kind] = i
            keep[i] = True
            entered[v] = i
            if more_of:
                sent[u, v] = i
            if window > 0 and not remembered:
                targets[u] = (since, many + 1)
                if more_of:
                    place[u, v] = (since, many)
            if holds:
                held = known.get(v, 0)
                both = told | held
                if 0 < limit < both.bit_count():
                    full.add(v)
                    more = told & ~held
                    for _ in range(limit - held.bit_count()):
                        held |= more & -more
                        more &= more - 1
                    known[v] = held
                elif both != held:
                    known[v] = told if both == told else both  # nodes that know the same share one set
                if u in full:
                    full.add(v)
    return keep, lent, answered


def in_order(pdf: pd.DataFrame, sources: bool, window: int, limit: int, room: int = ROOM) -> pd.DataFrame:
    """The edges of one weak component that stay, see judged()."""
    rows = pdf.sort_values(["start_t", "end_t", "edge_id"])[COLUMNS].reset_index(drop=True)
    number, names = pd.factorize(pd.concat([rows["src"], rows["dst"]], ignore_index=True), sort=True)
    kind, kinds = pd.factorize(rows["etype"])
    end, size = rows["end_t"].tolist(), rows["size"].tolist()
    kept, lent = judged(number[: len(rows)], number[len(rows) :], kind, kinds.get_loc("PtoP") if "PtoP" in kinds else -1, np.zeros(len(rows), np.int32), end.__getitem__, size.__getitem__, sources, window, limit, room)
    for i, (till, total) in lent.items():
        end[i], size[i] = till, total
    return rows.assign(end_t=end, size=size).iloc[kept]


def _stay(batches: Iterator[pa.RecordBatch], sources: bool, window: int, limit: int) -> Iterator[pa.RecordBatch]:
    """edge_id, changed, end_t, size of the edges that stay; batches hold whole components, each in the order of its edges."""
    rows = pa.Table.from_batches(batches) if (batches := [b for b in batches if len(b)]) else None
    if rows is None:
        return
    ends, n = np.concatenate([rows[c].to_numpy() for c in ("s", "d")]), len(rows)
    own = np.zeros(int(ends.max()) + 1, bool)
    own[ends] = True
    ends = (np.cumsum(own, dtype=np.int32) - 1)[ends]  # the task's own nodes, numbered without gaps
    kind = rows["etype"].combine_chunks().dictionary_encode()
    process = pc.index(kind.dictionary, "PtoP").as_py()
    kept, lent = judged(ends[:n], ends[n:], pc.fill_null(kind.indices, -2).to_numpy(), process, rows["component"].to_numpy(), lambda i: rows["end_t"][i].as_py(), lambda i: rows["size"][i].as_py(), sources, window, limit)
    ids = rows["edge_id"].to_numpy()
    for low in range(0, len(kept), AT_ONCE):
        some = kept[low : low + AT_ONCE].tolist()
        end, size = ([lent[i][k] if i in lent else None for i in some] for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([i in lent for i in some]), pa.array(end, pa.int64()), pa.array(size, pa.int64())], ["edge_id", "changed", "end_t", "size"])


def preserving(edges: DataFrame, sources: bool = False, window: int = -1, limit: int = -1) -> DataFrame:
    """`fd`, and with sources `sd`. Only numbers go to the tasks that follow edges one by one; an edge without one of its ends stays."""
    if not sources and window <= 0:
        return full_dependence(edges)
    edges = (edges if held(edges) else stored(edges)).select(*COLUMNS)
    names = codes(nodes_of(edges).where("node IS NOT NULL"))
    told = stored(coded(edges, names).select("edge_id", "s", "d", "etype", "start_t", "end_t", "size"))
    parts = linked_numbers(told, names.count(), IN_PROCESS)
    placed = told.join(parts, "s").repartition("component").sortWithinPartitions("component", "start_t", "end_t", "edge_id").drop("start_t")
    run = lambda batches: _stay(batches, sources, window, limit)
    stay = placed.mapInArrow(run, "edge_id long, changed boolean, end_t long, size long").select("edge_id", "changed", F.col("end_t").alias("_end"), F.col("size").alias("_size"))
    out = edges.join(checkpoint(stay), "edge_id").withColumns({"end_t": F.when(F.col("changed"), F.col("_end")).otherwise(F.col("end_t")), "size": F.when(F.col("changed"), F.col("_size")).otherwise(F.col("size"))})
    return out.select(*COLUMNS).unionByName(edges.where("src IS NULL OR dst IS NULL"))
