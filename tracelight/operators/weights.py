"""Edge weights from time, amount and structure, and their combination.

Sums over the edges of a source are aggregated first and joined back, so that a source with many edges is no single task.
Two-means clustering is one algorithm at every size: rounds of one aggregate a partition until labels stand. Rows lie in
blocks of near ones, so that a round looks only at the rows of blocks that both centres share.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight import graph
from tracelight.plans.fixpoint import checkpoint, hashed, held, released, stored

FEATURES = ("w_time", "w_amount", "w_struct")


def time_weight(end: Column, poi_time: int) -> Column:
    gap = F.abs(end - F.lit(poi_time)) / F.lit(float(graph.SECOND))
    return F.log(1 + F.when(gap == 0, F.lit(1e10)).otherwise(1 / F.when(gap != 0, gap)))


def amount_weight(size: Column, detection: float) -> Column:
    return 1 / (F.abs(size - F.lit(float(detection))) + F.lit(1e-4))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out; a self-loop counts on both sides."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def raw_features(edges: DataFrame, poi_time: int, detection: float, seeds: list[str], n_edges: int | None = None, busy: bool = False) -> DataFrame:
    """edges with w_time, w_amount, w_struct before normalisation; with busy also _busy, whether several edges enter the target."""
    n = n_edges if n_edges is not None else edges.count()
    d = degrees(edges).select(F.col("node").alias("dst"), "n_in", "n_out")
    struct = F.when(F.col("dst").isin(seeds), F.lit(float(n))).otherwise(F.col("n_out") / F.col("n_in"))
    return edges.join(hashed(d, n), "dst").withColumns({"w_time": time_weight(F.col("end_t"), poi_time), "w_amount": amount_weight(F.col("size"), detection), "w_struct": struct}).select(*edges.columns, *FEATURES, *([(F.col("n_in") > 1).alias("_busy")] if busy else []))


def with_sums(edges: DataFrame, columns: dict[str, Column], n_edges: int | None = None) -> DataFrame:
    """edges with sums over the edges of each one's source, under the names given.

    The sums are combined before the shuffle; a source with many edges skews the join only, which adaptive execution splits.
    """
    sums = edges.groupBy("src").agg(*[F.sum(c).alias(n) for n, c in columns.items()])
    return edges.join(sums if n_edges is None else hashed(sums, n_edges), "src").select(*edges.columns, *columns)


def _share(value: str, total: str, least: float = 0.0, otherwise: Column | None = None) -> Column:
    """A value divided by its source's total, where that is above least."""
    return F.when(F.col(total) > least, F.col(value) / F.when(F.col(total) != 0, F.col(total))).otherwise(F.col(value) if otherwise is None else otherwise)


def normalised(edges: DataFrame) -> DataFrame:
    edges = edges if held(edges) else stored(edges)
    x = with_sums(edges, {f"_{c}": F.col(c) for c in FEATURES}, edges.count())
    return x.select(*[_share(c, f"_{c}").alias(c) if c in FEATURES else c for c in edges.columns])


def standardised(edges: DataFrame) -> DataFrame:
    """(x - mean) / sample deviation over all edges; a constant feature becomes 0."""
    m = edges.agg(*[f(c).alias(f"{k}_{c}") for c in FEATURES for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = edges.crossJoin(F.broadcast(m))  # one row of six numbers
    return joined.withColumns({c: F.when(F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) < 1e-12, 0.0).otherwise((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in FEATURES}).select(*edges.columns)


def _mix(edges: DataFrame, seeds: list[str], shares: tuple, zero: tuple = (0.5, 0.5), factor: float = 0.99) -> DataFrame:
    """Convex mix of the normalised features, then shares of each source's total; sources without data leave amounts out."""
    edges = checkpoint(edges)
    x = with_sums(edges, {f"_{c}": F.col(c) for c in [*FEATURES, "size"]})
    x = x.withColumns({"w_time": _share("w_time", "_w_time"), "w_amount": _share("w_amount", "_w_amount"), "w_struct": _share("w_struct", "_w_struct", 1e-8, F.lit(1.0))})
    x = x.withColumn("w_struct", F.when(F.col("src").isin(seeds), F.lit(1.0)).otherwise(F.col("w_struct")))
    t, s, a = shares
    x = x.withColumn("_none", F.col("_size") < 1e-8)
    x = x.withColumn("_mixed", F.when(F.col("_none"), zero[0] * F.col("w_time") + zero[1] * F.col("w_struct")).otherwise(t * F.col("w_time") + s * F.col("w_struct") + a * F.col("w_amount")))
    x = with_sums(checkpoint(x.select(*edges.columns, "_none", "_mixed")), {"_total": F.col("_mixed")})
    share = F.col("_mixed") / F.when(F.col("_total") != 0, F.col("_total"))
    return x.select(*edges.columns, F.coalesce(F.when(F.col("_none"), share).otherwise(share * factor), F.lit(0.0)).alias("weight"))


def nonml(edges: DataFrame, poi_time: int, detection: float, seeds: list[str]) -> DataFrame:
    return _mix(raw_features(edges, poi_time, detection, seeds), seeds, (0.334, 0.333, 0.333))


def nonml_random(edges: DataFrame, poi_time: int, detection: float, seeds: list[str], seed: int = 1) -> DataFrame:
    """nonml with a random convex combination for each source, drawn from a hash so that reruns agree."""
    u = [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "src"), F.lit(1 << 30)) / float(1 << 30) + 1e-9 for i in range(3)]
    total = u[0] + u[1] + u[2]
    pair = u[0] + u[1]
    return _mix(raw_features(edges, poi_time, detection, seeds), seeds, (u[0] / total, u[1] / total, u[2] / total), (u[0] / pair, u[1] / pair))


def heuristic(edges: DataFrame) -> DataFrame:
    """The fallback mix of features that are already normalised."""
    mix = F.when(F.col("_size") < 1e-8, 0.5 * F.col("w_time") + 0.5 * F.col("w_struct")).otherwise(0.3333 * F.col("w_time") + 0.3333 * F.col("w_struct") + 0.3334 * F.col("w_amount"))
    return with_sums(edges, {"_size": F.col("size")}).select(*edges.columns, mix.alias("weight"))


def shared_out(scored: DataFrame, factor: float, n_edges: int | None = None) -> DataFrame:
    """Scores as shares of their source's total, times a factor; as they are where the total is nothing."""
    rest = [c for c in scored.columns if c != "score"]
    weight = F.when(F.col("_total") < 1e-8, F.col("score")).otherwise(F.col("score") / F.when(F.col("_total") != 0, F.col("_total")) * factor)
    return with_sums(scored, {"_total": F.col("score")}, n_edges).select(*rest, weight.alias("weight"))


def fanout(edges: DataFrame) -> DataFrame:
    """edge_id, fanout: 1 / out-degree of the source + 1e-6; 1e-6 for files that nothing enters."""
    d = degrees(edges).select(F.col("node").alias("src"), "n_in", "n_out")
    value = F.when((graph.kind("src") == "F") & (F.col("n_in") == 0), 1e-6).otherwise(1 / F.col("n_out") + 1e-6)
    return edges.join(d, "src").select("edge_id", value.alias("fanout"))


# --- clustering ----------------------------------------------------------------------------


def projection(n: tuple[int, int], mean: tuple[np.ndarray, np.ndarray], within: np.ndarray, seeded: tuple[bool, bool]) -> np.ndarray:
    """Fisher's direction from sizes, means and the within-group scatter, with its sign fixed."""
    gap = mean[0] - mean[1]
    candidates = [np.linalg.pinv(within) @ gap]
    if np.linalg.matrix_rank(within) < len(gap):
        candidates.insert(0, gap)
    scaled = [v / np.linalg.norm(v) for v in candidates if np.linalg.norm(v) > 0]
    if not scaled:
        return np.ones(len(gap)) / np.sqrt(len(gap))
    v = max(scaled, key=lambda c: float(c @ gap) ** 2)
    if (v <= 0).all():
        return -v
    if (v >= 0).all():
        return v
    if seeded[0] != seeded[1]:
        high = 0 if seeded[0] else 1
    elif n[0] != n[1]:
        high = 0 if n[0] < n[1] else 1
    else:
        return v
    return -v if mean[high] @ v < mean[1 - high] @ v else v


def directions(n: np.ndarray, mean: np.ndarray, within: np.ndarray, seeded: np.ndarray) -> np.ndarray:
    """projection() of many sources at once; the first axis is the source."""
    if not len(n):
        return np.zeros((0, 3))
    gap = mean[:, 0] - mean[:, 1]
    fisher = (np.linalg.pinv(within) @ gap[:, :, None])[:, :, 0]
    length = lambda v: np.linalg.norm(v, axis=1, keepdims=True)
    unit = lambda v: np.divide(v, length(v), out=np.zeros_like(v), where=length(v) > 0)
    along = lambda v: np.einsum("ij,ij->i", v, gap) ** 2
    g, f = unit(gap), unit(fisher)
    plain = (np.linalg.matrix_rank(within) < 3) & (length(gap)[:, 0] > 0) & ((along(g) >= along(f)) | (length(fisher)[:, 0] == 0))
    v = np.where(plain[:, None], g, f)
    v[length(v)[:, 0] == 0] = 1 / np.sqrt(3)
    differ = seeded[:, 0] != seeded[:, 1]
    high = np.where(differ, np.where(seeded[:, 0], 0, 1), np.where(n[:, 0] < n[:, 1], 0, 1))
    at = np.arange(len(n))
    side = lambda k: np.einsum("ij,ij->i", mean[at, k], v)
    turned = (differ | (n[:, 0] != n[:, 1])) & (side(high) < side(1 - high)) & ~(v >= 0).all(axis=1)
    return np.where((turned | (v <= 0).all(axis=1))[:, None], -v, v)


def _hash(ids: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each id (splitmix64), the same wherever the row lies."""
    z = ids.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return z ^ (z >> np.uint64(31))


def _race(ids: np.ndarray, salt: int) -> np.ndarray:
    """Exponential variates: the least of them over weights draws a row in proportion to its weight."""
    return -np.log((_hash(ids, salt).astype(np.float64) + 0.5) / 2.0**64)


def _least(race: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple | None:
    """(value, id, point) of the least value, the smallest id among equals; None without a finite one."""
    if not len(race) or not np.isfinite(race.min()):
        return None
    at = np.flatnonzero(race == race.min())
    i = at[ids[at].argmin()]
    return float(race[i]), int(ids[i]), x[i]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]


def _nearer(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label of each row, 0 where both centres are equally near, and its squared distance."""
    far = np.stack([_squares(x, c[0]), _squares(x, c[1])])
    return far.argmin(axis=0), far.min(axis=0)


def _firsts(x: np.ndarray, ids: np.ndarray, tries: int, seed: int) -> list:
    return [_least(_race(ids, seed * 1000 + 2 * t), x, ids) for t in range(tries)]


def _seconds(x: np.ndarray, ids: np.ndarray, firsts: list, seed: int) -> list:
    out = []
    for t, a in enumerate(firsts):
        d = _squares(x, a)
        race = np.divide(_race(ids, seed * 1000 + 2 * t + 1), d, out=np.full(len(d), np.inf), where=d > 0)
        out.append(_least(race, x, ids))
    return out


def _drawn(parts: list[list]) -> list:
    return [min(filter(None, p), key=lambda r: r[:2], default=None) for p in zip(*parts)]


def _round(x: np.ndarray, ids: np.ndarray, centres: dict) -> dict:
    """For each start the counts, sums, cost and a digest of the labels."""
    out, mark = {}, _hash(ids, 7)
    for t, c in centres.items():
        label, near = _nearer(x, c)
        sums = np.stack([x[label == k].sum(axis=0) for k in range(2)])
        out[t] = (np.bincount(label, minlength=2), sums, float(near.sum()), int(mark[label == 1].sum(dtype=np.uint64)))
    return out


def _summed(parts: list[dict]) -> dict:
    return {t: (sum(p[t][0] for p in parts), sum(p[t][1] for p in parts), sum(p[t][2] for p in parts), sum(p[t][3] for p in parts) % (1 << 64)) for t in parts[0]}


def _two_centres(ask: Callable, tries: int, seed: int) -> np.ndarray | None:
    """k-means++ with k = 2 until labels repeat, the best of several starts; ask(f, join, ...) joins f of each part of the rows.

    Draws depend on ids alone; between divisions into parts only the last bits of sums differ, so costs are compared loosely.
    """
    drawn = ask(_firsts, _drawn, tries, seed)
    if not drawn or drawn[0] is None:
        return None  # no rows
    firsts = [r[2] for r in drawn]
    seconds = ask(_seconds, _drawn, firsts, seed)
    live = {t: np.stack([a, r[2]]) for t, (a, r) in enumerate(zip(firsts, seconds)) if r is not None}
    seen, done = {t: set() for t in live}, {}
    while live:
        for t, (n, sums, cost, mark) in ask(_round, _summed, live).items():
            if mark in seen[t]:
                done[t] = (cost, live.pop(t))
                continue
            seen[t].add(mark)
            live[t] = np.stack([sums[k] / n[k] if n[k] else live[t][k] for k in range(2)])
    best = None
    for cost, c in (done[t] for t in sorted(done)):
        if best is None or cost < best[0] * (1 - 1e-9):
            best = (cost, c)
    return None if best is None else best[1]


def two_means(x: np.ndarray, ids: np.ndarray, tries: int = 20, seed: int = 1) -> np.ndarray:
    """Labels of the rows of one source, see two_means_of."""
    c = _two_centres(lambda f, join, *args: f(x, ids, *args), tries, seed)
    return np.zeros(len(x), int) if c is None else _nearer(x, c)[0]


#: Rows that are put into blocks together, and rows of a block.
CHUNK, BLOCK = 65_536, 128


def blocks_of(x: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """An order in which near rows form blocks, by halves of the widest side, and the first row of each block."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        at = open_.pop()
        if len(at) <= size:
            out.append(at)
            continue
        own, half = x[at], len(at) // 2
        part = np.argpartition(own[:, (own.max(axis=0) - own.min(axis=0)).argmax()], half)
        open_ += [at[part[half:]], at[part[:half]]]
    n = np.array([len(at) for at in out])
    return np.concatenate(out), np.cumsum(n) - n


def _boxes(x: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each block its least and greatest corner, mean, scatter and size; the digest of its ids."""
    n = np.diff(np.append(first, len(x)))
    mean = np.add.reduceat(x, first) / n[:, None]
    spread = np.add.reduceat(((x - np.repeat(mean, n, axis=0)) ** 2).sum(axis=1), first)
    return np.column_stack([np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), mean, spread, n]), np.add.reduceat(_hash(ids, 7), first)


def _block_round(x: np.ndarray, ids: np.ndarray, first: np.ndarray, box: np.ndarray, marks: np.ndarray, centres: dict) -> dict:
    """_round() by blocks: one that lies on one side of the plane between the centres, by more than rounding, counts as a whole."""
    low, high, mean, spread, n = box[:, :3], box[:, 3:6], box[:, 6:9], box[:, 9], box[:, 10].astype(np.int64)
    out = {}
    for t, c in centres.items():
        a, b = ((corner - (c[0] + c[1]) / 2) * (c[1] - c[0]) for corner in (low, high))
        slack = 1e-12 * sum((np.maximum(np.abs(low - k), np.abs(high - k)) ** 2).sum(axis=1) for k in c)
        sure = [np.maximum(a, b).sum(axis=1) < -slack, np.minimum(a, b).sum(axis=1) > slack]
        shared = np.flatnonzero(~(sure[0] | sure[1]))
        m = n[shared]
        rows = np.repeat(first[shared] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        own = x[rows]
        label, near = _nearer(own, c)
        count = np.bincount(label, minlength=2) + [n[s].sum() for s in sure]
        sums = np.stack([own[label == k].sum(axis=0) + n[s] @ mean[s] for k, s in enumerate(sure)])
        cost = near.sum() + sum((spread[s] + n[s] * _squares(mean[s], c[k])).sum() for k, s in enumerate(sure))
        mark = int(_hash(ids[rows[label == 1]], 7).sum(dtype=np.uint64)) + int(marks[sure[1]].sum(dtype=np.uint64))
        out[t] = (count, sums, float(cost), mark % (1 << 64))
    return out


_PACKED = (("x", np.float64), ("ids", np.int64), ("first", np.int64), ("box", np.float64), ("marks", np.uint64))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of edge_id and the features as chunks of blocks."""

    def chunk(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, *x = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in waiting]) for i in range(4))
        x = np.stack(x, axis=1).astype(float)
        order, first = blocks_of(x)
        x, ids = x[order], ids[order]
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (x, ids, first, *_boxes(x, ids, first))], [c for c, _ in _PACKED])

    waiting, n = [], 0
    for b in batches:
        if len(b):
            waiting.append(b)
            n += len(b)
        if n >= CHUNK:
            yield chunk(waiting)
            waiting, n = [], 0
    if n:
        yield chunk(waiting)


def two_means_of(rows: DataFrame, tries: int = 20, seed: int = 1, cheap: bool = False) -> DataFrame:
    """rows (edge_id and the features) with column _k, the label: rounds of one aggregate a partition.

    cheap: rows are columns of what is stored, so that they are read again rather than stored once more.
    """
    kept = rows if cheap or held(rows) else stored(rows)
    packed = checkpoint(kept.select("edge_id", *FEATURES).mapInArrow(_packed, ", ".join(f"{c} binary" for c, _ in _PACKED)))

    def ask(f: Callable, join: Callable, *args):
        by_blocks = f is _round

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = None
            for batch in batches:
                for values in zip(*batch.columns):
                    x, ids, *blocks = (np.frombuffer(v.as_buffer(), kind) for v, (_, kind) in zip(values, _PACKED))
                    x = x.reshape(-1, 3)
                    told = _block_round(x, ids, blocks[0], blocks[1].reshape(-1, 11), blocks[2], *args) if by_blocks else f(x, ids, *args)
                    parts = told if parts is None else join([parts, told])
            if parts is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], ["told"])

        parts = [pickle.loads(r[0]) for r in packed.mapInArrow(run, "told binary").collect()]  # a row of some hundred numbers a partition
        return join(parts) if parts else None

    c = _two_centres(ask, tries, seed)
    if c is None:
        return kept.withColumn("_k", F.lit(0))
    far = []
    for k in range(2):  # as _squares() has them
        gap = [F.col(name) - F.lit(float(v)) for name, v in zip(FEATURES, c[k])]
        far.append(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
    return kept.withColumn("_k", F.when(far[1] < far[0], 1).otherwise(0))


def rescale(values: np.ndarray) -> np.ndarray:
    """(x - min + offset) / (max - min); the offset is a hundredth of the step from the least to the second value."""
    u = np.unique(values)
    if len(u) < 2 or u[-1] - u[0] < 1e-12:
        return np.ones(len(values))
    return (values - u[0] + (u[1] - u[0]) / 100) / (u[-1] - u[0])


def rescaled(scored: DataFrame) -> DataFrame:
    """rescale() of column score over all rows."""
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    second = None if low is None else scored.where(F.col("score") > F.lit(low)).agg(F.min("score")).first()[0]
    if second is None or high - low < 1e-12:
        return scored.withColumn("score", F.lit(1.0))
    return scored.withColumn("score", (F.col("score") - low + (second - low) / 100) / (high - low))


def _clustered(every: DataFrame, chosen: DataFrame, seeds: list[str], tries: int) -> DataFrame:
    """every with column score: chosen edges (both stored) are clustered, all are projected and rescaled; 3 x 3 algebra on the driver.

    Without two groups the heuristic mix is rescaled instead.
    """
    names = list(FEATURES)
    told = two_means_of(chosen.select("edge_id", "src", *[F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0)).alias(c) for c in names]), tries, cheap=True)
    moments = told.groupBy("_k").agg(F.count("*").alias("n"), F.max(F.col("src").isin(seeds)).alias("seeded"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).collect()
    if len(moments) < 2:
        return rescaled(checkpoint(heuristic(every).withColumnRenamed("weight", "score")))
    a, b = sorted(moments, key=lambda r: r["_k"])
    means = tuple(np.array([r[f"m{i}"] for i in range(3)]) for r in (a, b))
    center = [F.when(F.col("_k") == a["_k"], F.lit(float(means[0][i]))).otherwise(F.lit(float(means[1][i]))) for i in range(3)]
    cells = [(i, j) for i in range(3) for j in range(i, 3)]
    s = told.agg(*[F.sum((F.col(names[i]) - center[i]) * (F.col(names[j]) - center[j])).alias(f"s{i}{j}") for i, j in cells]).first()
    within = np.zeros((3, 3))
    for i, j in cells:
        within[i, j] = within[j, i] = s[f"s{i}{j}"]
    v = projection((a["n"], b["n"]), means, within, (a["seeded"], b["seeded"]))
    score = sum(F.coalesce(F.col(c), F.lit(0.0)) * float(v[i]) for i, c in enumerate(names))
    return rescaled(every.withColumn("score", score))


def cluster_all(edges: DataFrame, poi_time: int, detection: float, seeds: list[str], tries: int = 20, only_busy: bool = False, factor: float = 0.99) -> DataFrame:
    """`clusterall`; with only_busy `nonoutlier`, which clusters only edges whose target has several in-edges."""
    raw = stored(raw_features(edges, poi_time, detection, seeds, busy=only_busy))
    x = stored(normalised(raw).withColumn("w_struct", F.when(F.col("dst").isin(seeds), 1.0).otherwise(F.col("w_struct"))))
    released(raw)
    every, chosen = (x.drop("_busy"), x.where("_busy")) if only_busy else (x, x)
    return shared_out(_clustered(every, chosen, seeds, tries), factor, x.count())


def individual(edges: DataFrame, poi_time: int, detection: float, seeds: list[str], tries: int = 20) -> DataFrame:
    """`localtime`, `localamount`, `localstruct`: the structure feature is 0 but into seeds, then as cluster_all without 0.99."""
    x = normalised(raw_features(edges, poi_time, detection, seeds))
    x = stored(x.withColumn("w_struct", F.when(F.col("dst").isin(seeds), 1.0).otherwise(0.0)))
    return shared_out(_clustered(x, x, seeds, tries), 1.0, x.count())


def local_kernel(pdf: pd.DataFrame, seeds: frozenset, tries: int) -> pd.DataFrame:
    x = pdf[list(FEATURES)].fillna(0.0).to_numpy()
    if len(pdf) == 1:
        return pdf.assign(weight=0.99)  # all of its source's share
    label = two_means(x, pdf["edge_id"].to_numpy(), tries)
    if len(np.unique(label)) < 2:
        t, a, s = x.T
        score = 0.5 * t + 0.5 * s if pdf["size"].sum() < 1e-8 else 0.3333 * t + 0.3333 * s + 0.3334 * a
    else:
        groups = [x[label == k] for k in range(2)]
        means = tuple(g.mean(axis=0) for g in groups)
        within = sum((g - m).T @ (g - m) for g, m in zip(groups, means))
        seeded = tuple(bool(pdf["src"][label == k].isin(seeds).any()) for k in range(2))
        score = rescale(x @ projection((len(groups[0]), len(groups[1])), means, within, seeded))
    total = score.sum()
    return pdf.assign(weight=score if total < 1e-8 else score / total * 0.99)


def _of_runs(first: np.ndarray, race: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each run of rows (their first rows are given) the row of the least value, the smallest id among equals; -1 without a finite one."""
    low = np.minimum.reduceat(race, first)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(race))))
    at = np.flatnonzero((race == low[of]) & np.isfinite(race))
    at = at[np.lexsort((ids[at], of[at]))]
    out = np.full(len(first), -1)
    runs, where = np.unique(of[at], return_index=True)
    out[runs] = at[where]
    return out


def two_means_of_runs(x: np.ndarray, ids: np.ndarray, first: np.ndarray, tries: int = 20, seed: int = 1) -> np.ndarray:
    """two_means() of each run of rows by itself, all runs at once: one start after the other, live runs only."""
    n = np.diff(np.append(first, len(x)))
    best, chosen = np.full(len(first), np.inf), np.zeros((len(first), 2, 3))
    mark = _hash(ids, 7)
    for t in range(tries):
        one = _of_runs(first, _race(ids, seed * 1000 + 2 * t), ids)
        gap = x - np.repeat(x[one], n, axis=0)
        d = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]
        race = np.divide(_race(ids, seed * 1000 + 2 * t + 1), d, out=np.full(len(d), np.inf), where=d > 0)
        two = _of_runs(first, race, ids)
        live = np.flatnonzero(two >= 0)
        c = np.stack([x[one[live]], x[two[live]]], axis=1)
        seen: list[np.ndarray] = []
        while len(live):
            m = n[live]
            start = np.cumsum(m) - m
            rows = np.repeat(first[live] - start, m) + np.arange(m.sum())
            own, of = x[rows], np.repeat(np.arange(len(live)), m)
            far = [((own - c[of, k]) ** 2) for k in range(2)]
            far = np.stack([f[:, 0] + f[:, 1] + f[:, 2] for f in far])
            label, near = far.argmin(axis=0), far.min(axis=0)
            now = np.add.reduceat(np.where(label == 1, mark[rows], np.uint64(0)), start)
            stands = np.zeros(len(live), bool)
            for s in seen:
                stands |= s == now
            cost = np.add.reduceat(near, start)
            better = stands & (cost < best[live] * (1 - 1e-9))
            best[live[better]], chosen[live[better]] = cost[better], c[better]
            ones = np.add.reduceat(label, start)
            for k, count in enumerate((m - ones, ones)):
                sums = np.add.reduceat(np.where((label == k)[:, None], own, 0.0), start)
                some = count > 0
                c[some, k] = sums[some] / count[some, None]
            seen = [s[~stands] for s in [*seen, now]]
            live, c = live[~stands], c[~stands]
    far = np.stack([((x - np.repeat(chosen[:, k], n, axis=0)) ** 2) @ np.ones(3) for k in range(2)])
    return np.where(np.repeat(np.isfinite(best), n), far.argmin(axis=0), 0)


#: Rows of sources that local_weights() clusters at once.
AT_ONCE = 200_000


def local_weights(pdf: pd.DataFrame, seeds: frozenset, tries: int) -> pd.DataFrame:
    """local_kernel() of each source of rows that are sorted by source."""
    first = np.flatnonzero(np.append(True, pdf["src"].to_numpy()[1:] != pdf["src"].to_numpy()[:-1]))
    x, n = pdf[list(FEATURES)].fillna(0.0).to_numpy(float), np.diff(np.append(first, len(pdf)))
    label = two_means_of_runs(x, pdf["edge_id"].to_numpy(), first, tries)
    total = lambda v: np.add.reduceat(v, first)
    each, ones = lambda v: np.repeat(v, n, axis=0), total(label)
    t, a, s = x.T
    mixed = np.where(each(total(pdf["size"].to_numpy()) < 1e-8), 0.5 * t + 0.5 * s, 0.3333 * t + 0.3333 * s + 0.3334 * a)
    two = np.flatnonzero((ones > 0) & (ones < n))
    means, within = np.empty((len(two), 2, 3)), np.empty((len(two), 3, 3))
    for i, (at, m) in enumerate(zip(first[two].tolist(), n[two].tolist())):
        own, high = x[at : at + m], label[at : at + m] == 1
        groups = (own[~high], own[high])
        means[i] = [g.sum(axis=0) / len(g) for g in groups]
        within[i] = sum((g - mean).T @ (g - mean) for g, mean in zip(groups, means[i]))
    seeded = pdf["src"].isin(seeds).to_numpy()
    of_seed = np.stack([total(seeded & (label == k)) > 0 for k in range(2)], axis=1)[two]
    v = np.zeros((len(first), 3))
    v[two] = directions(np.stack([n - ones, ones], axis=1)[two], means, within, of_seed)
    value = np.einsum("ij,ij->i", x, each(v)) if len(two) else np.zeros(len(x))
    low, top = np.minimum.reduceat(value, first), np.maximum.reduceat(value, first)
    second = np.minimum.reduceat(np.where(value > each(low), value, np.inf), first)
    flat = (top - low < 1e-12) | ~np.isfinite(second)
    step, width = np.where(flat, 0.0, second - low) / 100, np.where(flat, 1.0, top - low)
    scaled = np.where(each(flat), 1.0, (value - each(low) + each(step)) / each(width))
    score = np.where(each((ones > 0) & (ones < n)), scaled, mixed)
    of = each(total(score))
    score = np.where(each(n == 1), 0.99, np.where(of < 1e-8, score, score / np.where(of < 1e-8, 1.0, of) * 0.99))
    return pdf.assign(weight=score)


def cluster_local(edges: DataFrame, poi_time: int, detection: float, seeds: list[str], tries: int = 20) -> DataFrame:
    """`clusterlocal`: the same, with the edges of each source by themselves: a source is in one task, which takes many sources at once."""
    x = normalised(raw_features(edges, poi_time, detection, seeds))
    x = x.withColumn("w_struct", F.when(F.col("dst").isin(seeds), 1.0).otherwise(F.col("w_struct"))).select("edge_id", "src", "dst", "etype", "event", "start_t", "end_t", "size", *FEATURES)
    schema = "edge_id long, src string, dst string, etype string, event string, start_t long, end_t long, size long, w_time double, w_amount double, w_struct double, weight double"
    held = frozenset(seeds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, rows = [], 0
        for pdf in batches:
            waiting.append(pdf)
            rows += len(pdf)
            if rows >= AT_ONCE:
                every = pd.concat(waiting, ignore_index=True)
                whole = every["src"] != every["src"].iloc[-1]  # the last source can go on in the next batch
                if whole.any():
                    yield local_weights(every[whole], held, tries)
                waiting = [every[~whole]]
                rows = len(waiting[0])
        if rows:
            yield local_weights(pd.concat(waiting, ignore_index=True), held, tries)

    return x.repartition("src").sortWithinPartitions("src").mapInPandas(run, schema)


def weighted(edges: DataFrame, mode: str, poi_time: int, detection: float, seeds: list[str]) -> DataFrame:
    if mode == "nonml":
        return nonml(edges, poi_time, detection, seeds)
    if mode == "nonmlrandom":
        return nonml_random(edges, poi_time, detection, seeds)
    if mode in ("clusterall", "nonoutlier"):
        return cluster_all(edges, poi_time, detection, seeds, only_busy=mode == "nonoutlier")
    if mode in ("clusterlocal", "clusterlocal_dec"):
        return cluster_local(edges, poi_time, detection, seeds)
    if mode in ("localtime", "localamount", "localstruct"):
        return individual(edges, poi_time, detection, seeds)
    if mode == "fanout":
        return edges.join(fanout(edges).withColumnRenamed("fanout", "weight"), "edge_id")
    if mode in ("nodoze", "read_only"):
        return edges.withColumn("weight", F.lit(0.0))
    raise ValueError(f"unknown weight mode {mode!r}")
