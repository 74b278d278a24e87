"""Exact top-k inner products by a pivot-distance index.

Index: every distinct vector is keyed by its nearest pivot and its distance to it; a pivot's distances are cut into annuli
at quantiles of all its vectors. A cell (pivot, annulus) keeps its least and greatest distance to every pivot, its greatest
squared norm and its number of vectors. From |q - x| >= | |q - p| - |x - p| | for each pivot p and
2<q, x> = |q|^2 + |x|^2 - |q - x|^2 follows an upper bound of a query's scores in a cell.

Neighbouring annuli of a pivot are packed into slots of about BLOCK vectors; a larger cell is several blocks of a slot. A
query is sent once to each block of a slot in which it has a cell to visit.

Search: a query visits its cells in the order of their bounds. First come just enough to hold k vectors; they give a score
the k-th result has at least. Then come the remaining cells whose bound reaches that score - annuli around the query's own
distance, outwards - and the search stops there: no other cell can hold a result, so the results are exact. visited() tells
the share of the index that this reads.

The queries that visit a block are cut into blocks of QUERY_BLOCK, so that a hot slot is many groups. Equal vectors are one
entry with their k + 1 smallest ids, which suffices for any query. Scores are exact: by double products while they stay
below 2^53, else by 64-bit integers.

Bounds: PIVOTS pivots (those vectors with the smallest hashes) and the PIVOTS distances of PIVOTS x ANNULI cells are on the
driver, at any size of the table; all vectors are indexed.

Defined results. Vectors that are null or hold null or non-finite components take no part, nor do null vec_ids; a query
that takes no part has no rows. Fewer rows than k: all. Equal scores: the smaller vec_id first. Vectors of different lengths
are not compared. Empty vectors score 0. Rows sharing a vec_id: those of equal vectors are one; different vectors are queries and
candidates each, of equal scores for a query one counts; a query has no candidate of its own id. Empty table: empty result. Only vec_id and embedding are read, so other columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm import kit
from tracelight.llm.pstable import usable

PIVOTS, ANNULI, BLOCK, QUERY_BLOCK, SCALE = 64, 16, 4096, 1024, 1024


def _matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.Array):
        return np.asarray(column.flatten(), np.int64).reshape(len(column), d)
    return np.stack(column.to_numpy()).astype(np.int64).reshape(len(column), d)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q with all rows of x."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = x.astype(np.float64), pivots.astype(np.float64)
    out = np.empty((len(a), len(b)))
    for j in range(len(b)):
        out[:, j] = np.sqrt(((a - b[j]) ** 2).sum(axis=1))
    return out


def _assigner(pivots: np.ndarray):
    d = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), d)
            far = _distances(x, pivots)
            near = far.argmin(axis=1)
            r = far[np.arange(len(x)), near]
            norm = (x.astype(np.float64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(r), pa.array(norm)], [*batch.schema.names, "pivot", "r", "norm"])

    return run


def _ranger(pivots: np.ndarray):
    """cell, to, least, most: the least and greatest distance of a cell's vectors to each pivot, over one partition."""
    d = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = most = None
        for batch in batches:
            far, cell = _distances(_matrix(batch.column("v"), d), pivots), np.asarray(batch.column("cell"))
            if least is None:
                least, most = (np.full((len(pivots) * ANNULI, len(pivots)), x) for x in (np.inf, -np.inf))
            np.minimum.at(least, cell, far)
            np.maximum.at(most, cell, far)
        if least is not None:
            cell, to = np.nonzero(np.isfinite(least))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(to, pa.int32()), pa.array(least[cell, to]), pa.array(most[cell, to])], ["cell", "to", "least", "most"])

    return run


def bounds(q: np.ndarray, pivots: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
    """Upper bounds of the scores of each query in each cell; a little slack covers rounding of the distances.

    cells: least and most (cell, pivot), norm (cell).
    """
    far = _distances(q, pivots)
    gap = np.zeros((len(q), len(cells["norm"])))
    for p in range(len(pivots)):
        np.maximum(gap, far[:, p, None] - cells["most"][None, :, p], out=gap)
        np.maximum(gap, cells["least"][None, :, p] - far[:, p, None], out=gap)
    norm = (q.astype(np.float64) ** 2).sum(axis=1)[:, None]
    top = (norm + cells["norm"] - gap**2) / 2
    return top + 1e-9 * (norm + cells["norm"]) + 1e-6


def _visits(q: np.ndarray, bar: np.ndarray | None, pivots: np.ndarray, cells: dict[str, np.ndarray], need: int) -> np.ndarray:
    """Which cells each query visits: first just enough for `need` vectors, then (with a bar) the others that reach it."""
    top = bounds(q, pivots, cells)
    order = np.argsort(-top, axis=1, kind="stable")
    held = np.cumsum(cells["n"][order], axis=1)
    early = np.zeros(top.shape, bool)
    np.put_along_axis(early, order, held - cells["n"][order] < need, axis=1)
    return early if bar is None else ~early & (top >= bar[:, None])


def _visitor(pivots: np.ndarray, cells: dict[str, np.ndarray], need: int, first: bool):
    """Queries -> the blocks of the slots they visit, first round or second (which has the column bar).

    In the second round a slot that was read in the first is read again where another of its cells is to be visited.
    """
    d, names = pivots.shape[1], ["slot", "part", "q", "v"]
    slots, blocks = int(cells["slot"].max()) + 1, np.zeros(int(cells["slot"].max()) + 1, np.int64)
    np.maximum.at(blocks, cells["slot"], cells["blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                visit = _visits(_matrix(part.column("v"), d), None if first else np.asarray(part.column("bar"), np.float64), pivots, cells, need)
                row, cell = np.nonzero(visit)
                seen = np.unique(row * slots + cells["slot"][cell])
                row, slot = seen // slots, seen % slots
                times = blocks[slot]
                row, slot, block = np.repeat(row, times), np.repeat(slot, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(block, pa.int32()), part.column("q").take(take), part.column("v").take(take)], names)

    return run


def _prober(d: int, k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(vectors):
            x = _matrix(vectors["v"], d)
            ids = vectors["ids"].to_numpy()
            for lo in range(0, len(queries), 256):
                part = queries.iloc[lo : lo + 256]
                s = scores(_matrix(part["v"], d), x)
                for row, q in zip(s, part["q"].to_numpy()):
                    few = np.arange(len(row))
                    if len(row) > k:
                        bar = np.partition(row, len(row) - k)[len(row) - k]
                        few = np.flatnonzero(row >= bar)  # ties at the bar all go on
                    best = sorted((-int(row[i]), int(v)) for i in few for v in ids[i])[:k]
                    out += [(q, v, -s_) for s_, v in best]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"]).astype({"q": "int64", "vec_id": "int64", "score": "int64"})

    return run


def _ranked(found: DataFrame, k: int, by: str = "q") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _probe(index: DataFrame, visits: DataFrame, d: int, k: int) -> DataFrame:
    cuts = F.greatest(F.lit(1), F.ceil(F.col("visits") / QUERY_BLOCK)).cast("int")
    sizes = visits.groupBy("slot", "part").agg(F.count("*").alias("visits"))
    keys = ["slot", "part", "cut"]
    left = kit.hot_join(visits, sizes, ["slot", "part"], "visits").select("slot", "part", F.pmod(F.xxhash64("q"), cuts).cast("int").alias("cut"), "q", "v")
    right = index.join(sizes, ["slot", "part"]).select("slot", "part", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut"), "v", "ids")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_prober(d, k), "q long, vec_id long, score long")


def _slots(pivot: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of cells in order: their slot, and the number of blocks of a cell that has a slot to itself."""
    slot, blocks, held = np.zeros(len(n), np.int64), np.maximum(1, -(-n // BLOCK)), 0
    for c in range(1, len(n)):
        held += n[c - 1]
        fresh = pivot[c] != pivot[c - 1] or held + n[c] > BLOCK
        slot[c], held = slot[c - 1] + fresh, 0 if fresh else held
    return slot, blocks


def _indexed(classes: DataFrame, d: int, pivots: int) -> tuple[DataFrame, np.ndarray, dict[str, np.ndarray]] | None:
    """The vectors with their cells, the pivots and the cells; None without vectors."""
    drawn = kit.fewest(classes.select("v", "q"), classes.count(), F.xxhash64("v"), pivots, "q")
    if not drawn:
        return None
    points = np.array([r["v"] for r in drawn], np.int64).reshape(len(drawn), d)
    held = kit.checkpoint(classes.select("q", "ids", "asked", "v").mapInArrow(_assigner(points), "q long, ids array<long>, asked boolean, v array<long>, pivot int, r double, norm double"))
    quantiles = F.percentile_approx("r", F.array(*[F.lit(i / ANNULI) for i in range(1, ANNULI)]), F.lit(1000))
    edges = held.groupBy("pivot").agg(quantiles.alias("edges"))  # one row a pivot
    cell = (F.col("pivot") * ANNULI + F.size(F.filter("edges", lambda e: e < F.col("r")))).cast("int")
    placed = kit.checkpoint(held.join(F.broadcast(edges), "pivot").select("q", "ids", "asked", "v", "pivot", "norm", cell.alias("cell")))
    stats = placed.groupBy("cell", "pivot").agg(F.max("norm").alias("norm"), F.count("*").alias("n")).orderBy("cell").collect()  # at most PIVOTS x ANNULI rows
    ranges = placed.select("cell", "v").mapInArrow(_ranger(points), "cell int, to int, least double, most double").groupBy("cell", "to").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()
    cells = {c: np.array([r[c] for r in stats]) for c in ("cell", "pivot", "norm", "n")}
    at = {c: i for i, c in enumerate(cells["cell"].tolist())}
    cells["least"], cells["most"] = (np.zeros((len(stats), len(points))) for _ in range(2))
    for r in ranges:
        cells["least"][at[r["cell"]], r["to"]], cells["most"][at[r["cell"]], r["to"]] = r["least"], r["most"]
    cells["slot"], cells["blocks"] = _slots(cells["pivot"], cells["n"])
    return placed, points, cells


def _search(classes: DataFrame, d: int, k: int, pivots: int) -> DataFrame | None:
    """q (class), vec_id, score, rank: the k + 1 best of each query class, its own ids included."""
    need, built = k + 1, _indexed(classes, d, pivots)
    if built is None:
        return None
    placed, points, cells = built
    where = F.create_map(*[F.lit(int(x)) for c, s, n in zip(cells["cell"], cells["slot"], cells["blocks"]) for x in (c, s * (1 << 20) + n)]).cast("map<int,bigint>")
    index = placed.withColumn("at", F.element_at(where, F.col("cell")))
    part = F.pmod(F.xxhash64("q"), F.col("at") % (1 << 20)).cast("int")
    index = kit.checkpoint(index.select(F.floor(F.col("at") / (1 << 20)).cast("int").alias("slot"), part.alias("part"), "v", "ids"))
    queries = placed.where("asked").select("q", "v")
    kind = "slot int, part int, q long, v array<long>"
    early = kit.checkpoint(queries.mapInArrow(_visitor(points, cells, need, True), kind))
    early = kit.checkpoint(_ranked(_probe(index, early, d, need), need))
    bars = early.groupBy("q").agg(F.when(F.count("*") >= need, F.min("score").cast("double")).alias("bar"))
    left = queries.join(bars, "q", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    late = kit.checkpoint(left.mapInArrow(_visitor(points, cells, need, False), kind))
    late = _probe(index, late, d, need)
    # A vector that both rounds read is one result.
    return _ranked(early.select("q", "vec_id", "score").unionAll(late).distinct(), need)


def visited(vectors: np.ndarray, queries: np.ndarray, pivots: np.ndarray, cells: dict[str, np.ndarray], k: int = 10) -> float:
    """Share of all (query, vector) pairs that lie in visited cells, given the exact k-th scores."""
    s = scores(queries, vectors)
    bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    reach = _visits(queries, None, pivots, cells, k + 1) | _visits(queries, bar, pivots, cells, k + 1)
    return float((reach @ cells["n"]).sum() / (len(queries) * cells["n"].sum()))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k best other rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable() & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * SCALE).cast("long")).alias("v"), (F.col("vec_id") % every == 0).alias("asked")).distinct()
    # Equal vectors are one class: its k + 1 smallest ids; Spark limits each group before the shuffle.
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.select("v", "vec_id").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    classes = few.groupBy("v").agg(F.min("vec_id").alias("q"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where("asked").select("v").distinct().withColumn("asked", F.lit(True))
    classes = kit.checkpoint(classes.join(asked, "v", "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    out = None
    for r in classes.select(F.size("v").alias("d")).distinct().orderBy("d").collect():  # the lengths of vectors
        one = _search(classes.where(F.size("v") == r["d"]), r["d"], k, pivots)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).limit(0)
    # From classes back to query rows.
    best = out.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("x")))).alias("best"))
    of = rows.where("asked").join(classes.where("asked").select("v", "q"), "v").select(F.col("vec_id").alias("query_id"), "q")
    mine = of.join(best, "q").select("query_id", F.slice(F.filter("best", lambda b: b["x"] != F.col("query_id")), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.x").alias("vec_id"), (-F.col("b.s")).alias("score"))
