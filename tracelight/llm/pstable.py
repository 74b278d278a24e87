"""Near-duplicate vectors by p-stable (Gaussian) hashing for the Euclidean distance.

Vectors are normalised, projected on random directions, shifted and cut into steps of a fixed width; a table's bucket is
the list of its projections' step numbers. Two unit vectors of cosine 0.98 lie 0.2 apart. With ten projections of width
1 and 32 tables such a pair shares a bucket with probability above 0.997, closer pairs with more.

Equal vectors of a label first collapse into one class. A bucket of n classes is cut into blocks of BLOCK; each pair of
blocks is one group, compared by a matrix product, so no task ever holds a whole hot bucket. Groups are packed by hash into
bins of about BIN rows, small groups compared together. A pair counts in the first table that both share, so no list of
pairs is shuffled: a bin returns link counts and at most one edge a member.

Defined results. Every row is a vector of its own; rows that share a vec_id may hold equal or different vectors, each is
linked by what it holds and counts as another vector to the others. component_id is the smallest vec_id of the rows that
links reach. Null or zero vectors, vectors with null or non-finite components, null labels: n_links 0, their own component.
Null vec_id: takes no part, component_id null, kept. Vectors of different lengths are never linked. Ties cannot matter:
components and counts are sets. Empty table: empty result. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import kit

TABLES, PROJECTIONS, WIDTH, BLOCK, COSINE = 32, 10, 1.0, 1024, 0.98
BIN, SMALL = 2_000, 64


def usable(column: str = "embedding") -> F.Column:
    """A vector without null or non-finite components."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(column).isNotNull() & F.coalesce(good, F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hasher(tables: int, projections: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        for batch in batches:
            vectors, label = batch.column("embedding"), np.asarray(batch.column("label"), np.int64)
            sizes = np.asarray(pa.compute.list_value_length(vectors))
            out = np.zeros((len(batch), tables), np.int32)
            for d in np.unique(sizes).tolist():
                if d not in drawn:
                    rng = np.random.default_rng([seed, d])
                    drawn[d] = rng.standard_normal((d, tables * projections)), rng.uniform(0, width, tables * projections)
                at = np.flatnonzero(sizes == d)
                x = _unit(np.asarray(vectors.take(pa.array(at)).flatten(), np.float64).reshape(len(at), d))
                steps = np.floor((x @ drawn[d][0] + drawn[d][1]) / width).astype(np.int64).astype(np.uint64).reshape(len(at), tables, projections)
                h = kit.mix((label[at].astype(np.uint64)[:, None] * np.uint64(1000003) + np.uint64(d)) + np.arange(tables, dtype=np.uint64))
                for p in range(projections):
                    h = kit.mix(h * np.uint64(0x9E3779B97F4A7C15) + steps[:, :, p])
                out[at] = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "n", "label", "embedding")), kit.list_column(out.ravel(), np.full(len(batch), tables), pa.int32())],
                ["node", "n", "label", "embedding", "buckets"],
            )

    return run


def _roots(n: int, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The smallest index that links (a, c) reach from each of n."""
    low = np.arange(n)
    while len(a):
        new = low.copy()
        least = np.minimum(low[a], low[c])
        np.minimum.at(new, a, least)
        np.minimum.at(new, c, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _pairs(x: np.ndarray, group: np.ndarray, block: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (rows are sorted by it) that reach the bound, some at a time; across blocks if i <> j."""
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(new, len(group)))
    few = (size <= SMALL) & (i[new] == j[new])
    place, rows = np.arange(len(group)) - np.repeat(new, size), np.repeat(np.where(few, size, 0), size)
    for k in range(1, int(size[few].max(initial=0))):  # all small groups at once: each row with the k-th after it
        a = np.flatnonzero(place + k < rows)
        hit = np.einsum("ij,ij->i", x[a], x[a + k]) >= cosine
        yield a[hit], a[hit] + k
    for lo, n in zip(new[~few].tolist(), size[~few].tolist()):
        at = np.arange(lo, lo + n)
        left, right = at[block[at] == i[lo]], at[block[at] == j[lo]]
        for s in range(0, len(left), 256):
            a, c = np.nonzero(x[left[s : s + 256]] @ x[right].T >= cosine)
            a, c = left[s + a], right[c]
            ok = (a < c) | (i[lo] != j[lo])
            yield a[ok], c[ok]


def _comparer(cosine: float):
    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.sort_values(["d", "group", "node"]).groupby("d"):
            x, b = _unit(np.stack(part["embedding"].to_numpy())), np.stack(part["buckets"].to_numpy())
            group, node, n, label, table = (part[c].to_numpy() for c in ("group", "node", "n", "label", "t"))
            links, found = np.zeros(len(part), np.int64), []
            for a, c in _pairs(x, group, part["block"].to_numpy(), part["i"].to_numpy(), part["j"].to_numpy(), cosine):
                # Only in the first table that both share; labels differ only where hashes of groups collide.
                ok = np.concatenate([((b[a[s : s + 65536]] == b[c[s : s + 65536]]).argmax(axis=1) == table[a[s : s + 65536]]) for s in range(0, len(a), 65536)] or [np.zeros(0, bool)])
                ok &= label[a] == label[c]
                a, c = a[ok], c[ok]
                np.add.at(links, a, n[c])
                np.add.at(links, c, n[a])
                low = _roots(len(part), a, c)  # a forest instead of all links
                found.append(np.flatnonzero(low != np.arange(len(part))))
                found.append(low[found[-1]])
            low = _roots(len(part), np.concatenate(found[::2] or [np.zeros(0, int)]), np.concatenate(found[1::2] or [np.zeros(0, int)]))
            hit = links > 0
            out.append(pd.DataFrame({"node": node[hit], "links": links[hit], "root": node[low][hit]}))
        return pd.concat(out)

    return run


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept, n_copies for each row of vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("embedding"), F.col("label").cast("long").alias("label"))
    whole = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)
    key = [F.when(F.coalesce(whole, F.lit(False)), h("label", "embedding")) for h in (F.xxhash64, F.hash)]
    rows = rows.withColumns({"h1": key[0], "h2": key[1]})
    good = rows.where("h1 is not null")
    found = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    # Written once with its number, a class keeps it whatever is computed anew later.
    classes = kit.checkpoint(found.withColumn("node", F.monotonically_increasing_id()))
    hashed = kit.checkpoint(classes.select("node", "n", "label", "embedding").mapInArrow(_hasher(tables, projections, width, seed), "node long, n long, label long, embedding array<double>, buckets array<int>"))
    slots = kit.checkpoint(hashed.select("node", "label", F.size("embedding").alias("d"), F.posexplode("buckets").alias("t", "bucket")))
    bucket = ["t", "bucket", "label", "d"]
    full = slots.groupBy(*bucket).agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / block).cast("int")
    placed = kit.hot_join(slots, full, bucket, "members").select(*bucket, "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    # A member of block x meets block y in group (min, max).
    meet = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meet = kit.checkpoint(meet.select(F.xxhash64(*bucket, F.least("block", "other"), F.greatest("block", "other")).alias("group"), "t", "d", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    bins = max(1, -(-meet.count() // BIN))
    vectors_of = hashed.select("node", "n", "label", "embedding", "buckets")
    groups = meet.join(vectors_of, "node").withColumn("bin", F.pmod(F.xxhash64(F.lit("bin"), "group"), F.lit(bins)))
    told = kit.checkpoint(groups.groupBy("bin").applyInPandas(_comparer(cosine), "node long, links long, root long"))
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    roots = kit.checkpoint(kit.connected_components(told.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = classes.select("h1", "h2", "node", "id", "n").join(links, "node", "left").join(roots, "node", "left").select("h1", "h2", "id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    rooted = kit.checkpoint(rooted)
    named = rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("held"))
    per = kit.hot_join(rooted, named, "root", "held").select("h1", "h2", "n", "links", "component_id")
    out = kit.hot_join(good.select("vec_id", "h1", "h2"), per, ["h1", "h2"], "n").select("vec_id", "n", "links", "component_id")
    apart = rows.where("h1 is null").select("vec_id", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(apart).select(
        "vec_id",
        (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        F.col("n").cast("long").alias("n_copies"),
    )
