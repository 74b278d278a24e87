"""Near-duplicate documents by BagMinHash signatures of word-shingle multisets.

Signature: every distinct shingle owns, for each dyadic block of its multiplicity axis ([0, 1), [1, 2), [2, 4), ...),
a Poisson process whose points carry a time, a signature component and a level within the block. Points whose level lies
under the shingle's multiplicity count; the earliest point of each component is the signature. Processes of blocks that
start above the multiplicity are never opened and a process stops at the horizon beyond which all components are filled,
so a text costs about m ln m points, however long it is. The blocks of an axis are independent processes side by side
rather than a tree whose nodes split their points; their superposition is the same process. Two signatures agree in a component with probability equal to
the weighted Jaccard similarity of the multisets.

Then: texts with equal word sequences collapse into classes; signature bands bucket the classes; each bucket's members
are verified against one pivot (a star, linear in the bucket), then those that are not in its component against the rest
of the bucket, in blocks of BLOCK by BLOCK that are compared in memory, so that no list of pairs is made. Links inside a
component cannot change it, so none that matters is lost.

Defined results. Null or wordless text: no class, linked with nothing, kept. Fewer words than a shingle: all words are the
one shingle. Null doc_id: takes no part, kept. Rows sharing a doc_id are linked by their texts like any others. Repeated rows: one class. Empty table:
empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import kit

BANDS, ROWS, WORDS, SIMILARITY, BLOCK = 25, 5, 5, 0.8, 512


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The shingle hashes of one text with repetitions; a shorter text has one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return kit.grams(hashes, min(k, len(hashes)), salt=min(k, len(hashes)))


def signatures(text_of: np.ndarray, element: np.ndarray, weight: np.ndarray, total: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """m signature values for each text; (text_of, element, weight) are its distinct shingles, total its summed weights."""
    n = len(total)
    best, out = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    stop = (np.log(m) + 4.0) / np.maximum(total, 1)
    todo = np.ones(n, bool)
    while todo.any():
        use = todo[text_of]
        text, el, w = text_of[use], element[use], weight[use]
        block = 0
        while len(el):
            width = 1 if block == 0 else 1 << (block - 1)
            base = 0 if block == 0 else width
            state = kit.mix(el ^ kit.mix(np.full(1, block * 1000003 + seed, np.uint64)))
            live, time = np.arange(len(el)), np.zeros(len(el))
            while len(live):
                state = kit.mix(state + np.uint64(0x9E3779B97F4A7C15))
                time = time - np.log(kit.unit(state)) / (m * width)
                on = time < stop[text[live]]
                live, time, state = live[on], time[on], state[on]
                draw = kit.mix(state ^ np.uint64(0xD1B54A32D192ED03))
                ok = base + (draw >> np.uint64(32)).astype(np.int64) % width < w[live]
                at = text[live[ok]] * m + ((draw[ok] & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
                t = time[ok]
                np.minimum.at(best, at, t)
                won = best[at] == t
                out[at[won]] = state[ok][won]
            block += 1
            more = w > (1 << (block - 1))
            text, el, w = text[more], el[more], w[more]
        todo &= np.isinf(best).reshape(n, m).any(axis=1) & (total > 0)
        stop = np.where(todo, stop * 2, stop)
    return out.reshape(n, m)


def multiset(s: np.ndarray) -> np.ndarray:
    """Distinct values that stand for (shingle, occurrence number): set overlap of these is multiset overlap."""
    s = np.sort(s)
    if not len(s):
        return s
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    first = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return kit.mix(s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketcher(bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bands * rows
        for batch in batches:
            for lo, hi, data, offs in kit.text_chunks(batch.column("text")):
                _, _, h, first = kit.words(data, offs)
                keys, text_of, elements, weights, total = [], [], [], [], np.zeros(hi - lo)
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    if a == b:
                        keys.append(None)
                        continue
                    keys.append(kit.digest(h[a:b]))
                    el, c = np.unique(shingles(h[a:b], k), return_counts=True)
                    text_of.append(np.full(len(el), i))
                    elements.append(el)
                    weights.append(c)
                    total[i] = c.sum()
                values = np.zeros(0, np.int64)
                sizes = np.where(total > 0, bands, 0)
                if text_of:
                    sig = signatures(np.concatenate(text_of), np.concatenate(elements), np.concatenate(weights), total, m)[total > 0]
                    acc = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        acc = kit.mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                    values = kit.longs(acc.ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), batch.column("key").slice(lo, hi - lo), pa.array(keys, pa.binary()), kit.list_column(values, sizes, pa.int64())],
                    ["doc_id", "key", "class", "bands"],
                )

    return run


def _elementer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in kit.text_chunks(batch.column("text")):
                _, _, h, first = kit.words(data, offs)
                cuts, want = list(zip(first[:-1].tolist(), first[1:].tolist())), batch.column("class").slice(lo, hi - lo).to_pylist()
                # Of rows that share a doc_id, those with the words of the class.
                mine = [i for i, (a, b) in enumerate(cuts) if a < b and kit.digest(h[a:b]) == want[i]]
                if not mine:
                    continue
                sets = [multiset(shingles(h[slice(*cuts[i])], k)) for i in mine]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo).take(pa.array(mine, pa.int64())), kit.list_column(kit.longs(np.concatenate(sets)), np.array([len(s) for s in sets]), pa.int64())],
                    ["node", "elements"],
                )

    return run


def _verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with their multiset Jaccard similarity at or above the bound as column linked."""
    left = elements.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = elements.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", (both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).alias("linked"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of each of left with each of right (sets), by products over slices of their elements."""
    ends = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    flat = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    found = []
    for values, owner in zip(flat, ends):
        at = np.searchsorted(common, values)
        hit = (at < len(common)) & (common[np.minimum(at, max(len(common) - 1, 0))] == values) if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        found.append((at[hit][order], owner[hit][order]))
    for lo in range(0, len(common), 4096):
        sides = []
        for (at, owner), n in zip(found, out.shape):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            m = np.zeros((n, min(4096, len(common) - lo)), np.float32)
            m[owner[a:b], at[a:b] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _across(similarity: float):
    """Links between different components among the rows of one block and the members of another; a spanning set of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        is_left = rows["left"].to_numpy()
        l, r = rows[is_left], rows[~is_left]
        if not len(l) or not len(r):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        x, y = list(l["elements"]), list(r["elements"])
        both = overlaps(x, y)
        total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
        apart = l["root"].to_numpy()[:, None] != r["root"].to_numpy()[None, :]
        i, j = np.nonzero(apart & (both >= similarity * total))
        joined: dict[int, int] = {}

        def top(a: int) -> int:
            while joined.get(a, a) != a:
                a = joined[a]
            return a

        out = []
        ids, others, ra, rb = (s.to_numpy() for s in (l["node"], r["node"], l["root"], r["root"]))
        for a, b in zip(i.tolist(), j.tolist()):
            u, v = top(int(ra[a])), top(int(rb[b]))
            if u != v:
                joined[max(u, v)] = min(u, v)
                out.append((ids[a], others[b]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _grouped(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """near_duplicates() with key (of the text) and root (of the group, null without words)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = kit.checkpoint(ids.withColumn("key", F.xxhash64("text")).mapInArrow(_sketcher(bands, rows, words), "doc_id long, key long, class binary, bands array<long>"))
    real = sketch.where("class is not null and doc_id is not null")
    classes = kit.checkpoint(real.groupBy("class").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("bands").alias("bands")))
    # A class is named by its smallest doc_id; classes that share it, by their digests.
    several = kit.checkpoint(classes.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("several")))
    unique = several.isEmpty()
    if unique:
        classes = classes.withColumn("node", F.col("id"))
    else:
        classes = kit.checkpoint(classes.join(several, "id", "left").withColumn("node", F.when(F.col("several"), F.xxhash64("class")).otherwise(F.col("id"))))

    slots = kit.checkpoint(classes.select("node", F.explode("bands").alias("bucket")))
    sizes = slots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = kit.checkpoint(kit.hot_join(slots, sizes, "bucket", "n").select("bucket", "node", "n"))
    # The pivot is the member that shares buckets with the most others: the least edited of a family of copies.
    central = members.groupBy("node").agg(F.sum("n").alias("score"))
    pivots = members.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("p"), F.max("n").alias("met"))
    shared = kit.checkpoint(kit.hot_join(members, pivots, "bucket", "met").select("bucket", "node", "p", "n"))
    wanted = shared.select("node").distinct()
    # Only texts of shared buckets are read again; the small side is hashed, so texts are not sorted.
    wanted = classes.join(wanted, "node", "left_semi").select(F.col("id").alias("doc_id"), "node", "class")
    texts = ids.join(wanted.hint("shuffle_hash"), "doc_id").select("node", "class", "text")
    elements = kit.checkpoint(texts.mapInArrow(_elementer(words), "node long, elements array<long>").dropDuplicates(["node"]))

    del slots, sizes, members, central, pivots, wanted, texts  # only the checkpoints below are read on
    kit.release(docs.sparkSession)
    star = shared.where("node <> p").select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()
    linked = kit.checkpoint(_verified(star, elements, similarity).where("linked").select("a", "b"))
    roots = kit.connected_components(linked)

    # Second step: members whose component is not their bucket's pivot's, against the rest of the bucket, block by block.
    known = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = roots.select(F.col("node").alias("p"), F.col("root").alias("p_root"))
    known = kit.checkpoint(known.join(heads, "p", "left").withColumn("apart", F.col("root") != F.coalesce("p_root", "p")).select("bucket", "node", "root", "n", "apart"))
    open_ = known.where("apart").groupBy("bucket").agg(F.count("*").alias("r"), F.max("n").alias("n"))
    cuts = open_.select("bucket", "n", F.ceil(F.col("r") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("n") / BLOCK).cast("int").alias("columns"))
    at = kit.hot_join(known.select("bucket", "node", "root", "apart"), cuts, "bucket", "n")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = at.where("apart").select("bucket", "node", "root", F.lit(True).alias("left"), place("rows").alias("i"), spread("columns").alias("j"))
    right = at.select("bucket", "node", "root", F.lit(False).alias("left"), spread("rows").alias("i"), place("columns").alias("j"))
    groups = left.unionAll(right).join(elements, "node")
    more = kit.checkpoint(groups.groupBy("bucket", "i", "j").applyInPandas(_across(similarity), "a long, b long"))
    del star, known, open_, cuts, at, left, right, groups
    kit.release(docs.sparkSession)
    if not more.isEmpty():
        roots = kit.connected_components(linked.unionAll(more))

    named = classes.select("class", "node", "id", "n").join(roots, "node", "left").select("class", F.col("id").alias("class_id"), F.col("n").alias("n_copies"), F.coalesce("root", "node").alias("root"))
    if unique:
        named = named.withColumn("component_id", F.col("root"))
    else:
        named = kit.checkpoint(named)
        named = named.join(named.groupBy("root").agg(F.min("class_id").alias("component_id")), "root")
    out = sketch.select("doc_id", "key", "class").join(named, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        "key",
        "root",
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, component_id (smallest doc_id of its group), kept, class_id (smallest doc_id with the same words), n_copies."""
    return _grouped(docs, similarity, words, bands, rows).drop("key", "root")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id (of rows of a group sharing it, one)."""
    found = kit.checkpoint(_grouped(docs, **options))

    def joined(left: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        own = kit.null_columns(docs, "_", ["id", "key"])
        rows = rows.select(F.col("doc_id").alias(own["id"]), F.col("key").alias(own["key"])).hint("shuffle_hash")
        return left.join(rows, (F.col("doc_id") == F.col(own["id"])) & (F.xxhash64("text") == F.col(own["key"])), how)

    out = joined(docs, found.where("not kept").select("doc_id", "key").distinct(), "left_anti").select(*docs.columns)
    kept = found.where("kept and doc_id is not null")
    again = kit.checkpoint(kept.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return out
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "root").agg(F.min("key").alias("key")).select("doc_id", "key").distinct()
    own = kit.null_columns(docs, "_", ["key"])["key"]
    repeated = joined(out, one, "left_semi").withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own]).select(*docs.columns)
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)
