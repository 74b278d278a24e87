"""Repeated passages by sparse suffix arrays over words.

Suffixes are retained only where a text's own content selects them: at the minimisers of its rolling word 8-gram hashes
over windows of WINDOW positions. Every passage of LENGTH words holds a minimiser within its first WINDOW words, the same in
every text that holds the passage, and at least LENGTH - WINDOW + 1 words of it follow: the suffix's key. Keys that only
one document has fall away by partial and final aggregation.

The remaining suffixes are sorted by key, then by the words that follow, then by the words before them, read leftwards:
range partitions in order are the sparse suffix array. Neighbours are compared word by word. Neighbours that agree on all
q words after the key are an interval of depth q; members of an interval that also agree on the t = WINDOW - 1 - q words
before the suffix hold the same passage of LENGTH words. Doing so for each t from 0 to WINDOW - 1 extends every match to
the left and to the right as far as it goes; longer passages hold further minimisers, whose matches overlap, so that the
union is the maximal span. All repeated passages of LENGTH words or more are found, and nothing shorter.

The first and the last key of a partition can go on in others. Their passages are compared across the seams by hash:
each that a partition holds is told once, and the documents of those that it has found in one document only ask. A key of a
third of all documents is thus many partitions; each holds its own part, nothing more.

Documents with equal words are one class first; in a class of several, the whole text is a span.

Words before and after are compared by 32 bits, the rest by 64 bits: of 2^32 comparisons one takes a span one word too far.
A task reads its range partition in blocks of about BLOCK suffixes, cut between keys, so what it holds does not grow with the
partition. A key of more suffixes than a block is cut too; its blocks are compared like partitions.

Defined results. Only repetition between different doc_ids counts. Null or empty text, or below LENGTH words: no rows.
Null doc_id: takes no part. Rows sharing a doc_id are one document with all their spans. Texts of any length are whole.
Empty table: empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import kit

LENGTH, GRAM, WINDOW = 50, 8, 26
#: Suffixes that a task holds at once.
BLOCK = 1 << 14


def minimisers(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each run of `window` hashes (the rightmost of equal ones), each once."""
    if not len(g):
        return np.zeros(0, np.int64)
    if len(g) <= window:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))])
    # The least of a window is the less of a block's suffix minimum and the next block's prefix minimum.
    n = len(g)
    pad = np.full(-(-n // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[:n] = g
    blocks = pad.reshape(-1, window)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - window + 1)
    least = np.minimum(suffix[starts], prefix[starts + window - 1])
    # A position is chosen if it holds the least of some window it lies in and no equal one follows in that window.
    chosen = np.zeros(n, bool)
    for at in range(window):
        hit = g[starts + at] == least
        chosen[starts[hit] + at] = True
    return np.flatnonzero(chosen)


def _suffixes(length: int, gram: int, window: int):
    rest = length - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in kit.text_chunks(batch.column("text")):
                _, _, h, first = kit.words(data, offs)
                g, right = kit.grams(h, gram), kit.grams(h, rest, salt=1)
                keys, n, values, sizes = [], [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    keys.append(kit.digest(h[a:b]))
                    n.append(b - a)
                    at = np.zeros(0, np.int64)
                    if b - a >= length:
                        at = minimisers(g[a : b - gram + 1], window)
                        at = at[at + rest <= b - a]
                    values.append(right[a + at])
                    sizes.append(len(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), kit.list_column(kit.longs(np.concatenate(values)), np.array(sizes), pa.int64())],
                    ["doc_id", "class", "n_words", "suffixes"],
                )

    return run


def _contexts(length: int, gram: int, window: int):
    """The live suffixes of each text: key, the words after it and those before it (leftwards) as bytes, node, place."""
    rest, side = length - window + 1, window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                data, offs = kit.utf8(batch.column("text").slice(row, 1))
                _, _, h, _ = kit.words(data[offs[0] : offs[1]], offs - offs[0])
                if len(h) < length:
                    continue
                at = minimisers(kit.grams(h, gram), window)
                at = at[at + rest <= len(h)]
                keys = kit.grams(h, rest, salt=1)[at]
                live = np.isin(keys, np.asarray(batch.column("live")[row].values, np.int64).view(np.uint64))
                at, keys = at[live], keys[live]
                word = (h >> np.uint64(32)).astype(">u4")
                node = batch.column("node")[row].as_py()
                for s in range(0, len(at), 20_000):
                    some = at[s : s + 20_000].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(kit.longs(keys[s : s + 20_000])), pa.array([word[p + rest : p + length].tobytes() for p in some], pa.binary()),
                            pa.array([word[max(0, p - side) : p][::-1].tobytes() for p in some], pa.binary()), pa.array(np.full(len(some), node), pa.int64()), pa.array(some, pa.int32()),
                        ],
                        ["key", "after", "before", "node", "place"],
                    )

    return run


def _sides(column: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (n, side), zero beyond the end, and their numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    words, at, n = data[offs[0] : offs[-1]].view(">u4"), (offs[:-1] - offs[0]) // 4, np.diff(offs) // 4
    out = np.zeros((len(column), side), np.uint32)
    for j in range(side):
        has = np.flatnonzero(n > j)
        out[has, j] = words[at[has] + j]
    return out, n


def _held_by(ids: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row whether its id is also held by another node; the first row and the least node of each id."""
    order = np.argsort(ids, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
    low, high = np.minimum.reduceat(node[order], new), np.maximum.reduceat(node[order], new)
    size = np.diff(np.append(new, len(ids)))
    out = np.empty(len(ids), bool)
    out[order] = np.repeat(low != high, size)
    return out, order[new], low


def matched(key: np.ndarray, after: np.ndarray, n_after: np.ndarray, before: np.ndarray, n_before: np.ndarray, node: np.ndarray, edge: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple]]:
    """For sorted suffixes which (row, t) passages another document holds, and what is to be compared across the seams.

    The second: (row, t, hash, least node, whether it asks), for the rows of edge: those of the first and the last key, unless told.
    """
    n, side = after.shape
    same = np.concatenate([[False], key[1:] == key[:-1]])
    # Words after the key that a suffix shares with the one before it in order.
    agree = np.concatenate([[0], np.minimum(np.cumprod(after[1:] == after[:-1], axis=1, dtype=np.int8).sum(axis=1), np.minimum(n_after[1:], n_after[:-1]))])
    if edge is None:
        edge = (key == key[0]) | (key == key[-1])
    covered, open_ = np.zeros((n, side + 1), bool), []
    left = np.zeros(n, np.uint64)
    seam, right = np.flatnonzero(edge), [np.zeros(int(edge.sum()), np.uint64)]
    for q in range(side if len(seam) else 0):
        right.append(kit.mix(right[-1] * np.uint64(0x9E3779B97F4A7C15) + after[seam, q].astype(np.uint64) + np.uint64(1)))
    for t in range(side + 1):
        q = side - t
        if t:
            left = kit.mix(left * np.uint64(0x9E3779B97F4A7C15) + before[:, t - 1].astype(np.uint64) + np.uint64(1))
        interval = np.cumsum(~(same & (agree >= q)))
        able = (n_after >= q) & (n_before >= t)
        many = np.bincount(interval, able, interval[-1] + 1)[interval] > 1
        at = np.flatnonzero(able & many)
        if len(at):
            hit, _, _ = _held_by(kit.mix(left[at] + interval[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), node[at])
            covered[at[hit], t] = True
        own = able[seam]
        at = seam[own]
        if len(at):
            h = kit.mix(kit.mix(left[at] ^ kit.mix(right[q][own] + np.uint64(t))) + key[at].view(np.uint64))
            _, first, low = _held_by(h, node[at])
            lone = ~covered[at, t]
            asks = np.flatnonzero(lone)
            tell = first[~lone[first]]
            open_.append((at[asks], np.full(len(asks), t), h[asks], node[at[asks]], np.ones(len(asks), bool)))
            least = np.zeros(len(at), np.int64)
            least[first] = low
            open_.append((at[tell], np.full(len(tell), t), h[tell], least[tell], np.zeros(len(tell), bool)))
    return covered, open_


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of about `rows` sorted suffixes, cut between keys, and which of their suffixes stand at a seam.

    At a seam is what has the first or the last key of the partition, or a key of more than `rows` suffixes, which is cut.
    """
    held, n, first, cut = [], 0, None, None

    def block(table: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray]:
        key = table.column("key").to_numpy()
        edge = key == first
        if cut is not None:
            edge |= key == cut
        if last:
            edge |= key == key[-1]
        return table, edge

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        first = key[0] if first is None else first
        at = len(key) - int(np.argmax((key != key[-1])[::-1])) if key[0] != key[-1] else 0  # where the last key begins
        if not at:
            cut = key[0]
            at = len(key)
        yield block(table.slice(0, at), False)
        held, n = table.slice(at).combine_chunks().to_batches(), len(key) - at
    if n:
        table = pa.Table.from_batches(held)
        first = table.column("key")[0].as_py() if first is None else first
        yield block(table, True)


def _neighbours(length: int, window: int, rows: int):
    """Of one range partition, block by block: spans (kind 0) and what is open at its seams (kind 1: tells, 2: asks)."""
    side, names = window - 1, ["kind", "node", "start", "end", "passage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edge in _blocks(batches, rows):
            key, node, place = (table.column(c).to_numpy() for c in ("key", "node", "place"))
            (after, n_after), (before, n_before) = _sides(table.column("after"), side), _sides(table.column("before"), side)
            covered, open_ = matched(key, after, n_after, before, n_before, node, edge)
            # Runs of t along a row: a span from the largest t's start to the smallest t's end.
            grown = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (row, low), (_, high) = np.nonzero(grown == 1), np.nonzero(grown == -1)
            parts = [(np.zeros(len(row), np.int8), node[row], place[row] - (high - 1), place[row] - low + length, np.zeros(len(row), np.int64))]
            parts += [(np.where(asks, 2, 1).astype(np.int8), who, place[r] - t, place[r] - t + length, kit.longs(h)) for r, t, h, who, asks in open_]
            for kind, who, start, end, h in parts:
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(who, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(h, pa.int64())], names)

    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words: one row for each maximal span of repeated passages."""
    if not gram <= length - window + 1:
        raise ValueError("the window leaves no room for a gram")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    read = kit.checkpoint(ids.mapInArrow(_suffixes(length, gram, window), "doc_id long, class binary, n_words int, suffixes array<long>").where(F.col("n_words") >= length))
    classes = kit.checkpoint(read.groupBy("class").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.first("n_words").alias("n_words"), F.first("suffixes").alias("suffixes")))
    suffixes = classes.select("node", F.explode("suffixes").alias("suffix"))
    shared = suffixes.groupBy("suffix").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high").select("suffix", "n")
    shared = kit.checkpoint(shared)
    live = kit.hot_join(suffixes, shared, "suffix", "n").groupBy("node").agg(F.collect_set("suffix").alias("live"))
    texts = ids.withColumnRenamed("doc_id", "node").join(live.hint("shuffle_hash"), "node").select("node", "text", "live")
    order = ["key", "after", "before", "node", "place"]
    array = texts.mapInArrow(_contexts(length, gram, window), "key long, after binary, before binary, node long, place int")
    # A key that is more than a partition is dealt by its next words and its documents; the bounds drawn for it are short.
    array = array.repartitionByRange("key", F.substring("after", 1, 16), "node").sortWithinPartitions(*order)
    found = kit.checkpoint(array.mapInArrow(_neighbours(length, window, block), "kind byte, node long, start int, end int, passage long"))
    seams = found.where("kind > 0")
    several = seams.groupBy("passage").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high").select("passage", "n")
    across = kit.hot_join(seams, several, "passage", "n").where("kind = 2")
    spans = found.where("kind = 0").select("node", "start", "end").unionAll(across.select("node", "start", "end"))
    per = spans.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("hits"))
    # Spans that overlap or touch are one.
    kind = "array<struct<start:int,end:int>>"

    def merge(acc, x):
        near = F.coalesce(x["start"] <= acc["end"], F.lit(False))
        flush = F.when(acc["start"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))
        return F.struct(F.when(near, acc["start"]).otherwise(x["start"]).alias("start"), F.when(near, F.greatest(acc["end"], x["end"])).otherwise(x["end"]).alias("end"), F.when(near, acc["done"]).otherwise(flush).cast(kind).alias("done"))

    start = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.array().cast(kind).alias("done"))
    finish = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))).cast(kind))
    merged = per.select("node", F.aggregate("hits", start, merge, finish).alias("spans"))
    whole = F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"))
    both = classes.join(merged, "node", "left").select("class", "node", F.when(F.col("node") != F.col("last"), F.array(whole).cast(kind)).otherwise(F.col("spans")).alias("spans")).where("spans is not null")
    out = read.select("doc_id", "class").distinct().join(both, "class").select("doc_id", F.explode("spans").alias("s"))
    return out.select("doc_id", F.col("s.start").cast("long").alias("start_word"), F.col("s.end").cast("long").alias("end_word"), (F.col("s.end") - F.col("s.start")).cast("long").alias("n_words"))
