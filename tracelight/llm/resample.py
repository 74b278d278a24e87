"""Quality classifier by importance resampling.

Tokens are runs of word characters or of punctuation, case kept; a text's features are its hashed token 1- and 2-grams.
Two bag models with additive smoothing are counted: the target from labelled good documents, the raw one from all
documents. A document's log weight is the sum of log(target / raw) over its features. It takes part in a Gumbel top-k draw
(log weight plus Gumbel noise from a hash of its id and its weight), which samples without replacement in proportion to the
weights. k is the number of documents whose log weight reaches a level fitted on labelled documents that the target model
has not seen.

Bounds: the models read at most LABELLED labelled documents (those with the smallest hash of doc_id; of rows that share a
doc_id the smallest text); counts of the raw model, the draw and its threshold cover all documents. The driver gets
2 x BUCKETS counts, histogram bins and the weights of at most LABELLED documents.

Defined results. Null or empty text: no features, log weight 0, takes part like any other. Null doc_id: hashed as 0. Very
long texts count whole. Ties at the threshold all stay, so repeated rows, which score and draw alike, stay or go together.
No labels of either class: k is all rows. Empty table: empty result. Other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import kit

BUCKETS, LABELLED, SMOOTH, BINS = 1 << 14, 20_000, 0.5, 4096


def features(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the text of each."""
    _, _, h, first = kit.words(data, offs, punct=True)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    two = kit.grams(h, 2)
    inside = text[1:] == text[:-1]
    number = np.concatenate([h, two[inside]]) % np.uint64(buckets)
    return number.astype(np.int64), np.concatenate([text, text[1:][inside] if len(text) else text])


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offs in kit.text_chunks(batch.column("text")):
                counts += np.bincount(features(data, offs, buckets)[0], minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["bucket", "n"])

    return run


def _scorer(table: np.ndarray, seed: int):
    buckets = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n, key = [], [], []
            ids = pa.compute.fill_null(batch.column("doc_id").cast(pa.int64()), 0).to_numpy().astype(np.uint64)
            for lo, hi, data, offs in kit.text_chunks(batch.column("text")):
                number, text = features(data, offs, buckets)
                score = np.bincount(text, table[number], hi - lo)
                # The text's part of the hash: a commutative sum of mixed features.
                mixed = kit.mix(ids[lo:hi] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) + kit.mix((score * 2.0**20).astype(np.int64).astype(np.uint64)))
                w.append(score)
                n.append(np.bincount(text, minlength=hi - lo))
                key.append(score - np.log(-np.log(kit.unit(mixed))))
            if w:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.concatenate(w)), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(key))], [*batch.schema.names, "log_weight", "n_features", "draw"]
                )

    return run


def counts(texts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets)
    for r in texts.select("text").mapInArrow(_counter(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    t, r = target + smooth, raw + smooth
    return np.log(t / t.sum()) - np.log(r / r.sum())


def score(docs: DataFrame, table: np.ndarray, seed: int = 5) -> DataFrame:
    """docs with log_weight, n_features and draw (the Gumbel key)."""
    if taken := {c.lower() for c in docs.columns} & {"log_weight", "n_features", "draw"}:
        raise ValueError(f"score() makes the columns {sorted(taken)} itself")
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("log_weight", DoubleType()), StructField("n_features", LongType()), StructField("draw", DoubleType())])
    return docs.mapInArrow(_scorer(table, seed), schema)


def largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of column draw, by narrowing histograms: each round counts all rows into BINS bins."""
    low, high = keys.agg(F.min("draw"), F.max("draw")).first()
    if low is None:
        return float("-inf")
    above = 0
    while True:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            return low
        bin_of = F.least(F.floor((F.col("draw") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        found = sorted(((r["b"], r["n"], r["lo"], r["hi"]) for r in keys.where(F.col("draw").between(low, high)).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("draw").alias("lo"), F.max("draw").alias("hi")).collect()), reverse=True)
        for _, n, lo, hi in found:
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
        if above + n == k or low == high:
            return low


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED) -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, level of the log weight that parts good from bad)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)  # bounded by the parameter
    sample = kit.checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(3)) == 0
    table = log_ratio(counts(sample.where(~held & (F.col("quality") == 1)), buckets), counts(docs, buckets))
    told = score(sample.where(held).select("doc_id", "text", "quality"), table).select("quality", "log_weight").collect()
    good = np.sort([r["log_weight"] for r in told if r["quality"] == 1])
    bad = np.sort([r["log_weight"] for r in told if r["quality"] != 1])
    if not len(good) or not len(bad):
        return table, float("-inf")
    # The level with the best balanced accuracy; of equal ones the lowest, which keeps more.
    at = np.unique(np.concatenate([good, bad]))
    right = 1 - np.searchsorted(good, at) / len(good) + np.searchsorted(bad, at) / len(bad)
    best = int(np.argmax(right))
    return table, float(at[best] if best == 0 else (at[best] + at[best - 1]) / 2)


def resampled(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED, k: int | None = None, seed: int = 5) -> DataFrame:
    """The k documents drawn, with doc_id, log_weight, n_features, draw and all columns of docs under `row`."""
    table, level = fit(docs, labels, buckets, labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text",)]).alias("row"))
    keys = kit.checkpoint(score(rows.select("doc_id", "text"), table, seed).select("log_weight", "draw"))
    k = k if k is not None else keys.where(F.col("log_weight") >= F.lit(level)).count()
    bar = largest(keys, k) if k else float("inf")
    return score(rows, table, seed).where(F.col("draw") >= F.lit(bar))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that were drawn, with their own columns."""
    drawn = resampled(docs, labels, **options)
    return drawn.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
