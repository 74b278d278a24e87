"""Shared parts: checkpoints, Arrow text access, vectorised word hashing, connected components.

Words are maximal runs of ASCII letters, digits and bytes above 0x7F; A-Z count as a-z.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20  # bytes of text handled at once; one longer text is handled alone


# --- Spark ---------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's shared folder; on a local master without one, in a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffles and checkpoints that nothing refers to: it waits for the driver's collector, which
    a driver with little to do seldom runs."""
    spark.sparkContext._jvm.System.gc()


def fewest(rows: DataFrame, total: int, hashed: F.Column, n: int, *order: str) -> list:
    """The n of rows (about total of them) with the smallest hashes, ties by order; collected, so n must be a bounded parameter.

    Only rows under a bound of the hash reach the sort, about 8 n of them however many there are; where fewer than n lie
    under it, the bound is widened, at last to all.
    """
    share = min(1.0, 8 * n / max(total, 1))
    while True:
        bound = min(int(share * 2.0**64) - 2**63, 2**63 - 1)
        found = rows.where(hashed <= F.lit(bound)).orderBy(hashed, *order).limit(n).collect()
        if len(found) >= n or share >= 1:
            return found
        share = min(1.0, share * 16)


def null_columns(df: DataFrame, prefix: str, names: list[str]) -> dict[str, str]:
    """A free column name for each of names, so that clashing columns of the input stay untouched."""
    have, out = {c.lower() for c in df.columns}, {}
    for n in names:
        free = f"{prefix}{n}"
        while free.lower() in have:
            free += "_"
        out[n] = free
        have.add(free.lower())
    return out


HOT = 1024


def hot_join(rows: DataFrame, unique: DataFrame, keys: str | list[str], count: str, total: int | None = None) -> DataFrame:
    """rows joined to unique, which has one row a key and in column `count` the number of rows with it.

    Keys with more than a HOT-th of all rows are fewer than HOT: these are broadcast and their rows stay where they are;
    the other rows are shuffled, so no task gets more than a HOT-th of them by one key.
    """
    total, names = rows.count() if total is None else total, [keys] if isinstance(keys, str) else keys
    unique = checkpoint(unique)
    hashed = F.xxhash64(F.lit(HOT), *names)
    hot = [r[0] for r in unique.where(F.col(count) > max(total / HOT, 1)).select(hashed).distinct().collect()]  # fewer than HOT
    if not hot:
        return rows.join(unique, keys)
    cold = rows.where(~hashed.isin(hot)).join(unique.where(~hashed.isin(hot)), keys)
    # Keys whose hash is that of a hot one go with it: as many as collide.
    return cold.unionByName(rows.where(hashed.isin(hot)).join(F.broadcast(unique.where(hashed.isin(hot))), keys))


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns node, root from edges (a, b): root is the smallest node that links reach.

    Alternating large-star and small-star steps on the distributed edge list until it stands; nothing is collected but
    counts and a checksum a round. A node that many edges meet is joined by broadcast, see hot_join. Nodes without an edge
    to another node do not appear.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = checkpoint(e)
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("met")).select("u", F.least("u", "m").alias("m"), "met")
        large = hot_join(both, low, "u", "met", 2 * state["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("met"))
        small = hot_join(large, low, "u", "met", 2 * state["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        del both, large, low, small
        release(e.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- hashing -------------------------------------------------------------------------------

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW.get("n", 0) < n:
        n = max(n, CHUNK + 1)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW.update(n=n, both=tuple(out))
    return _POW["both"]


# --- text ----------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column without copying; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offs


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them): whole texts, about limit bytes at once."""
    data, offs = utf8(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _classes(lower: bool, punct: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: its token class (0: none) and the byte that is hashed."""
    kind, byte = np.zeros(256, np.uint8), np.arange(256).astype(np.uint64) + np.uint64(1)
    for c in range(256):
        if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128:
            kind[c] = 1
        elif punct and 33 <= c < 127:
            kind[c] = 2
        if lower and 65 <= c < 91:
            byte[c] = c + 33
    return kind, byte


_WORDS, _TOKENS = _classes(True, False), _classes(False, True)


def words(data: np.ndarray, offs: np.ndarray, punct: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words, and the number of the first word of each text.

    punct: runs of punctuation are tokens too and case is kept.
    """
    n = len(data)
    kind_of, byte_of = _TOKENS if punct else _WORDS
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    kind = kind_of[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[offs[(offs > 0) & (offs < n)]] = True
    at = np.flatnonzero(change)
    real = kind[at[:-1]] != 0
    starts, ends = at[:-1][real], at[1:][real]
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_of[data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLD)
    return starts, ends, hashes, np.searchsorted(starts, offs)


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of hashes[i : i + k] for each i; a text's own are those that end within it."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    out = np.full(n, (salt * 2 + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(k):
        out = out * _GOLD + hashes[j : j + n]
    return mix(out)


def text_gram_slices(first: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """For each text, where its k-grams stand in grams(...)."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield a, max(a, b - k + 1)


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again."""
    import uuid

    spark = df.sparkSession
    checkpoint(spark.range(1))  # settles the folder
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files that stored() wrote for df, once nothing reads them any more."""
    spark = df.sparkSession
    own = (spark.sparkContext.getCheckpointDir() or "").rpartition("/")[2]
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own and f"/{own}/tables/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
