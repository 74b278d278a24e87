"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is (its target weight x rows wanted) / its rows. Each document inverts the Poisson
distribution of that mean at a hash of the seed and its contents, and is exploded into so many copies. The cumulative
distribution is tabulated once a source and looked up by each document. All copies are then dealt to partitions and ordered
within them by another hash: a global shuffle that reruns alike on as many partitions and needs no pass for range bounds.
Rates above 400 are drawn as a sum of independent parts.

The table of sources is broadcast if its cumulative distributions hold at most BROADCAST_ENTRIES numbers together (counted
first), else joined by a shuffle that Spark can split where it is skewed.

Weights: a map source -> weight; sources without one get `other` (default: 1, so by default all sources are even). They
are divided by their sum. Rows wanted: the number of input rows unless given.

Defined results. Null sources are one source. A null text or id is hashed as empty. Repeated rows draw alike. Weight 0 or
a draw of 0: no copy. Very long texts are copied whole. Rows whose order hashes tie stand next to each other. Empty table:
empty result. Other columns pass through under any name; copy_no, if asked for, counts from 0 and takes the place of an
input column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm import kit

SEED, PART, BROADCAST_ENTRIES = 17, 400.0, 4_000_000


def hash_unit(*values: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    hexa = F.substring(F.md5(F.concat_ws("|", *values)), 1, 13)
    return (F.conv(hexa, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """The Poisson distribution's P(X <= 0), P(X <= 1), ... for a rate up to PART, until its tail is below rounding."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, i):
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["cdf"])


def inverse(cdf: Column, u: Column) -> Column:
    """The smallest k whose cumulative probability reaches u, or the end of the table."""
    return F.least(F.size(F.filter(cdf, lambda c: c < u)), F.size(cdf) - 1)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, wanted: int | None = None, source: str = "source") -> DataFrame:
    """src (null as ''), no_src, rows, rate."""
    weights = weights or {}
    per = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), F.col(source).isNull().alias("no_src")).agg(F.count("*").alias("rows"))
    weight = F.lit(float(other))
    for name, w in weights.items():
        weight = F.when(F.col("src") == name, F.lit(float(w))).otherwise(weight)
    per = kit.checkpoint(per.withColumn("weight", weight))
    total = per.agg(F.sum("weight").alias("w"), F.sum("rows").alias("n")).first()
    aim = float(wanted if wanted is not None else (total["n"] or 0))
    scale = aim / total["w"] if total["w"] else 0.0
    return per.select("src", "no_src", "rows", (F.col("weight") * F.lit(scale) / F.col("rows")).alias("rate"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, wanted: int | None = None, source: str = "source", seed: int = SEED, numbered: bool = False, shuffle: bool = True) -> DataFrame:
    """docs replicated to the target mixture, in a global random order."""
    own = kit.null_columns(docs, "_", ["src", "no_src", "cdf", "parts", "key", "u", "copies", "copy", "order"])
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))
    per = rates(docs, weights, other, wanted, source).select(
        F.col("src").alias(own["src"]), F.col("no_src").alias(own["no_src"]), parts.alias(own["parts"]), cumulative(F.col("rate") / parts).alias(own["cdf"])
    )
    per = kit.checkpoint(per)
    if (per.agg(F.sum(F.size(own["cdf"])).alias("n")).first()["n"] or 0) <= BROADCAST_ENTRIES:
        per = F.broadcast(per)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat_ws("|", F.lit(str(seed)), text("doc_id"), F.md5(text("text")))
    keyed = docs.withColumns({own["src"]: text(source), own["no_src"]: F.col(source).isNull(), own["key"]: key})
    # The key and its number are columns below the join, so that they are not evaluated again inside the lookup.
    keyed = keyed.withColumn(own["u"], hash_unit(F.col(own["key"])))
    joined = keyed.join(per, [own["src"], own["no_src"]])
    cdf = F.col(own["cdf"])
    each = F.transform(F.sequence(F.lit(1), F.col(own["parts"])), lambda i: hash_unit(F.col(own["key"]), i.cast("string")))
    many = F.aggregate(each, F.lit(0), lambda acc, u: acc + inverse(cdf, u))
    copies = F.when(F.col(own["parts"]) == 1, inverse(cdf, F.col(own["u"]))).otherwise(many)
    out = joined.withColumn(own["copies"], copies)
    out = out.withColumn(own["copy"], F.explode(F.when(F.col(own["copies"]) > 0, F.sequence(F.lit(0), F.col(own["copies"]) - 1))))
    if shuffle:
        out = out.withColumn(own["order"], F.xxhash64(own["key"], own["copy"])).repartition(own["order"]).sortWithinPartitions(own["order"])
    columns = [F.col(f"`{c}`") for c in docs.columns if not (numbered and c.lower() == "copy_no")]
    return out.select(*columns, *([F.col(own["copy"]).cast("long").alias("copy_no")] if numbered else []))
