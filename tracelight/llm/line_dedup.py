"""Site-relative boilerplate lines, with DataFrame functions only.

Pages are grouped by host; a line's frequency is the number of the host's pages that contain it divided by the number of
the host's pages. Lines above the ratio, on enough pages, are dropped from all of the host's pages.

Lines are compared by 64-bit hash within a host. A line counts once a page and is pre-aggregated before the shuffle, so a
hot host costs no more than any other. A host has at most (lines a page / ratio) dropped lines; these sets are joined back
by host, as a broadcast if all of them together are few, else as a shuffled join that Spark can split where it is skewed.

Defined results. Null text: stays null. Blank lines stay and are not counted. Null hosts are one host. Rows are pages:
repeated rows count each and each get a result. A text that loses all lines becomes empty. A line whose frequency equals
the ratio stays. Very long texts are split whole. Empty table: empty result. Columns other than the text and host column
pass through under any name; n_lines and n_dropped, if asked for, take the place of input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm import kit

RATIO, LEAST_PAGES, BROADCAST_LINES = 0.1, 5, 500_000


def _lines(text: Column | str) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, line_hash, pages (that contain it) and host_pages for each line to drop."""
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(host).isNull().alias("no_host"), F.col(text).alias("text"))
    hosts = pages.groupBy("host", "no_host").agg(F.count("*").alias("host_pages"))
    full = F.filter(F.array_distinct(_lines("text")), lambda x: F.trim(x) != "")
    lines = pages.select("host", "no_host", F.explode(F.transform(full, lambda x: F.xxhash64(x))).alias("line_hash"))
    counts = lines.groupBy("host", "no_host", "line_hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    return counts.join(hosts, ["host", "no_host"]).where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def without_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_lines: int = BROADCAST_LINES, counts: bool = False) -> DataFrame:
    """docs with boilerplate lines gone from the text; counts: also n_lines and n_dropped."""
    found = kit.checkpoint(boilerplate(docs, host, text, ratio, least_pages))
    own = kit.null_columns(docs, "_", ["host", "no_host", "gone", "lines", "kept"])
    sets = found.groupBy(F.col("host").alias(own["host"]), F.col("no_host").alias(own["no_host"])).agg(F.collect_list("line_hash").alias(own["gone"]))
    if found.count() <= broadcast_lines:
        sets = F.broadcast(sets)
    keyed = docs.withColumns({own["host"]: F.coalesce(F.col(host).cast("string"), F.lit("")), own["no_host"]: F.col(host).isNull()})
    joined = keyed.join(sets, [own["host"], own["no_host"]], "left")
    gone = F.col(own["gone"])
    kept = F.when(gone.isNull(), _lines(text)).otherwise(F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(gone, F.xxhash64(x))))
    joined = joined.withColumn(own["kept"], kept)
    columns = [(F.concat_ws("\n", F.when(F.col(text).isNotNull(), F.col(own["kept"]))) if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    columns = [F.when(F.col(text).isNotNull(), c).alias(text) if n == text else c for n, c in zip(docs.columns, columns) if not (counts and n.lower() in ("n_lines", "n_dropped"))]
    if counts:
        n = F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long")
        left = F.coalesce(F.size(own["kept"]), F.lit(0)).cast("long")
        columns += [F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n).alias("n_lines"), F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n - left).alias("n_dropped")]
    return joined.select(*columns)
