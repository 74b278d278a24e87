"""Column functions over the argument text of system-call log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def result_size(args: Column) -> Column:
    """The digits right after the first `res=`; null if there are none."""
    first = F.regexp_extract(args, r"^(?:(?!res=)[\s\S])*res=([0-9]+)", 1)
    return F.when(first != "", first.try_cast("long"))


def unwrapped(path: Column) -> Column:
    """`a(b)` stands for b: what follows the first bracket, without the last character."""
    return F.when(path.contains("("), F.regexp_extract(path, r"^[^(]*\((.*).$", 1)).otherwise(path)


def descriptor(args: Column) -> Column:
    """The token after the first `fd=`, without what stands before its tag."""
    return F.regexp_extract(args, r"^(?:(?!fd=)[\s\S])*fd=[^<\s]*(<[0-9a-z]+>[^\s]*)", 1)


def file_of(token: Column) -> Column:
    """The path of a file descriptor, else null."""
    path = F.regexp_replace(F.regexp_extract(token, r"^<f>(.+)$", 1), r"\)$", "")
    return F.when(path != "", unwrapped(path))


def descriptor_file(args: Column) -> Column:
    return file_of(descriptor(args))


def filename(args: Column) -> Column:
    path = F.regexp_extract(args, r"^(?:(?!filename=)[\s\S])*filename=([^\s]+)", 1)
    return F.when(path != "", unwrapped(path))


def socket(args: Column) -> Column:
    """src_ip, src_port, dst_ip, dst_port of a 4-tuple descriptor; raw ones have UNKNOWN ports; else null."""
    d = F.regexp_replace(descriptor(args), r"\)$", "")
    body = F.regexp_extract(d, r"^<(?:4t|6t|4u|6u)>(.+)->(.+)$", 0)
    source, sink = F.regexp_extract(body, r"^<..>(.+)->", 1), F.regexp_extract(body, r"->(.+)$", 1)
    host = lambda c: F.regexp_extract(c, r"^(.*):([^:]*)$", 1)
    port = lambda c: F.regexp_replace(F.regexp_extract(c, r"^(.*):([^:]*)$", 2), "^domamin$", "53")
    raw = F.regexp_extract(d, r"^<4r>(.+)->(.+)$", 1), F.regexp_extract(d, r"^<4r>(.+)->(.+)$", 2)
    four = lambda a, b, c, e: F.struct(a.alias("src_ip"), b.alias("src_port"), c.alias("dst_ip"), e.alias("dst_port"))
    ok = (body != "") & source.contains(":") & sink.contains(":")
    return F.when(ok, four(host(source), port(source), host(sink), port(sink))).when(raw[0] != "", four(raw[0], F.lit("UNKNOWN"), raw[1], F.lit("UNKNOWN")))


def socket_signature(s: Column) -> Column:
    return F.concat(s["src_ip"], F.lit(":"), s["src_port"], F.lit("->"), s["dst_ip"], F.lit(":"), s["dst_port"])


def socket_of(token: Column) -> Column:
    """The signature of a socket descriptor, as socket_signature(socket()) has it, in one pass; else null."""
    four = F.regexp_extract(token, r"^<[46][tu]>(.+:[^:]*->.+?:[^:]*?)\)?$", 1)
    raw = F.regexp_extract(token, r"^<4r>(.+->.+?)\)?$", 1)
    named = F.regexp_replace(four, r":domamin$", ":53")
    return F.when(four != "", named).when(raw != "", F.concat(F.regexp_replace(raw, "->", ":UNKNOWN->"), F.lit(":UNKNOWN")))


def epoch_nanos(stamp: Column) -> Column:
    """Seconds and a decimal fraction as nanoseconds; the fraction is padded or cut to nine digits."""
    seconds = F.substring_index(stamp, ".", 1).try_cast("long")
    digits = F.when(stamp.contains("."), F.substring(F.rpad(F.substring_index(stamp, ".", -1), 9, "0"), 1, 9)).otherwise("0")
    return seconds * 1_000_000_000 + digits.try_cast("long")


def nanos_text(nanos: Column) -> Column:
    """Nanoseconds as seconds text without trailing zeros."""
    text = F.concat(F.floor(nanos / 1_000_000_000).cast("string"), F.lit("."), F.lpad((nanos % 1_000_000_000).cast("string"), 9, "0"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def rename_paths(args: Column) -> Column:
    """old and new: from `oldpath=` to the last ` newpath`, from `newpath=` to the last blank; `a(b)` stands for b."""
    old = F.regexp_extract(args, r"oldpath=(.*) newpath", 1)
    new = F.regexp_extract(args, r"newpath=(.*) ", 1)
    inside = lambda c: F.when(c.endswith(")"), F.regexp_extract(c, r"^(?:[^(]*\()?(.*)\)$", 1)).otherwise(c)
    return F.struct(inside(old).alias("old"), inside(new).alias("new"))


def exec_parent(args: Column) -> Column:
    pid, name = F.regexp_extract(args, r"ptid=(\d+)\((.+?)\)", 1), F.regexp_extract(args, r"ptid=(\d+)\((.+?)\)", 2)
    return F.when(pid != "", F.concat(pid, name))


def legacy_fields(line: Column, layout: str) -> Column:
    """The older space-delimited layouts: `plain`, `no_exec`, `with_exec`, `host`."""
    parts = F.split(line, " ")
    strip = lambda c, p: F.regexp_replace(c, p, "")
    shift = 1 if layout == "host" else 0
    get = lambda i: F.get(parts, F.lit(i + shift))
    tail = F.array_join(F.slice(parts, 9 + shift, F.greatest(F.size(parts) - (8 + shift) - (1 if layout == "with_exec" else 0), F.lit(0))), " ")
    fields = [get(0).alias("timestamp"), get(1).alias("cpu"), get(2).alias("process"), strip(get(3), r"[()]").alias("pid"), get(4).alias("direction"), get(5).alias("event"), strip(get(6), "^cwd=").alias("cwd"), strip(get(7), "^latency=").alias("latency"), tail.alias("args")]
    if layout == "with_exec":
        fields.append(strip(F.element_at(parts, -1), "^exepath=").alias("exepath"))
    if layout == "host":
        fields.append(F.get(parts, F.lit(0)).alias("host"))
    return F.struct(*fields)
