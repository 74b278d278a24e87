"""Column functions over audit records (CDM), and the fixed tables of event families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Audit event names by the direction of their flow (O object, P process).
FLOWS = {
    "O2P": ["READ", "RECVFROM", "RECVMSG", "ACCEPT", "CHECK_FILE_ATTRIBUTES", "LOADLIBRARY", "EXECUTE"],
    "P2O": ["WRITE", "SENDTO", "SENDMSG", "CONNECT", "BIND", "CREATE_OBJECT", "TRUNCATE", "MODIFY_FILE_ATTRIBUTES", "UNLINK"],
    "P2P": ["FORK", "CLONE", "CREATE_THREAD", "SIGNAL", "MODIFY_PROCESS"],
    "O2O": ["RENAME", "LINK", "FLOWS_TO", "TEE", "SPLICE", "SHM", "UPDATE"],
}


def normalised_event(name: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(name)), "^EVENT_", "")


def flow_kind(name: Column) -> Column:
    out, event = F.lit("SKIP"), normalised_event(name)
    for kind, names in FLOWS.items():
        out = F.when(event.isin(names), kind).otherwise(out)
    return F.when(name.isNull(), "SKIP").otherwise(out)


def edge_type(source_kind: Column, target_kind: Column) -> Column:
    pair = F.concat(source_kind, F.lit("to"), target_kind)
    return F.when(pair.isin("PtoF", "FtoP", "PtoN", "NtoP", "PtoP"), pair).otherwise("ObjectFlow")


def uuid_text(raw: Column) -> Column:
    """16 bytes as 8-4-4-4-12 lowercase hex."""
    h = F.lower(F.hex(raw))
    return F.when(raw.isNotNull(), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def uuid8(uuid: Column) -> Column:
    return F.substring(F.regexp_replace(uuid, "-", ""), -8, 8)


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash; the whole path if nothing does; null for a blank one."""
    whole = F.translate(F.trim(path), "\\", "/")
    last = F.element_at(F.split(whole, "/"), -1)
    return F.when(whole != "", F.when(last != "", last).otherwise(whole))


def first_command_token(command: Column) -> Column:
    """The base name of a command line's first word, or of what stands in quotes at its beginning."""
    line = F.trim(command)
    quoted = F.regexp_extract(line, r'^"([^"]+)"', 1)
    return base_name(F.when(quoted != "", quoted).otherwise(F.split(line, " ")[0]))


def memory_label(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))


def object_label(prefix: str, *labels: Column) -> Column:
    """The first label that is not blank, behind the prefix of its kind."""
    return F.concat(F.lit(prefix + "://"), first_non_blank(*labels))
