"""Capture filters as predicates: ports, process names, cgroup globs, protocols by port, and capture budgets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PORTS = 16
# Bytes kept of a call, by protocol, and over all.
BUDGETS = {"http": 2048, "s3": 2048, "redis": 512}
BUDGET = 8192


def port_filter(local_port: Column, ports: list[int]) -> Column:
    """Only the server's own side of a connection: then what it receives is a request."""
    if len(ports) > MOST_PORTS:
        raise ValueError(f"at most {MOST_PORTS} ports")
    return local_port.isin(*ports)


def name_filter(comm: Column, patterns: list[str]) -> Column:
    """Exact names, or prefixes ending in *."""
    out = F.lit(False)
    for p in patterns:
        out = out | (comm.startswith(p[:-1]) if p.endswith("*") else comm == p)
    return out


def glob_regex(glob: str) -> str:
    """* stays within a path segment, ** crosses them, ? is one character of a segment."""
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


def cgroup_filter(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def proto_of_port(port: Column, table: list[tuple[int, str]], default: str = "pg") -> Column:
    """The first entry for the port, else the default."""
    out = F.lit(default)
    for p, proto in reversed(table):
        out = F.when(port == p, proto).otherwise(out)
    return out


def capture_budget(proto: Column, explicit: Column, overall: int = BUDGET) -> Column:
    """A port's explicit budget, else its protocol's capped by the overall one, else that."""
    pairs = [F.lit(x) for kv in BUDGETS.items() for x in kv]
    return F.coalesce(explicit, F.least(F.create_map(*pairs)[proto], F.lit(overall)), F.lit(overall))


def all_of(df: DataFrame, *predicates: Column) -> DataFrame:
    """Filters one after the other, so that each can be pushed to the scan by itself."""
    for p in predicates:
        df = df.where(p)
    return df


def drop_ciphertext(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped counts by connection): data of a TLS connection that isn't decrypted goes, and is counted."""
    cipher = F.col("tls") & ~F.col("decrypted")
    return events.where(~cipher), events.where(cipher).groupBy("conn").agg(F.count("*").alias("dropped"))


def drop_blind(events: DataFrame, blind: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded by reason): all data of connections that are known not to be parsed."""
    counts = events.join(blind, "conn").groupBy("reason").agg(F.count("*").alias("discarded"))
    return events.join(blind, "conn", "left_anti"), counts
