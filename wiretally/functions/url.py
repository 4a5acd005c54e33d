"""Redaction of query strings, and small parts of HTTP heads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A query key that holds one of these has a secret value.
SECRET_KEYS = ("token", "sig", "password", "passwd", "secret", "key", "code", "auth")
MARK = "***"
_SECRET = "(?i)([?&;][^=&;?]*(?:" + "|".join(SECRET_KEYS) + ")[^=&;?]*=)[^&;]*"


def redact(target: Column) -> Column:
    """Values of secret keys become ***; the path and other values stay. Keys are found anywhere in a query, & or ; between."""
    at = F.instr(target, "?")
    query = F.substring(target, at, F.length(target))
    clean = F.regexp_replace(query, _SECRET, f"$1{MARK.replace('*', '*')}")
    return F.when(at > 0, F.concat(F.substring(target, F.lit(1), at - 1), clean)).otherwise(target)


def redaction_needed(target: Column) -> Column:
    at = F.instr(target, "?")
    return (at > 0) & F.substring(target, at, F.length(target)).rlike(_SECRET)


def masked_in_place(target: Column) -> Column:
    """Every query value replaced by as many stars: the length stays."""
    at = F.instr(target, "?")
    pairs = F.split(F.substring(target, at + 1, F.length(target)), "&")

    def star(p: Column) -> Column:
        eq = F.instr(p, "=")
        return F.when(eq > 0, F.concat(F.substring(p, F.lit(1), eq), F.repeat(F.lit("*"), F.length(p) - eq))).otherwise(p)

    return F.when(at > 0, F.concat(F.substring(target, F.lit(1), at), F.array_join(F.transform(pairs, star), "&"))).otherwise(target)


_TRACEPARENT = "^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})(?:-.*)?$"


def traceparent(header: Column) -> Column:
    """struct(trace_id, parent_id, trace_flags) of a version 00 header with ids that aren't zero, else null."""
    trace, parent = F.regexp_extract(header, _TRACEPARENT, 1), F.regexp_extract(header, _TRACEPARENT, 2)
    flags = F.conv(F.regexp_extract(header, _TRACEPARENT, 3), 16, 10).cast("int")
    ok = header.rlike(_TRACEPARENT) & ~trace.rlike("^0+$") & ~parent.rlike("^0+$")
    return F.when(ok, F.struct(trace.alias("trace_id"), parent.alias("parent_id"), flags.alias("trace_flags")))


def basic_user(header: Column) -> Column:
    """The user name of a Basic authorization; null if it isn't one, has no colon or holds control bytes. What follows the
    colon never leaves this expression."""
    token = F.regexp_extract(header, "(?i)^basic +([A-Za-z0-9+/=]+) *$", 1)
    plain = F.try_to_binary(token, F.lit("base64")).cast("string")
    user = F.substring_index(plain, ":", 1)
    return F.when((token != "") & (F.instr(plain, ":") > 0) & ~user.rlike(r"[\x00-\x1f\x7f]"), user)


def split_target(target: Column) -> Column:
    """struct(host, path, query) of an origin-form or absolute-form target."""
    absolute = target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    rest = F.regexp_replace(target, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.when(absolute, F.regexp_extract(rest, "^[^/?]*", 0))
    tail = F.when(absolute, F.regexp_replace(rest, "^[^/?]*", "")).otherwise(target)
    path = F.substring_index(tail, "?", 1)
    return F.struct(
        host.alias("host"),
        F.when(absolute & (path == ""), "/").otherwise(path).alias("path"),
        F.when(F.instr(tail, "?") > 0, F.substring(tail, F.instr(tail, "?") + 1, F.length(tail))).otherwise("").alias("query"),
    )


def content_length(value: Column) -> Column:
    """A list of equal decimal lengths is one length; anything else is null."""
    parts = F.transform(F.split(value, ","), lambda x: F.trim(x))
    same = F.size(F.array_distinct(parts)) == 1
    return F.when(same & F.get(parts, F.lit(0)).rlike("^[0-9]{1,18}$"), F.get(parts, F.lit(0)).cast("long"))


def list_has(value: Column, token: str) -> Column:
    """Whether a comma-separated header value has the token, in any case."""
    return F.array_contains(F.transform(F.split(F.lower(value), ","), lambda x: F.trim(x)), token.lower())


def label_escape(value: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value
