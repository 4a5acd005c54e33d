"""Route templates: from a request target to a bounded identity, in Catalyst expressions.

Three layers: a route the application declared, an explicit map, and classifiers of path segments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.operators.reduce import clip_label

ID = "{id}"
DEPTH, MOST_DEPTH, TEXT_BYTES = 8, 32, 255
MAP_LINES, MAP_SEGMENTS, QUERY_KEYS, VALUE_BYTES = 512, 16, 8, 32

# Shapes of a value, as opposed to a name. Anchored, and free of look-around so that any engine can use them.
NUMBER = "^[0-9]+$"
HEX = "^[0-9A-Fa-f]{8,}$"
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
ULID = "^[0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{26}$"
DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
BASE64 = "^[A-Za-z0-9+/=_-]{16,}$"
CONTROL = r"[\x00-\x1f\x7f]"
#: Longer segments are no names.
NAME_BYTES = 24
EXTENSION = r"\.([A-Za-z0-9]{1,8})$"


def opaque(segment: Column) -> Column:
    """Whether a segment looks like a value: a number, long, hex, UUID, ULID, date, base64 or mostly digits."""
    size = F.octet_length(segment)
    digits = F.length(F.regexp_replace(segment, "[^0-9]", ""))
    mixed = segment.rlike("[A-Z]") & segment.rlike("[a-z]") & segment.rlike("[0-9]")
    value = (
        segment.rlike(CONTROL) | segment.rlike(NUMBER) | (size > NAME_BYTES) | segment.rlike(HEX) | segment.rlike(UUID)
        | segment.rlike(ULID) | segment.rlike(DATE) | (segment.rlike(BASE64) & mixed) | ((size >= 6) & (digits * 10 > size * 4))
    )
    return (size > 0) & value


def template_segment(segment: Column) -> Column:
    """A file name keeps its extension if any part of its stem is a value; other segments are kept or become {id}."""
    ext = F.regexp_extract(segment, EXTENSION, 1)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(ext) - 1)
    is_file = ext.rlike("[A-Za-z]") & (F.length(stem) > 0)
    parts = F.exists(F.split(stem, r"\."), opaque)
    return F.when(is_file, F.when(parts, F.concat(F.lit("{file}."), ext)).otherwise(segment)).when(opaque(segment), ID).otherwise(segment)


def template_path(path: Column, depth: int = DEPTH) -> Column:
    """The template of a path; empty segments and a closing slash stay, deeper segments become /... ."""
    depth = min(max(depth, 1), MOST_DEPTH)
    segments = F.split(path, "/")
    rest = F.slice(segments, 2, depth)
    text = F.concat(F.lit("/"), F.array_join(F.transform(rest, template_segment), "/"))
    text = F.concat(text, F.when(F.size(segments) - 1 > depth, "/...").otherwise(""))
    return F.when(path.startswith("/"), text).otherwise(F.when(opaque(path), ID).otherwise(path))


def path_of(target: Column) -> Column:
    return F.substring_index(F.substring_index(target, "#", 1), "?", 1)


def query_of(target: Column) -> Column:
    """What follows the first question mark, or empty."""
    return F.when(F.instr(target, "?") > 0, F.substring(target, F.instr(target, "?") + 1, F.length(target))).otherwise("")


def promoted(target: Column, keys: list[str]) -> Column:
    """Configured query keys in their order, with classified values; a key without a value is kept empty."""
    pairs = F.split(query_of(target), "&")

    def first(key: str) -> Column:
        return F.get(F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == key), F.lit(0))

    out = []
    for key in keys[:QUERY_KEYS]:
        hit = first(key)
        value = F.when(F.instr(hit, "=") > 0, F.substring(hit, F.instr(hit, "=") + 1, F.length(hit))).otherwise("")
        value = F.when((F.octet_length(value) > VALUE_BYTES) | opaque(value), ID).otherwise(value)
        out.append(F.when(hit.isNotNull(), F.concat(F.lit(f"{key}="), value)))
    found = F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, F.concat(F.lit("?"), F.array_join(found, "&"))).otherwise("")


def given(route: Column) -> Column:
    """A route that the application declared: trusted but for control bytes."""
    return clip_label(F.regexp_replace(route, CONTROL, ""), TEXT_BYTES)


@dataclass(frozen=True)
class Pattern:
    method: str
    text: str

    @property
    def segments(self) -> list[str]:
        return self.text.split("/")[1:]


def parse_map(text: str) -> tuple[list[Pattern], int]:
    """Lines `METHOD /pattern`; # starts a comment line. Returns the patterns and how many lines were rejected."""
    patterns, rejected = [], 0
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        parts = line.split()
        ok = len(parts) == 2 and parts[1].startswith("/") and "?" not in parts[1] and parts[1].count("/") <= MAP_SEGMENTS
        if ok and len(patterns) < MAP_LINES:
            patterns.append(Pattern(*parts))
        else:
            rejected += 1
    return patterns, rejected


def mapped(method: Column, path: Column, patterns: list[Pattern]) -> Column:
    """The first pattern that matches, or null. A pattern is at most a few hundred lines, so it is an expression: segment
    counts agree, braces match any one segment, * any method."""
    segments = F.slice(F.split(path, "/"), 2, MOST_DEPTH)
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        ok = F.size(segments) == len(p.segments)
        for i, s in enumerate(p.segments):
            if not (s.startswith("{") and s.endswith("}")):
                ok = ok & (F.get(segments, F.lit(i)) == s)
        if p.method != "*":
            ok = ok & (method == p.method)
        out = F.when(ok, p.text).otherwise(out)
    return out


def route(method: Column, target: Column, patterns: list[Pattern] = (), keys: list[str] = (), depth: int = DEPTH) -> Column:
    """The route label of a request."""
    path = path_of(target)
    base = template_path(path, depth)
    if patterns:
        base = F.coalesce(mapped(method, path, list(patterns)), base)
    return clip_label(F.concat(base, promoted(target, list(keys))), TEXT_BYTES)


def map_table(patterns: list[Pattern], df: DataFrame) -> DataFrame:
    """The map as rows, first line first."""
    rows = [(i, p.method, p.text) for i, p in enumerate(patterns)]
    return df.sparkSession.createDataFrame(rows, "ord int, method string, pattern string")
